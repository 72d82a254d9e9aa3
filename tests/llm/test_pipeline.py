"""The pipeline's stages on the smallest tables, each against a plain version on its own input."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from veilcast.llm import language, mixing, tokens
from tests.llm.test_operators import contamination_oracle, near_oracle


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs, seen = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    seen.append(docs.toPandas())
    for _, stage in pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).toPandas())
        seen.append(docs.toPandas())
    return seen


def test_columns(stages):
    for out in stages[:-1]:
        assert list(out.columns) == pipeline.COLUMNS
    assert {"shard", "slot"} <= set(stages[-1].columns)


def test_language_keeps_clean_documents(stages):
    assert len(stages[1]) >= 0.99 * len(stages[0])


def test_language_rejects_foreign_texts_and_junk(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    english = docs.filter("lang = 'en' AND n_chars > 500").orderBy("doc_id").first()
    planted = {
        "russian": "Все люди рождаются свободными и равными в своем достоинстве и правах.",
        "japanese": "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。",
        "polish": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw",
        "consonants": "xkcd qwrtp zxcvb mnbvc lkjhg fdsrt wqpzx kjhgf dsxcv bnmlk",
        "keys": "asdf " * 40,
    }
    rows = [(-2 - 2 * k - j, t, lang, "s", len(t)) for k, t in enumerate(planted.values()) for j, lang in enumerate((None, "en"))]
    rows += [(-100, english.text, None, "s", 9), (-101, english.text, "fr", "s", 9), (-102, "123 !!!", "en", "s", 9), (-103, None, "en", "s", 9)]
    more = docs.select(*pipeline.COLUMNS).unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select(*[F.col(c).cast(docs.schema[c].dataType) for c in pipeline.COLUMNS]))
    out = pipeline.known_language(spark, more, sf_dir)
    assert {r.doc_id: r.lang for r in out.filter("doc_id < 0").collect()} == {-100: "en", -101: "en"}
    assert out.filter("doc_id >= 0").count() >= 0.99 * docs.count()


def test_language_learns_and_measures_on_all_labelled_rows(spark, sf_dir, monkeypatch):
    """Beyond op7's bound too: the model is that of all labelled rows to learn from, and all held-out ones set the cut."""
    words = "stone river paper meadow harbor".split()
    rows = [(k, f"{words[k % 5]} {words[k // 5 % 5]}", "en" if k % 11 else None, "s", 9) for k in range(66_000)]
    docs = spark.createDataFrame(pd.DataFrame(rows, columns=pipeline.COLUMNS)).repartition(8)
    seen, fit, fits = {}, pipeline.fit, pipeline.fits
    monkeypatch.setattr(pipeline, "fit", lambda *a, **k: seen.setdefault("model", fit(*a, **k)))
    monkeypatch.setattr(pipeline, "fits", lambda known: (seen.setdefault("known", known.count()), fits(known))[1])
    assert pipeline.known_language(spark, docs, sf_dir).count() == len(rows)
    held = [zlib.crc32(str(k).encode()) % 3 == 1 for k, *_ in rows]
    assert seen["known"] == sum(h for h, r in zip(held, rows) if r[2]) > language.SAMPLE_DOCS
    encode = sentencepiece.SentencePieceProcessor(model_file=tokens.tokenizer_path(language.VOCABULARY)).encode
    ids = {w: encode(w) for w in words}
    counts = Counter(i for h, r in zip(held, rows) if r[2] and not h for w in r[1].split() for i in ids[w])
    langs, table = seen["model"]
    top = max(counts, key=counts.get)
    assert langs == ["en"] and all(table[i, 0] / table[top, 0] == pytest.approx((m + language.SMOOTHING) / (counts[top] + language.SMOOTHING)) for i, m in counts.items())


def test_quantiles_of_all_rows(spark):
    rng = np.random.default_rng(4)
    group = rng.integers(0, 3, 9000)
    x = np.where(group == 0, np.round(rng.standard_normal(9000), 1), np.where(group == 1, rng.standard_normal(9000) * 1e6, 7.0))
    df = spark.createDataFrame(pd.DataFrame({"g": group.astype(np.int32), "x": x})).repartition(5)
    shares = [0.0, 0.001, 0.05, 0.5, 0.77, 1.0]
    got = language.quantiles(df, shares)
    assert all(got[g] == pytest.approx(np.quantile(x[group == g], shares).tolist()) for g in range(3))
    assert language.quantiles(df.limit(0), shares) == {}


def test_one_of_each_group(stages):
    rows = list(zip(stages[1]["doc_id"], stages[1]["text"]))
    want = {i for i, (_, c) in near_oracle(rows, 5, 80).items() if i == c}
    assert set(stages[2]["doc_id"]) == want


def test_decontaminated(stages, spark, sf_dir):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = {i for i, _, hit, _ in contamination_oracle(list(zip(stages[2]["doc_id"], stages[2]["text"])), items) if not hit}
    assert set(stages[3]["doc_id"]) == want


def test_mixture_by_tokens(stages):
    """The kept documents are those of a plain fit on the library's token counts."""
    docs = stages[3].copy()
    library = Tokenizer.from_file(tokens.tokenizer_path(tokens.VOCABULARY))
    docs["n"] = [len(library.encode(t or "", add_special_tokens=False).ids) for t in docs["text"]]
    marks = (("table", (" | ",)), ("notice", ("!!",)), ("markup", ("###", "***", "$$$")))
    docs["topic"] = [next((name for name, own in marks if any(m in (t or "") for m in own)), "prose") for t in docs["text"]]
    cells = docs.assign(source=docs["source"].fillna("(null)"), lang=docs["lang"].fillna("(null)")).groupby(["source", "lang", "topic"], as_index=False)["n"].sum()
    fitted, total = cells["n"].astype(float), float(cells["n"].sum())
    goals = {}
    for d, power in mixing.TEMPER.items():
        share = (cells.groupby(d)["n"].sum() / total) ** power
        goals[d] = total * share / share.sum()
    for _ in range(mixing.ITERATIONS):
        for d in mixing.TEMPER:
            fitted = fitted * cells[d].map(goals[d] / fitted.groupby(cells[d]).sum())
    ratio = fitted / cells["n"]
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if ((mid * ratio).clip(upper=1) * cells["n"]).sum() < mixing.BUDGET * total else (low, mid)
    chance = {(r.source, r.lang, r.topic): min(1.0, high * x) for r, x in zip(cells.itertuples(), ratio)}
    draw = lambda i: int(hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[:8], 16) / 2**32
    want = {r.doc_id for r in docs.itertuples() if draw(r.doc_id) < chance[(r.source or "(null)", r.lang or "(null)", r.topic)]}
    assert set(stages[4]["doc_id"]) == want


def test_empty_tables(spark, sf_dir, tmp_path):
    """Every stage of empty documents is empty, and no benchmark contaminates nothing."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    bench.limit(0).write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    assert pipeline.without_benchmarks(spark, docs, str(tmp_path)).count() == docs.count()


def test_odd_rows(spark, sf_dir):
    """Null and repeated ids, null columns and repeats go through every stage; each is judged by its own text."""
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").filter("length(text) > 200").first().text
    base = "the river and the stone light of a winter garden are silent paper engines of copper signal and meadow"
    rows = [(None, item, None, None, None), (None, base, "en", "s", 1), (1, base, None, None, 2), (1, item, "en", "s", 3), (1, base, None, None, 2), (2, None, None, None, None), (3, "", "en", "s", 0)]
    kinds = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select(*[F.col(c).cast(kinds[c].dataType) for c in pipeline.COLUMNS])
    clean = sorted((r.doc_id or 0, r.text or "") for r in pipeline.without_benchmarks(spark, docs, sf_dir).collect())
    assert clean == [(0, base), (1, base), (1, base), (2, ""), (3, "")]
    assert pipeline.one_of_each_group(spark, docs, sf_dir).count() == 7
    assert {r.text for r in pipeline.raked_sample(spark, docs, sf_dir).collect()} <= {base, item, None, ""}
    assert pipeline.shards(spark, docs, sf_dir).count() == 7
    assert pipeline.known_language(spark, docs, sf_dir).filter("text IS NULL OR text = ''").count() == 0


def test_mixture_and_shards(stages):
    assert 0 < len(stages[4]) < len(stages[3]) and set(stages[4]["doc_id"]) <= set(stages[3]["doc_id"])
    assert sorted(stages[5]["doc_id"]) == sorted(stages[4]["doc_id"])
    sizes = stages[5].groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1
