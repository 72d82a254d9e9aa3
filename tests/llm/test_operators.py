"""Each operator against a plain version on small rows: nulls, empty and long texts, ties, repeats, empty tables, further columns."""

import hashlib
import math
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veilcast.llm import components, language, mixing, near_text, postings, records, sentences, sharding, suffixes, tokens, vectors
from veilcast.llm.common import shared_dir

WORDS = "the of river stone light winter garden paper silent engine copper signal meadow harbor lantern orbit".split()


def prose(seed, n):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        w = WORDS[rng.integers(len(WORDS))] + ("" if rng.random() < 0.6 else str(rng.integers(50)))
        out.append(w + (". " if k % 9 == 8 else " "))
    return "".join(out).strip() + "."


PASSAGE = prose(999, 60)


@pytest.fixture(scope="module")
def texts():
    base = [prose(k, 40 + 17 * k % 90) for k in range(30)]
    near = [" ".join([*base[3].split()[:-2], "changed", f"end{k}"]) for k in range(6)]
    odd = [None, "", " ", "x", "ab\n\n\tcd  ef", "naïve 漢字 🙂 text　wide", "<|endoftext|> inside", "UPPER and lower", prose(5, 20000), "!!!", "12 34"]
    shared = [base[10] + " " + PASSAGE, PASSAGE + "\n" + base[11], base[12] + "\n" + PASSAGE + " " + base[13]]
    return [*base, *near, *odd, *shared, base[0], base[0], base[1] + " "]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k, t, "en" if k % 3 else None, f"s{k % 4}" if k % 5 else None, 1, 2, "z") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, id long, component long, n string").repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


def with_odd_ids(spark, docs):
    more = spark.createDataFrame([(None, PASSAGE, None, None, 1, 2, "z"), (3, prose(3, 91), "en", "s1", 1, 2, "z"), (3, prose(3, 91), "en", "s1", 1, 2, "z")], docs.schema)
    return docs.unionByName(more)


# 1


def test_matrix_row_sums_to_partitions_and_shards():
    sizes, shards = [7, 0, 12, 5, 30], [14, 14, 13, 13]
    rows = [sharding.matrix_row(sizes, shards, 3, p) for p in range(5)]
    assert [sum(r) for r in rows] == sizes and np.sum(rows, axis=0).tolist() == shards


def test_matrix_law_is_that_of_a_permutation():
    got = np.array([sharding.matrix_row([10, 20], [15, 15], s, 0)[0] for s in range(3000)])
    assert abs(got.mean() - 5) < 0.1 and abs(got.var() - 10 * 0.25 * 20 / 29) < 0.15
    big = [sharding.hypergeometric(np.random.default_rng(s), 700_000_000, 700_000_000, 10**6) for s in range(50)]
    assert abs(np.mean(big) - 500_000) < 400


def test_shards_are_even_and_gapless(spark, docs, empty):
    odd = with_odd_ids(spark, docs).withColumn("shard", F.lit("old"))
    got = sharding.shuffle_into_shards(odd, 7).toPandas()
    sizes = got.groupby("shard").size()
    assert len(got) == odd.count() and sizes.max() - sizes.min() <= 1
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in got.groupby("shard"))
    assert sharding.shuffle_into_shards(empty, 7).count() == 0
    assert "__vc_at" not in got.columns and {"id", "n"} <= set(got.columns)


# 2


def sentence_oracle(rows, run=3):
    import regex

    find, seen, out = regex.compile(sentences.SENTENCE).findall, {}, {}
    for i, t in sorted(rows):
        own = [s.strip(sentences.BLANKS) for s in find(t or "")]
        for k in range(len(own) - run + 1):
            seen.setdefault("\n".join(own[k : k + run]), (i, k))
    for i, t in rows:
        raw = find(t or "")
        own = [s.strip(sentences.BLANKS) for s in raw]
        gone = {k + j for k in range(len(own) - run + 1) if seen["\n".join(own[k : k + run])] != (i, k) for j in range(run)}
        out[i] = (len(raw), len(gone), "".join(s for k, s in enumerate(raw) if k not in gone))
    return out


def test_sentence_spans(spark, docs, texts, empty):
    got = {r.doc_id: (r.n_sentences, r.n_removed, r.text) for r in sentences.drop_repeated_spans(docs).collect()}
    want = sentence_oracle(list(enumerate(texts)))
    for i, t in enumerate(texts):
        assert got[i] == (want[i][0], want[i][1], t if t is None else want[i][2]), i
    assert got[len(texts) - 6][1] > 0 or got[len(texts) - 5][1] > 0
    assert sentences.drop_repeated_spans(empty).count() == 0
    assert sentences.drop_repeated_spans(with_odd_ids(spark, docs)).count() == docs.count() + 3


def test_sentence_marks_of_other_scripts(spark):
    """Runs are found and cut in texts without Latin marks or blanks, by the operator and by SQL alike."""
    run = ["春はあけぼの。やうやう白くなりゆく。山ぎは少し明かりて！", "यह पहला वाक्य है। यह दूसरा है। यह तीसरा है।", "یہ پہلا جملہ ہے۔ یہ دوسرا ہے۔ یہ تیسرا ہے۔"]
    rows = [(2 * k + j, f"{'前' * (k + j + 1)}。{r}末{k}{j}") for k, r in enumerate(run) for j in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_sentences, r.n_removed, r.text) for r in sentences.drop_repeated_spans(df).collect()}
    assert got == sentence_oracle(rows) and [got[i][1] for i in range(6)] == [0, 3, 0, 3, 0, 3]
    duck = duckdb.connect()
    duck.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    assert {r[0]: (r[1], r[2]) for r in duck.execute(sentences.ORACLE_SQL).fetchall()} == {i: v[:2] for i, v in got.items()}


#: The query's SQL with runs of $1 words; it isn't the query's, whose runs are of three sentences.
RUNS_BY_WORDS_SQL = rf"""
WITH s AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^{sentences.MARKS}]+[{sentences.MARKS}]*[ \t\r\n\f]*|[{sentences.MARKS}]+[ \t\r\n\f]*') AS ss FROM documents
), x AS (
  SELECT doc_id, k, len(regexp_extract_all(ss[k], '{sentences.WORD}')) AS n FROM s, unnest(range(1, CAST(len(ss) + 1 AS BIGINT))) AS t(k)
), c AS (SELECT *, CAST(sum(n) OVER (PARTITION BY doc_id ORDER BY k) AS BIGINT) AS upto FROM x),
e AS (SELECT doc_id, upto, min(k) AS k FROM c WHERE n > 0 GROUP BY doc_id, upto),
r AS (
  SELECT c.doc_id, c.k, e.k AS last, array_to_string([trim(y, e' \t\r\n\f') FOR y IN ss[c.k : e.k]], e'\n') AS h
  FROM c ASOF JOIN e ON c.doc_id = e.doc_id AND c.upto - c.n + $1 <= e.upto JOIN s ON s.doc_id = c.doc_id
), f AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, k) AS rn FROM r),
g AS (SELECT DISTINCT doc_id, unnest(range(k, last + 1)) AS k FROM f WHERE rn > 1),
gs AS (SELECT doc_id, list(k) AS gone FROM g GROUP BY doc_id)
SELECT doc_id, CAST(len(ss) AS BIGINT) AS n_sentences, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  array_to_string([ss[k] FOR k IN range(1, CAST(len(ss) + 1 AS BIGINT)) IF NOT list_contains(coalesce(gone, []), k)], '') AS kept
FROM s LEFT JOIN gs USING (doc_id)
"""


def test_runs_by_words(spark, texts):
    """Long passages of one and two sentences go, three short sentences stay; with runs of three it is the reverse."""
    one, short = " ".join(f"word{k}" for k in range(55)) + ".", "Oh yes. Not so. Well then."
    two, han = one.replace("word30", "word30."), "".join(chr(0x4E00 + 7 * k) for k in range(60)) + "。"
    rows = [(2 * k + j, f"Begin {k} {j}. {p} End {k} {j}.") for k, p in enumerate([one, two.replace("word", "next"), han, short]) for j in range(2)]
    rows += [(100 + i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    by = {w: {r.doc_id: (r.n_sentences, r.n_removed, r.text or "") for r in sentences.drop_repeated_spans(df, words=w).collect()} for w in (None, 20)}
    assert [by[20][i][1] for i in range(8)] == [0, 1, 0, 2, 0, 1, 0, 0] and [by[None][i][1] for i in range(8)] == [0] * 7 + [3]
    duck = duckdb.connect()
    duck.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    assert {r[0]: r[1:] for r in duck.execute(RUNS_BY_WORDS_SQL, [20]).fetchall()} == by[20]


# 3 and 4


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokens.tokenizer_path(tokens.VOCABULARY))


def test_token_counts(spark, docs, texts, empty, library):
    got = {r.doc_id: r.n_tokens for r in tokens.token_counts(docs, frequent=50).collect()}
    assert got == {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    assert tokens.token_counts(empty).count() == 0
    assert tokens.token_counts(with_odd_ids(spark, docs), frequent=5).count() == docs.count() + 3


def test_units_cut_where_tokens_do(library):
    rng = np.random.default_rng(4)
    parts = ["a", "b1", " ", "  ", "\n", "\t", "'s", "'", ".", "é", "\xa0", "　", "\r\n", "🙂", "漢", "\x1c", "\x85", "<|endoftext|>", "The"]
    fuzz = ["".join(parts[k] for k in rng.integers(len(parts), size=rng.integers(25))) for _ in range(4000)]
    encoder = tokens.UnitEncoder(tokens.tokenizer_path(tokens.VOCABULARY), len, cache_units=500)
    got = [sum(v) for k in range(0, len(fuzz), 100) for v in encoder.batch(fuzz[k : k + 100])]
    assert got == [len(e.ids) for e in library.encode_batch(fuzz, add_special_tokens=False)]


def test_crc32c_vectors():
    assert records.crc32c([b"123456789", b"\0" * 32, b"\xff" * 32]).tolist() == [0xE3069283, 0x8A9136AA, 0x62A8AB43]


def test_records_round_trip(spark, docs, texts, empty, library):
    out = shared_dir(spark)
    index = records.write_records(docs, out)
    read = sorted(records.read_records(spark, out, index).collect(), key=lambda r: (r.part, r.ordinal))
    assert [r.id for r in read] == list(range(len(texts)))
    for r, t in zip(read, texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, records.END_ID]
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    rows = index.orderBy(F.rand(1)).limit(5).collect()
    for (i, ids), row in zip(records.read_at(out, [(r.file, r.offset, r.length) for r in rows]), rows):
        assert i == row.id and len(ids) == row.n_tokens
    out = shared_dir(spark)
    assert records.read_records(spark, out, records.write_records(empty, out)).count() == 0


def test_records_of_odd_ids_in_many_chunks(spark, docs, library):
    """Null and repeated ids are all written and read back, in order, whatever the stretches read at a time."""
    odd, out = with_odd_ids(spark, docs), shared_dir(spark)
    index = records.write_records(odd, out)
    whole, cut = (sorted(records.read_records(spark, out, index, n).collect()) for n in (1 << 30, 500))
    assert whole == cut and len(cut) == odd.count()
    assert [r.id for r in cut] == sorted((r.doc_id for r in odd.collect()), key=lambda i: (i is not None, i or 0))
    first = {}
    for r in cut:
        assert r.first == first.get(r.part, 0)
        first[r.part] = r.first + r.n_tokens
    want = sorted(zlib.crc32(np.array([*library.encode(r.text or "", add_special_tokens=False).ids, records.END_ID], "<u4").tobytes()) for r in odd.collect())
    assert sorted(r.ids_crc32 for r in cut) == want
    assert records.read_records(spark, out, index, 500).rdd.getNumPartitions() > 10


def test_token_queries_against_the_library(spark, tmp_path, library):
    """op1's, op3's and op4's columns on a small table."""
    rows = [(3, "one two  three"), (1, None), (2, "naïve 漢字 " * 300), (9, ""), (5, "x" * 5000), (7, "one two  three"), (8, "a b")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    ids = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in rows}
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.op3_token_counts(spark, str(tmp_path)).collect()}
    assert got == {i: (len((t or "").encode()), len(ids[i]), len(ids[i]) > 512) for i, t in rows}
    at, want = 0, {}
    for i in sorted(ids):
        own = [*ids[i], 2]
        want[i] = (at, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        at += len(own)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in records.op4_token_records(spark, str(tmp_path)).collect()} == want
    shards = sharding.op1_hypergeometric_shards(spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.size, r.text_crc32, r.law, r.grown_shard) for r in shards} == {i: (len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), "rows", None) for i, t in rows}
    assert sorted((r.shard, r.slot) for r in shards) == [(s, 0) for s in range(7)]


def test_long_units_are_not_kept(library):
    """Texts without spaces leave a worker's caches as they were."""
    encoder = tokens.UnitEncoder(tokens.tokenizer_path(tokens.VOCABULARY), len)
    assert encoder.twin is not None
    rng = np.random.default_rng(3)
    blocks = ["".join(map(chr, rng.integers(0x4E00, 0x9000, 20_000))) for _ in range(20)] + ["".join(map(chr, rng.integers(97, 123, 20_000))) for _ in range(20)] + ["a " + "b" * 70 + " c"]
    got = [sum(v) for v in encoder.batch(blocks)]
    assert got == [len(e.ids) for e in library.encode_batch(blocks, add_special_tokens=False)]
    assert sum(len(u) for u in encoder.young) + sum(len(u) for u in encoder.old) < 100


def test_whole_texts_skip_units(library, texts):
    """Texts of long-settled scripts are encoded at once; those with long runs, which would be quadratic, never are."""
    encoder, seen = tokens.UnitEncoder(tokens.tokenizer_path(tokens.VOCABULARY), lambda ids: ids.tolist(), whole_texts=True), []

    class Watched:
        def __init__(self, twin):
            self.encode, self.twin = twin.encode, twin

        def encode_to_numpy(self, text, **k):
            seen.append(text)
            return self.twin.encode_to_numpy(text, **k)

    encoder.wrap_runs, encoder.twin = (lambda ids, a, b: [ids[x:y].tolist() for x, y in zip(a, b)]), Watched(encoder.twin)
    short = ["  two  blanks \n\n\r\n lines\t\tend ", "don't I'LL we've 12345 ½²³ ñandú Жизнь ΑΒΓ ß ŉ", " ", "\n", "x" * 128, "a\n \nb" + " " * 128 + "c", *(t for t in texts if t and t.isascii() and len(t) < 2000 and "<|" not in t)]
    long = ["y" * 129, "Ж" * 65, "!\x01" * 65 + " a", "word " + "z" * 5000 + " word", "a" + " " * 129 + "b", "\n" * 140, "漢字 kana", "a\u00a0b", "<|endoftext|> inside"]
    got = [sum(values, []) for values in encoder.batch([*short, *long])]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in [*short, *long]]
    assert seen[: len(short)] == short and not set(seen) & set(long)


def test_damage_is_found():
    blob = bytearray(b"".join(records.frames([b"a" * 40, b"b" * 40])))
    assert len(records.unframe(bytes(blob))[0]) == 2
    blob[30] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        records.unframe(bytes(blob))


# 5


def near_oracle(rows, words, numerator):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().translate(near_text.LOWER).split()
        sets[i] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    label = {i: i for i in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= numerator * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("words,numerator", [(3, 85), (5, 80)])
def test_near_components(spark, docs, texts, empty, words, numerator):
    got = {r.id: (r.n_shingles, r.component_id) for r in near_text.near_components(docs, words=words, numerator=numerator).collect()}
    assert got == near_oracle(list(enumerate(texts)), words, numerator)


def test_near_components_in_many_blocks(spark, monkeypatch, empty):
    monkeypatch.setattr(near_text, "BLOCK", 7)
    monkeypatch.setattr(near_text, "GROUP", 20)
    rng = np.random.default_rng(6)
    base = prose(77, 120).split()
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(int(rng.integers(0, 7))):
            w[int(rng.integers(len(w)))] = f"w{rng.integers(1000)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: (r.n_shingles, r.component_id) for r in near_text.near_components(df, words=3, numerator=85).collect()}
    assert got == near_oracle(rows, 3, 85)
    monkeypatch.setattr(near_text, "GROUP", 1)  # the bound on whole groups changes no answer
    assert got == {r.id: (r.n_shingles, r.component_id) for r in near_text.near_components(df, words=3, numerator=85).collect()}
    assert near_text.near_components(empty).count() == 0


def test_near_components_of_shared_ids(spark):
    """Rows of one id are one node with the links of all its texts; null ids and texts without words stand alone."""
    a, b = prose(301, 80), prose(302, 80)
    near = lambda t, k: " ".join([*t.split()[:-1], f"end{k}"])
    rows = [(5, a), (5, b), (7, near(a, 1)), (9, near(b, 2)), (5, a), (11, prose(303, 80)), (None, a), (None, near(b, 3)), (5, None), (12, ""), (12, " "), (13, prose(303, 80)), (3, near(b, 4)), (14, a.upper())]
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, id long, node long, th long").repartition(4)
    got = sorted((r.id, r.component_id, r.kept) for r in near_text.near_components(df, words=3, numerator=85).filter("id IS NOT NULL AND n_shingles > 0").collect())
    assert got == [(3, 3, True), (5, 3, False), (5, 3, False), (5, 3, False), (7, 3, False), (9, 3, False), (11, 11, True), (13, 11, False), (14, 3, False)]
    rest = sorted((r.n_shingles > 0, r.id or 0, r.component_id or 0, r.kept) for r in near_text.near_components(df, words=3, numerator=85).filter("id IS NULL OR n_shingles = 0").collect())
    assert rest == [(False, 5, 5, True), (False, 12, 12, True), (False, 12, 12, True), (True, 0, 0, False), (True, 0, 0, False)]


def test_sketch_estimates(spark):
    common = np.arange(1, 2001, dtype=np.uint64)
    sets = [near_text.mix64(common), near_text.mix64(np.arange(150, 2151, dtype=np.uint64)), near_text.mix64(np.arange(5000, 7000, dtype=np.uint64))]
    x = near_text.odd_sketches(near_text.samples_of(sets))
    d = near_text.counts_between(x, x)
    assert d[0, 0] == 0 and d[0, 1] <= near_text.count_limit(0.85) < d[0, 2]


def test_common_counts_agree():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 300, 80).astype(np.uint64)) for _ in range(20)]
    got = near_text.common_counts(sets)
    assert all(got[a, b] == len(np.intersect1d(sets[a], sets[b])) for a in range(20) for b in range(20) if a != b)


def test_components(spark):
    rng = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(k, k + 1) for k in range(1000, 1060)] + [(None, 4), (5, 5)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(links, "a long, b long").repartition(6)).collect()}
    label = {}
    for a, b in links:
        if a is not None and a != b:
            label.setdefault(a, a)
            label.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if a in label and b in label and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    assert got == {i: c for i, c in label.items() if i != c}


# 6


def contamination_oracle(rows, items, size=10):
    windows = {}
    for item, t in items:
        w = postings.words_of((t or "").encode())
        for a, n in postings.item_windows(w, size):
            windows.setdefault(tuple(w[a : a + n]), set()).add(None if item is None else str(item))
    out = []
    for i, t in rows:
        w = postings.words_of((t or "").encode())
        hit, found = set(), set()
        for win, names in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    found |= names
        out.append((i, len(w), len(hit), sorted(found, key=lambda x: (x is None, x or ""))))
    return out


@pytest.mark.parametrize("block_bytes,most_terms,segment", [(1 << 20, 1 << 20, 1 << 20), (200, 1 << 20, 300), (1, 2, 1 << 20)])
def test_contamination(spark, docs, texts, empty, monkeypatch, block_bytes, most_terms, segment):
    """Any number of blocks, stored terms and segments gives the same rows, with shared and null ids and items without one."""
    monkeypatch.setattr(postings, "SEGMENT_WORDS", segment)
    monkeypatch.setattr(postings, "CANDIDATES", 5)
    items = [(1, " ".join(PASSAGE.split()[5:40])), (2, "UPPER and"), (30, None), (4, ""), (5, texts[2][:200]), (5, "x"), (6, "never occurs here at all"), (None, texts[4][:150]), (None, "lower"), (7, "a a a a a a a a a a a")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    short = [t if t is None or len(t) < 5000 else t[:5000] for t in texts]
    every = [*enumerate(short), (3, PASSAGE), (3, None), (None, PASSAGE), (None, texts[2]), (None, "clean"), (3, "a " * 30)]
    rows = spark.createDataFrame([(i, t, 1, 2, "z") for i, t in every], "doc_id long, text string, id long, part long, items string").repartition(3)
    got = postings.decontaminate(rows, bench, block_bytes=block_bytes, most_terms=most_terms).withColumn("hit", postings.covered()).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:]))
    assert sorted([(r.id, r.n_words, r.hit, list(r["items"])) for r in got], key=key) == sorted(contamination_oracle(every, items), key=key)
    assert postings.decontaminate(empty, bench, block_bytes=block_bytes).count() == 0
    assert postings.decontaminate(rows, bench.limit(0)).withColumn("hit", postings.covered()).filter("hit > 0").count() == 0


def test_proximity(spark):
    rows = spark.createDataFrame([(1, "alpha x beta gamma"), (2, "gamma alpha beta"), (3, "alpha x x x x beta gamma"), (4, "alpha beta")], "doc_id long, text string")
    bench = spark.createDataFrame([(9, "alpha beta gamma")], "item_id long, text string")
    hits = lambda slop: sorted(r.id for r in postings.decontaminate(rows, bench, slop=slop).filter("size(spans) > 0").collect())
    assert hits(None) == [] and hits(0) == [2] and hits(1) == [1, 2] and hits(4) == [1, 2, 3]


# 7


def test_forward_sums_all_segmentations():
    pieces = ["", language.START, language.START + "a", "a", "b", "ab", "ba", language.START + "ab"]
    table = np.array([[0, 0], [0.1, 0.2], [0.2, 0.1], [0.1, 0.1], [0.2, 0.2], [0.2, 0.1], [0.1, 0.2], [0.1, 0.1]])
    scorer = language.Scorer(pieces, table)

    def brute(s):
        if not s:
            return np.ones(2)
        total = language.UNKNOWN * brute(s[1:])
        for p, row in zip(pieces, table):
            if p and s.startswith(p):
                total = total + row * brute(s[len(p) :])
        return total

    for w in ("a", "ab", "abba", "aab", "c", "abcab"):
        assert np.allclose(scorer.forward([language.START + w])[0], np.log(brute(language.START + w))), w


def test_long_runs_are_scored_whole():
    """Scaling changes nothing, and no run is cut."""
    pieces = language.pieces_of(language.tokenizer_path(language.VOCABULARY))
    rng = np.random.default_rng(1)
    table = rng.random((len(pieces), 3)) ** 8
    table[[k for k, p in enumerate(pieces) if not p]] = 0
    scorer = language.Scorer(pieces, table / table.sum(axis=0))
    assert max(scorer.lengths) == max(len(p) for p in pieces if p and language.LETTERS.fullmatch(p.removeprefix(language.START) or "a"))
    words = ["".join(rng.choice(list("etaoinshr"), n)) for n in (40, 40, 55, 64, 70)]

    def exact(word):
        known = {p: k for k, p in enumerate(pieces) if p}
        a = [[Fraction(1)] * 3]
        for i in range(1, len(word) + 1):
            row = [x * Fraction(language.UNKNOWN) for x in a[-1]]
            for length in scorer.lengths:
                if length <= i and (k := known.get(word[i - length : i])) is not None:
                    row = [x + a[i - length][j] * Fraction(scorer.rows[k, j]) for j, x in enumerate(row)]
            a.append(row)
        return [math.log(x.numerator) - math.log(x.denominator) for x in a[-1]]

    got = scorer.forward_scaled([language.START + w for w in words])
    for w, row in zip(words, got):
        assert np.allclose(row, exact(language.START + w), rtol=1e-9), w
    short = [w[:30] for w in words]
    assert np.allclose(scorer.forward_scaled([language.START + w for w in short]), scorer.forward([language.START + w for w in short]), rtol=1e-9)
    texts = [" ".join([words[0], "one", words[3]]), words[4], "one two", None, "x" * 5000]
    both = scorer.batch(texts)
    assert np.allclose(both[0, :-1], got[0] + scorer.forward([language.START + "one"])[0] + got[3]) and np.allclose(both[1, :-1], got[4])
    assert both[0, -1] == 107 and both[4, -1] == 5000 and np.isfinite(both).all()
    assert all(len(w) <= language.SHORT for w in scorer.cache)


def test_rare_languages_are_learned_from():
    rates = language.sampling_rates({"en": 10**12, "fr": 50, "sw": 10**6}, 20_000)
    assert rates["fr"] == 1 and abs(rates["sw"] * 10**6 - 500) < 1 and abs(rates["en"] * 10**12 - 20_000) < 1


def test_language_query_columns(spark, tmp_path):
    rows = [(k, f"the river and the stone of winter {k}", "en") for k in range(30)] + [(100 + k, f"la rivière et la pierre de l'hiver {k}", "fr") for k in range(30)] + [(200, None, "en"), (201, "12 34 !!", "fr"), (None, "the stone of winter", None)]
    spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, lang string, score string, held_out int").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in language.op7_language_id(spark, str(tmp_path)).collect()}
    for i, t, lang in rows:
        assert got[i].held_out == (i is None or zlib.crc32(str(i).encode()) % 3 == 1)
        assert got[i].lang_pred == ("und" if i in (200, 201) else lang or "en") and 0 <= got[i].score <= 1


def test_language_held_out_accuracy(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    model = language.fit(rows.filter(~language.held_out("doc_id")))
    got = language.predict(rows.filter(language.held_out("doc_id")), model)
    assert got.filter("lang_pred = lang").count() >= 0.98 * got.count()
    assert got.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0


def test_language_of_odd_texts(spark, docs, texts, empty):
    model = language.fit(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(docs, model).collect()}
    assert all(got[i] == ("und", 0.0) for i, t in enumerate(texts) if t in (None, "", " ", "!!!", "12 34")) and got[0][0] == "en"
    assert language.predict(empty, language.fit(empty)).count() == 0
    assert {r.lang_pred for r in language.predict(docs, language.fit(empty)).collect()} == {"und"}


# 8


def vector_oracle(rows, threshold=0.95):
    ok = {i: np.array(v, float) for i, v in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = [i for i, _ in rows]
    links = {i: set() for i in ids}
    for a in ok:
        for b in ok:
            if a != b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]) >= threshold:
                links[a].add(b)
    label = {i: i for i in ids}
    for _ in ids:
        for a in ids:
            for b in links[a]:
                label[a] = label[b] = min(label[a], label[b])
    return {i: (len(links[i]), label[i]) for i in ids}


@pytest.mark.parametrize("block", [2048, 9])
def test_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rng = np.random.default_rng(5)
    rows = []
    for k in range(40):
        center = rng.standard_normal(32)
        for _ in range(int(rng.integers(1, 8))):
            rows.append(center + rng.standard_normal(32) * rng.choice([0.05, 0.15, 0.3]))
    rows += [rows[0], rows[0], 3 * rows[1], np.zeros(32)]
    rows = [[float(x) for x in np.float32(r)] for r in rows] + [None, [], [1.0, float("nan")] * 16, [1.0, None] * 16, [1.0, 2.0], [2.0, 4.0]]
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = {r.id: (r.n_links, r.component_id) for r in vectors.near_vectors(df).collect()}
    want = vector_oracle(rows)
    total = sum(n for n, _ in want.values())
    assert sum(n for n, _ in got.values()) >= 0.995 * total and all(got[i][0] <= want[i][0] for i in want)
    assert sum(got[i] != want[i] for i in want) <= 2
    assert vectors.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("exact", [1 << 19, 0])
def test_links_of_unbalanced_vectors(spark, monkeypatch, exact):
    monkeypatch.setattr(vectors, "EXACT", exact, raising=False)
    rng = np.random.default_rng(9)
    base = rng.standard_normal((1500, 64))
    odd = rng.standard_normal((450, 64))
    odd[:150, 32:] *= 0.05  # nearly all in one half
    odd[150:300] *= np.array([rng.permutation(np.arange(64) < 3) for _ in range(150)])
    odd[300:, 40] += 40  # one dominant dimension, here alike in all of these
    x = np.concatenate([base, odd])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal(x.shape) * np.where(np.abs(x) > 1e-9, 1, 0)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = 0.955 * x + np.sqrt(1 - 0.955**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    every = np.concatenate([x, y])
    near = every @ every.T >= 0.95
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(every)], "vec_id long, embedding array<double>").repartition(4)
    got = {r.id: r.n_links for r in vectors.near_vectors(df).collect()}
    assert [got[k] for k in range(len(every))] == near.sum(axis=1).tolist()


def test_no_size_or_setting_decides_links(spark, monkeypatch):
    """Beyond any size all pairs are compared, in blocks that meet once each, some beside a task's own at a time."""
    for name, value in {"EXACT": 0, "TABLES": 1, "MISS": 0.9, "LOAD": 0.05, "BLOCK": 5, "BLOCKS": 4, "BLOCK_BYTES": 16 * 4 * 60, "SPAN": 2, "TASK_ROWS": 100}.items():
        monkeypatch.setattr(vectors, name, value, raising=False)
    rng = np.random.default_rng(3)
    for n in (700, 731):  # even and odd numbers of blocks
        base = rng.standard_normal((n // 2, 16))
        every = np.float32(np.concatenate([base, base + 0.3 * rng.standard_normal(base.shape), base[:1]]))
        rows = [(7 * k, [float(x) for x in v]) for k, v in enumerate(every)]
        got = {r.id: (r.n_links, r.component_id) for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
        assert got == vector_oracle(rows) and sum(k for k, _ in got.values()) > n // 3


def test_vectors_of_many_lengths(spark):
    rows = [(2 * n + k, [float(n)] * (n - 1) + [float(k)]) for n in range(2, 90) for k in (1, 2)]
    got = {r.id: (r.n_links, r.component_id) for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == vector_oracle(rows)


# 9


def byte_oracle(docs: list[tuple[int, bytes]], length: int = suffixes.LENGTH) -> list[tuple[int, int, int, int, bytes]]:
    """By a set of all strings seen."""
    seen, out = set(), []
    for i, raw in sorted(docs):
        gone = np.zeros(len(raw) + 1, np.int8)
        for k in range(len(raw) - length + 1):
            s = raw[k : k + length]
            if s in seen:
                gone[k : k + length] = 1
            seen.add(s)
        out.append((i, len(raw), int(gone.sum()), int((np.diff(gone, prepend=0) == 1).sum()), bytes(b for b, g in zip(raw, gone) if not g)))
    return out


def test_repeated_bytes(spark, docs, texts, empty):
    got = {r.id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.drop_repeated_bytes(docs).collect()}
    want = {i: tuple(rest) for i, *rest in byte_oracle([(k, (t or "").encode()) for k, t in enumerate(texts)])}
    assert got == want and sum(w[1] for w in want.values()) > 1000
    assert suffixes.drop_repeated_bytes(empty).count() == 0


def test_repeated_bytes_within_and_overlapping(spark):
    rng = np.random.default_rng(8)
    block = bytes(rng.integers(97, 123, 400).astype(np.uint8)).decode()
    rows = [(1, "a" * 450), (2, block + block[100:350] + "zz"), (3, "q" + block), (4, "a" * 150), (5, "ab" * 120), (6, block[::-1]), (None, block)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.id: (r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.drop_repeated_bytes(df, length=60).collect()}
    want = byte_oracle([(suffixes.LAST if i is None else i, t.encode()) for i, t in rows], 60)
    assert got == {(None if i == suffixes.LAST else i): (g, s, k) for i, _, g, s, k in want}


def test_anchors_in_pieces(spark, docs, texts, monkeypatch):
    """Texts longer than a piece lose nothing: windows over a border are in one piece or the other."""
    monkeypatch.setattr(suffixes, "PIECE", 333)
    long = "".join(texts[k] for k in range(12))
    rows = [(1, long), (2, texts[20] + long[150:1800] + texts[21]), (3, None), (4, long[-700:]), (None, long[300:900])]
    raw = np.frombuffer(long.encode(), np.uint8)
    pos, first, last, _ = suffixes.anchors_of(raw, np.array([len(raw)]), 100)
    assert sorted(x for a, b in zip(first.tolist(), last.tolist()) for x in range(a, b + 1)) == list(range(len(raw) - 99))
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(suffixes)  # workers see the small piece too
    try:
        got = {r.id: (r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.drop_repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()}
    finally:
        cloudpickle.unregister_pickle_by_value(suffixes)
    want = byte_oracle([(suffixes.LAST if i is None else i, (t or "").encode()) for i, t in rows])
    assert got == {(None if i == suffixes.LAST else i): (g, s, k) for i, _, g, s, k in want}


def test_merge_of_runs():
    rng = np.random.default_rng(2)
    length, runs = 12, []
    for _ in range(5):
        own = sorted(bytes(rng.integers(97, 100, length).astype(np.uint8)) for _ in range(int(rng.integers(1, 60))))
        runs.append((own, [0, *suffixes.common_prefixes(np.frombuffer(b"".join(own), np.uint8).reshape(-1, length))[1:].tolist()]))
    run, at, common = suffixes.merge_runs(runs, length)
    out = [runs[r][0][a] for r, a in zip(run, at)]
    assert out == sorted(x for r, _ in runs for x in r)
    assert common[1:] == suffixes.common_prefixes(np.frombuffer(b"".join(out), np.uint8).reshape(-1, length))[1:].tolist()


# 10


def test_raking_meets_its_marginals():
    rng = np.random.default_rng(1)
    cells = np.array([(a, b, c) for a in range(4) for b in range(3) for c in range(2)])
    w = rng.integers(1, 1000, len(cells)).astype(float)
    targets = []
    for d, power in enumerate([0.5, 0.5, 0.7]):
        share = np.bincount(cells[:, d], weights=w) / w.sum()
        goal = mixing.target_shares(dict(enumerate(share)), power, None)
        assert np.allclose(list(goal.values()), share**power / (share**power).sum())
        targets.append(np.array(list(goal.values())) * w.sum())
    fitted = mixing.rake(cells, w, targets, 50)
    assert mixing.residual(cells, fitted, targets) < 1e-9 < mixing.residual(cells, w, targets)
    assert np.allclose(np.bincount(cells[:, 0], weights=fitted), targets[0], rtol=1e-6)
    c = mixing.scale_for_budget(fitted / w, w, 0.6)
    assert abs((np.minimum(1, c * fitted / w) * w).sum() / w.sum() - 0.6) < 1e-9


def test_targets_are_named():
    goal = mixing.target_shares({"a": 0.5, "b": 0.3, "c": 0.2, "d": 0.0}, 1.0, {"a": 0.1, "zz": 0.4})
    assert np.allclose([goal[v] for v in "abcd"], [0.1, 0.54, 0.36, 0])
    assert np.allclose(list(mixing.target_shares({"a": 0.5, "b": 0.5}, 1.0, {"a": 0.2, "b": 0.2}).values()), [0.5, 0.5])
    with pytest.raises(ValueError, match="target weights"):
        mixing.target_shares({"a": 0.5, "b": 0.5}, 1.0, {"a": 1.2})


def test_mixture(spark, docs, empty):
    odd = with_odd_ids(spark, docs).withColumn("topic", F.lit("old"))
    for more in ({}, {"targets": {"source": {"s1": 0.5}}}):
        small, large = (mixing.mix(odd, max_cells=m, iterations=8, **more).toPandas().sort_values(["doc_id", "text"]) for m in (1000, 1))
        assert len(small) == odd.count() and (small["kept"].to_numpy() == large["kept"].to_numpy()).all()
        assert np.allclose(small["ratio"].astype(float), large["ratio"].astype(float), atol=1e-9) and np.allclose(small["probability"].astype(float), large["probability"].astype(float), atol=1e-9)
    assert mixing.mix(empty).count() == 0


def test_mixture_by_tokens_and_named_targets(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counted = tokens.token_counts(rows.withColumn("key", F.struct("doc_id", "source", "lang", "text")), id_col="key").select("key.*", "n_tokens")
    name = rows.filter("source IS NOT NULL").groupBy("source").count().orderBy("count").first()["source"]
    got = mixing.mix(counted, weight_col="n_tokens", targets={"source": {name: 0.4}}, iterations=200, tolerance=1e-3, temper={"lang": 1.0, "topic": 1.0}).toPandas()
    assert (got["n_words"] == got["n_tokens"]).all()
    raked = got["n_words"] * got["ratio"]
    assert abs(raked[got["source"] == name].sum() / raked.sum() - 0.4) < 2e-3
    assert abs((got["n_words"] * got["probability"]).sum() / got["n_words"].sum() - mixing.BUDGET) < 1e-6
    with pytest.raises(ValueError, match="a marginal is off"):
        mixing.mix(counted, weight_col="n_tokens", targets={"source": {name: 0.4}}, iterations=1, tolerance=1e-12)


def test_digests_agree_with_texts(spark, sf_dir):
    out = suffixes.op9_repeated_bytes(spark, sf_dir).filter("n_removed = 0").limit(5).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert all(r.kept_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in out)
