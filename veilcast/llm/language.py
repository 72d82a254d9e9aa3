"""Operator 7, language identification by segmentation-marginalised unigrams.

Each language is a unigram model over the pieces of one fixed public vocabulary. A word's likelihood is
the sum over all its segmentations into pieces, which the forward recursion gives in one pass:
a[0] = 1, a[i] = sum over pieces ending at i of a[i - length] * p(piece). A text's score is the sum of
its words' logarithms. Words that were scored stay in a cache of the Python worker, and new ones are
scored many at a time with array operations: substrings become rolling hashes, looked up at once. Runs of any
length are scored whole, over all segmentations; in long ones the recursion is scaled as it goes.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, prepare, require, stage_table, worker_state
from .tokens import tokenizer_path

VOCABULARY = "piece_bpe_32k.model"
SAMPLE_DOCS = 20_000  # bound on the labelled rows that are learned from, about
FIT_WORDS = 200_000  # different words that a task holds while it learns
BINS = 1024
SMOOTHING = 0.1
UNKNOWN = 1e-7
SHORT = 32  # letters; longer runs are scored with scaling, and not kept
FEWEST_DOCS = 500  # of a language, that are learned from even where it is rare
SEED = 11
LONG_CELLS = 1 << 18  # letters of long runs that are scored together
LOWEST = 6.0  # deviations below the mean that a short text may have by chance
SLACK = 0.3  # of the log-likelihood a letter, at least
RARE = 1000
CACHE_WORDS = 150_000
BITS = 18
START = "▁"
LETTERS = re.compile(r"[^\W\d_]+")
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


def pieces_of(path: str) -> list[str]:
    """The vocabulary's pieces by id; "" for those that no text spells (controls, single bytes)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return ["" if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) else model.id_to_piece(i) for i in range(model.vocab_size())]


def held_out(id_col: str):
    """Whether a row is kept from learning: crc32 of the id as text, mod 3, is 1; also where the id is null."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def fit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_docs: int | None = SAMPLE_DOCS, path: str | None = None) -> tuple[list[str], np.ndarray]:
    """(languages, probabilities[piece, language]) from the labelled rows of df.

    A random part of the rows, about `sample_docs` where there are more but at least about FEWEST_DOCS of each language that
    has them, or with None all rows, are segmented by the vocabulary's own tokenizer; piece counts are summed map-side and then by
    (language, piece), so the driver gets at most languages x vocabulary numbers. Rows are drawn one by one, so a text that
    many rows share counts as often as it should. Rows without text or language are left out."""
    prepare(df.sparkSession)
    path = path or tokenizer_path(VOCABULARY)
    rows = df.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {} if sample_docs is None else {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row a language
    if sum(sizes.values()) > (sample_docs or 0):
        rates = sampling_rates(sizes, sample_docs)
        rate = F.element_at(F.create_map(*[F.lit(x) for pair in rates.items() for x in pair]), F.col("lang"))
        rows = rows.filter(F.rand(SEED) < rate)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        found: dict[str, Counter] = {}
        totals: dict[str, Counter] = {}

        def encode() -> None:
            for lang, words in found.items():
                pieces = totals.setdefault(lang, Counter())
                for ids, m in zip(model.encode(list(words), num_threads=1), words.values()):
                    for i in ids:
                        pieces[i] += m
            found.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found.setdefault(lang, Counter()).update(LETTERS.findall(text.lower()))
            if sum(map(len, found.values())) > FIT_WORDS:
                encode()
        encode()
        for lang, pieces in totals.items():
            yield pa.record_batch([pa.array([lang] * len(pieces)), pa.array(list(pieces), pa.int32()), pa.array(list(pieces.values()), pa.int64())], names=["lang", "piece", "n"])

    counts = rows.mapInArrow(count, "lang string, piece int, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
    names = pieces_of(path)
    langs = sorted(counts["lang"].unique().tolist())
    table = np.full((len(names), len(langs)), SMOOTHING)
    table[counts["piece"].to_numpy(dtype=np.int64), np.searchsorted(langs, counts["lang"].to_numpy(dtype=str))] += counts["n"].to_numpy(dtype=np.float64)
    table[[k for k, p in enumerate(names) if not p]] = 0
    return langs, table / table.sum(axis=0, keepdims=True) if langs else table


def sampling_rates(sizes: dict[str, int], sample_docs: int) -> dict[str, float]:
    """The part of each language's rows to learn from."""
    n = sum(sizes.values())
    return {lang: min(1.0, max(sample_docs / n, FEWEST_DOCS / m)) for lang, m in sizes.items()}


class Scorer:
    """Log-likelihoods of letter runs for all languages, by the forward recursion over all segmentations into pieces of any
    length. Runs of up to SHORT letters are kept."""

    def __init__(self, pieces: list[str], table: np.ndarray, cache_words: int = CACHE_WORDS):
        self.n_langs, self.limit = table.shape[1], cache_words
        own = [(p, k) for k, p in enumerate(pieces) if p and LETTERS.fullmatch(p.removeprefix(START) or "a")]  # what runs can hold
        self.lengths = sorted({len(p) for p, _ in own})
        self.rows = np.concatenate([table, np.zeros((1, self.n_langs))])
        self.none = len(table)
        keys = np.array([self._hash_one(p) for p, _ in own], dtype=np.uint64)
        values = np.array([k for _, k in own], dtype=np.int64)
        self.levels = []
        while len(keys):  # each level takes what no other key of it claims; the rest goes on, by other bits of the hash
            slot = self._slot(mix64(keys), len(self.levels))
            at_key, at_value = np.zeros(1 << BITS, np.uint64), np.full(1 << BITS, self.none, np.int64)
            _, first = np.unique(slot, return_index=True)
            at_key[slot[first]], at_value[slot[first]] = keys[first], values[first]
            self.levels.append((at_key, at_value))
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, values = keys[rest], values[rest]
        self.cache: dict[str, int] = {}
        self.scores = np.zeros((1024, self.n_langs + 1))  # the last column has the letters

    @staticmethod
    def _slot(mixed: np.ndarray, level: int) -> np.ndarray:
        return ((mixed >> np.uint64(64 - BITS - 9 * min(level, 5))) & np.uint64((1 << BITS) - 1)).astype(np.int64)

    @staticmethod
    def _hash_one(s: str) -> int:
        h = 0
        for c in s:
            h = (h * BASE + ord(c) + 1) & MASK
        return h

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Piece numbers of hashes, or `none`."""
        mixed, out = mix64(keys), np.full(keys.shape, self.none, np.int64)
        for k, (at_key, at_value) in enumerate(self.levels):
            slot = self._slot(mixed, k)
            hit = at_key[slot] == keys
            out[hit] = at_value[slot[hit]]
        return out

    def forward(self, words: list[str]) -> np.ndarray:
        """log p for words of one length, at most SHORT + 1 characters with the start mark."""
        n = len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).reshape(len(words), n).astype(np.uint64)
        with np.errstate(over="ignore"):
            prefix = np.zeros((n + 1, len(words)), np.uint64)
            for i in range(n):
                prefix[i + 1] = prefix[i] * np.uint64(BASE) + codes[:, i] + np.uint64(1)
            found = {}
            for length in self.lengths:
                if length <= n:
                    power = np.uint64(pow(BASE, length, 1 << 64))
                    found[length] = self.find(prefix[length:] - prefix[:-length] * power)
        a = np.zeros((n + 1, len(words), self.n_langs))
        a[0] = 1
        for i in range(1, n + 1):
            a[i] = a[i - 1] * UNKNOWN
            for length, pieces in found.items():
                if length <= i:
                    at = pieces[i - length]
                    some = np.flatnonzero(at != self.none)
                    if len(some):
                        a[i][some] += a[i - length][some] * self.rows[at[some]]
        return np.log(a[n])

    def forward_scaled(self, words: list[str]) -> np.ndarray:
        """log p for words of any lengths: as forward, with what is carried on divided by its newest value now and then."""
        sizes = np.array([len(w) for w in words])
        n, w = int(sizes.max()), len(words)
        codes = np.zeros((n, w), np.uint64)
        for k, word in enumerate(words):
            codes[: len(word), k] = np.frombuffer(word.encode("utf-32-le"), np.uint32)
        lengths = [x for x in self.lengths if x <= n]
        found = np.full((len(lengths), n + 1, w), self.none, np.int32)  # by end
        with np.errstate(over="ignore"):
            prefix = np.zeros((n + 1, w), np.uint64)
            for i in range(n):
                prefix[i + 1] = prefix[i] * np.uint64(BASE) + codes[i] + np.uint64(1)
            for k, length in enumerate(lengths):
                found[k, length:] = self.find(prefix[length:] - prefix[:-length] * np.uint64(pow(BASE, length, 1 << 64)))
        back = np.array(lengths) - 1
        held = np.zeros((max(lengths, default=1), w, self.n_langs))  # at 0 the newest
        held[0] = 1
        scale, out = np.zeros((w, self.n_langs)), np.zeros((w, self.n_langs))
        for i in range(1, n + 1):
            new = held[0] * UNKNOWN + (self.rows[found[:, i]] * held[back]).sum(axis=0)
            held[1:] = held[:-1]
            held[0] = new
            done = np.flatnonzero(sizes == i)
            if len(done):
                out[done] = np.log(new[done]) + scale[done]
            if i % 8 == 0:  # a step is no smaller than UNKNOWN, so eight are far from the smallest number
                scale += np.log(new)
                held /= new
        return out

    def long_runs(self, runs: set[str]) -> dict[str, np.ndarray]:
        """Scores of runs beyond SHORT, with their letters, those of like lengths together."""
        out, block, cells = {}, [], 0
        for run in [*sorted(runs, key=len), None]:
            if block and (run is None or len(run) > 2 * len(block[0]) or cells + len(run) > LONG_CELLS):
                for r, row in zip(block, self.forward_scaled([START + r for r in block])):
                    out[r] = np.append(row, len(r))
                block, cells = [], 0
            if run is not None:
                block.append(run)
                cells += len(run)
        return out

    def learn(self, runs: set[str]) -> None:
        if len(self.cache) + len(runs) > self.limit:
            self.cache, self.scores = {}, np.zeros((1024, self.n_langs + 1))
        first, need = len(self.cache), len(self.cache) + len(runs)
        if need > len(self.scores):
            grown = np.zeros((max(need, min(2 * need, self.limit)), self.n_langs + 1))
            grown[:first] = self.scores[:first]
            self.scores = grown
        by_length: dict[int, list[str]] = {}
        for r in runs:
            by_length.setdefault(len(r), []).append(r)
        for n, same in by_length.items():
            for at in range(0, len(same), 4096):
                block = same[at : at + 4096]
                self.scores[first : first + len(block), :-1] = self.forward([START + r for r in block])
                self.scores[first : first + len(block), -1] = n
                self.cache.update(zip(block, range(first, first + len(block))))
                first += len(block)

    def batch(self, texts: list[str | None]) -> np.ndarray:
        """Log-likelihoods of whole texts, as sums over their letter runs, and in the last column their letters."""
        split = [LETTERS.findall(t.lower()) if t else [] for t in texts]
        every = set().union(*split)
        long = {w for w in every if len(w) > SHORT}
        every -= long
        need = {w for w in every if w not in self.cache}
        if need:
            before = self.cache
            self.learn(need)
            if self.cache is not before:
                self.learn(every.difference(need))
        far, get = self.long_runs(long), self.cache.__getitem__
        out = np.zeros((len(texts), self.n_langs + 1))
        for k, runs in enumerate(split):
            if far and (own := [far[w] for w in runs if len(w) > SHORT]):
                out[k] = np.sum(own, axis=0)
                runs = [w for w in runs if len(w) <= SHORT]
            if runs:
                out[k] += self.scores[np.fromiter(map(get, runs), np.int64, len(runs))].sum(axis=0)
        return out


def predict(df: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text", path: str | None = None, details: bool = False) -> DataFrame:
    """df with lang_pred (string) and score (double, the posterior under equal priors); with `details` also letters
    (long) and per_letter (double, the log-likelihood of lang_pred by letters, null without any).

    A text without letters, empty or null, is `und` with score 0, as are all texts if no language was
    learned. Texts are scored whole. Equal scores go to the language that sorts first. Existing columns of these
    names are replaced."""
    prepare(df.sparkSession)
    path = path or tokenizer_path(VOCABULARY)
    langs, table = model
    shared = df.sparkSession.sparkContext.broadcast((langs, table.astype(np.float32)))  # vocabulary x languages numbers
    key = (path, uuid.uuid4().hex)

    def score(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        langs, table = shared.value
        scorer = worker_state(key, lambda: Scorer(pieces_of(path), table.astype(np.float64)))
        for series in texts:
            preds, scores, letters, fits = [], [], [], []
            values = series.tolist()
            for at in range(0, len(values), 512):
                block = values[at : at + 512]
                logs = scorer.batch(block) if langs else np.zeros((len(block), 1))
                for text, row, size in zip(block, logs[:, :-1], logs[:, -1].tolist()):
                    letters.append(int(size))
                    if not langs or not text or not LETTERS.search(text):
                        preds.append("und")
                        scores.append(0.0)
                        fits.append(None)
                        continue
                    best = int(row.argmax())
                    preds.append(langs[best])
                    scores.append(float(1 / np.exp(row - row[best]).sum()))
                    fits.append(float(row[best]) / size)
            yield pd.DataFrame({"lang_pred": preds, "score": scores, "letters": letters, "per_letter": fits})

    guess = F.pandas_udf(score, "lang_pred string, score double, letters long, per_letter double")
    names = ["lang_pred", "score", "letters", "per_letter"] if details else ["lang_pred", "score"]
    return df.drop(*names).withColumn("__vc_g", guess(text_col)).select("*", *(f"__vc_g.{c}" for c in names)).drop("__vc_g")


def quantiles(df: DataFrame, shares: list[float]) -> dict[int, list[float]]:
    """For each group g of all rows (g int, x double) the exact quantiles of x, between two ranks linearly.

    Each pass counts the rows of every interval that still holds a wanted rank in BINS bins, and goes on with the bins where
    the ranks lie, until those hold one value; so at most BINS rows an interval reach the driver, of any number."""
    sizes, found, spans = {}, {}, []
    for r in df.groupBy("g").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect():
        sizes[r["g"]] = r["n"]
        spans.append((r["g"], r["lo"], r["hi"], 0, {turn(s * (r["n"] - 1)) for s in shares for turn in (math.floor, math.ceil)}))
    while spans:
        found.update({(g, k): lo for g, lo, hi, _, ranks in spans if lo == hi for k in ranks})
        spans = [s for s in spans if s[1] < s[2]]
        if not spans:
            break
        ends, bins = [s[:3] for s in spans], BINS

        def count(batches: Iterator[pa.RecordBatch], ends=ends, bins=bins) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                group, value = (c.to_numpy() for c in batch.columns)
                for k, (g, lo, hi) in enumerate(ends):
                    x = np.sort(value[(group == g) & (value >= lo) & (value <= hi)])
                    place, first = np.unique(np.minimum((x - lo) / (hi - lo) * bins, bins - 1).astype(np.int32), return_index=True)
                    last = np.append(first[1:], len(x))
                    yield pa.record_batch([pa.array(np.full(len(place), k, np.int32)), pa.array(place), pa.array(last - first), pa.array(x[first]), pa.array(x[last - 1] if len(x) else x)], names=["span", "bin", "n", "lo", "hi"])

        counted = df.select("g", "x").mapInArrow(count, "span int, bin int, n long, lo double, hi double").groupBy("span", "bin")
        inside = sorted(counted.agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect())
        narrower, below = [], [s[3] for s in spans]
        for k, _, n, lo, hi in inside:
            if own := {r for r in spans[k][4] if below[k] <= r < below[k] + n}:
                narrower.append((spans[k][0], lo, hi, below[k], own))
            below[k] += n
        spans = narrower
    out: dict[int, list[float]] = {g: [] for g in sizes}
    for g, n in sizes.items():
        for s in shares:
            low, high = found[g, math.floor(s * (n - 1))], found[g, math.ceil(s * (n - 1))]
            out[g].append(low + (high - low) * (s * (n - 1) % 1))
    return out


def fits(known: DataFrame):
    """A condition on rows of predict(..., details=True): whether a text is like those of its predicted language.

    `known` has such rows with a label `lang`, best ones the model hasn't learned from; those it agrees with count, all of them. A
    text of n letters fits if its log-likelihood a letter is no more than LOWEST * sqrt(b / n) + c below its language's mean; b is
    the known texts' variance a letter, and c, SLACK or more, lets all but one in RARE of them fit. The posterior can't
    tell: it is near 1 for any text with a few words. Languages without known texts take all languages' mean, and without
    any known text all texts fit."""
    agreed = known.filter("lang = lang_pred AND letters > 0")
    rows, _ = stage_table(agreed.select("lang", F.col("letters").cast("double").alias("n"), F.col("per_letter").alias("x")))
    sums = rows.groupBy("lang").agg(F.sum(F.col("n") * F.col("x")).alias("nx"), F.sum("n").alias("n"), F.count("*").alias("rows")).collect()  # a row a language
    if not sums:
        return F.lit(True)
    means = F.create_map(*[F.lit(v) for r in sums for v in (r["lang"], r["nx"] / r["n"])])
    n, off, one = F.col("n"), F.col("x") - F.element_at(means, F.col("lang")), F.lit(0).alias("g")
    # b from the typical deviations of texts of like lengths, which a few odd texts don't move
    parts = max(1, min(20, sum(r["rows"] for r in sums) // 20))
    bounds = quantiles(rows.select(one, n.alias("x")), [k / parts for k in range(1, parts)])[0]
    part = sum(((n >= x).cast("int") for x in bounds), F.lit(0))
    typical = quantiles(rows.select(part.alias("g"), F.abs(off).alias("x")), [0.5])
    inverse = {r["g"]: r["m"] for r in rows.groupBy(part.alias("g")).agg(F.avg(1 / n).alias("m")).collect()}
    b = float(np.median([(1.4826 * median) ** 2 / inverse[g] for g, (median,) in typical.items()]))
    c = max(SLACK, -quantiles(rows.select(one, (off + LOWEST * F.sqrt(F.lit(b) / n)).alias("x")), [1 / RARE])[0][0])
    every = F.lit(sum(r["nx"] for r in sums) / sum(r["n"] for r in sums))
    mean = F.coalesce(F.element_at(means, F.col("lang_pred")), every)
    return F.coalesce(F.col("per_letter") >= mean - LOWEST * F.sqrt(F.lit(b) / F.col("letters")) - c, F.lit(False))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.filter(~held_out("doc_id")))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
