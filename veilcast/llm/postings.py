"""Operator 6, benchmark decontamination by a distributed positional inverted index.

The index is split by document, as search engines do: each row of the stored table is a segment of whole
documents with, for every test term, the sorted word positions where it occurs. Positions run through
all documents of a segment, so one number names document and place. Terms are 64-bit hashes of words. Only
those of the test set are stored, as no other list can take part in an intersection, as long as they are at
most MOST_TERMS; beyond, all are. Building the index needs no shuffle.

Test items are taken in blocks of BLOCK_BYTES, each against the whole index. A window of an item is a list of
terms with their offsets. In a segment its candidates are the positions of the term that is rarest there, shifted to
the window's start; they are intersected with the shifted lists of the other terms, for all windows at once. A hit names its
segment and the document's place in it, so any number of blocks gives the same rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, require, stage_table

WINDOW = 10
BLOCK_BYTES = 8 << 20
MOST_TERMS = 8 << 20  # different words of the test set that are broadcast, 8 bytes each
SEGMENT_WORDS = 1 << 20
CANDIDATES = 1 << 20  # positions looked at together
U = np.uint64
#: Byte classes of a word: digits, letters (A-Z as a-z) and all of UTF-8 beyond ASCII.
TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SEGMENT_SCHEMA = "part long, segment long, keys binary, has binary, n_words binary, terms binary, ends binary, postings binary"


def words_of(raw: bytes | None) -> list[bytes]:
    return raw.translate(TO_WORDS).split() if raw else []


def item_windows(words: list[bytes], size: int = WINDOW) -> list[tuple[int, int]]:
    """(start, length) of each window; fewer words than `size`, but not none, are one window."""
    return [(k, size) for k in range(len(words) - size + 1)] if len(words) >= size else [(0, len(words))] if words else []


def hashes_of(words: list[bytes], cache: dict[bytes, int] | None = None) -> np.ndarray:
    """64-bit hashes of words; the cache keeps short ones."""
    import xxhash

    cache = {} if cache is None else cache
    digest, get = xxhash.xxh3_64_intdigest, cache.get
    out = np.empty(len(words), U)
    for k, w in enumerate(words):
        h = get(w)
        if h is None:
            h = digest(w)
            if len(w) <= 32:
                if len(cache) >= 200_000:
                    cache.clear()
                cache[w] = h
        out[k] = h
    return out


def test_terms(tests: DataFrame, most: int) -> np.ndarray | None:
    """The sorted hashes of all different words of the test set, or None if they are more than `most`."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                yield pa.record_batch([pa.array(np.unique(hashes_of(words_of(raw))).view(np.int64))], names=["term"])

    found = tests.select("text").mapInArrow(collect, "term long").distinct()
    rows = found.limit(most + 1).toPandas()["term"].to_numpy(np.int64)
    return np.sort(rows.view(U)) if len(rows) <= most else None


def build_index(df: DataFrame, terms: np.ndarray | None, columns: list[str], text_col: str) -> tuple[DataFrame, str]:
    """The stored segments of all documents, and their path. `columns` are numbers that are kept of each document."""
    shared = df.sparkSession.sparkContext.broadcast(terms)  # MOST_TERMS hashes at most

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, cache, m = shared.value, {}, len(columns)
        part, count = TaskContext.get().partitionId(), 0
        keys, n_words, hashes, held = [], [], [], 0

        def segment() -> pa.RecordBatch:
            flat = np.concatenate(hashes) if hashes else np.zeros(0, U)
            at = np.arange(len(flat)) if known is None else np.flatnonzero(among(flat, known))
            own, code, counts = np.unique(flat[at], return_inverse=True, return_counts=True)
            table = np.array([[0 if x is None else x for x in row] for row in keys], np.int64)
            there = np.array([[x is not None for x in row] for row in keys], np.uint8)
            cells = [table, there, np.array(n_words, np.int32), own, np.cumsum(counts).astype(np.int64), at[np.argsort(code, kind="stable")].astype(np.uint32)]
            return pa.record_batch([pa.array([part], pa.int64()), pa.array([count], pa.int64()), *[pa.array([c.tobytes()], pa.binary()) for c in cells]], names=["part", "segment", "keys", "has", "n_words", "terms", "ends", "postings"])

        for batch in batches:
            rows = zip(*[batch.column(k).to_pylist() for k in range(m)])
            for row, raw in zip(rows, batch.column(m).to_pylist()):
                found = hashes_of(words_of(raw), cache)
                keys.append(row)
                n_words.append(len(found))
                hashes.append(found)
                held += len(found)
                if held >= SEGMENT_WORDS:
                    yield segment()
                    keys, n_words, hashes, held, count = [], [], [], 0, count + 1
        if keys:
            yield segment()

    chosen = df.select(*[F.col(c).cast("long").alias(f"k{k}") for k, c in enumerate(columns)], F.col(text_col).cast("binary").alias("text"))
    return stage_table(chosen.mapInArrow(build, SEGMENT_SCHEMA))


def documents_of(index: DataFrame, columns: list[str]) -> DataFrame:
    """(part, segment, place, the kept columns, n_words) of every document of the index."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, segment, keys, has, n_words in zip(*[c.to_pylist() for c in batch.columns]):
                n = np.frombuffer(n_words, np.int32).astype(np.int64)
                m = len(n)
                keys, has = np.frombuffer(keys, np.int64).reshape(m, -1), np.frombuffer(has, np.uint8).reshape(m, -1)
                cols = [pa.array(np.ascontiguousarray(keys[:, k]), pa.int64(), mask=has[:, k] == 0) for k in range(len(columns))]
                yield pa.record_batch([pa.array(np.full(m, part)), pa.array(np.full(m, segment)), pa.array(np.arange(m)), *cols, pa.array(n)], names=["part", "segment", "place", *columns, "n_words"])

    return index.select("part", "segment", "keys", "has", "n_words").mapInArrow(rows, f"part long, segment long, place long, {', '.join(f'`{c}` long' for c in columns)}, n_words long")


def among(x: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    """Which of x are in a sorted array."""
    if not len(sorted_):
        return np.zeros(len(x), bool)
    at = np.searchsorted(sorted_, x)
    at[at == len(sorted_)] = 0
    return sorted_[at] == x


def phrase_matches(windows: np.ndarray, lengths: np.ndarray, slots: np.ndarray, begins: np.ndarray, sizes: np.ndarray, postings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, start) of all occurrences in a segment. windows: the terms of each, as numbers whose list in the
    segment is slots[number], -1 for none; rows are padded. begins and sizes: of the lists in `postings`."""
    real = np.arange(windows.shape[1]) < lengths[:, None]
    lists = np.where(real, slots[windows], 0)
    able = np.flatnonzero((lists >= 0).all(axis=1))
    none = np.zeros(0, np.int64)
    if not len(able):
        return none, none
    lists, real, lengths = lists[able], real[able], lengths[able]
    order = np.argsort(np.where(real, sizes[lists], np.iinfo(np.int64).max), axis=1, kind="stable")  # rarest here first
    n_positions = int(postings.max()) + 1
    term_at = np.full(n_positions, -1, np.int32)  # the same lists, by position
    term_at[postings] = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    first = order[:, 0]
    rare = np.take_along_axis(lists, order[:, :1], 1)[:, 0]
    load, cut, out = sizes[rare], 0, ([none], [none])
    total = np.cumsum(load)
    while cut < len(able):  # whole windows, some CANDIDATES at a time
        stop = max(cut + 1, int(np.searchsorted(total, (total[cut - 1] if cut else 0) + CANDIDATES, side="right")))
        w = np.repeat(np.arange(cut, stop), load[cut:stop])
        within = np.arange(len(w)) - np.repeat(np.cumsum(load[cut:stop]) - load[cut:stop], load[cut:stop])
        starts = postings[begins[rare[w]] + within].astype(np.int64) - first[w]
        ok = (starts >= 0) & (starts + lengths[w] <= n_positions)
        w, starts = w[ok], starts[ok]
        for k in range(1, order.shape[1]):
            if not len(w):
                break
            at = order[w, k]
            ok = (k >= lengths[w]) | (term_at[np.minimum(starts + at, n_positions - 1)] == lists[w, at])
            w, starts = w[ok], starts[ok]
        out[0].append(able[w])
        out[1].append(starts)
        cut = stop
    return np.concatenate(out[0]), np.concatenate(out[1])


def proximity_spans(lists: list[np.ndarray], order: list[int], width: int) -> list[tuple[int, int]]:
    """(first, last) positions of the tightest spans of at most `width` words, one for each occurrence of
    the rarest word that has all words of the phrase, each at a place of its own, in any order."""
    out = []
    for p in lists[order[0]].tolist():
        near = [x[np.searchsorted(x, p - width + 1) : np.searchsorted(x, p + width)].tolist() for x in lists]
        if not all(near):
            continue
        need: dict[tuple, int] = {}
        for x in near:
            need[tuple(x)] = need.get(tuple(x), 0) + 1
        best = None
        for low in sorted({q for x in near for q in x if q <= p}):
            ends = []
            for x, n in need.items():
                inside = [q for q in x if q >= low]
                ends.append(inside[n - 1] if len(inside) >= n else math.inf)
            high = max(*ends, p) if len(ends) > 1 else max(ends[0], p)
            if high - low < width and (best is None or high - low <= best[1] - best[0]):
                best = (low, high)
        if best:
            out.append(best)
    return out


def find_hits(index: DataFrame, items: list[tuple[str | None, list[bytes]]], size: int = WINDOW, slop: int | None = None) -> DataFrame:
    """(part, segment, place, spans array<array<int>>, items array<string>) of the documents that hold a window of
    these items: the merged word ranges that windows cover and the items' ids. With `slop`, a window also matches where its
    words lie within its length plus slop, in any order."""
    own = sorted({w for _, words in items for w in words})
    number = {w: k for k, w in enumerate(own)}
    rows, owner = [], []
    for k, (_, words) in enumerate(items):
        codes = [number[w] for w in words]
        for at, n in item_windows(codes, size):
            rows.append(codes[at : at + n])
            owner.append(k)
    lengths = np.array([len(r) for r in rows], np.int64)
    windows = np.zeros((len(rows), max(size, 1)), np.int32)
    for k, r in enumerate(rows):
        windows[k, : len(r)] = r
    block = (hashes_of(own), windows, lengths, np.array(owner, np.int64), [i for i, _ in items])
    shared = index.sparkSession.sparkContext.broadcast(block)  # of BLOCK_BYTES of items, or one item

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, windows, lengths, owner, names = shared.value
        for batch in batches:
            for part, segment, n_words, terms, ends, postings in zip(*[c.to_pylist() for c in batch.columns]):
                n_words, terms, ends, postings = np.frombuffer(n_words, np.int32), np.frombuffer(terms, U), np.frombuffer(ends, np.int64), np.frombuffer(postings, np.uint32)
                if not len(postings) or not len(windows):
                    continue
                begins = np.concatenate([[0], ends[:-1]])
                slots = np.where(among(hashes, terms), np.searchsorted(terms, hashes), -1)
                w, a = phrase_matches(windows, lengths, slots, begins, ends - begins, postings)
                b = a + lengths[w] - 1
                if slop is not None:
                    near = proximity_matches(windows, lengths, slots, begins, ends, postings, slop)
                    w, a, b = (np.concatenate(x) for x in zip((w, a, b), near))
                bases = np.concatenate([[0], np.cumsum(n_words, dtype=np.int64)])
                d = np.searchsorted(bases, a, side="right") - 1
                inside = b < bases[d + 1]  # a window never crosses documents
                spans: dict[int, list] = {}
                hit: dict[int, set] = {}
                for doc, x, y, k in zip(d[inside].tolist(), (a - bases[d])[inside].tolist(), (b - bases[d])[inside].tolist(), owner[w][inside].tolist()):
                    spans.setdefault(doc, []).append((x, y + 1))
                    hit.setdefault(doc, set()).add(names[k])
                if spans:
                    m, docs = len(spans), sorted(spans)
                    yield pa.record_batch(
                        [
                            pa.array(np.full(m, part)), pa.array(np.full(m, segment)), pa.array(docs, pa.int64()),
                            pa.array([merged(spans[x]) for x in docs], pa.list_(pa.list_(pa.int32()))), pa.array([sorted(hit[x], key=lambda i: (i is None, i or "")) for x in docs], pa.list_(pa.string())),
                        ],
                        names=["part", "segment", "place", "spans", "items"],
                    )

    return index.select("part", "segment", "n_words", "terms", "ends", "postings").mapInArrow(match, "part long, segment long, place long, spans array<array<int>>, items array<string>")


def proximity_matches(windows: np.ndarray, lengths: np.ndarray, slots: np.ndarray, begins: np.ndarray, ends: np.ndarray, postings: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, first, last) of the tightest spans that hold all words of a window, for windows whose terms the segment has."""
    found = []
    for k, n in enumerate(lengths.tolist()):
        own = slots[windows[k, :n]]
        if (own < 0).any():
            continue
        lists = [postings[begins[s] : ends[s]].astype(np.int64) for s in own.tolist()]
        order = sorted(range(n), key=lambda j: len(lists[j]))  # noqa: B023
        found += [(k, x, y) for x, y in proximity_spans(lists, order, n + slop)]
    return tuple(np.array([f[j] for f in found], np.int64) for j in range(3))


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Disjoint half-open ranges in order."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def blocks_of(tests: DataFrame, block_bytes: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """The items and their words, about block_bytes at a time; a longer item comes alone."""
    held, size = [], 0
    for row in tests.toLocalIterator():
        held.append((row["item"], words_of(bytes(row["text"]))))
        size += len(row["text"])
        if size >= block_bytes:
            yield held
            held, size = [], 0
    yield held


def decontaminate(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = WINDOW, slop: int | None = None, block_bytes: int = BLOCK_BYTES, most_terms: int = MOST_TERMS, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of df: (id long, n_words long, spans, items): the word ranges covered by
    occurrences of windows of benchmark items, and the ids (as text, sorted) of the items that occur. `extra` names
    further whole-number columns to return.

    Words are runs of letters, digits and non-ASCII bytes, A-Z lower-cased; a window is `size` consecutive
    words of an item, or all of them where it has fewer. Null and empty texts have no words and no hits;
    null ids and ids that repeat give a row each, with the hits of its own text. Items without words have no windows; items of
    one id count once, and all items without an id are one, named null, which comes last. Empty tables give
    empty or unhit results. Other columns are ignored."""
    prepare(df.sparkSession)
    require(df, id_col, text_col, *extra)
    require(benchmark, item_col, item_text)
    tests, _ = stage_table(benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).cast("binary").alias("text")).filter("text IS NOT NULL"))
    columns = ["id", *[f"extra_{c}" for c in extra]]
    index, _ = build_index(df, test_terms(tests, most_terms), [id_col, *extra], text_col)
    parts = [find_hits(index, items, size, slop) for items in blocks_of(tests, block_bytes)]
    hits = parts[0]
    for other in parts[1:]:
        hits = hits.unionByName(other)
    if len(parts) > 1:
        joined = hits.groupBy("part", "segment", "place").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
        hits = joined.select("part", "segment", "place", F.udf(merged, "array<array<int>>")("spans").alias("spans"), F.array_sort(F.array_distinct("items")).alias("items"))
    every = documents_of(index, columns).join(hits, ["part", "segment", "place"], "left")
    return every.select("id", *[F.col(f"extra_{c}").alias(c) for c in extra], "n_words", F.coalesce("spans", F.array().cast("array<array<int>>")).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def covered(spans: str = "spans"):
    """How many words the ranges cover."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, x: n + x[1] - x[0])


def op6_benchmark_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = covered()
    return found.select(
        F.col("id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


#: Words as runs of the allowed characters; windows of the benchmark joined with windows of the documents.
ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), bw AS (
  SELECT DISTINCT item, least(len(ws), 10) AS n, array_to_string(ws[k : k + least(len(ws), 10) - 1], ' ') AS s
  FROM b, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) AS t(k) WHERE len(ws) > 0
), lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, k, array_to_string(ws[k : k + n - 1], ' ') AS s FROM w, lens, unnest(range(1, CAST(len(ws) - n + 2 AS BIGINT))) AS t(k) WHERE len(ws) >= n
), hit AS (SELECT doc_id, k, n, item FROM dw JOIN bw USING (n, s)),
marks AS (SELECT DISTINCT doc_id, p FROM (SELECT DISTINCT doc_id, k, n FROM hit) h, unnest(range(k, k + n)) AS t(p)),
cover AS (SELECT doc_id, count(*) AS n_hit FROM marks GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN cover USING (doc_id) LEFT JOIN its USING (doc_id)
"""
