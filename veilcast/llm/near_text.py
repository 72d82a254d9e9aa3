"""Operator 5, MinHash near-dedup with odd sketches.

A document is the set of its word shingles. SAMPLES MinHash values of the set serve twice. In BANDS bands
of ROWS values they propose candidates. Folded into a bitmap, where sample i with value m flips bit
hash(i, m), they become an odd sketch: the XOR of two sketches has a bit for (nearly) each sample in
which the sets differ, so its population count estimates a high similarity closely. A proposal goes on
only if that count is at most what a pair at the threshold exceeds with a chance below 1e-9. What is
left is confirmed on the full sets.

Documents of equal sets are one class, a node with a number of its own; classes that share a document id are linked by it.
Surviving proposals are only used to split nodes in candidate groups, so a bucket of many nodes gives a spanning forest of them.
Every link lies within a group. The whole texts of a group's nodes are then brought together and links are confirmed on the full
sets of all pairs that share a bucket and that the sketches let through. A group of up to GROUP nodes comes whole, dealt over block
pairs where it is large or long, so that a text moves once; a group of more is taken apart again into its buckets, as proposals
chain. Both ways look at the same pairs. A task gives back a spanning forest of its links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, prepare, require, stage_table, worker_state
from .components import components, forest

BANDS, ROWS = 28, 5
SAMPLES = BANDS * ROWS
SKETCH_BITS = 512
BLOCK = 1024
SMALL = 8
GROUP = 8 * BLOCK
BLOCK_BYTES = 32 << 20
SEED = 20231
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
U = np.uint64


class Shingler:
    """Sorted 64-bit hashes of the distinct shingles of a text; word hashes stay in a bounded cache."""

    def __init__(self, words: int, limit: int = 150_000):
        self.k, self.limit, self.cache = words, limit, {}

    def __call__(self, raw: bytes | None) -> np.ndarray:
        import xxhash

        words = raw.translate(LOWER).split() if raw else []
        if not words:
            return np.zeros(0, U)
        cache = self.cache
        if len(cache) > self.limit:
            cache.clear()
        new = [w for w in set(words) if w not in cache]
        for w in new:
            cache[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(cache.__getitem__, words), U, len(words))
        k = min(self.k, len(h))
        with np.errstate(over="ignore"):
            total = np.full(len(h) - k + 1, U(k))
            for j in range(k):
                total = mix64(total * U(0x9E3779B97F4A7C15) + h[j : len(h) - k + 1 + j])
        return np.unique(total)


def samples_of(sets: list[np.ndarray], seed: int = SEED) -> np.ndarray:
    """MinHash values, one row a set; sets aren't empty."""
    rng = np.random.Generator(np.random.Philox(key=[seed, 1]))
    a = rng.integers(1 << 63, size=SAMPLES, dtype=U) * U(2) + U(1)
    b = rng.integers(1 << 63, size=SAMPLES, dtype=U)
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), SAMPLES), U)
    with np.errstate(over="ignore"):
        for i in range(SAMPLES):
            x = flat * a[i] + b[i]
            out[:, i] = np.minimum.reduceat(x ^ (x >> U(32)), starts)
    return out


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps of SKETCH_BITS bits as rows of uint64."""
    with np.errstate(over="ignore"):
        bit = (mix64(samples + np.arange(1, SAMPLES + 1, dtype=U) * U(0xD6E8FEB86659FD93)) % U(SKETCH_BITS)).astype(np.int64)
    flat = np.zeros((len(samples), SKETCH_BITS), np.uint8)
    np.add.at(flat, (np.arange(len(samples))[:, None], bit), 1)
    return np.packbits(flat & 1, axis=1).view(U)


def band_keys(samples: np.ndarray) -> np.ndarray:
    out = np.zeros((len(samples), BANDS), U)
    with np.errstate(over="ignore"):
        for r in range(ROWS):
            out = mix64(out * U(0x9E3779B97F4A7C15) + samples[:, r::ROWS][:, :BANDS])
        return mix64(out + np.arange(BANDS, dtype=U)).view(np.int64)


def count_limit(similarity: float, sigmas: float = 6.2) -> int:
    """The XOR population count that a pair of this similarity exceeds with a chance below 1e-9."""
    differ = SAMPLES * (1 - similarity) + sigmas * math.sqrt(SAMPLES * similarity * (1 - similarity))
    flips = 2 * differ
    return math.ceil(SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** flips) + 3)


def signatures(df: DataFrame, words: int) -> DataFrame:
    """(id, th, n, k1, k2, bands, sketch) of each row of df(id, text, th); the last four are null for empty sets."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingle = worker_state(("shingles", words), lambda: Shingler(words))
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                sets = [shingle(raw) for raw in part.column(1).to_pylist()]
                some = [k for k, s in enumerate(sets) if len(s)]
                keys = {k: np.frombuffer(xxhash.xxh3_128_digest(sets[k].tobytes()), np.int64) for k in some}
                bands, sketch = {}, {}
                if some:
                    samples = samples_of([sets[k] for k in some])
                    bands = dict(zip(some, band_keys(samples)))
                    sketch = dict(zip(some, odd_sketches(samples)))
                m = len(sets)
                yield pa.record_batch(
                    [
                        part.column(0), part.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array([int(keys[k][0]) if k in keys else None for k in range(m)], pa.int64()),
                        pa.array([int(keys[k][1]) if k in keys else None for k in range(m)], pa.int64()),
                        pa.array([bands.get(k) for k in range(m)], pa.list_(pa.int64())), pa.array([sketch[k].tobytes() if k in sketch else None for k in range(m)], pa.binary()),
                    ],
                    names=["id", "th", "n", "k1", "k2", "bands", "sketch"],
                )

    return df.mapInArrow(sign, "id long, th long, n long, k1 long, k2 long, bands array<long>, sketch binary")


def groups_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    """Whole groups of rows sorted by their first column, several at a time: column name to arrays."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        key = batch.column(0).to_numpy()
        cut = int(np.searchsorted(key, key[-1], side="left")) if np.all(key[:-1] <= key[1:]) else 0
        if held and held[-1].column(0)[-1].as_py() != key[0] and not cut:
            yield pa.Table.from_batches(held)
            held = [batch]
        elif cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def counts_between(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """XOR population counts of all rows of x with all rows of y."""
    out = np.zeros((len(x), len(y)), np.uint16)
    for w in range(x.shape[1]):
        out += np.bitwise_count(x[:, w][:, None] ^ y[:, w][None, :])
    return out


def _sketches(column) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, U).reshape(-1, SKETCH_BITS // 64)


def _first_wave(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, id, sketch) sorted by key -> (a, b): a spanning forest of the candidates of whole buckets."""
    for table in groups_of(batches):
        key, ids, x = table.column(0).to_numpy(), table.column(1).to_numpy(), _sketches(table.column(2))
        bounds = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        size = np.diff(bounds)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        few = np.repeat(size <= SMALL, size)
        for d in range(1, SMALL):
            at = np.flatnonzero((key[:-d] == key[d:]) & few[:-d]) if d < len(key) else np.zeros(0, np.int64)
            if len(at):
                at = at[np.bitwise_count(x[at] ^ x[at + d]).sum(axis=1) <= limit]
                a.append(ids[at])
                b.append(ids[at + d])
        for lo, hi in zip(bounds[:-1][size > SMALL].tolist(), bounds[1:][size > SMALL].tolist()):
            r, c = np.nonzero(np.triu(counts_between(x[lo:hi], x[lo:hi]) <= limit, 1))
            a.append(ids[lo:hi][r])
            b.append(ids[lo:hi][c])
        a, b = forest(np.concatenate(a), np.concatenate(b))  # the same pair meets in many buckets
        yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of all pairs of sets, by products of incidence columns."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, codes, counts = np.unique(flat, return_inverse=True, return_counts=True)
    shared = np.cumsum(counts > 1) - 1
    keep = counts[codes] > 1
    owner, codes = owner[keep], shared[codes[keep]]
    order = np.argsort(codes, kind="stable")
    owner, codes = owner[order], codes[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    width = 4096
    for lo in range(0, int(shared[-1]) + 1 if len(shared) else 0, width):
        a, b = np.searchsorted(codes, (lo, lo + width))
        block = np.zeros((len(sets), width), np.float32)
        block[owner[a:b], codes[a:b] - lo] = 1
        total += block @ block.T
    return total.astype(np.int64)


def confirmed(sets: list[np.ndarray], r: np.ndarray, c: np.ndarray, numerator: int) -> np.ndarray:
    """Which of the pairs (r, c) are links on the full sets."""
    n = np.array([len(s) for s in sets], np.int64)
    if len(r) > 20_000:
        common = common_counts(sets)[r, c]
    else:
        common = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(r.tolist(), c.tolist())], np.int64)
    return 100 * common >= numerator * (n[r] + n[c] - common)


def _confirm(batches: Iterator[pa.RecordBatch], words: int, limit: int, numerator: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, node, side, sketch, text, bands) sorted by key -> spanning forests of the links found."""
    shingle = worker_state(("shingles", words), lambda: Shingler(words))
    for table in groups_of(batches):
        key, ids, side, x, texts = table.column(0).to_numpy(), table.column(1).to_numpy(), table.column(2).to_numpy(), _sketches(table.column(3)), table.column(4)
        bands = np.array(table.column(5).to_pylist(), np.int64)
        bounds = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        out_a, out_b = [], []
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if hi - lo < 2:
                continue
            s = side[lo:hi]
            good = np.triu(counts_between(x[lo:hi], x[lo:hi]) <= limit, 1)
            if s.any():  # two blocks meet; pairs inside a block are another task's
                good &= s[:, None] != s[None, :]
            r, c = np.nonzero(good)
            meet = np.concatenate([np.zeros(0, bool), *((bands[lo + r[k : k + 65536]] == bands[lo + c[k : k + 65536]]).any(axis=1) for k in range(0, len(r), 65536))])
            r, c = r[meet], c[meet]
            if len(r):
                used, at = np.unique(np.concatenate([r, c]), return_inverse=True)
                sets = [shingle(texts[lo + k].as_py()) for k in used.tolist()]
                ok = confirmed(sets, at[: len(r)], at[len(r) :], numerator)
                a, b = forest(ids[lo:hi][r[ok]], ids[lo:hi][c[ok]])
                out_a.append(a)
                out_b.append(b)
        if out_a:
            yield pa.record_batch([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], names=["a", "b"])


def near_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, numerator: int = 80) -> DataFrame:
    """(id long, n_shingles long, component_id long, kept boolean): documents linked where
    100 * intersection >= numerator * union of their shingle sets, confirmed on whole sets.

    Words are runs without ASCII white space, A-Z lower-cased. A text of fewer words than a shingle has
    its whole sequence as one; null, empty and blank texts have no shingles and link with nothing, so their
    component is their own id. Rows with shingles that share an id are one node of the link graph, with the links of all of
    their texts (a row each in the result); a null id is a row that links with nothing, with a null component. An empty
    table gives an empty one; other columns are ignored."""
    require(df, id_col, text_col)
    prepare(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")).withColumn("th", F.xxhash64("text"))
    limit = count_limit(numerator / 100)
    signed, _ = stage_table(signatures(docs, words))
    real = signed.filter("n > 0 AND id IS NOT NULL")
    # a class is one set; (id, th) finds one of its texts again. Its number is fixed by the write
    found = real.groupBy("k1", "k2").agg(F.min(F.struct("id", "th", "bands", "sketch")).alias("m"))
    classes, _ = stage_table(found.select(F.monotonically_increasing_id().alias("node"), "k1", "k2", "m.*"))
    nodes = classes.select("k1", "k2", "node")
    keys = classes.select("node", F.explode("bands").alias("key"))
    sizes = keys.groupBy("key").agg(F.count("*").alias("m"), F.min("node").alias("lead")).filter("m > 1")
    members, _ = stage_table(keys.join(sizes, "key"))
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("node", F.lit(SEED)), blocks).cast("int")
    first = members.join(classes.select("node", "sketch"), "node").select(F.when(F.col("m") <= BLOCK, F.col("key")).otherwise(F.xxhash64("key", mine)).alias("key"), "node", "sketch")
    wave = first.repartition("key").sortWithinPartitions("key", "node").mapInArrow(lambda x: _first_wave(x, limit), "a long, b long")
    # a bucket of several blocks is one group as a whole: candidates may lie across its blocks
    wide = members.filter(F.col("m") > BLOCK).select(F.col("lead").alias("a"), F.col("node").alias("b"))
    grouped = components(wave.unionByName(wide))
    group, _ = stage_table(grouped.unionByName(grouped.select(F.col("component").alias("id"), "component").distinct()).withColumnRenamed("id", "node"))
    wanted = classes.select("node", "id", "th", "bands", "sketch").join(group, "node")
    texts = docs.join(wanted, ["id", "th"]).dropDuplicates(["node"]).select("node", "component", "bands", "sketch", "text")
    texts, _ = stage_table(texts)
    size = texts.groupBy("component").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    small = size.filter(F.col("n") <= GROUP).select("component", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    large = size.filter(F.col("n") > GROUP).select("component")
    whole = texts.join(small, "component").select(F.col("component").alias("key"), "node", "bands", "sketch", "text", "blocks")
    apart = members.join(texts.join(large, "component", "left_semi"), "node")
    apart = apart.select("key", "node", "bands", "sketch", "text", "m", F.octet_length("text").alias("bytes"))
    heavy = apart.groupBy("key").agg(F.sum("bytes").alias("total"))
    apart = apart.join(heavy, "key").select("key", "node", "bands", "sketch", "text", F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("total") / BLOCK_BYTES)).cast("int").alias("blocks"))
    dealt = whole.unionByName(apart).withColumn("mine", F.pmod(F.xxhash64("node", F.lit(SEED + 1)), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    side = F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2)
    placed = dealt.select(F.xxhash64("key", low, high).alias("key"), "node", side.cast("int").alias("side"), "sketch", "text", "bands")
    links = placed.repartition("key").sortWithinPartitions("key", "node").mapInArrow(lambda x: _confirm(x, words, limit, numerator), "a long, b long")
    # several texts under one id: their classes are linked by it
    several = real.groupBy("id").agg(F.min("k1").alias("x"), F.max("k1").alias("y"), F.min("k2").alias("z"), F.max("k2").alias("w")).filter("x <> y OR z <> w").select("id")
    shared = real.join(several, "id", "left_semi").join(nodes, ["k1", "k2"]).select("id", "node")
    same = shared.join(shared.groupBy("id").agg(F.min("node").alias("a")), "id").select("a", F.col("node").alias("b"))
    labels, _ = stage_table(components(links.unionByName(same)))
    marked = classes.select("k1", "k2", "node", "id").join(labels.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    # components are named by the smallest id, and most classes are one by themselves
    least = marked.join(labels.select("component").distinct(), "component", "left_semi").groupBy("component").agg(F.min("id").alias("least"))
    named = marked.join(least, "component", "left").select("k1", "k2", F.coalesce("least", "id").alias("component"))
    out = signed.select("id", "n", "k1", "k2").join(named, ["k1", "k2"], "left")
    out = out.select("id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))


def op5_odd_sketch_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=3, numerator=85).withColumnRenamed("id", "doc_id")


#: Sets by their shingles; pairs by an inverted index; components by reachability.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[k : k + least(len(ws), 3) - 1], ' ') AS g
  FROM w, unnest(range(1, greatest(len(ws) - 3, 0) + 2)) AS t(k) WHERE len(ws) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""
