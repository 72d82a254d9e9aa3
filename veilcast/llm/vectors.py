"""Operator 8, embedding near-dedup: all pairs of different vectors, in blocks, at any number of them.

The vectors of one length are dealt over blocks by a hash, a file each below the shared folder. A task takes one block and
reads some others one after the other, so vectors are never shuffled for pairs, and every two blocks meet once. Single
precision sorts out what stays below the threshold by more than its rounding error, and double precision decides on
the rest. Nothing is left to chance: no size, setting or property of the vectors decides which links are found.

Equal vectors are one class with a multiplicity. Link counts and local components leave a task as sums and
stars, never as pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, require, stage_table
from .components import components, forest

THRESHOLD = 0.95
BLOCK = 2048  # vectors of a block, at least where there are more
BLOCKS = 64  # of the vectors of one length, unless they would exceed BLOCK_BYTES
BLOCK_BYTES = 8 << 20  # of a block's stored components, about
SPAN = 16  # blocks that a task reads beside its own, at most
TASK_ROWS = 1024  # vectors a task, at least on average
STRIPE = 1 << 22  # inner products at a time
SEED = 7


def valid(vec: str):
    """Whether a vector can link: there, not zero, and all components there and finite."""
    v = F.col(vec)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _unit(raw: list[bytes], kind: str) -> np.ndarray:
    """Stored vectors of one length, scaled to unit length in double precision."""
    x = np.frombuffer(b"".join(raw), dtype=kind).reshape(len(raw), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def near_pairs(x: np.ndarray, y: np.ndarray | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) with x[i] @ y[j] >= threshold in double precision, some rows of x at a time; without y those of x with i < j."""
    same, y = y is None, x if y is None else y
    x4, y4, dim = x.astype(np.float32), y.astype(np.float32), x.shape[1]
    floor, rows, some = threshold - (dim + 8) * 2.0**-22, max(1, STRIPE // max(1, len(y))), max(1, STRIPE // dim)
    for lo in range(0, len(x), rows):
        first = lo if same else 0
        i, j = np.nonzero(x4[lo : lo + rows] @ y4[first:].T >= floor)
        if same:
            i, j = i[i < j], j[i < j]
        if len(i) * 8 > rows * len(y):
            near = (x[lo : lo + rows] @ y[first:].T)[i, j] >= threshold
        else:
            near = np.concatenate([np.zeros(0, bool), *(np.einsum("ij,ij->i", x[lo + i[k : k + some]], y[first + j[k : k + some]]) >= threshold for k in range(0, len(i), some))])
        yield lo + i[near], first + j[near]


def _block(uri: str, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, multiplicities and unit vectors of the block in a folder, in the order of ids; a block may be empty."""
    from pyarrow import fs

    where, folder = fs.FileSystem.from_uri(uri)
    files = [f.path for f in where.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if f.path.endswith(".parquet")]
    parts = [pq.ParquetFile(where.open_input_file(f)).read(["id", "n", "raw"]) for f in files]
    if not sum(p.num_rows for p in parts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 1))
    rows = pa.concat_tables(parts).sort_by("id")
    return rows["id"].to_numpy(), rows["n"].to_numpy(), _unit(rows["raw"].to_pylist(), kind)


def _pairs_in_task(batches: Iterator[pa.RecordBatch], path: str, threshold: float, kind: str, span: int) -> Iterator[pa.RecordBatch]:
    """Links of each row's block with itself (offset 0) and with the blocks at the next offsets, cyclically, `span` of them a row."""
    links: dict[int, int] = {}
    ends_a, ends_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def add(ids: np.ndarray, sums: np.ndarray) -> None:
        for k in np.flatnonzero(sums).tolist():
            links[int(ids[k])] = links.get(int(ids[k]), 0) + int(sums[k])

    for batch in batches:
        for dim, blocks, own, first in zip(*[c.to_pylist() for c in batch.columns]):
            ids, mult, x = _block(f"{path}/dim={dim}/block={own}", kind)
            total = np.zeros(len(ids), np.int64)
            for offset in range(first, min(first + span, blocks // 2 + 1)):
                if not len(ids) or 2 * offset == blocks and own >= offset:  # half around, two blocks would meet twice
                    continue
                others, weights, y = (ids, mult, None) if offset == 0 else _block(f"{path}/dim={dim}/block={(own + offset) % blocks}", kind)
                if not len(others):
                    continue
                theirs = total if y is None else np.zeros(len(others), np.int64)
                for r, c in near_pairs(x, y, threshold):
                    np.add.at(total, r, weights[c])
                    np.add.at(theirs, c, mult[r])
                    ends_a.append(ids[r])
                    ends_b.append(others[c])
                    if sum(map(len, ends_a)) > 1 << 21:
                        a, b = forest(np.concatenate(ends_a), np.concatenate(ends_b))
                        ends_a[:], ends_b[:] = [a], [b]
                if y is not None:
                    add(others, theirs)
            add(ids, total)
    a, b = forest(np.concatenate(ends_a), np.concatenate(ends_b))
    ids = np.array(list(links), np.int64)
    yield pa.record_batch([pa.array(np.concatenate([ids, a])), pa.array(np.concatenate([np.array(list(links.values()), np.int64), np.zeros(len(a), np.int64)])), pa.array(np.concatenate([ids, b]))], names=["id", "n", "to"])


def near_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """(id long, n_links long, component_id long, kept boolean): links are pairs with cosine of at least
    `threshold` in double precision. All are found, among any number of vectors; the work grows with its square.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, and
    vectors of different lengths don't link. Equal vectors link with each other whatever their number.
    Rows that share an id give a row each and count as one end in components; a null id is a row with
    a null component. An empty table gives an empty one; other columns are ignored."""
    require(df, id_col, vec_col)
    prepare(df.sparkSession)
    kind, size = ("<f4", 4) if dict(df.select(vec_col).dtypes)[vec_col] == "array<float>" else ("<f8", 8)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).withColumn("ok", valid("v") & F.col("id").isNotNull())
    keyed = rows.withColumn("k1", F.when(F.col("ok"), F.xxhash64("v"))).withColumn("k2", F.when(F.col("ok"), F.xxhash64(F.lit(SEED), "v")))
    raw = F.pandas_udf(lambda s: s.map(lambda x: np.asarray(x, kind).tobytes()), "binary")
    classes, _ = stage_table(keyed.filter("ok").groupBy("k1", "k2").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("v").alias("v")).withColumn("raw", raw("v")).select("k1", "k2", "id", "n", "raw"))
    dim = (F.octet_length("raw") / size).cast("int").alias("dim")
    needed = F.greatest(F.least(F.ceil(F.col("m") / BLOCK), F.lit(BLOCKS)), F.ceil(F.col("m") * F.col("dim") * size / BLOCK_BYTES))
    sizes, _ = stage_table(classes.groupBy(dim).agg(F.count("*").alias("m")).withColumn("blocks", needed.cast("int")))  # a row a length
    mine = F.pmod(F.xxhash64("id", F.lit(SEED)), F.col("blocks")).cast("int").alias("block")
    dealt = classes.select("id", "n", "raw", dim).join(sizes, "dim").select("dim", mine, "id", "n", "raw")
    _, path = stage_table(dealt.repartition("dim", "block"), "dim", "block")
    span = SPAN  # the session's, whatever workers have
    jobs = sizes.filter("m > 1").select("dim", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("own"))
    jobs = jobs.withColumn("first", F.explode(F.sequence(F.lit(0), F.floor(F.col("blocks") / 2).cast("int"), F.lit(span))))
    total = sizes.agg(F.sum("m")).first()[0] or 0
    tasks = max(1, min(jobs.count(), math.ceil(total / TASK_ROWS)))
    found, _ = stage_table(jobs.repartition(tasks).mapInArrow(lambda b: _pairs_in_task(b, path, threshold, kind, span), "id long, n long, to long"))
    counts = found.filter("n > 0").groupBy("id").agg(F.sum("n").alias("links"))
    labels = components(found.filter("n = 0"), "id", "to")
    groups = classes.select("k1", "k2", "id", "n").join(counts, "id", "left").join(labels, "id", "left")
    groups = groups.select("k1", "k2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "id").alias("component"))
    out = keyed.select("id", "k1", "k2").join(groups, ["k1", "k2"], "left")
    out = out.select("id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))


def op8_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id")


ORACLE_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), ok AS (
  SELECT * FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= {THRESHOLD}
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a), d AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN d USING (vec_id)
"""
