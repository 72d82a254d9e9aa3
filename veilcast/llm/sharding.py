"""Operator 1, sharding: a uniform shuffle into shards whose sizes are exact.

A communication matrix says how many rows each input partition sends to each shard. Its row sums are
the partition sizes, its column sums the shard sizes, and its law is that of a uniform random
permutation: multivariate hypergeometric. Partitions are the leaves of a binary tree; a node splits
what is left for its shards between its two halves with draws seeded by the node, so a task derives
its own row of the matrix in log(partitions) draws and no one holds the whole matrix.

Each task then deals its rows out by a random permutation of that row's labels, the rows are exchanged
once, by (shard, block), and permuted again inside each block. Blocks are random parts of a shard
that keep a task's share small at any size; their offsets come from a count of the labels alone.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import prepare, require, stage_table

N_SHARDS = 24
SEED = 20240601
BLOCK_ROWS = 20_000
MIN_BLOCKS = 8


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """One exact draw. numpy's sampler holds below 1e9; above, the distribution function is inverted
    over 40 standard deviations around the mode, outside which less than 1e-300 of the mass lies."""
    if good == 0 or draws == 0:
        return 0
    if bad == 0:
        return draws
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, draws))
    total = good + bad
    low, high = max(0, draws - bad), min(good, draws)
    mode = (draws + 1) * (good + 1) // (total + 2)
    sd = math.sqrt(max(draws * (good / total) * (bad / total) * ((total - draws) / (total - 1)), 1.0))
    span = int(40 * sd) + 40
    first, last = max(low, mode - span), min(high, mode + span)
    k = np.arange(first, last, dtype=np.float64)
    step = np.log((good - k) * (draws - k)) - np.log((k + 1) * (bad - draws + k + 1))
    mass = np.concatenate([[0.0], np.cumsum(step)])
    mass = np.exp(mass - mass.max())
    at = np.cumsum(mass)
    return first + int(np.searchsorted(at, rng.random() * at[-1], side="right"))


def split_counts(rng: np.random.Generator, left: list[int], rows: int) -> list[int]:
    """How the next `rows` rows of a random permutation fall on shards that lack `left` rows."""
    out, rest, open_ = [], rows, sum(left)
    for n in left:
        take = hypergeometric(rng, n, open_ - n, rest)
        out.append(take)
        rest, open_ = rest - take, open_ - n
    return out


def matrix_row(sizes: list[int], shards: list[int], seed: int, part: int) -> list[int]:
    """The row of the communication matrix of one partition."""
    ends = np.concatenate([[0], np.cumsum(sizes)]).tolist()
    low, high, have = 0, len(sizes), list(shards)
    while high - low > 1:
        mid = (low + high) // 2
        rng = np.random.Generator(np.random.Philox(key=[seed, low * (len(sizes) + 1) + high]))
        half = split_counts(rng, have, ends[mid] - ends[low])
        if part < mid:
            high, have = mid, half
        else:
            low, have = mid, [a - b for a, b in zip(have, half)]
    return have


def shuffle_into_shards(df: DataFrame, n_shards: int = N_SHARDS, seed: int = SEED, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """df with `shard` (int, 0 to n_shards - 1) and `slot` (long, gapless from 0 in each shard).

    Every row counts as itself: nulls in any column, empty texts, ties and repeated rows (in whatever
    column) are dealt out like all others, and an empty table gives an empty one. Shard sizes differ by
    one at most; the first (rows mod n_shards) shards have the extra row. Existing columns named
    `shard` or `slot` are replaced. The result is the same for the same files, seed and settings.
    A plan that holds an exchange may deal its rows out anew when a task runs again, so it is first
    written to the shared folder."""
    prepare(df.sparkSession)
    spark = df.sparkSession
    df = df.drop("shard", "slot")
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        df, _ = stage_table(df)
    found = df.groupBy(F.spark_partition_id().alias("p")).count().collect()  # one row a partition
    by = {r["p"]: r["count"] for r in found}
    sizes = [by.get(p, 0) for p in range(max(by, default=-1) + 1)]
    total = sum(sizes)
    shards = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    blocks = max(MIN_BLOCKS, math.ceil(total / (n_shards * block_rows)))
    state: dict[int, np.ndarray] = {}

    def deal(ids: pd.Series) -> pd.Series:
        x = ids.to_numpy()
        out = np.zeros(len(x), dtype=np.int32)
        part = x >> 33
        for p in np.unique(part).tolist():
            if p not in state:
                state.clear()
                labels = np.repeat(np.arange(n_shards, dtype=np.int32), matrix_row(sizes, shards, seed, p))
                state[p] = np.random.Generator(np.random.Philox(key=[seed ^ 0x5EED, p])).permutation(labels)
            here = part == p
            at = x[here] & ((1 << 33) - 1)
            if at.max() >= len(state[p]):
                raise RuntimeError(f"partition {p} has more rows than were counted; its input changed")
            out[here] = state[p][at]
        return pd.Series(out)

    label = F.pandas_udf(deal, "int")
    keyed = df.withColumn("__vc_at", F.monotonically_increasing_id())
    dealt = keyed.withColumn("shard", label("__vc_at")).withColumn("__vc_block", F.pmod(F.xxhash64("__vc_at", F.lit(seed)), F.lit(blocks)).cast("int"))
    counts = dealt.groupBy("shard", "__vc_block").count()
    offsets = counts.select("shard", "__vc_block", (F.sum("count").over(W.partitionBy("shard").orderBy("__vc_block")) - F.col("count")).alias("__vc_first"))
    within = W.partitionBy("shard", "__vc_block").orderBy(F.xxhash64("__vc_at", F.lit(seed + 1)), "__vc_at")
    placed = dealt.join(offsets, ["shard", "__vc_block"]).withColumn("slot", F.col("__vc_first") + F.row_number().over(within) - 1)
    return placed.select(*df.columns, "shard", F.col("slot").cast("long").alias("slot"))


def op1_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 23 under the law `rows`: counts at most one apart, every
    permutation equally likely. The law knows no groups, so equal texts are rows like all others."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    require(docs, "doc_id", "text")
    out = shuffle_into_shards(docs)
    text = F.coalesce(F.col("text"), F.lit(""))
    return out.select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
