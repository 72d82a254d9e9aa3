"""Connected components by alternating stars, for link tables of any size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, prepare, stage_table


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, smallest member) for all but the smallest member of each component of these links."""
    if not len(a):
        return a, b
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:  # hooking to the smaller root, then jumping: rounds grow with the logarithm
        before = label.copy()
        lu, lv = label[u], label[v]
        np.minimum.at(label, lu, lv)
        np.minimum.at(label, lv, lu)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
        if np.array_equal(before, label):
            break
    own = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[own], nodes[label[own]]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a = b = np.zeros(0, np.int64)
    for batch in batches:
        a = np.concatenate([a, batch.column(0).to_numpy()])
        b = np.concatenate([b, batch.column(1).to_numpy()])
        if len(a) > 1 << 20:
            a, b = forest(a, b)
    a, b = forest(a, b)
    for at in range(0, len(a), 1 << 16):
        yield pa.record_batch([pa.array(a[at : at + (1 << 16)]), pa.array(b[at : at + (1 << 16)])], names=["a", "b"])


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): for every id in a link, other than a component's smallest, the smallest id it
    reaches. Each task first reduces its links to stars; then large and small stars alternate until
    nothing changes. A hub's links meet only in aggregations with map-side combining and in joins
    whose other side is unique. Null ends and self-links are left out."""
    prepare(links.sparkSession)
    spark = links.sparkSession
    clean = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    state, path = stage_table(clean.mapInArrow(_local, "a long, b long").distinct())
    mark = lambda t: t.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
    old = mark(state)
    while old[0]:
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        new, new_path = stage_table(small.filter("a <> b").distinct())
        drop_path(spark, path)
        state, path = new, new_path
        now = mark(state)
        if now == old:
            break
        old = now
    return state.select(F.col("a").alias("id"), F.col("b").alias("component"))
