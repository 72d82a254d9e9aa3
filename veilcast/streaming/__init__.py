"""Counters over streams: windows of world counters that can be added up, released batch by batch.

Counter lists of two parts of a group add up element by element, so a stream keeps them as its state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import PrivacyConfig
from ..functions import noise, worlds


def windowed_counters(events: DataFrame, time: str, window: str, late: str, h: Column, value: Column, keys: list[str] = ()) -> DataFrame:
    """(window, keys, counters, mask): per-window world sums of a stream or a table; rows later than `late` are dropped
    by the watermark, as streams have it."""
    at = F.window(time, window).alias("window")
    return events.withWatermark(time, late).groupBy(at, *keys).agg(F.array(*worlds.world_sums(h, value)).alias("counters"), worlds.seen(h, value).alias("mask"))


def release_batch(config: PrivacyConfig, sink: Callable[[DataFrame], None], keys: list[str] = ()) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: releases finished windows with noise and hands them to a sink. Draws depend on window and keys
    alone, so a batch that runs again releases the same answers."""

    def run(batch: DataFrame, _: int) -> None:
        own = [F.col("window.start"), *[F.col(k) for k in keys]]
        sink(batch.select("window", *keys, noise.release(F.col("counters"), F.col("mask"), config, scale=2.0, tag="window", keys=own).alias("value")))

    return run
