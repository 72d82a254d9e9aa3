"""Noise: Gaussian, calibrated to the variance across worlds, and Laplace. Draws hash the seed, a tag and the group's
keys, so a retried task or a second action gives the same answer."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import PrivacyConfig, signed

TWO53 = float(1 << 53)
FEWEST_UPDATES = 500
NO_DIVERSITY = "detected absence of sample diversity"


def uniform(config: PrivacyConfig, tag: str, keys: list[Column]) -> Column:
    """In (0, 1), from seed, tag and keys."""
    h = F.xxhash64(F.lit(config.query_hash_signed), F.lit(tag), *keys)
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / TWO53


def gauss(config: PrivacyConfig, tag: str, keys: list[Column]) -> Column:
    """Standard normal, by Box and Muller."""
    return F.sqrt(-2 * F.log(uniform(config, tag + ":r", keys))) * F.cos(2 * math.pi * uniform(config, tag + ":a", keys))


def ratio(x: Column, y: Column) -> Column:
    """x / y on doubles as IEEE has it, which ANSI division would refuse."""
    by_zero = F.when(x.isNull(), None).when(F.isnan(x) | (x == 0), F.lit(float("nan"))).when(x > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(y == 0, by_zero).otherwise(F.try_divide(x, y))


def whole(x: Column) -> Column:
    """Truncated toward zero."""
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))


def variance(vals: Column) -> Column:
    """Sample variance over the 64 worlds."""
    total = F.aggregate(vals, F.lit(0.0), lambda s, x: s + x)
    return F.aggregate(vals, F.lit(0.0), lambda s, x: s + (x - total / 64) * (x - total / 64)) / 63


def absent(mask: Column, config: PrivacyConfig, correction: float, tag: str, keys: list[Column]) -> Column:
    """Whether an answer is withheld because too few worlds have it."""
    if config.pac_mi <= 0:
        return F.bit_count(mask) * F.lit(float(correction)) < 1
    n = max(1, math.floor(64 * correction))
    return (64 - F.bit_count(mask)) > F.floor(uniform(config, tag + ":null", keys) * n)


def faint(out: Column, noise_var: Column, config: PrivacyConfig, tag: str, keys: list[Column]) -> Column:
    """Whether an answer is withheld as drowned in its noise."""
    tau = config.privacy_min_group_count
    if tau is None or math.isnan(tau):
        return F.lit(False)
    z = F.abs(out) / F.sqrt(noise_var)
    keep = 1 / (1 + F.exp(F.greatest(F.lit(-30.0), F.least(F.lit(30.0), -3 * (z - F.lit(float(tau)))))))
    return F.when(noise_var > 0, uniform(config, tag + ":keep", keys) >= keep).otherwise(F.lit(False))


def release(counters: Column, mask: Column, config: PrivacyConfig, correction: float = 1.0, scale: float = 1.0, tag: str = "", keys: list[Column] | tuple = (), scale_values: bool = True, nulling: bool = True) -> Column:
    """One answer from 64 counters: the secret world's value with noise of variance(worlds) / (2 mi).

    Without a bound (mi 0) it is world 0's value, exactly. `scale` undoes the sampling of half the units."""
    keys = list(keys)
    factor = float(correction) if scale_values else 1.0
    vals = F.transform(counters, lambda c, j: F.when(F.call_function("shiftrightunsigned", mask, j).bitwiseAND(F.lit(1).cast("long")) == 1, c.cast("double") * factor).otherwise(F.lit(0.0)))
    if config.pac_mi <= 0:
        out = F.get(vals, F.lit(0)) * float(scale)
    else:
        spread = variance(vals) / (2 * config.pac_mi)
        own = F.get(vals, F.lit(config.secret_world))
        sound = (spread > 0) & (spread < float("inf")) & ~F.isnan(spread)
        raw = F.when(sound, own + F.sqrt(spread) * gauss(config, tag, keys)).otherwise(own)
        out = raw * float(scale)
        out = F.when(sound & faint(out, spread * float(scale) ** 2, config, tag, keys), None).otherwise(out)
    return F.when(absent(mask, config, correction, tag, keys), None).otherwise(out) if nulling else out


def pac_noised(counters: Column, config: PrivacyConfig, tag: str = "noised", keys=()) -> Column:
    """A released value of a list of 64; any other length gives null. Null elements count as 0."""
    c = F.transform(counters, lambda x: F.coalesce(x.cast("double"), F.lit(0.0)))
    return F.when(F.size(counters) == 64, release(c, F.lit(-1).cast("long"), config, tag=tag, keys=keys))


def pac_finalize(counters: Column, config: PrivacyConfig, tag: str = "finalize", keys=()) -> Column:
    """A stored counter list as one value: noised, but never withheld."""
    c = F.transform(counters, lambda x: F.coalesce(x.cast("double"), F.lit(0.0)))
    quiet = PrivacyConfig(**{**config.__dict__, "privacy_min_group_count": None})
    return F.when(F.size(counters) == 64, release(c, F.lit(-1).cast("long"), quiet, tag=tag, keys=keys, nulling=False))


def dp_laplace_noise(value: Column, scale: float, config: PrivacyConfig, tag: str = "laplace", keys=()) -> Column:
    """value plus Laplace noise of this scale; the value itself for a scale that isn't positive and finite."""
    v = value.cast("double")
    if not (scale > 0 and math.isfinite(scale)):
        return v
    h = F.xxhash64(F.lit(config.query_hash_signed), F.lit(tag), v, F.lit(float(scale)), *list(keys))
    u = (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / TWO53 - 0.5
    return v - F.lit(float(scale)) * F.signum(u) * F.log1p(-2 * F.abs(u))


class Posterior:
    """What an observer of all answers so far can think of the secret world; each answer sharpens it."""

    def __init__(self, config: PrivacyConfig, mi: float, stream: int):
        self.p, self.mi, self.tau, self.secret = np.full(64, 1 / 64), mi, config.privacy_min_group_count, config.secret_world
        self.rng = np.random.Generator(np.random.Philox(key=[config.query_hash & ((1 << 63) - 1), 0xCE11 + (stream << 20)]))

    def answer(self, vals: np.ndarray, present: int, correction: float, scale: float) -> float | None:
        """One answer from the values of the worlds, with noise for the observer's uncertainty about them."""
        withheld = 64 - present > int(self.rng.random() * max(1, math.floor(64 * correction)))
        p, own = self.p, float(vals[self.secret])
        off = vals - p @ vals
        var = float(p @ (off * off)) / (2 * self.mi)
        draw, keep = self.rng.standard_normal(), self.rng.random()
        if withheld:
            return None
        if not (var > 0 and math.isfinite(var)):
            return own * scale
        raw = own + math.sqrt(var) * draw
        like = (vals - raw) ** 2 * (-0.5 / var)
        p = p * np.exp(like - like[p > 1e-290].max()) + 1e-300
        self.p = p / p.sum()
        tau = self.tau
        if tau is not None and keep >= 1 / (1 + math.exp(max(-30.0, min(30.0, -3 * (abs(raw) / math.sqrt(var) - tau))))):
            return None
        return raw * scale


def _worlds(column: pa.ListArray, masks: np.ndarray, factor: float) -> np.ndarray:
    """Rows of 64 counters, zero where the mask has no bit."""
    if column.null_count:
        column = pa.array([[0.0] * 64 if x is None else x for x in column.to_pylist()], pa.list_(pa.float64()))
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(len(masks), 64)
    on = (masks.view(np.uint64)[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1) == 1
    return np.where(on, np.nan_to_num(flat, nan=0.0, posinf=np.inf, neginf=-np.inf) * factor, 0.0)


def release_tracked(df: DataFrame, cells: list[tuple[str, str, str, float, float, bool]], order: list[str], config: PrivacyConfig, watch: tuple[str, str, str] | None = None) -> DataFrame:
    """Releases the counter columns of a grouped result with a posterior over worlds that each answer sharpens.

    cells: (output, counters, mask, correction, scale, scale_values). The posterior runs through all cells in the
    order of the group keys. The groups are aggregated in parallel and then exchanged to one task, a row a group, which streams them in
    batches. With pac_ptracking_partitions above 1 they are dealt over so many tasks by their keys, each with a posterior
    of its own and that part of the bound. `watch` names updates, mask and counters for the diversity check, which fails the
    task at its end, before any of its rows count."""
    inputs = list(dict.fromkeys(x for cell in cells for x in cell[1:3])) + [x for x in (watch or ()) if x not in {y for cell in cells for y in cell[1:3]}]
    kept = [c for c in df.columns if c not in inputs]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in kept] + [f"`{c[0]}` double" for c in cells])
    tasks = max(1, int(config.pac_ptracking_partitions)) if order else 1
    mi = config.pac_mi / tasks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        state = Posterior(config, mi, context.partitionId() if context else 0)
        updates = odd = sound = 0
        for batch in batches:
            col = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            made = []
            for _, counters, mask, correction, scale, scaled in cells:
                masks = col[mask].fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                made.append((_worlds(col[counters], masks, correction if scaled else 1.0), np.bitwise_count(masks.view(np.uint64)).tolist(), correction, scale))
            answers: list[list] = [[] for _ in cells]
            for k in range(batch.num_rows):
                for out, (vals, present, correction, scale) in zip(answers, made):
                    out.append(state.answer(vals[k], present[k], correction, scale))
            if watch:
                masks = col[watch[1]].fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                vals, on = _worlds(col[watch[2]], masks, 1.0), (masks.view(np.uint64)[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1) == 1
                off, alike = 64 - on.sum(axis=1), np.where(on, vals, -np.inf).max(axis=1) == np.where(on, vals, np.inf).min(axis=1)
                single = int(((off >= 29) & (off <= 35) & alike).sum())
                updates, odd, sound = updates + (pa.compute.sum(col[watch[0]]).as_py() or 0), odd + single, sound + batch.num_rows - single
            yield pa.record_batch([*[col[c] for c in kept], *[pa.array(x, pa.float64()) for x in answers]], names=[*kept, *[c[0] for c in cells]])
        if updates >= FEWEST_UPDATES and odd > 2 * sound:
            raise RuntimeError(NO_DIVERSITY)

    dealt = df.repartition(tasks, *order) if tasks > 1 else df.repartition(1)
    chosen = dealt.sortWithinPartitions(*order) if order else dealt
    return chosen.select(*kept, *inputs).mapInArrow(run, schema)


def diversity(updates: Column, mask: Column, counters: Column) -> tuple[Column, Column]:
    """(suspicious, sound) of a group: one world pattern and one value suggests a single unit behind it."""
    off = 64 - F.bit_count(mask)
    on = F.filter(F.transform(counters, lambda c, j: F.when(F.call_function("shiftrightunsigned", mask, j).bitwiseAND(F.lit(1).cast("long")) == 1, c)), lambda x: x.isNotNull())
    odd = (off >= 29) & (off <= 35) & (F.array_max(on) == F.array_min(on))
    return F.coalesce(odd, F.lit(False)), F.coalesce(~odd, F.lit(True))


__all__ = ["release", "pac_noised", "pac_finalize", "dp_laplace_noise", "signed"]
