"""Counters of 64 possible worlds: aggregates that keep one value a world, and scalars over them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import PrivacyConfig
from . import noise

WORLDS = 64
_CMP = {
    "gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b,
    "lte": lambda a, b: a <= b, "eq": lambda a, b: a == b, "neq": lambda a, b: a != b,
}


def bit(h: Column, j) -> Column:
    return F.shiftrightunsigned(h, j).bitwiseAND(F.lit(1).cast("long")) == 1


def world_sums(h: Column, value: Column) -> list[Column]:
    """Sum of value in each world; rows of null hash or value count in none."""
    v = value.cast("double")
    return [F.coalesce(F.sum(F.when(bit(h, j), v)), F.lit(0.0)) for j in range(WORLDS)]


def world_extremes(h: Column, value: Column, greatest: bool) -> list[Column]:
    pick = F.max if greatest else F.min
    return [F.coalesce(pick(F.when(bit(h, j), value.cast("double"))), F.lit(0.0)) for j in range(WORLDS)]


def seen(h: Column, value: Column | None = None) -> Column:
    """The worlds that any counted row is in."""
    return F.coalesce(F.bit_or(h if value is None else F.when(value.isNotNull(), h)), F.lit(0).cast("long"))


def _scaled(values: list[Column], mask: Column, factor: float) -> Column:
    return F.array(*[F.when(bit(mask, j), F.lit(float(factor)) * c).otherwise(F.lit(0.0)) for j, c in enumerate(values)])


def pac_count(h: Column, value: Column | None = None, correction: float = 1.0) -> Column:
    one = F.lit(1.0) if value is None else F.when(value.isNotNull(), F.lit(1.0))
    return _scaled(world_sums(h, one), seen(h, value), 2 * correction)


def pac_sum(h: Column, value: Column, correction: float = 1.0) -> Column:
    return _scaled(world_sums(h, value), seen(h, value), 2 * correction)


def pac_min(h: Column, value: Column, correction: float = 1.0) -> Column:
    return _scaled(world_extremes(h, value, False), seen(h, value), 1)


def pac_max(h: Column, value: Column, correction: float = 1.0) -> Column:
    return _scaled(world_extremes(h, value, True), seen(h, value), 1)


def pac_avg(h: Column, value: Column, correction: float = 1.0) -> Column:
    return pac_div(pac_sum(h, value, correction), pac_count(h, value, correction))


def _relist(c: Column, pick) -> Column:
    """Element-wise aggregate of lists; null lists and elements are skipped, and nothing gives null."""
    out = F.array(*[pick(F.get(c, F.lit(j)).cast("double")) for j in range(WORLDS)])
    return F.when(F.count(c) > 0, out)


def pac_sum_list(c: Column) -> Column:
    return _relist(c, F.sum)


def pac_min_list(c: Column) -> Column:
    return _relist(c, F.min)


def pac_max_list(c: Column) -> Column:
    return _relist(c, F.max)


def pac_count_list(c: Column) -> Column:
    return _relist(c, lambda x: F.when(F.count(x) > 0, F.count(x).cast("double")))


def _noised(values: list[Column], mask: Column, config: PrivacyConfig, correction: float, scale: float, tag: str, keys: list[Column], scale_values: bool = True) -> Column:
    counters = F.array(*values)
    return noise.release(counters, mask, config, correction=correction, scale=scale, tag=tag, keys=keys, scale_values=scale_values)


def pac_noised_count(h: Column, config: PrivacyConfig, value: Column | None = None, correction: float = 1.0, tag: str = "count", keys=()) -> Column:
    one = F.lit(1.0) if value is None else F.when(value.isNotNull(), F.lit(1.0))
    return noise.whole(_noised(world_sums(h, one), seen(h, value), config, correction, 2, tag, list(keys))).cast("long")


def pac_noised_sum(h: Column, value: Column, config: PrivacyConfig, correction: float = 1.0, tag: str = "sum", keys=()) -> Column:
    return _noised(world_sums(h, value), seen(h, value), config, correction, 2, tag, list(keys))


def pac_noised_min(h: Column, value: Column, config: PrivacyConfig, correction: float = 1.0, tag: str = "min", keys=()) -> Column:
    return _noised(world_extremes(h, value, False), seen(h, value), config, correction, 1, tag, list(keys), False)


def pac_noised_max(h: Column, value: Column, config: PrivacyConfig, correction: float = 1.0, tag: str = "max", keys=()) -> Column:
    return _noised(world_extremes(h, value, True), seen(h, value), config, correction, 1, tag, list(keys), False)


def pac_noised_avg(h: Column, value: Column, config: PrivacyConfig, correction: float = 1.0, tag: str = "avg", keys=()) -> Column:
    """Two draws: a noised sum over a noised count."""
    return noise.ratio(pac_noised_sum(h, value, config, correction, tag + ":s", keys), pac_noised_count(h, config, value, correction, tag + ":c", keys).cast("double"))


def pac_div(a: Column, b: Column) -> Column:
    """Element-wise; a null element gives null, x / 0 infinity, 0 / 0 not-a-number."""
    return F.zip_with(a, b, lambda x, y: noise.ratio(x.cast("double"), y.cast("double")))


def pac_mean(c: Column) -> Column:
    kept = F.filter(c, lambda x: x.isNotNull())
    total = F.aggregate(kept, F.lit(0.0), lambda s, x: s + x.cast("double"))
    return F.when(F.size(kept) > 0, total / F.size(kept))


def pac_coalesce(c: Column) -> Column:
    return F.coalesce(c, F.array_repeat(F.lit(None).cast("double"), WORLDS))


def pac_noised_div(a: Column, b: Column, config: PrivacyConfig, tag: str = "div", keys=()) -> Column:
    return noise.pac_noised(pac_div(a, b), config, tag=tag, keys=keys)


def pack(bits: Column) -> Column:
    """A list of booleans as a mask; null elements are unset."""
    at = F.transform(bits, lambda b, j: F.when(b, F.call_function("shiftleft", F.lit(1).cast("long"), j)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(at, F.lit(0).cast("long"), lambda m, x: m.bitwiseOR(x))


def pac_select(h: Column, bits: Column) -> Column:
    """The worlds of a hash in which a predicate holds."""
    return h.bitwiseAND(pack(bits))


def pac_select_cmp(op: str, h: Column, value: Column, counters: Column) -> Column:
    """Worlds of a hash in which `value op counter` holds; null if any argument is."""
    v = value.cast("float")
    mask = pack(F.transform(counters, lambda c: _CMP[op](v, c.cast("float"))))
    return F.when(value.isNotNull() & counters.isNotNull(), h.bitwiseAND(mask))


def pac_filter(bits: Column, config: PrivacyConfig, correction: float = 1.0, tag: str = "filter", keys=()) -> Column:
    """Whether a predicate over worlds passes: by majority if deterministic, else by a draw of one world."""
    pop = F.bit_count(pack(bits))
    if config.pac_mi <= 0:
        passes = pop * F.lit(float(correction)) >= 32
    else:
        n = max(1, int(64 / correction))
        passes = pop > F.floor(noise.uniform(config, tag, list(keys)) * n)
    return F.coalesce(bits.isNotNull() & (F.size(bits) > 0) & passes, F.lit(False))


def pac_filter_cmp(op: str, value: Column, counters: Column, config: PrivacyConfig, correction: float = 1.0, tag: str = "filter", keys=()) -> Column:
    v = value.cast("float")
    return pac_filter(F.transform(counters, lambda c: _CMP[op](v, c.cast("float"))), config, correction, tag, keys)


def _comparisons() -> dict:
    made = {}
    for op in _CMP:
        made[f"pac_select_{op}"] = lambda h, value, counters, op=op: pac_select_cmp(op, h, value, counters)
        made[f"pac_filter_{op}"] = lambda value, counters, config, correction=1.0, tag="filter", keys=(), op=op: pac_filter_cmp(op, value, counters, config, correction, tag, keys)
    return made


globals().update(_comparisons())

#: Counts have no outliers to clip.
pac_clip_count, pac_noised_clip_count = pac_count, pac_noised_count

__all__ = [
    "pac_count", "pac_sum", "pac_min", "pac_max", "pac_avg", "pac_sum_list", "pac_min_list", "pac_max_list", "pac_count_list",
    "pac_noised_count", "pac_noised_sum", "pac_noised_min", "pac_noised_max", "pac_noised_avg", "pac_div", "pac_mean", "pac_coalesce",
    "pac_noised_div", "pac_select", "pac_filter", "pac_clip_count", "pac_noised_clip_count", *_comparisons(),
]
