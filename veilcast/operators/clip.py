"""Outlier clipping: contributions of units are split in magnitude levels, and levels at the ends that too few units
support are dropped or scaled to the nearest supported one.

A unit contributes one value to a group, so the support of a level is its number of rows. Two aggregations do it: by
(group, sign, level), at most 60 rows a group, and then by group over those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import PrivacyConfig
from ..functions import noise, worlds
from ..functions.sqltext import CLIPPED
from ..plans.ir import Agg, Node
from .emit import Emitter, call, group_outputs

LEVELS = 30


def level_of(v: Column) -> Column:
    """0 below 256, then one level for each factor of 4."""
    magnitude = F.abs(v)
    bits = F.floor(F.log2(F.greatest(magnitude, F.lit(1.0)))).cast("int")
    return F.when(magnitude < 256, 0).otherwise(F.least(F.floor((bits - 4) / 2).cast("int"), F.lit(LEVELS - 1)))


def clip_branch(per_unit: DataFrame, keys: list[str], value: str, func: str, config: PrivacyConfig, counters: str, mask: str) -> DataFrame:
    """(keys, counters, mask): 64 counters of the values of per_unit, one row a (group, unit hash __h), with unsupported
    end levels clipped. Positive and negative values have levels of their own; levels between supported ones stay."""
    v = F.col(value).cast("double")
    rows = per_unit.filter(F.col(value).isNotNull()).withColumn("__neg", v < 0).withColumn("__level", level_of(v))
    h = F.col("__h")
    made = worlds.world_sums(h, v) if func == "sum" else [F.when(F.bit_or(h).isNotNull(), (F.max if func == "max" else F.min)(F.when(worlds.bit(h, j), v))) for j in range(worlds.WORLDS)]
    levels = rows.groupBy(*keys, "__neg", "__level").agg(F.count("*").alias("__n"), F.array(*made).alias("__c"), F.bit_or(h).alias("__m"))
    groups = levels.groupBy(*keys).agg(F.collect_list(F.struct("__neg", "__level", "__n", "__c", "__m")).alias("__l"))  # 60 at most
    good = lambda neg: F.transform(F.filter("__l", lambda x: (x["__neg"] == neg) & (x["__n"] >= int(config.pac_clip_support or 0))), lambda x: x["__level"])
    ends = groups.select("*", *[f(good(neg)).alias(name) for neg, a, b in ((False, "__p0", "__p1"), (True, "__q0", "__q1")) for f, name in ((F.array_min, a), (F.array_max, b))])

    def factor(x: Column) -> Column:
        first, last = F.when(x["__neg"], F.col("__q0")).otherwise(F.col("__p0")), F.when(x["__neg"], F.col("__q1")).otherwise(F.col("__p1"))
        nearest = F.greatest(first, F.least(last, x["__level"]))
        inside = x["__level"] == nearest
        factor_ = F.when(inside, F.lit(1.0)).when(F.lit(bool(config.pac_clip_scale)), F.pow(F.lit(4.0), (nearest - x["__level"]).cast("double")))
        return F.when(first.isNotNull(), factor_)  # without any supported level of its sign a value counts nowhere

    kept = ends.withColumn("__k", F.filter(F.transform("__l", lambda x: F.struct(factor(x).alias("f"), x["__c"].alias("c"), x["__m"].alias("m"))), lambda x: x["f"].isNotNull()))

    def world(j: Column) -> Column:
        values = F.transform("__k", lambda x: F.get(x["c"], j) * x["f"])
        if func == "sum":
            return F.aggregate(values, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
        return F.coalesce((F.array_max if func == "max" else F.array_min)(F.filter(values, lambda x: x.isNotNull())), F.lit(0.0))

    return kept.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(63)), world).alias(counters), F.aggregate("__k", F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x["m"])).alias(mask))


def pac_clip(df: DataFrame, keys: list[str], h: Column, value: Column, func: str, config: PrivacyConfig, noised: bool = False, correction: float = 1.0, tag: str | None = None) -> DataFrame:
    """(keys, value): clipped sum, min or max by group as 64 counters, or as one released answer.

    Rows are first summed (or reduced to their extreme) by unit, so that a level counts units."""
    unit = {"sum": F.sum, "min": F.min, "max": F.max}[func]
    per_unit = df.select(*keys, h.alias("__h"), value.cast("double").alias("__x")).filter("__h IS NOT NULL").groupBy(*keys, "__h").agg(unit("__x").alias("__x"))
    out = clip_branch(per_unit, keys, "__x", func, config, "__c", "__m")
    scale = 2.0 if func == "sum" else 1.0
    if noised:
        answer = noise.release(F.col("__c"), F.col("__m"), config, correction, scale, tag or f"clip_{func}", [F.col(k) for k in keys], func == "sum")
    else:
        factor = scale * (correction if func == "sum" else 1.0)
        answer = F.transform("__c", lambda c, j: F.when(F.call_function("shiftrightunsigned", F.col("__m"), j).bitwiseAND(F.lit(1).cast("long")) == 1, c * factor).otherwise(F.lit(0.0)))
    return out.select(*keys, answer.alias("value"))


class ClipCompiler(Emitter):
    """Trees with clipped aggregates from SQL text, which stand in the plan as any_value(named_struct(...)).r with their
    arguments: they are computed by group beside the other aggregates and joined by the group's keys."""

    @staticmethod
    def clipped(a: Agg) -> str | None:
        found = [f for f in CLIPPED if a.arg is not None and a.func == "any_value" and a.arg.text.replace("`", "").lower().startswith((f"(named_struct('f', '{f}',", f"named_struct('f', '{f}',", f"(struct('{f}' as f", f"struct('{f}' as f"))]
        return found[0] if found else None

    def aggregate(self, df: DataFrame, n: Node, extra: list[str] = ()) -> DataFrame:
        calls = [a for x, _ in n.exprs for a in x.aggs]
        if not any(map(self.clipped, calls)):
            return super().aggregate(df, n, extra)
        keys = [f"__g{k}" for k in range(len(n.groups))]
        rows = df.select("*", *[F.expr(g.text).alias(k) for k, g in zip(keys, n.groups)])
        plain = {f"__p{k}": a for k, a in enumerate(calls) if not self.clipped(a)}
        out = rows.groupBy(*keys).agg(F.count("*").alias("__n"), *[F.expr(call(a)).alias(name) for name, a in plain.items()])
        at = {id(a): name for name, a in plain.items()}
        for k, a in enumerate(calls):
            if func := self.clipped(a):
                own = rows.select(*keys, F.expr(a.arg.text).alias("__s"))
                correction = own.select("__s.c").limit(1).first()
                part = pac_clip(own.select(*keys, "__s.h", "__s.v"), keys, F.col("h"), F.col("v"), CLIPPED[func], self.config, "noised" in func, float(correction[0]) if correction else 1.0, f"{func}{k}")
                kind = {"pac_noised_clip_sumcount": "bigint"}.get(func)
                value = noise.whole(F.col("value")).cast(kind) if kind else F.col("value")
                tag = f"__k{k}_"
                named = part.select(*[F.col(c).alias(tag + c) for c in keys], F.struct(value.alias("r")).alias(f"__c{k}"))
                cond = F.lit(True)
                for c in keys:
                    cond = cond & F.col(c).eqNullSafe(F.col(tag + c))
                out = (out.join(named, cond, "left") if keys else out.crossJoin(F.broadcast(named))).drop(*[tag + c for c in keys])  # without groups, one row
                at[id(a)] = f"__c{k}"
        made = [F.expr(x.fill([f"`{at[id(a)]}`" for a in x.aggs])).alias(u) for x, u in n.exprs if x.aggs]
        return out.select("*", *made).select(*group_outputs(n))


def _named(func: str, noised: bool):
    def call(df: DataFrame, keys: list[str], h: Column, value: Column, config: PrivacyConfig, correction: float = 1.0) -> DataFrame:
        return pac_clip(df, keys, h, value, func, config, noised, correction)

    return call


pac_clip_sum, pac_clip_min, pac_clip_max = (_named(f, False) for f in ("sum", "min", "max"))
pac_noised_clip_sum, pac_noised_clip_min, pac_noised_clip_max = (_named(f, True) for f in ("sum", "min", "max"))
#: A count is the sum of each unit's count of rows.
pac_noised_clip_sumcount = pac_noised_clip_sum
