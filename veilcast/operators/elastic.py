"""The second mode: clipped inputs and Laplace noise calibrated by elastic sensitivity."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Link, PrivacyCatalog, PrivacyError, plain
from ..config import PrivacyConfig
from ..functions.noise import dp_laplace_noise
from ..plans.ir import Agg, Node
from .emit import Emitted, Emitter, group_outputs

ALLOWED = {"sum", "count", "avg"}


def max_frequency(spark: SparkSession, table: str, columns: tuple[str, ...]) -> int:
    """The most rows of a whole base table that share a link value; 0 for an empty table."""
    counts = spark.table(table).groupBy(*[F.col(f"`{c}`") for c in columns]).count()
    return int(counts.agg(F.max("count")).first()[0] or 0)


def smooth_sensitivity(frequencies: list[int], epsilon: float, delta: float) -> float:
    """2 * max over k of prod(mf + k) * exp(-beta k), beta = epsilon / (2 ln(2 / delta))."""
    if not 0 < delta <= 0.5:
        raise PrivacyError("dp_delta must be positive and at most 0.5")
    beta = epsilon / (2 * math.log(2 / delta))
    k = np.arange(int(max(1000, min(len(frequencies) / beta + 200, 1e5))) + 1, dtype=np.float64)
    log = -beta * k
    for mf in frequencies:
        log = log + np.log(np.maximum(mf + k, 1e-300))
    return float(2 * np.exp(log.max()))


class ElasticCompiler(Emitter):
    _frequencies: dict = {}

    def __init__(self, spark: SparkSession, catalog: PrivacyCatalog, config: PrivacyConfig):
        super().__init__(spark, catalog, config)
        self.compile = lambda n: self.emit(n, set()).df

    def chain(self, root: Node) -> list[Link]:
        """The links from the farthest scanned table to the one privacy unit."""
        tables = [plain(n.table) for n in root.walk() if n.kind == "scan" and n.table]
        if len(tables) != len(set(tables)):
            raise PrivacyError("dp_elastic: self-joins are not supported")
        scanned = [t for t in tables if self.catalog.is_pu(t)]
        if len(scanned) > 1:
            raise PrivacyError("dp_elastic: expected exactly one privacy unit table")
        units = {u for t in tables for u in self.catalog.units_of(t)}
        if len(units) > 1:
            raise PrivacyError("dp_elastic: the query touches multiple privacy unit tables")
        unit = next(iter(units))
        longest: list[Link] = []
        start = unit
        for t in tables:
            if t == unit:
                continue
            path = self.catalog.path_to(t, unit)
            if path is None:
                raise PrivacyError(f"dp_elastic: table '{t}' has no PRIVACY_LINK path to '{unit}'")
            if len(path) > len(longest):
                longest, start = path, t
        on_chain = {start, unit, *[plain(x.table) for x in longest]}
        for t in tables:
            if t not in on_chain:
                raise PrivacyError("dp_elastic: star/diamond joins are not supported; all tables must lie on one chain")
        self.start = start
        return longest

    def sensitivity(self, links: list[Link]) -> float:
        found, at = [], self.start
        for link in links:
            found.append(max_frequency(self.spark, at, link.local))
            at = link.table
        if self.config.dp_delta is None:
            return float(math.prod(found)) if found else 1.0
        return smooth_sensitivity(found, self.config.dp_epsilon, self.config.dp_delta)

    def compile_root(self, root: Node) -> DataFrame:
        cfg = self.config
        if not (cfg.dp_epsilon > 0 and math.isfinite(cfg.dp_epsilon)):
            raise PrivacyError("dp_epsilon must be a positive finite number")
        targets = [n for n in root.walk() if n.kind == "aggregate"]
        if len(targets) != 1:
            raise PrivacyError("dp_elastic: expected exactly one aggregate")
        self.target = targets[0]
        for x, _ in self.target.exprs:
            for a in x.aggs:
                if a.distinct:
                    raise PrivacyError("dp_elastic: DISTINCT aggregates are not supported")
                if a.func not in ALLOWED:
                    raise PrivacyError("dp_elastic: only COUNT, SUM, and AVG are supported")
                if a.func in ("sum", "avg") and cfg.dp_sum_bound is None:
                    raise PrivacyError("dp_sum_bound must be set for SUM and AVG")
        self.es = self.sensitivity(self.chain(root))
        return self.emit(root, set()).df

    def emit(self, n: Node, units: set[str]) -> Emitted:
        return Emitted(self.noised(n)) if n is getattr(self, "target", None) else super().emit(n, units)

    def noised(self, n: Node) -> DataFrame:
        cfg = self.config
        calls: list[Agg] = [a for x, _ in n.exprs for a in x.aggs]
        off = cfg.privacy_noise is False
        bound = float(cfg.dp_sum_bound or 0)
        spread = len(calls) if len(calls) > 1 else 1
        rows = self.emit(n.children[0], set()).df
        rows = rows.select("*", *[F.expr(g.text).alias(f"__g{k}") for k, g in enumerate(n.groups)])
        keys = [f"__g{k}" for k in range(len(n.groups))]
        cols, scales, outs = [], {}, {}
        for k, a in enumerate(calls):
            where = F.expr(a.where.fill()) if a.where else F.lit(True)
            doubled = 2 if a.func == "avg" else 1
            count_scale = 0.0 if off else self.es / cfg.dp_epsilon * spread * doubled
            if a.func in ("sum", "avg"):
                v = F.expr(a.arg.fill())
                clipped = F.when(where, F.greatest(F.least(v.cast("double"), F.lit(bound)), F.lit(-bound)).cast(a.arg.type.lower()))
                cols.append(F.sum(clipped).alias(f"__s{k}"))
                scales[f"__s{k}"] = count_scale * bound
            if a.func == "count":
                v = F.lit(1) if a.arg is None else F.expr(a.arg.fill())
                cols.append(F.count(F.when(where, v)).alias(f"__c{k}"))
                scales[f"__c{k}"] = count_scale
            if a.func == "avg":
                cols.append(F.count(F.when(where, F.lit(1))).alias(f"__c{k}"))
                scales[f"__c{k}"] = count_scale
        df = rows.groupBy(*keys).agg(*(cols or [F.count("*").alias("__n")]))
        group_keys = [F.col(c) for c in keys]
        for name, scale in scales.items():
            df = df.withColumn(name + "x", dp_laplace_noise(F.col(name), scale, cfg, name, group_keys))
        tau = cfg.privacy_min_group_count
        if tau is not None:
            for k, a in enumerate(calls):
                for name in [f"__s{k}"] if a.func == "sum" else [f"__c{k}"]:
                    df = df.filter(F.abs(F.col(name + "x")) >= float(tau) * math.sqrt(2) * scales[name])
        for k, a in enumerate(calls):
            if a.func == "avg":
                outs[k] = F.col(f"__s{k}x") / F.greatest(F.col(f"__c{k}x"), F.lit(1.0))
            else:
                x = F.col(f"__{'s' if a.func == 'sum' else 'c'}{k}x")
                outs[k] = F.rint(x).cast("long") if a.type.upper() in ("BIGINT", "INT") else x.cast(a.type.lower())
        df = df.select("*", *[c.alias(f"__o{k}") for k, c in outs.items()])
        k, made = 0, []
        for x, u in n.exprs:
            if x.aggs:
                made.append(F.expr(x.fill([f"`__o{k + i}`" for i in range(len(x.aggs))])).alias(u))
                k += len(x.aggs)
        return df.select("*", *made).select(*group_outputs(n))
