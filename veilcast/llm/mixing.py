"""Operator 10, mixing sources to target weights by iterative proportional fitting.

Token weights are summed by cell (source, language, topic), one aggregation with map-side combining.
Raking then scales the cell table in turn to each marginal, a fixed number of rounds; `residual` tells how far the marginals then
are from their targets, and a tolerance refuses a fit beyond it. The ratio of fitted to given weight is what a cell's
documents should count. A document is kept with probability min(1, c * ratio), with c such that the expected
tokens meet the budget. Draws hash the id, so they are the same in each run and each retried task. Documents are
read twice and never shuffled.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import require, stage_table

ITERATIONS = 20
BUDGET = 0.6  # share of all tokens that the sample should hold
#: Target shares are the given ones to this power, renormalised: 1 keeps them, 0 makes all equal.
TEMPER = {"source": 0.5, "lang": 0.5, "topic": 0.7}
MAX_CELLS = 200_000  # beyond it the same rounds run as DataFrame operations; sums agree to about 1e-9
SEED = "mix-1"
WORD = r"[^ \t\n\r\f\x0B]+"


def surface_topic(text):
    """A coarse topic from marks in the whole text; null texts are prose."""
    has = lambda mark: F.coalesce(F.contains(text, F.lit(mark)), F.lit(False))
    return F.when(has(" | "), "table").when(has("!!"), "notice").when(has("###") | has("***") | has("$$$"), "markup").otherwise("prose")


def draw(id_col: str, seed: str = SEED):
    """A uniform number in [0, 1) from the id."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / float(1 << 32)


def target_shares(share: dict[str, float], power: float, named: dict[str, float] | None) -> dict[str, float]:
    """Target shares of one dimension's values, from their given shares: those to this power, renormalised. Values that
    are named get what is named; the others divide the rest. Values without weight get nothing."""
    tempered = {v: s**power if s > 0 else 0.0 for v, s in share.items()}
    given = {v: x for v, x in (named or {}).items() if share.get(v, 0) > 0}
    if any(x < 0 for x in given.values()) or sum(given.values()) > 1 + 1e-9:
        raise ValueError(f"target weights must be at least 0 and at most 1 together, not {named}")
    rest = sum(s for v, s in tempered.items() if v not in given)
    free = 1 - sum(given.values()) if rest > 0 else 0.0
    out = {v: given[v] if v in given else s * free / rest if rest > 0 else 0.0 for v, s in tempered.items()}
    total = sum(out.values())
    return {v: s / total if total > 0 else 0.0 for v, s in out.items()}


def rake(cells: np.ndarray, weights: np.ndarray, targets: list[np.ndarray], iterations: int = ITERATIONS) -> np.ndarray:
    """Fitted weights of cells, given the code of each cell in each dimension and the targets of each dimension's codes."""
    fitted = weights.astype(np.float64).copy()
    for _ in range(iterations):
        for d, target in enumerate(targets):
            have = np.bincount(cells[:, d], weights=fitted, minlength=len(target))
            fitted *= np.divide(target, have, out=np.zeros_like(have), where=have > 0)[cells[:, d]]
    return fitted


def residual(cells: np.ndarray, fitted: np.ndarray, targets: list[np.ndarray]) -> float:
    """The largest distance of a marginal from its target, as a part of all weight."""
    off = [np.abs(np.bincount(cells[:, d], weights=fitted, minlength=len(t)) - t).max(initial=0) for d, t in enumerate(targets)]
    return float(max(off, default=0.0) / max(float(fitted.sum()), 1e-300))


def scale_for_budget(ratio: np.ndarray, weights: np.ndarray, budget: float) -> float:
    """c with sum(min(1, c * ratio) * weights) = budget * sum(weights), for a budget in (0, 1]."""
    order = np.argsort(-ratio, kind="stable")
    r, w = ratio[order], weights[order].astype(np.float64)
    full = np.concatenate([[0], np.cumsum(w)[:-1]])
    rest = np.cumsum((r * w)[::-1])[::-1]
    c = np.divide(budget * w.sum() - full, rest, out=np.full_like(rest, np.inf), where=rest > 0)
    ok = np.flatnonzero(c * r <= 1)
    return float(c[ok[0]]) if len(ok) else float(1 / r[r > 0].min())


def fit_distributed(cells: DataFrame, dims: list[str], tempers: list[float], named: list[dict | None], budget: float, iterations: int) -> tuple[DataFrame, float]:
    """As rake and scale_for_budget, for cell tables too large for one process: a stage table a round. c is bracketed until
    no cell's bound lies between, and then solved for. Also the residual."""
    total = cells.agg(F.sum("w")).first()[0]
    table, targets = cells.withColumn("x", F.col("w").cast("double")), []
    for d, power, given in zip(dims, tempers, named):
        share = cells.groupBy(d).agg(F.sum("w").alias("s")).withColumn("s", F.when(F.col("s") > 0, F.pow(F.col("s") / total, F.lit(power))).otherwise(0.0))
        want = F.lit(None).cast("double")
        for value, x in (given or {}).items():
            want = F.when((F.col(d) == value) & (F.col("s") > 0), F.lit(float(x))).otherwise(want)
        share = share.withColumn("want", want)
        fixed, rest = share.agg(F.coalesce(F.sum("want"), F.lit(0.0)), F.coalesce(F.sum(F.when(F.col("want").isNull(), F.col("s"))), F.lit(0.0))).first()
        part = F.coalesce("want", F.col("s") * ((1 - fixed) / rest if rest > 0 else 0.0)) / (1.0 if rest > 0 else max(fixed, 1e-300))
        targets.append(stage_table(share.select(d, (part * total).alias("goal")))[0])
    for _ in range(iterations):
        for d, goal in zip(dims, targets):
            have = table.groupBy(d).agg(F.sum("x").alias("have"))
            table = table.join(have, d).join(goal, d).withColumn("x", F.when(F.col("have") > 0, F.col("x") * F.col("goal") / F.col("have")).otherwise(0.0)).drop("have", "goal")
        table, _ = stage_table(table)
    off = [table.groupBy(d).agg(F.sum("x").alias("have")).join(goal, d).agg(F.max(F.abs(F.col("have") - F.col("goal")))).first()[0] or 0.0 for d, goal in zip(dims, targets)]
    table = table.withColumn("ratio", F.when(F.col("w") > 0, F.col("x") / F.col("w")).otherwise(0.0))
    most = table.agg(F.max("ratio"), F.min(F.when(F.col("ratio") > 0, F.col("ratio")))).first()
    low, high = 0.0, 1 / most[1] if most[1] else 1.0
    for _ in range(60):
        mid = (low + high) / 2
        got = table.agg(F.sum(F.least(F.lit(1.0), F.lit(mid) * F.col("ratio")) * F.col("w"))).first()[0] or 0.0
        low, high = (mid, high) if got < budget * total else (low, mid)
    full, part = table.agg(F.sum(F.when(F.col("ratio") * high > 1, F.col("w"))), F.sum(F.when(F.col("ratio") * high <= 1, F.col("ratio") * F.col("w")))).first()
    c = (budget * total - (full or 0)) / part if part else high
    return table.select(*dims, "ratio", F.least(F.lit(1.0), F.lit(float(c)) * F.col("ratio")).alias("probability")), max(off) / total if total else 0.0


def mix(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", temper: dict[str, float] | None = None, budget: float = BUDGET,
    iterations: int = ITERATIONS, seed: str = SEED, max_cells: int = MAX_CELLS, weight_col: str | None = None, topic_col: str | None = None,
    targets: dict[str, dict[str, float]] | None = None, tolerance: float | None = None,
) -> DataFrame:
    """df with n_words and topic, the cell's raking ratio and keep probability, and kept (boolean).

    A document weighs its words, or what the whole numbers of weight_col say (token counts, say; null is 0), which n_words
    then holds; its topic is that of its surface, or topic_col's. `targets` names target shares by dimension (source, lang, topic) and
    value; all else is as target_shares says. With a tolerance, marginals farther from their targets raise ValueError.

    A null source, language or topic is a value of its own, "(null)". Null and empty texts weigh nothing: their cells'
    ratio is that of the cell, 0 if it holds nothing else, and they are then kept by probability 0.
    Rows that share an id share its draw. An empty table gives an empty one. Existing columns of the new
    names are replaced, weight_col and topic_col among them if they have these names."""
    require(df, id_col, text_col, source_col, lang_col, *[c for c in (weight_col, topic_col) if c])
    powers = {**TEMPER, **(temper or {})}
    dims, names = ["__vc_source", "__vc_lang", "__vc_topic"], ["source", "lang", "topic"]
    tempers, named = [powers[n] for n in names], [(targets or {}).get(n) for n in names]
    text = F.col(text_col)
    weight = F.coalesce(F.col(weight_col), F.lit(0)) if weight_col else F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0))
    topic = F.coalesce(F.col(topic_col).cast("string"), F.lit("(null)")) if topic_col else surface_topic(text)
    made = ["n_words", "topic", "ratio", "probability", "kept"]
    base = [c for c in df.columns if c not in made]
    marked = df.withColumn("__vc_n", weight.cast("long")).withColumn("__vc_topic", topic)
    marked = marked.withColumn("__vc_source", F.coalesce(F.col(source_col).cast("string"), F.lit("(null)"))).withColumn("__vc_lang", F.coalesce(F.col(lang_col).cast("string"), F.lit("(null)")))
    marked = marked.select(*base, F.col("__vc_n").alias("n_words"), *dims)
    cells = marked.groupBy(*dims).agg(F.sum("n_words").alias("w"))
    found = cells.limit(max_cells + 1).collect()
    spark = df.sparkSession
    if len(found) > max_cells:
        fitted, off = fit_distributed(stage_table(cells)[0], dims, tempers, named, budget, iterations)
    else:
        found.sort(key=lambda r: tuple(r[d] for d in dims))
        codes, goals = np.zeros((len(found), len(dims)), np.int64), []
        weights = np.array([r["w"] for r in found], dtype=np.float64)
        total = float(weights.sum())
        for d, name in enumerate(dims):
            values, codes[:, d] = np.unique([r[name] for r in found], return_inverse=True) if found else (np.zeros(0, str), 0)
            share = np.bincount(codes[:, d], weights=weights, minlength=len(values)) / total if total > 0 else np.zeros(len(values))
            goal = target_shares(dict(zip(values.tolist(), share.tolist())), tempers[d], named[d])
            goals.append(np.array([goal[v] * total for v in values.tolist()]))
        ratio, c, off = np.zeros(len(found)), 0.0, 0.0
        if total > 0:
            raked = rake(codes, weights, goals, iterations)
            off = residual(codes, raked, goals)
            ratio = np.divide(raked, weights, out=ratio, where=weights > 0)
            c = scale_for_budget(ratio, weights, budget)
        rows = [(*[r[d] for d in dims], float(x), float(min(1.0, c * x))) for r, x in zip(found, ratio)]
        fitted = F.broadcast(spark.createDataFrame(rows, ", ".join(f"{d} string" for d in dims) + ", ratio double, probability double"))  # max_cells rows at most
    if tolerance is not None and off > tolerance:
        raise ValueError(f"after {iterations} rounds a marginal is off by {off:.3g} of all weight, more than {tolerance:.3g}")
    out = marked.join(fitted, dims, "left")
    out = out.withColumn("kept", draw(id_col, seed) < F.coalesce("probability", F.lit(0.0)))
    return out.select(*base, "n_words", F.col("__vc_topic").alias("topic"), "ratio", "probability", "kept")


def op10_raked_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "source", "lang", "topic", "n_words", F.round("ratio", 6).alias("ratio"), F.round("probability", 6).alias("probability"), "kept")


def oracle_sql() -> str:
    """The same fit as unrolled SQL: one common table for each scaling step."""
    dims, powers = ["source", "lang", "topic"], [TEMPER["source"], TEMPER["lang"], TEMPER["topic"]]
    steps = [
        rf"""marked AS (SELECT doc_id, coalesce(source, '(null)') AS source, coalesce(lang, '(null)') AS lang, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\f\x0B]+')) AS BIGINT) AS n_words,
  CASE WHEN contains(text, ' | ') THEN 'table' WHEN contains(text, '!!') THEN 'notice' WHEN contains(text, '###') OR contains(text, '***') OR contains(text, '$$$') THEN 'markup' ELSE 'prose' END AS topic FROM documents)""",
        "cells AS (SELECT source, lang, topic, CAST(sum(n_words) AS DOUBLE) AS w FROM marked GROUP BY ALL)", "total AS (SELECT sum(w) AS t FROM cells)",
        "x0 AS (SELECT *, w AS x FROM cells)",
    ]
    for d, p in zip(dims, powers):
        steps.append(f"g_{d} AS (SELECT {d}, t * s / sum(s) OVER () AS goal FROM (SELECT {d}, CASE WHEN sum(w) > 0 THEN pow(sum(w) / any_value(t), {p}) ELSE 0 END AS s, any_value(t) AS t FROM cells, total GROUP BY {d}))")
    k = 0
    for _ in range(ITERATIONS):
        for d in dims:
            k += 1
            steps.append(f"x{k} AS MATERIALIZED (SELECT source, lang, topic, w, CASE WHEN h > 0 THEN x * goal / h ELSE 0 END AS x FROM (SELECT *, sum(x) OVER (PARTITION BY {d}) AS h FROM x{k - 1}) JOIN g_{d} USING ({d}))")
    steps.append(f"fit AS (SELECT *, CASE WHEN w > 0 THEN x / w ELSE 0 END AS r FROM x{k})")
    steps.append("ranked AS (SELECT *, coalesce(sum(w) OVER (ORDER BY r DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(r * w) OVER (ORDER BY r DESC, source, lang, topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM fit)")
    steps.append(f"scale AS (SELECT coalesce(max((SELECT c FROM (SELECT ({BUDGET} * t - before) / rest AS c, r, before FROM ranked, total WHERE rest > 0) WHERE c * r <= 1 ORDER BY r DESC, before LIMIT 1)), 0) AS c)")
    return "WITH " + ",\n".join(steps) + f"""
SELECT doc_id, d.source, d.lang, m.topic, m.n_words, round(r, 6) AS ratio, round(least(1.0, c * r), 6) AS probability,
  CAST(CAST('0x' || substr(md5('{SEED}:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 < least(1.0, c * r) AS kept
FROM marked m JOIN fit f ON m.source = f.source AND m.lang = f.lang AND m.topic = f.topic JOIN documents d USING (doc_id), scale
"""
