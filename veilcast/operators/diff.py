"""The utility report: private and exact answers side by side, with the error of each cell."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import PrivacyError
from ..config import PrivacyConfig
from ..plans.ir import Node


def parse_diffcols(text: str) -> tuple[int | None, str | None]:
    """'N', 'N:path', 'true' or '/path' as (number of key columns or None for automatic, path or None)."""
    text = str(text)
    head, _, tail = text.partition(":")
    if head.isdigit():
        return int(head), tail or None
    return None, text if text.lower() != "true" else None


def automatic_keys(root: Node) -> int:
    """The groups of the topmost aggregate, unless they leave no measure."""
    for n in root.walk():
        if n.kind == "aggregate":
            return len(n.groups) if len(n.groups) < len(root.output) else 0
    return 0


def diff_cells(private: DataFrame, exact: DataFrame, n_keys: int) -> DataFrame:
    """Rows matched on the first n_keys columns (on position for 0): keys, and a relative error in percent for each number."""
    names = exact.columns
    if n_keys >= len(names):
        raise PrivacyError(f"pac_diffcols: {n_keys} key columns leave no measure of {len(names)} columns")
    p = private.toDF(*[f"__p{k}" for k in range(len(names))])
    r = exact.toDF(*[f"__r{k}" for k in range(len(names))])
    if n_keys:
        cond = F.lit(True)
        for k in range(n_keys):
            cond = cond & F.col(f"__p{k}").eqNullSafe(F.col(f"__r{k}"))
    else:
        at = W.orderBy(F.monotonically_increasing_id())  # by position: reports are small
        p, r = p.withColumn("__pn", F.row_number().over(at)), r.withColumn("__rn", F.row_number().over(at))
        cond = F.col("__pn") == F.col("__rn")
    both = r.withColumn("__ref", F.lit(True)).join(p.withColumn("__pac", F.lit(True)), cond, "full")
    only_ref, only_pac = F.col("__pac").isNull(), F.col("__ref").isNull()
    cols = []
    for k, f in enumerate(exact.schema.fields):
        a, b = F.col(f"__r{k}"), F.col(f"__p{k}")
        if k < n_keys:
            c = F.when(only_ref, F.lit(None)).when(only_pac, b).otherwise(a)
        elif isinstance(f.dataType, T.NumericType):
            x, y = a.cast("double"), b.cast("double")
            error = 100 * F.abs(x - y) / F.greatest(F.lit(1e-5), F.abs(x))
            c = F.when(only_pac, F.lit(None)).when(only_ref, F.lit(0.0)).when(a.isNull() & b.isNull(), F.lit(0.0)).when(a.isNull() | b.isNull(), F.lit(50.0)).otherwise(error).cast(f.dataType)
        else:
            c = F.coalesce(a, b)
        cols.append(c.alias(f.name))
    return both.select(*cols)


def summary(cells: DataFrame, n_keys: int) -> tuple[float, float, float]:
    """(utility, recall, precision): mean error of cells, share of exact rows found, share of private rows that are real."""
    keys, measures = cells.columns[:n_keys], [f.name for f in cells.schema.fields[n_keys:] if isinstance(f.dataType, T.NumericType)]
    missing = F.lit(True) if keys else F.lit(False)
    some = F.lit(False)
    for k in keys:
        missing, some = missing & F.col(f"`{k}`").isNull(), some | F.col(f"`{k}`").isNull()
    extra = F.lit(False)
    for m in measures:
        extra = extra | F.col(f"`{m}`").isNull()
    row = cells.select(
        F.sum((some & ~missing).cast("int")).alias("partial"), F.sum((missing & ~extra).cast("int")).alias("missing"), F.sum(extra.cast("int")).alias("extra"), F.count("*").alias("n"),
        *[F.avg(F.when(~extra & ~missing, F.col(f"`{m}`").cast("double"))).alias(f"m{k}") for k, m in enumerate(measures)],
    ).first()
    if row["partial"]:
        raise PrivacyError("pac_diffcols: a key with some null parts can't be matched")
    n, lost, more = row["n"] or 0, row["missing"] or 0, row["extra"] or 0
    matched = n - lost - more
    means = [row[f"m{k}"] for k in range(len(measures)) if row[f"m{k}"] is not None]
    utility = sum(means) / len(means) if means else 0.0
    return utility, matched / (matched + lost) if matched + lost else 1.0, matched / (matched + more) if matched + more else 1.0


def utility_diff(private: DataFrame, exact: DataFrame, root: Node, config: PrivacyConfig) -> DataFrame:
    n, path = parse_diffcols(config.pac_diffcols)
    n = automatic_keys(root) if n is None else n
    cells = diff_cells(private, exact, n)
    if path:
        line = ",".join(f"{x:.6g}" for x in summary(cells, n))
        new = not os.path.exists(path)
        with open(path, "a") as f:
            f.write(("utility,recall,precision\n" if new else "") + line + "\n")
    return cells
