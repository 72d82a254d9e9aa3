"""Tables from files, registered under their names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


_VIEWS: dict[str, dict[str, str]] = {}


def register_parquet(spark: SparkSession, folder: str, names: tuple[str, ...] = TABLES) -> None:
    """Temporary views over `folder`/name.parquet; only the columns and rows that a query needs are read.

    Reading a file's schema is a job of its own, so views that stand for the same files are kept."""
    for name in names:
        path, own = f"{folder}/{name}.parquet", _VIEWS.setdefault(spark.sparkContext.applicationId, {})
        if own.get(name) == path and spark.catalog.tableExists(name):
            continue
        own[name] = path
        spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(name)


def register_csv(spark: SparkSession, path: str, name: str, schema: str, **options) -> DataFrame:
    df = spark.read.schema(schema).options(**options).csv(path)
    df.createOrReplaceTempView(name)
    return df
