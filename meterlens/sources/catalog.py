"""Inputs stored as one folder of parquet tables, and the checks on them."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlens.session import apply_settings

#: Every input a report may ask for.
INPUTS = (
    "usage", "list_prices", "price_history", "account_prices", "query_history", "warehouse_events", "warehouses",
    "clusters", "pipelines", "jobs", "job_run_timeline", "served_entities", "workspaces", "user_groups",
    "app_registry", "machine_prices", "estimate_prices", "use_cases", "use_case_objects", "dashboards", "aws_bronze", "azure_bronze", "gcp_export",
)


def available(spark: SparkSession, path: str) -> bool:
    """Is this table there?  A missing optional input is not an error; one that cannot be read is."""
    try:
        spark.read.parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


class ParquetTables:
    """The same inputs as :class:`FixtureTables`, read from ``<root>/<name>``.

    Partition ``usage`` by ``usage_date`` and ``query_history`` by the start
    day: every report filters on those columns directly, so whole partitions
    are pruned.  An optional input that is absent reads as ``None``.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = apply_settings(spark)
        self.root = root

    def __getattr__(self, name: str) -> DataFrame | None:
        if name not in INPUTS:
            raise AttributeError(name)
        path = f"{self.root}/{name}"
        return self.spark.read.parquet(path) if available(self.spark, path) else None


def input_status(spark: SparkSession, tables: dict[str, str]) -> DataFrame:
    """L10 as a report: name, whether the table can be read, and its row count."""
    rows = None
    for name, path in tables.items():
        ok = available(spark, path)
        counted = (spark.read.parquet(path).agg(F.count("*").alias("row_count")) if ok
                   else spark.range(1).select(F.lit(None).cast("long").alias("row_count")))
        row = counted.select(F.lit(name).alias("name"), F.lit(ok).alias("exists"), "row_count")
        rows = row if rows is None else rows.unionByName(row)
    return rows
