"""Daily marts: building, writing, keyed upsert, reading and freshness."""

from __future__ import annotations

from datetime import date, timedelta
from functools import reduce
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlens.functions import classify as C
from meterlens.operators.allocate import cost_per_query, started_in, tool_attribution
from meterlens.operators.pricing import day, metered, totals
from meterlens.plans.kpis import query_measures
from meterlens.plans.spend import categorised
from meterlens.sources.versions import Manifest, Store

#: Default history kept in the marts, in days.
LOOKBACK_DAYS = 730


def _effective():
    return F.sum("effective_spend").alias("effective_list_spend")


def daily_usage_summary(usage: DataFrame, prices: DataFrame, start: str, end: str) -> DataFrame:
    """L5."""
    return (metered(usage, prices, start, end, ["usage_date", "workspace_id"]).groupBy("usage_date")
            .agg(*totals(), _effective(), F.countDistinct("workspace_id").alias("workspace_count")))


def daily_product_breakdown(usage: DataFrame, prices: DataFrame, start: str, end: str) -> DataFrame:
    """L5 (2)."""
    return (categorised(usage, prices, start, end, C.product_category(), ["usage_date", "workspace_id"])
            .groupBy("usage_date", "product_category")
            .agg(*totals(), _effective(), F.countDistinct("workspace_id").alias("workspace_count")))


def daily_workspace_breakdown(usage: DataFrame, prices: DataFrame, workspaces: DataFrame, start: str, end: str) -> DataFrame:
    """L5 (3)."""
    return (metered(usage, prices, start, end, ["usage_date", "workspace_id"]).groupBy("usage_date", "workspace_id")
            .agg(*totals(), _effective()).join(workspaces, "workspace_id", "left")
            .select("usage_date", "workspace_id", "workspace_name", "total_dbus", "total_spend", "effective_list_spend"))


def daily_query_stats(history: DataFrame, start: str, end: str) -> DataFrame:
    """L5 (4)."""
    return started_in(history, start, end).groupBy(F.to_date("start_time").alias("usage_date")).agg(*query_measures())


def sql_tool_attribution(usage: DataFrame, prices: DataFrame, history: DataFrame, start: str, end: str) -> DataFrame:
    """A1 with all three cost measures."""
    return tool_attribution(usage, prices, history, start, end)


# fixed values: key of every mart
MART_KEYS = {
    "daily_usage_summary": ["usage_date"], "daily_product_breakdown": ["usage_date", "product_category"],
    "daily_workspace_breakdown": ["usage_date", "workspace_id"],
    "sql_tool_attribution": ["usage_date", "sql_product", "warehouse_id"], "daily_query_stats": ["usage_date"],
    "cost_per_query": ["usage_date", "statement_id", "warehouse_id"],
}


def build_marts(tables, start: str, end: str) -> dict[str, DataFrame]:
    """All daily marts of a window."""
    t = tables
    return {
        "daily_usage_summary": daily_usage_summary(t.usage, t.list_prices, start, end),
        "daily_product_breakdown": daily_product_breakdown(t.usage, t.list_prices, start, end),
        "daily_workspace_breakdown": daily_workspace_breakdown(t.usage, t.list_prices, t.workspaces, start, end),
        "sql_tool_attribution": sql_tool_attribution(t.usage, t.list_prices, t.query_history, start, end),
        "daily_query_stats": daily_query_stats(t.query_history, start, end),
        "cost_per_query": cost_per_query(t.usage, t.list_prices, t.query_history, start, end)
        .withColumn("usage_date", F.to_date("start_time")),
    }


# fixed values: columns whose daily totals a version records
MART_SUMS = {
    "daily_usage_summary": ["total_dbus", "total_spend"], "daily_product_breakdown": ["total_dbus", "total_spend"],
    "daily_workspace_breakdown": ["total_dbus", "total_spend"], "sql_tool_attribution": ["attributed_dbus", "attributed_spend"],
    "daily_query_stats": ["total_queries"], "cost_per_query": ["query_attributed_dollars_estimation"],
}


def history_window(as_of: str, days: int = LOOKBACK_DAYS) -> tuple[str, str]:
    """First and last day a mart keeps."""
    last = date.fromisoformat(as_of)
    return str(last - timedelta(days=days)), as_of


def refresh_marts(tables, root: str, as_of: str, days: int = LOOKBACK_DAYS) -> dict[str, Manifest]:
    """Build and write all daily marts over the history window."""
    marts = build_marts(tables, *history_window(as_of, days))
    return {name: write_mart(mart, root, name) for name, mart in marts.items()}


def _store(spark: SparkSession, root: str, name: str) -> Store:
    return Store(spark, f"{root}/{name}")


def write_mart(mart: DataFrame, root: str, name: str) -> Manifest:
    """Replace a mart in full, one folder per day, as a new version; rows without a day are no part of a mart."""
    return _store(mart.sparkSession, root, name).replace({name: mart}, {name: MART_SUMS[name]})


def upsert_mart(new_rows: DataFrame, root: str, name: str) -> Manifest:
    """Insert new keys, replace existing ones, keep the rest.

    Plain parquet has no row-level merge, so the days of the new rows are
    rewritten: old rows of those days whose key is not among the new ones are
    carried over; a null in a key equals a null.  The new rows are computed once,
    into a write that no version names and that goes afterwards.  Readers see
    the old version until the new one is complete.
    """
    store, keys = _store(new_rows.sparkSession, root, name), MART_KEYS[name]
    if store.current() is None:
        return write_mart(new_rows, root, name)
    staged = store.stage({name: new_rows})

    def merged(base: Manifest) -> dict[str, DataFrame]:
        fresh = store.open(name, manifest=Manifest(days=staged))
        if fresh is None:  # no rows, nothing to change
            return {}
        touched = staged[name].keys()
        old = store.open(name, min(touched), max(touched), base)
        if old is None:
            return {name: fresh}
        old = old.filter(F.col("usage_date").cast("string").isin(*touched))
        keyed = fresh.select(*[F.col(k).alias(f"_{k}") for k in keys])
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
        typed = fresh.select(*[F.col(f.name).cast(f.dataType) for f in old.schema.fields])
        return {name: old.join(keyed, same, "left_anti").unionByName(typed)}
    try:
        return store.change(merged, {name: MART_SUMS[name]})
    finally:
        store.discard(staged)


def _days(mart: DataFrame, start: str, end: str) -> DataFrame:
    return mart.filter(F.col("usage_date").between(day(start), day(end)))


def read_summary(mart: DataFrame, start: str, end: str) -> DataFrame:
    """L7.  The largest daily workspace count is not a distinct count over the range, and named accordingly."""
    return _days(mart, start, end).agg(
        F.sum("total_dbus").alias("total_dbus"), F.sum("total_spend").alias("total_spend"),
        F.max("workspace_count").alias("peak_daily_workspace_count"), F.countDistinct("usage_date").alias("days_in_range"),
        F.min("usage_date").alias("first_date"), F.max("usage_date").alias("last_date"))


def read_by_product(mart: DataFrame, start: str, end: str) -> DataFrame:
    """L7 (2)."""
    return (_days(mart, start, end).groupBy("product_category")
            .agg(F.sum("total_dbus").alias("total_dbus"), F.sum("total_spend").alias("total_spend"),
                 F.max("workspace_count").alias("peak_daily_workspace_count")).orderBy(F.desc("total_spend")))


def read_timeseries(mart: DataFrame, start: str, end: str) -> DataFrame:
    """L7 (3)."""
    return (_days(mart, start, end).select("usage_date", "product_category", "total_dbus", "total_spend")
            .orderBy("usage_date", "product_category"))


def read_by_workspace(mart: DataFrame, start: str, end: str) -> DataFrame:
    """L7 (4)."""
    return (_days(mart, start, end).groupBy("workspace_id")
            .agg(F.max("workspace_name").alias("workspace_name"), F.sum("total_dbus").alias("total_dbus"),
                 F.sum("total_spend").alias("total_spend")).orderBy(F.desc("total_spend")))


def read_tool_split(mart: DataFrame, start: str, end: str) -> DataFrame:
    """L7 (5)."""
    return (_days(mart, start, end).groupBy("sql_product")
            .agg(F.sum("attributed_dbus").alias("total_dbus"), F.sum("attributed_spend").alias("total_spend"))
            .orderBy(F.desc("total_spend")))


def read_etl(mart: DataFrame, start: str, end: str) -> DataFrame:
    """L7 (6)."""
    kind = (F.when(F.col("product_category") == "ETL - Streaming", "Streaming (SDP)")
             .when(F.col("product_category") == "ETL - Batch", "Batch Jobs"))
    return (_days(mart, start, end).withColumn("etl_type", kind).filter(F.col("etl_type").isNotNull()).groupBy("etl_type")
            .agg(F.sum("total_dbus").alias("total_dbus"), F.sum("total_spend").alias("total_spend"))
            .orderBy(F.desc("total_spend")))


def read_query_kpis(mart: DataFrame, start: str, end: str) -> DataFrame:
    """L7 (7); the user figure is the busiest day's."""
    sums = ["total_queries", "total_rows_read", "total_bytes_read", "total_compute_seconds"]
    return _days(mart, start, end).agg(*[F.sum(c).alias(c) for c in sums],
                                       F.max("unique_query_users").alias("peak_daily_query_users"))


def mart_or_live(mart_report: DataFrame | None, live: Callable[[], DataFrame], total: float | None) -> DataFrame:
    """The report on the mart, unless there is none or it adds up to nothing; then the live query.

    ``total`` comes with the version the report reads (:func:`mart_total`), so the choice runs no job.
    """
    return mart_report if mart_report is not None and total is not None and total > 0 else live()


def mart_total(spark: SparkSession, root: str, name: str, start: str, end: str, column: str = "total_spend") -> float | None:
    """The sum of a column over days of the current version, from its manifest."""
    manifest = _store(spark, root, name).current()
    return None if manifest is None else manifest.total(name, column, start, end)


def open_mart(spark: SparkSession, root: str, name: str, start: str | None = None, end: str | None = None) -> DataFrame | None:
    """The current version of a mart, or of some of its days."""
    return _store(spark, root, name).open(name, start, end)


def freshness_of(spark: SparkSession, root: str, names: list[str], as_of: str) -> DataFrame:
    """L9 for written marts, from their manifests alone."""
    rows = []
    for name in names:
        manifest = _store(spark, root, name).current()
        days = sorted(manifest.of(name)) if manifest else []
        ends = [date.fromisoformat(d) for d in days[:1] + days[-1:]]
        rows.append((name, manifest.rows(name) if manifest else 0, *(ends or [None, None]),
                     (date.fromisoformat(as_of) - ends[-1]).days if ends else None))
    return spark.createDataFrame(rows, "name string, row_count long, min_date date, max_date date, days_behind int")


def freshness(mart: DataFrame, name: str, as_of: str, date_column: str = "usage_date") -> DataFrame:
    """Rows, first and last day, and days behind."""
    last = F.to_date(F.max(date_column))
    return mart.agg(F.lit(name).alias("name"), F.count("*").alias("row_count"), F.to_date(F.min(date_column)).alias("min_date"),
                    last.alias("max_date"), F.datediff(day(as_of), last).alias("days_behind"))
