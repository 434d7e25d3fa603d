"""Day-over-day anomalies and alerts (N)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from meterlens.functions.shape import top
from meterlens.operators.pricing import day, metered

# fixed values: severity bounds and list lengths
HIGH_CHANGE = 50
LISTED_CHANGES = 20
LISTED_OBJECTS = 10


def daily_spend(usage: DataFrame, prices: DataFrame, start: str, end: str) -> DataFrame:
    return metered(usage, prices, start, end, ["usage_date"]).groupBy("usage_date").agg(F.sum("spend").alias("daily_spend"))


def day_changes(daily: DataFrame) -> DataFrame:
    """Each day against the previous day *that has spend rows*.

    The window spans all days, so it sees one row per day of the range and
    nothing more.  A previous spend of 0 gives a null percent.
    """
    previous = F.lag("daily_spend").over(W.orderBy("usage_date"))
    change = F.col("daily_spend") - F.col("prev_day_spend")
    percent = F.try_divide(100.0 * change.cast("double"), F.col("prev_day_spend").cast("double"))
    return (daily.withColumn("prev_day_spend", previous).filter(F.col("prev_day_spend").isNotNull())
            .withColumn("change_amount", change).withColumn("change_percent", percent))


def spend_anomalies(usage: DataFrame, prices: DataFrame, start: str, end: str, limit: int = LISTED_CHANGES) -> DataFrame:
    """The largest changes, rounded to 2 decimals; days after a day without spend are left out."""
    rows = day_changes(daily_spend(usage, prices, start, end)).filter(F.col("prev_day_spend") > 0)
    rows = rows.withColumn("change_percent", F.round("change_percent", 2))
    return top(rows, F.abs("change_percent"), limit, "usage_date")


def spend_spikes(usage: DataFrame, prices: DataFrame, as_of: str, threshold_percent: float = 20.0,
                 days_back: int = 7) -> DataFrame:
    """Days whose change reaches the threshold, up or down."""
    start = F.date_sub(day(as_of), days_back)
    rows = day_changes(daily_spend(usage, prices, start, as_of))
    size = F.abs("change_percent")
    return (rows.filter(size >= threshold_percent)
            .withColumn("alert_type", F.lit("spike"))
            .withColumn("severity", F.when(size > HIGH_CHANGE, "high").otherwise("medium"))
            .orderBy(size.desc(), "usage_date"))


def threshold_breaches(usage: DataFrame, prices: DataFrame, as_of: str, threshold: float, days_back: int = 7) -> DataFrame:
    """Days above a fixed amount."""
    start = F.date_sub(day(as_of), days_back)
    limit = F.lit(float(threshold))
    return (daily_spend(usage, prices, start, as_of).filter(F.col("daily_spend") > limit)
            .select("usage_date", "daily_spend", limit.alias("threshold"),
                    (F.col("daily_spend").cast("double") - limit).alias("excess_amount"),
                    F.lit("threshold").alias("alert_type"), F.lit("high").alias("severity"))
            .orderBy(F.desc("daily_spend"), "usage_date"))


def _dimension(name: str) -> Column:
    return F.col("usage_metadata.cluster_id") if name == "cluster_id" else F.col(name)


def day_breakdown(usage: DataFrame, prices: DataFrame, usage_date: str, dimension: str, limit: int = LISTED_OBJECTS) -> DataFrame:
    """One day by SKU, cluster or workspace; cluster rows need a cluster."""
    key = _dimension(dimension)
    where = key.isNotNull() if dimension == "cluster_id" else None
    rows = metered(usage, prices, usage_date, usage_date, [key.alias("key")], where)
    grouped = rows.groupBy(F.col("key").alias(dimension)).agg(F.sum("dbus").alias("dbus"), F.sum("spend").alias("spend"))
    return top(grouped, "spend", limit, dimension)


def alert_details(usage: DataFrame, prices: DataFrame, usage_date: str, previous_date: str | None = None,
                  limit: int = LISTED_OBJECTS) -> DataFrame:
    """N4 for all three dimensions, for the day and its previous day, from one scan of those days.

    Records are collapsed before each row is counted for its three dimensions.
    """
    days = [d for d in (usage_date, previous_date) if d is not None]
    dimensions = ("sku_name", "cluster_id", "workspace_id")

    def entry(dimension: str) -> Column:
        row = F.struct(F.lit(dimension).alias("dimension"), F.col(dimension).cast("string").alias("key"))
        return F.when(F.col("cluster_id").isNotNull(), row) if dimension == "cluster_id" else row
    period = F.when(F.col("usage_date") == day(usage_date), "current").otherwise("previous").alias("period")
    collapsed = metered(usage, prices, min(days), max(days), [period, *[_dimension(d).alias(d) for d in dimensions]],
                        F.col("usage_date").isin(*[date.fromisoformat(d) for d in days]))
    keys = ["period", "dimension", "key"]
    grouped = (collapsed.select("period", "dbus", "spend", F.explode(F.array(*map(entry, dimensions))).alias("e"))
               .filter(F.col("e").isNotNull()).select("period", "e.*", "dbus", "spend")
               .groupBy(*keys).agg(F.sum("dbus").alias("dbus"), F.sum("spend").alias("spend")))
    # the id breaks ties as in the report of one dimension, where workspaces sort as numbers
    number = F.when(F.col("dimension") == "workspace_id", F.col("key").cast("long"))
    rank = F.row_number().over(W.partitionBy("period", "dimension").orderBy(F.desc("spend"), number, "key"))
    return grouped.withColumn("rank", rank).filter(F.col("rank") <= limit).select(*keys, "dbus", "spend").orderBy("period", "dimension", F.desc("spend"))


def spike_alert(usage: DataFrame, prices: DataFrame, as_of: str, threshold_percent: float) -> DataFrame:
    """One row; all null when the day before ``as_of`` did not spike."""
    rows = day_changes(daily_spend(usage, prices, F.date_sub(day(as_of), 2), as_of))
    hit = rows.filter((F.col("usage_date") == F.date_sub(day(as_of), 1)) & (F.abs("change_percent") >= threshold_percent))
    return hit.agg(F.max("usage_date").alias("alert_date"), F.max("daily_spend").alias("current_spend"),
                   F.max("prev_day_spend").alias("previous_spend"), F.max("change_percent").alias("percent_change"))


def daily_threshold_alert(usage: DataFrame, prices: DataFrame, as_of: str, threshold: float) -> DataFrame:
    """A row when the day before ``as_of`` spent more than the threshold, else none."""
    yesterday = F.date_sub(day(as_of), 1)
    spent = daily_spend(usage, prices, yesterday, yesterday).agg(
        F.max("usage_date").alias("alert_date"), F.sum("daily_spend").alias("daily_spend"))
    return (spent.filter(F.col("daily_spend") > threshold)
            .withColumn("threshold", F.lit(float(threshold)))
            .withColumn("excess_amount", F.col("daily_spend").cast("double") - threshold))


def workspace_threshold_alert(usage: DataFrame, prices: DataFrame, as_of: str, threshold: float, days_back: int = 7,
                              limit: int = LISTED_OBJECTS) -> DataFrame:
    """Workspaces above a threshold over the last days."""
    rows = metered(usage, prices, F.date_sub(day(as_of), days_back), as_of, ["workspace_id", "usage_date"])
    spaces = (rows.groupBy("workspace_id").agg(F.sum("spend").alias("workspace_spend"),
                                               F.countDistinct("usage_date").alias("days_active"))
              .filter(F.col("workspace_spend") > threshold)
              .select("workspace_id", "workspace_spend", F.lit(float(threshold)).alias("threshold"), "days_active"))
    return top(spaces, "workspace_spend", limit, "workspace_id")
