"""Series helpers: roll-ups, summaries and calendar spines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from meterlens.operators.pricing import day

# fixed values: truncation unit per granularity (weeks start on Monday)
UNITS = {"daily": "day", "weekly": "week", "monthly": "month"}


def bucket(date: str | Column, granularity: str) -> Column:
    """First day of the bucket a date falls in."""
    column = F.col(date) if isinstance(date, str) else date
    return column if granularity == "daily" else F.trunc(column, UNITS[granularity])


def roll_up(series: DataFrame, granularity: str, average: bool = False) -> DataFrame:
    """Daily (date, value) to weeks or months, summed, or averaged for a rate."""
    how = F.avg if average else F.sum
    return (series.groupBy(bucket("date", granularity).alias("date")).agg(how("value").alias("value"))
            .orderBy("date"))


def summarize(series: DataFrame, positive_only: bool = False) -> DataFrame:
    """One row about a series.  P21: over its positive values only, where it has any."""
    values = series.select("date", F.col("value").cast("double").alias("value"))

    def pick(how, *extra) -> Column:
        whole = how("value", *extra)
        if not positive_only:
            return whole
        return F.coalesce(how(F.when(F.col("value") > 0, F.col("value")), *extra), whole)

    def first_last(how) -> Column:
        whole = how("value", "date")
        if not positive_only:
            return whole
        return F.coalesce(how("value", F.when(F.col("value") > 0, F.col("date"))), whole)
    s = values.agg(first_last(F.min_by).alias("first"), first_last(F.max_by).alias("last"), pick(F.min).alias("low"),
                   pick(F.max).alias("high"), pick(F.avg).alias("mean"))
    change = F.col("last") - F.col("first")
    percent = F.when(F.col("first") > 0, change / F.col("first") * 100).otherwise(F.lit(0.0))
    trend = F.when(F.abs(percent) < 5, "flat").when(percent > 0, "increasing").otherwise("decreasing")

    def out(c: Column, name: str) -> Column:
        return F.coalesce(F.round(c, 2), F.lit(0.0)).alias(name)
    return s.select(out(F.col("first"), "period_start_value"), out(F.col("last"), "period_end_value"),
                    out(change, "change_amount"), out(percent, "change_percent"), out(F.col("low"), "min_value"),
                    out(F.col("high"), "max_value"), out(F.col("mean"), "avg_value"),
                    F.coalesce(F.when(F.col("first").isNotNull(), trend), F.lit("flat")).alias("trend"))


def calendar(spark: SparkSession, start: str, end: str, name: str = "date") -> DataFrame:
    """One row per day, both ends included."""
    return spark.range(1).select(F.explode(F.sequence(day(start), day(end))).alias(name))


def burndown(daily: DataFrame, start: str, end: str, commit: float, as_of: str) -> DataFrame:
    """Cumulative spend of a contract against the ideal straight line.

    ``daily`` is (usage_date, total_spend).  The running sum covers the days of
    one contract, a few thousand rows at most.
    """
    until = F.least(day(as_of), day(end))
    total_days = F.datediff(day(end), day(start))
    spine = calendar(daily.sparkSession, start, end)
    spend = daily.filter(F.col("usage_date").between(day(start), until)).select(
        F.col("usage_date").alias("date"), F.col("total_spend").cast("double").alias("spend"))
    running = F.sum(F.coalesce("spend", F.lit(0.0))).over(W.orderBy("date").rowsBetween(W.unboundedPreceding, 0))
    ideal = F.datediff("date", day(start)) / total_days * F.lit(float(commit))
    return (spine.join(spend, "date", "left").withColumn("running", running)
            .select("date", F.when(F.col("date") <= until, F.round("running", 2)).alias("actual_cumulative"),
                    F.round(ideal, 2).alias("ideal_cumulative"))
            .orderBy("date"))


def burndown_kpis(daily: DataFrame, start: str, end: str, commit: float, as_of: str) -> DataFrame:
    """One row; pace is under below 0.95, on_pace up to 1.10, else over."""
    total = F.lit(float(commit))
    until = F.least(day(as_of), day(end))
    elapsed = F.greatest(F.datediff(until, day(start)), F.lit(1))
    spent = (daily.filter(F.col("usage_date").between(day(start), until))
             .agg(F.coalesce(F.sum(F.col("total_spend").cast("double")), F.lit(0.0)).alias("spent")))
    burn = F.col("spent") / elapsed
    days_left = (total - F.col("spent")) / burn
    projected = F.when(burn > 0, F.date_add(day(as_of), days_left.cast("int"))).otherwise(day(end))
    pace = F.col("spent") / (elapsed / F.datediff(day(end), day(start)) * total)
    return spent.select(
        total.alias("total_commit_usd"), F.round("spent", 2).alias("spent_to_date"),
        F.round(total - F.col("spent"), 2).alias("remaining"), elapsed.alias("days_elapsed"),
        F.greatest(F.datediff(day(end), day(as_of)), F.lit(0)).alias("days_remaining"),
        projected.alias("projected_end_date"),
        F.when(pace < 0.95, "under").when(pace <= 1.10, "on_pace").otherwise("over").alias("pace_status"))


def burndown_projection(daily: DataFrame, start: str, end: str, commit: float, as_of: str) -> DataFrame:
    """P22 plus a straight line from today's point to the projected end, capped at the commitment."""
    series = burndown(daily, start, end, commit, as_of)
    kpis = burndown_kpis(daily, start, end, commit, as_of)
    today = series.filter(F.col("date") == day(as_of)).select(F.max("actual_cumulative")).scalar()
    finish = kpis.select("projected_end_date").scalar()
    slope = F.try_divide(F.lit(float(commit)) - today, F.datediff(finish, day(as_of)))
    line = F.least(F.round(today + slope * F.datediff("date", day(as_of)), 2), F.lit(float(commit)))
    return series.withColumn("projected_cumulative", F.when(F.col("date") >= day(as_of), line))
