"""Users and groups (G)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlens.functions import classify as C
from meterlens.functions.shape import names_of, share_of_total, top, wide
from meterlens.operators.pricing import day, has_pipeline, in_window, metered, run_as


def _known_user() -> Column:
    return F.col("identity_metadata.run_as").isNotNull()


def _rows(usage: DataFrame, prices: DataFrame, start: str, end: str, dims: list[str | Column]) -> DataFrame:
    return metered(usage, prices, start, end, [run_as("user_email"), *dims], _known_user())


def _categorised(usage: DataFrame, prices: DataFrame, start: str, end: str, category: Column, dims: list[str | Column]) -> DataFrame:
    rows = _rows(usage, prices, start, end, ["billing_origin_product", "sku_name", has_pipeline(), *dims])
    return rows.withColumn("product_category", category)


def summary(usage: DataFrame, prices: DataFrame, start: str, end: str) -> DataFrame:
    """G1."""
    per_user = _rows(usage, prices, start, end, []).groupBy("user_email").agg(F.sum("spend").alias("s"), F.sum("dbus").alias("d"))
    return (per_user.agg(F.count("*").alias("user_count"), F.sum("s").alias("total_spend"), F.sum("d").alias("total_dbus"))
            .withColumn("avg_spend_per_user", F.try_divide(F.col("total_spend").cast("double"), F.col("user_count"))))


def by_spend(usage: DataFrame, prices: DataFrame, start: str, end: str) -> DataFrame:
    """G2."""
    return (_rows(usage, prices, start, end, ["usage_date", "workspace_id"]).groupBy("user_email")
            .agg(F.sum("spend").alias("total_spend"), F.sum("dbus").alias("total_dbus"),
                 F.countDistinct("usage_date").alias("active_days"), F.countDistinct("workspace_id").alias("workspace_count"))
            .orderBy(F.desc("total_spend"), "user_email"))


def _user_category(usage: DataFrame, prices: DataFrame, start: str, end: str) -> DataFrame:
    return (_categorised(usage, prices, start, end, C.product_category(), [])
            .groupBy("user_email", "product_category").agg(F.sum("spend").alias("spend")))


def by_category(usage: DataFrame, prices: DataFrame, start: str, end: str, limit: int | None = 5000) -> DataFrame:
    """The report lists at most ``limit`` rows; roll-ups (G4, G12) need them all, ``limit=None``."""
    return top(_user_category(usage, prices, start, end), "spend", limit, "user_email", "product_category")


def primary_product(categories: DataFrame) -> DataFrame:
    """The largest category of each user in a G3 report."""
    best = F.max_by("product_category", F.struct("spend", "product_category"))
    return categories.groupBy("user_email").agg(best.alias("primary_product"))


def daily_of_top_users(usage: DataFrame, prices: DataFrame, start: str, end: str, users: int = 6) -> DataFrame:
    """Daily spend of the largest users, from one scan.

    The largest users are found from the daily amounts and meet them again; both ask for the same shuffle, which Spark runs
    once.  No task holds the days of more than the listed users.
    """
    daily = _rows(usage, prices, start, end, ["usage_date"]).select("user_email", "usage_date", F.col("spend").alias("daily_spend"))
    listed = top(daily.groupBy("user_email").agg(F.sum("daily_spend").alias("total")), "total", users, "user_email").select("user_email")
    shown = daily.join(F.broadcast(listed), "user_email").select(F.col("usage_date").alias("date"), "user_email", "daily_spend")
    return shown.repartition(1).orderBy("date", F.desc("daily_spend"))  # a row per listed user and day


def daily_of_top_users_wide(daily: DataFrame, users: list[str] | None = None) -> DataFrame:
    """G5, one column per listed user (at most six names)."""
    return wide(daily, "date", "user_email", "daily_spend", users or names_of(daily, "user_email"))


def by_workspace(usage: DataFrame, prices: DataFrame, start: str, end: str, limit: int = 20) -> DataFrame:
    """G6."""
    spaces = (_rows(usage, prices, start, end, ["workspace_id"]).groupBy("workspace_id")
              .agg(F.countDistinct("user_email").alias("user_count"), F.sum("spend").alias("total_spend")))
    return top(spaces, "total_spend", limit, "workspace_id")


def _workspace_detail(usage: DataFrame, prices: DataFrame, start: str, end: str) -> DataFrame:
    return (_categorised(usage, prices, start, end, C.group_report_category(), ["workspace_id"])
            .groupBy("workspace_id", "user_email", "product_category").agg(F.sum("spend").alias("spend")))


def workspace_detail(usage: DataFrame, prices: DataFrame, start: str, end: str, limit: int | None = 2000) -> DataFrame:
    """G7; roll-ups (G8) need every row, ``limit=None``."""
    return top(_workspace_detail(usage, prices, start, end), "spend", limit, "workspace_id", "user_email", "product_category")


def group_rollup(detail: DataFrame, user_groups: DataFrame) -> DataFrame:
    """A G7 report by group.

    A user's spend counts in every group they are in, and the percentages use
    that total; ``distinct_spend`` is the same for all rows and counts each
    user once.  The nested list has one entry per workspace of the group, with
    its products by spend.
    """
    member = user_groups.select("user_email", "group_name").distinct()
    rows = detail.join(member, "user_email")
    # users are folded away before anything is collected
    cells = rows.groupBy("group_name", "workspace_id", "product_category").agg(F.sum("spend").alias("spend"))
    by_product = cells.groupBy("group_name", "product_category").agg(F.sum("spend").alias("spend"))
    best = by_product.groupBy("group_name").agg(
        F.max_by("product_category", F.struct("spend", "product_category")).alias("primary_product"))
    products = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("spend")).alias("o"), "product_category", "spend"))),
                           lambda p: F.struct(p["product_category"].alias("product"), p["spend"].alias("spend")))
    spaces = cells.groupBy("group_name", "workspace_id").agg(F.sum("spend").alias("spend"), products.alias("products"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("spend")).alias("o"), "workspace_id", "spend", "products"))),
                         lambda w: F.struct(w["workspace_id"].alias("workspace_id"), w["spend"].alias("spend"),
                                            w["products"].alias("products")))
    groups = spaces.groupBy("group_name").agg(F.sum("spend").alias("total_spend"), listed.alias("workspaces"))
    members = rows.groupBy("group_name").agg(F.countDistinct("user_email").alias("member_count"))
    once = detail.join(member, "user_email", "left_semi").select(F.sum(F.col("spend").cast("double"))).scalar()
    out = groups.join(members, "group_name").join(best, "group_name")
    return (share_of_total(out, "total_spend").withColumn("distinct_spend", once)
            .select("group_name", "total_spend", "member_count", "primary_product", "workspaces", "percentage", "distinct_spend")
            .orderBy(F.desc("total_spend"), "group_name"))


def ungrouped(detail: DataFrame, user_groups: DataFrame) -> DataFrame:
    """Spend of users in no group, by workspace."""
    return (detail.join(user_groups.select("user_email").distinct(), "user_email", "left_anti")
            .groupBy("workspace_id").agg(F.sum("spend").alias("spend")).orderBy(F.desc("spend"), "workspace_id"))


def middle_day(start: str, end: str) -> str:
    """Last day of the first half of a window."""
    first, last = date.fromisoformat(start), date.fromisoformat(end)
    return (first + (last - first) / 2).isoformat()


def spend_growth(usage: DataFrame, prices: DataFrame, start: str, end: str) -> DataFrame:
    """First against second half of the window; null when the first half is 0."""
    early = (F.col("usage_date") <= day(middle_day(start, end))).alias("early")
    rows = metered(usage, prices, start, end, [early], _known_user())

    def half(keep: Column) -> Column:
        return F.coalesce(F.sum(F.when(keep, F.col("spend"))).cast("double"), F.lit(0.0))
    halves = rows.agg(half(F.col("early")).alias("first_half"), half(~F.col("early")).alias("second_half"))
    growth = F.round((F.col("second_half") - F.col("first_half")) / F.col("first_half") * 100, 1)
    return halves.withColumn("spend_growth_pct", F.when(F.col("first_half") > 0, growth))


def user_growth(usage: DataFrame, start: str, end: str) -> DataFrame:
    """Active and new users per month; a user is folded to the set of their months."""
    rows = in_window(usage, start, end).filter(_known_user()).select(F.trunc("usage_date", "month").alias("m"), run_as("user")).distinct()
    months = rows.groupBy("user").agg(F.array_sort(F.collect_set("m")).alias("months"))
    pairs = months.select(F.posexplode("months").alias("position", "m"))
    new = F.sum(F.when(F.col("position") == 0, 1).otherwise(0))
    return (pairs.groupBy("m").agg(F.count("*").alias("active_users"), new.alias("new_users"))
            .select(F.date_format("m", "yyyy-MM").alias("month"), "active_users", "new_users").orderBy("month"))


def weekly_report(users: DataFrame, limit: int = 10) -> DataFrame:
    """The first rows of a G2 report."""
    return top(users, "total_spend", limit, "user_email").select("user_email", "total_spend", "active_days")


def product_totals(categories: DataFrame) -> DataFrame:
    """A G3 report by product."""
    return (categories.groupBy(F.col("product_category").alias("product")).agg(F.sum("spend").alias("spend"))
            .orderBy(F.desc("spend"), "product"))


def top_users_of_product(categories: DataFrame, product: str, limit: int = 5) -> DataFrame:
    """The largest users of one product."""
    rows = categories.filter((F.col("product_category") == product) & (F.col("spend") > 0)).select("user_email", "spend")
    return top(rows, "spend", limit, "user_email")
