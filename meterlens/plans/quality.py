"""Reconciliation checks (D).  Each is one row: check, status and its figures.

Statuses are pass, fail, or info for checks that only report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlens.functions import classify as C
from meterlens.functions.shape import one_row
from meterlens.operators.allocate import tool_work, warehouse_cost, work_shares
from meterlens.operators.pricing import metered
from meterlens.plans.spend import categorised

# fixed values: tolerances, in percent
SUM_TOLERANCE = 0.01
UNPRICED_TOLERANCE = 5.0
DUPLICATE_TOLERANCE = 1.0
DAY_TOLERANCE = 0.01


def _named(df: DataFrame, check: str, status: Column) -> DataFrame:
    return df.select(F.lit(check).alias("check"), status.alias("status"), "*")


def _passes(ok: Column) -> Column:
    return F.when(F.coalesce(ok, F.lit(False)), "pass").otherwise("fail")


def _percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(100 * part.cast("double"), whole.cast("double")), F.lit(0.0))


def ground_truth(usage: DataFrame, prices: DataFrame, start: str, end: str) -> DataFrame:
    """Passes when the window has data."""
    rows = metered(usage, prices, start, end, ["usage_date", "workspace_id"])
    facts = rows.agg(F.sum("spend").alias("total_spend"), F.sum("dbus").alias("total_dbus"),
                     F.coalesce(F.sum("records"), F.lit(0)).alias("total_rows"),
                     F.countDistinct("workspace_id").alias("workspace_count"), F.countDistinct("usage_date").alias("days_in_range"))
    return _named(facts, "ground_truth", _passes(F.col("total_rows") > 0))


def _completeness(check: str, whole: DataFrame, parts: DataFrame, name: str) -> DataFrame:
    both = one_row(whole, parts)
    gap = F.col("ground_truth_spend").cast("double") - F.col(name).cast("double")
    facts = (both.withColumn("difference", gap)
             .withColumn("difference_pct", _percent(F.abs("difference"), F.col("ground_truth_spend"))))
    return _named(facts, check, _passes(F.col("difference_pct") <= SUM_TOLERANCE))


def _truth(usage: DataFrame, prices: DataFrame, start: str, end: str) -> DataFrame:
    return metered(usage, prices, start, end, []).agg(F.sum("spend").alias("ground_truth_spend"))


def product_completeness(usage: DataFrame, prices: DataFrame, start: str, end: str) -> DataFrame:
    """D2."""
    products = (categorised(usage, prices, start, end, C.product_category(), []).groupBy("product_category")
                .agg(F.sum("spend").alias("s")).agg(F.sum("s").alias("product_sum_spend"), F.count("*").alias("category_count")))
    return _completeness("product_completeness", _truth(usage, prices, start, end), products, "product_sum_spend")


def workspace_completeness(usage: DataFrame, prices: DataFrame, start: str, end: str) -> DataFrame:
    """D3: only workspaces with an id add up, so usage without one shows as a gap."""
    spaces = (metered(usage, prices, start, end, ["workspace_id"]).filter(F.col("workspace_id").isNotNull())
              .groupBy("workspace_id").agg(F.sum("spend").alias("s"))
              .agg(F.sum("s").alias("workspace_sum_spend"), F.count("*").alias("workspace_count")))
    return _completeness("workspace_completeness", _truth(usage, prices, start, end), spaces, "workspace_sum_spend")


def price_coverage(usage: DataFrame, prices: DataFrame, start: str, end: str) -> DataFrame:
    """D4."""
    rows = metered(usage, prices, start, end, [], priced=True)

    def total(name: str, keep: Column | None = None) -> Column:
        return F.coalesce(F.sum(F.col(name) if keep is None else F.when(keep, F.col(name))), F.lit(0))
    priced = F.col("has_price")
    facts = rows.agg(total("records").alias("total_rows"), total("records", priced).alias("priced_rows"),
                     total("records", ~priced).alias("unpriced_rows"), total("dbus").alias("total_dbus"),
                     total("dbus", ~priced).alias("unpriced_dbus"))
    facts = (facts.withColumn("unpriced_row_pct", _percent(F.col("unpriced_rows"), F.col("total_rows")))
             .withColumn("unpriced_dbu_pct", _percent(F.col("unpriced_dbus"), F.col("total_dbus"))))
    return _named(facts, "price_coverage", _passes(F.col("unpriced_dbu_pct") <= UNPRICED_TOLERANCE))


def null_attribution(usage: DataFrame, prices: DataFrame, start: str, end: str) -> DataFrame:
    """D5."""
    known = None
    for name in ("cluster_id", "warehouse_id", "job_id", "dlt_pipeline_id", "endpoint_name"):
        present = F.col(f"usage_metadata.{name}").isNotNull()
        known = present if known is None else known | present
    rows = metered(usage, prices, start, end, [known.alias("known")])
    facts = rows.agg(F.sum("records").alias("total_rows"), F.sum("spend").alias("total_spend"),
                     F.coalesce(F.sum(F.when(~F.col("known"), F.col("records"))), F.lit(0)).alias("fully_unattributed_rows"),
                     F.coalesce(F.sum(F.when(~F.col("known"), F.col("spend"))), F.lit(0)).alias("unattributed_spend"))
    facts = facts.withColumn("unattributed_pct", _percent(F.col("unattributed_spend"), F.col("total_spend")))
    return _named(facts, "null_attribution", F.lit("info"))


def duplicate_prices(prices: DataFrame) -> DataFrame:
    """SKU and cloud pairs with more than one open price."""
    price = F.col("pricing.default")
    return (prices.filter(F.col("price_end_time").isNull()).groupBy("sku_name", "cloud")
            .agg(F.count("*").alias("active_prices"), F.min(price).alias("min_price"), F.max(price).alias("max_price"))
            .filter(F.col("active_prices") > 1).orderBy("sku_name", "cloud"))


def price_uniqueness(prices: DataFrame) -> DataFrame:
    """D6."""
    found = duplicate_prices(prices).agg(F.countDistinct("sku_name").alias("duplicate_price_skus"), F.count("*").alias("duplicate_pairs"))
    return _named(found, "price_uniqueness", _passes(F.col("duplicate_pairs") == 0))


def sql_attribution(usage: DataFrame, prices: DataFrame, history: DataFrame, start: str, end: str) -> DataFrame:
    """Attributed against billed SQL cost; a gap is expected, as cost on days without queries is not attributed.

    What is attributed of a (day, warehouse) cost is the cost times the shares
    of its tools, so one pass over the bill gives both sides.
    """
    keys = ["usage_date", "warehouse_id"]
    shares = work_shares(tool_work(history, start, end, C.sql_tool()), keys).groupBy(*keys).agg(F.sum("share").alias("share"))
    rows = warehouse_cost(usage, prices, start, end).join(shares, keys, "left")

    def attributed(name: str) -> Column:
        return F.coalesce(F.sum(F.col(name).cast("double") * F.col("share")), F.lit(0.0))
    facts = rows.agg(F.sum("spend").cast("double").alias("billing_spend"), F.sum("dbus").cast("double").alias("billing_dbus"),
                     attributed("spend").alias("attributed_spend"), attributed("dbus").alias("attributed_dbus"))
    facts = (facts.withColumn("difference", F.col("billing_spend") - F.col("attributed_spend"))
             .withColumn("difference_pct", _percent(F.col("difference"), F.col("billing_spend"))))
    return _named(facts, "sql_attribution", F.lit("info"))


def history_duplicates(history: DataFrame) -> DataFrame:
    """Counted per statement first, so the distinct count needs no second pass."""
    per_statement = history.groupBy("statement_id").agg(F.count("*").alias("n"))
    facts = per_statement.agg(F.sum("n").alias("total_rows"), F.count("statement_id").alias("unique_statements"))
    facts = (facts.withColumn("duplicate_rows", F.col("total_rows") - F.col("unique_statements"))
             .withColumn("duplicate_pct", _percent(F.col("duplicate_rows"), F.col("total_rows"))))
    return _named(facts, "query_history_duplicates", _passes(F.col("duplicate_pct") <= DUPLICATE_TOLERANCE))


def mart_mismatches(mart: DataFrame, live: DataFrame) -> DataFrame:
    """Days on which the mart and a live summary differ, or that only one of them has."""
    m = mart.select("usage_date", F.col("total_spend").cast("double").alias("mv_spend"))
    l = live.select("usage_date", F.col("total_spend").cast("double").alias("live_spend"))
    both = l.join(m, "usage_date", "full_outer").na.fill(0.0, ["live_spend", "mv_spend"])
    gap = F.col("live_spend") - F.col("mv_spend")
    return both.withColumn("difference", gap).withColumn("matches", F.abs(gap) <= DAY_TOLERANCE)


def mart_vs_live(mart: DataFrame, live: DataFrame) -> DataFrame:
    """D9."""
    facts = mart_mismatches(mart, live).agg(
        F.count("*").alias("total_dates_compared"), F.count(F.when(~F.col("matches"), 1)).alias("mismatched_dates"))
    return _named(facts, "mv_vs_live", _passes(F.col("mismatched_dates") == 0))
