"""Pricing of metered usage (K1, K2, K3) and price-list operators (V1-V5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlens.operators.intervals import join_intervals

#: Sums of quantities.  A price has up to 7 digits before the point; times a quantity of up to 18 digits it is exact.
QUANTITY = "decimal(38,12)"
PRICE = "decimal(19,12)"


def day(value: str | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("date")


def in_window(usage: DataFrame, start: str, end: str) -> DataFrame:
    """Records of the window, both ends included, with a positive quantity."""
    return usage.filter(F.col("usage_date").between(day(start), day(end)) & (F.col("usage_quantity") > 0))


def open_prices(prices: DataFrame) -> DataFrame:
    """The open price rows, renamed for joining.

    Two open rows for one SKU double the usage that matches them, as in any
    left join; the price uniqueness check guards the table.
    """
    default = F.col("pricing.default")
    return (prices.filter(F.col("price_end_time").isNull())
            .select(F.col("sku_name").alias("_sku"), F.col("cloud").alias("_cloud"),
                    default.alias("_list"),
                    F.coalesce(F.col("pricing.effective_list.default"), default).alias("_effective")))


def with_price(rows: DataFrame, prices: DataFrame, sku: str = "sku_name", cloud: str = "cloud") -> DataFrame:
    """Left join of the open price; a missing price is 0.

    No broadcast hint: a price list is far below the broadcast threshold, so
    Spark picks a broadcast join from its measured size, and beyond the
    threshold the adaptive shuffled join splits a hot SKU by itself.
    """
    p = open_prices(prices)
    zero = F.lit(0).cast(PRICE)
    return (rows.join(p, (rows[sku] == p._sku) & (rows[cloud] == p._cloud), "left")
            .withColumn("price", F.coalesce(F.col("_list").cast(PRICE), zero))
            .withColumn("effective_price", F.coalesce(F.col("_effective").cast(PRICE), zero))
            .withColumn("has_price", F.col("_list").isNotNull())
            .drop("_sku", "_cloud", "_list", "_effective"))


def priced_usage(usage: DataFrame, prices: DataFrame, start: str, end: str) -> DataFrame:
    """K1 row by row: every record of the window with its price and spend."""
    return (with_price(in_window(usage, start, end), prices)
            .withColumn("spend", spend_of(usage, "price")))


def spend_of(rows: DataFrame, price: str) -> Column:
    """Quantity times price, not rounded before the 17th decimal.

    A decimal has 38 digits, so Spark cuts the decimals of a product of wide ones: a quantity stored as decimal(38,18) would
    lose all beyond the ninth.  Such a quantity is multiplied in two parts, whole and fraction, whose products are exact.
    """
    quantity, kind = F.col("usage_quantity"), rows.schema["usage_quantity"].dataType
    if not isinstance(kind, T.DecimalType) or kind.precision <= 18:
        return quantity * F.col(price)
    fraction = quantity % F.lit(1)
    whole = (quantity - fraction).cast("decimal(18,0)") * F.col(price)
    rest = fraction.cast("decimal(18,18)") * F.col(price)
    return whole.cast("decimal(37,18)") + rest.cast("decimal(37,18)")


def metered(usage: DataFrame, prices: DataFrame, start: str, end: str, dims: list[str | Column],
            where: Column | None = None, positive: bool = True, priced: bool = False) -> DataFrame:
    """K1 pre-aggregated: one row per dims with dbus, spend, effective_spend and records.

    Quantities are summed per dims, SKU and cloud in the scan stage, and the sums are priced: all records of such a group
    have one price, so the exact decimals are those of pricing each record, at a product per group.  What is shuffled
    is one row per task and group, whatever the size of the price list, and a hot SKU, workspace or user costs nothing
    extra.  ``priced`` also groups by ``has_price``.
    """
    rows = usage.filter(F.col("usage_date").between(day(start), day(end)))
    if positive:
        rows = rows.filter(F.col("usage_quantity") > 0)
    if where is not None:
        rows = rows.filter(where)
    keys = [F.col(d) if isinstance(d, str) else d for d in dims]
    names = rows.select(*keys).columns
    sums = (rows.groupBy(*keys, F.col("sku_name").alias("_of_sku"), F.col("cloud").alias("_of_cloud"))
            .agg(F.sum("usage_quantity").alias("usage_quantity"), F.count("*").alias("_records")))
    if priced:
        names.append("has_price")
    return with_price(sums, prices, "_of_sku", "_of_cloud").groupBy(*names).agg(
        F.sum("usage_quantity").cast(QUANTITY).alias("dbus"), F.coalesce(F.sum("_records"), F.lit(0)).alias("records"),
        F.sum(spend_of(sums, "price")).alias("spend"), F.sum(spend_of(sums, "effective_price")).alias("effective_spend"))


def totals() -> list[Column]:
    """The two sums almost every report carries."""
    return [F.sum("dbus").alias("total_dbus"), F.sum("spend").alias("total_spend")]


def has_pipeline() -> Column:
    return F.col("usage_metadata.dlt_pipeline_id").isNotNull().alias("has_pipeline")


def meta(name: str) -> Column:
    return F.col(f"usage_metadata.{name}").alias(name)


def run_as(name: str = "run_as") -> Column:
    return F.col("identity_metadata.run_as").alias(name)


def effective_price(pricing: str = "pricing") -> Column:
    """K2."""
    return F.coalesce(F.col(f"{pricing}.effective_list.default"), F.col(f"{pricing}.default"), F.lit(0))


def with_price_as_of(usage: DataFrame, price_history: DataFrame, as_of: str, match_cloud: bool = True) -> DataFrame:
    """K3: the USD price valid when the usage ended.

    Equi join on SKU, unit, cloud and time bucket with the validity interval as
    a residual, so a record meets the versions around its time only.  The interval is closed at
    both ends: usage ending exactly at a version change matches both versions.
    An open interval ends the day after ``as_of``.  Price lists carry one row
    per cloud, so the cloud is part of the key unless ``match_cloud`` is off.
    """
    p = price_history.filter(F.col("currency_code") == "USD").select(
        F.col("sku_name").alias("_sku"), F.col("cloud").alias("_cloud"), F.col("usage_unit").alias("_unit"),
        F.col("pricing.default").cast(PRICE).alias("as_of_price"), F.col("price_start_time").alias("_from"),
        F.coalesce("price_end_time", F.date_add(day(as_of), 1).cast("timestamp")).alias("_to"))
    keys = [("sku_name", "_sku"), ("usage_unit", "_unit"), *([("cloud", "_cloud")] if match_cloud else [])]
    return join_intervals(usage, p, keys, "usage_end_time", "_from", "_to").drop("_sku", "_cloud", "_unit", "_from", "_to")


def price_list(prices: DataFrame, as_of: str) -> DataFrame:
    """V1: prices that are open or end after ``as_of``."""
    still_valid = F.col("price_end_time").isNull() | (F.col("price_end_time") > F.lit(as_of).cast("timestamp"))
    effective = (F.col("pricing.effective_list.default")
                 if "effective_list" in prices.schema["pricing"].dataType.names else F.lit(None).cast(PRICE))
    return (prices.filter(still_valid)
            .select("sku_name", "cloud", "currency_code", "usage_unit", F.col("pricing.default").alias("list_price"),
                    effective.alias("effective_list_price"), F.col("price_start_time").alias("start_time"),
                    F.col("price_end_time").alias("end_time"))
            .orderBy("sku_name", "cloud"))


def negotiated_price_list(account_prices: DataFrame | None, prices: DataFrame, as_of: str) -> DataFrame:
    """V2: the negotiated list where there is one, else V1."""
    return price_list(prices if account_prices is None else account_prices, as_of)


def price_multiplier(usage: DataFrame, prices: DataFrame, account_prices: DataFrame, as_of: str,
                     days: int = 30) -> DataFrame:
    """V3 and V4: usage-weighted ratio of negotiated to list price, over SKUs that have both.

    Usage is summed per SKU and cloud before either price join.
    """
    since = F.date_sub(day(as_of), days)
    recent = (usage.filter((F.col("usage_date") >= since) & (F.col("usage_date") <= day(as_of))
                           & (F.col("usage_quantity") > 0))
              .groupBy("sku_name", "cloud").agg(F.sum("usage_quantity").cast(QUANTITY).alias("quantity")))

    def price_of(table: DataFrame, name: str) -> DataFrame:
        p = open_prices(table)
        return p.filter(F.col("_list") > 0).select(F.col("_sku").alias("sku_name"), F.col("_cloud").alias("cloud"),
                                                   F.col("_list").cast(PRICE).alias(name))
    both = (recent.join(price_of(prices, "lp"), ["sku_name", "cloud"])
            .join(price_of(account_prices, "ap"), ["sku_name", "cloud"]))
    sums = both.agg(F.sum(F.col("quantity") * F.col("ap")).alias("weighted_account_spend"),
                    F.sum(F.col("quantity") * F.col("lp")).alias("weighted_list_spend"),
                    F.countDistinct("sku_name").alias("sku_count"))
    ratio = F.try_divide(F.col("weighted_account_spend").cast("double"), F.col("weighted_list_spend").cast("double"))
    return sums.select(ratio.alias("multiplier"), "sku_count", "weighted_list_spend", "weighted_account_spend",
                       F.round((1 - ratio) * 100, 2).alias("discount_percent"))


def apply_multiplier(report: DataFrame, multiplier: DataFrame, columns: list[str]) -> DataFrame:
    """V5: scale the spend columns of a report; quantities stay.

    The multiplier is a one-row frame used as a scalar subquery; without a
    multiplier the report is unchanged.
    """
    factor = F.coalesce(multiplier.select("multiplier").scalar(), F.lit(1.0))
    return report.withColumns({c: F.col(c).cast("double") * factor for c in columns})
