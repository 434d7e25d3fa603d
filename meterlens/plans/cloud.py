"""Cloud invoices: silver and gold tables (L2-L4) and reports on them (X)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlens.functions import classify as C
from meterlens.functions.shape import names_of, top, wide
from meterlens.operators.pricing import day

# fixed values: silver column -> invoice column
AWS_COLUMNS = {
    "billing_period_start": "bill_billing_period_start_date", "billing_period_end": "bill_billing_period_end_date",
    "payer_account_id": "bill_payer_account_id", "usage_account_id": "line_item_usage_account_id",
    "resource_id": "line_item_resource_id", "product_code": "line_item_product_code", "product_name": "product_product_name",
    "usage_type": "line_item_usage_type", "operation": "line_item_operation",
    "availability_zone": "line_item_availability_zone", "region": "product_region",
    "instance_type": "product_instance_type", "instance_family": "product_instance_type_family",
    "operating_system": "product_operating_system", "tenancy": "product_tenancy",
    "cluster_id": "resource_tags_user_cluster_id", "cluster_name": "resource_tags_user_cluster_name",
    "warehouse_id": "resource_tags_user_warehouse_id", "job_id": "resource_tags_user_job_id",
    "instance_pool_id": "resource_tags_user_instance_pool_id", "cluster_creator": "resource_tags_user_creator",
    "cost_center": "resource_tags_user_cost_center", "environment": "resource_tags_user_environment",
    "project": "resource_tags_user_project", "team": "resource_tags_user_team",
}
LINKS = ["cluster_id", "cluster_name", "warehouse_id", "job_id", "instance_pool_id", "cluster_creator"]
AWS_COSTS = ["unblended_cost", "net_unblended_cost", "blended_cost", "amortized_cost", "net_amortized_cost"]


def aws_silver(bronze: DataFrame) -> DataFrame:
    """L2: renamed invoice lines with charge type and five cost measures; tax lines are dropped.

    Dropping tax with a negated list also drops lines without a type.  The
    savings-plan part of amortised cost is the commitment of the billing period
    on each line, so that figure is an upper bound.
    """
    def first(*names: str) -> Column:
        return F.coalesce(*[F.col(n) for n in names], F.lit(0))
    unblended = first("line_item_unblended_cost")
    net = first("line_item_net_unblended_cost", "line_item_unblended_cost")
    reserved, committed = "reservation_amortized_upfront_cost_for_usage", "savings_plan_amortized_upfront_commitment_for_billing_period"
    net_reserved = "reservation_net_amortized_upfront_cost_for_usage"
    net_committed = "savings_plan_net_amortized_upfront_commitment_for_billing_period"
    lines = bronze.filter(F.col("line_item_usage_start_date").isNotNull() & (F.col("line_item_line_item_type") != "Tax"))
    return lines.select(
        F.to_date("line_item_usage_start_date").alias("usage_date"),
        F.date_trunc("hour", "line_item_usage_start_date").alias("usage_hour"),
        *[F.col(source).alias(name) for name, source in AWS_COLUMNS.items()],
        C.invoice_charge_type(F.col("line_item_line_item_type"), F.col("product_product_family")).alias("charge_type"),
        F.coalesce("pricing_term", F.lit("OnDemand")).alias("pricing_term"),
        F.col("line_item_currency_code").alias("currency_code"), F.col("line_item_usage_amount").alias("usage_amount"),
        F.col("line_item_normalized_usage_amount").alias("normalized_usage_amount"),
        unblended.alias("unblended_cost"), net.alias("net_unblended_cost"), first("line_item_blended_cost").alias("blended_cost"),
        (unblended + first(reserved) + first(committed)).alias("amortized_cost"),
        (net + first(net_reserved, reserved) + first(net_committed, committed)).alias("net_amortized_cost"),
        F.col("reservation_effective_cost").alias("ri_effective_cost"),
        F.col("savings_plan_savings_plan_effective_cost").alias("sp_effective_cost"), "_loaded_at")


def aws_gold(silver: DataFrame) -> DataFrame:
    """L3: daily costs per account, machine, charge type, tags and billed object."""
    keys = ["usage_date", "usage_account_id", "region", "charge_type", "pricing_term", "instance_type", "instance_family",
            "cost_center", "environment", "project", "team"]
    grouped = silver.groupBy(*keys, *LINKS, "currency_code").agg(
        *[F.sum(c).alias(c) for c in AWS_COSTS], F.sum("usage_amount").alias("total_usage_amount"),
        F.count("*").alias("line_item_count"))
    return grouped.select(*keys[:7], F.struct(*LINKS).alias("usage_metadata"), *keys[7:], *AWS_COSTS, "total_usage_amount",
                          "line_item_count", "currency_code")


def azure_gold(bronze: DataFrame, tag_prefix: str = "tag_") -> DataFrame:
    """L4: daily costs straight from the export.

    The machine size is read out of the JSON text, and rows are grouped by that
    size rather than by the raw text, which would split a day into lines again.
    """
    size = F.regexp_extract(F.coalesce("AdditionalInfo", F.lit("")), '"ServiceType":"([^"]+)"', 1)
    tags = {"cluster_id": "cluster_id", "cluster_name": "cluster_name", "warehouse_id": "warehouse_id", "job_id": "job_id",
            "instance_pool_id": "instance_pool_id", "cluster_creator": "creator"}
    lines = bronze.filter(F.col("Date").isNotNull()).select(
        F.col("Date").alias("usage_date"), F.col("SubscriptionId").alias("subscription_id"),
        F.col("SubscriptionName").alias("subscription_name"), F.col("ResourceGroup").alias("resource_group"),
        F.col("ResourceLocation").alias("location"), C.meter_charge_type(F.col("MeterCategory")).alias("charge_type"),
        F.coalesce("PricingModel", F.lit("OnDemand")).alias("pricing_model"), F.col("MeterCategory").alias("meter_category"),
        F.col("MeterSubCategory").alias("meter_subcategory"), F.col("ConsumedService").alias("consumed_service"),
        size.alias("vm_size"), F.regexp_extract(size, "^(Standard_[A-Z]+)", 1).alias("instance_family"),
        *[F.col(tag_prefix + t).alias(n) for n, t in tags.items()], F.col("CostCenter").alias("cost_center"),
        *[F.lit(None).cast("string").alias(n) for n in ("environment", "project", "team")],
        "CostInBillingCurrency", "CostInUsd", "EffectivePrice", "UnitPrice", "Quantity", "BillingCurrency")
    before = ["usage_date", "subscription_id", "subscription_name", "resource_group", "location", "charge_type",
              "pricing_model", "meter_category", "meter_subcategory", "consumed_service", "vm_size", "instance_family"]
    after = ["cost_center", "environment", "project", "team"]
    grouped = lines.groupBy(*before, *LINKS, *after).agg(
        F.sum("CostInBillingCurrency").alias("cost_in_billing_currency"), F.sum("CostInUsd").alias("cost_in_usd"),
        F.avg("EffectivePrice").alias("effective_price"), F.avg("UnitPrice").alias("unit_price"),
        F.sum("Quantity").alias("total_quantity"), F.count("*").alias("line_item_count"),
        F.max("BillingCurrency").alias("currency_code"))
    return grouped.select(*before, F.struct(*LINKS).alias("usage_metadata"), *after, "cost_in_billing_currency", "cost_in_usd",
                          "effective_price", "unit_price", "total_quantity", "line_item_count", "currency_code")


def _range(gold: DataFrame, start: str, end: str) -> DataFrame:
    """Invoice reports leave the end day out."""
    return gold.filter((F.col("usage_date") >= day(start)) & (F.col("usage_date") < day(end)))


def _days(name: str) -> Column:
    return F.countDistinct("usage_date").alias(name)


def _link(name: str) -> Column:
    return F.col(f"usage_metadata.{name}")


def aws_summary(gold: DataFrame, start: str, end: str) -> DataFrame:
    """X1."""
    return _range(gold, start, end).agg(
        F.sum("unblended_cost").alias("total_unblended"), F.sum("net_unblended_cost").alias("total_net_unblended"),
        F.sum("amortized_cost").alias("total_amortized"), F.sum("net_amortized_cost").alias("total_net_amortized"),
        F.countDistinct(_link("cluster_id")).alias("cluster_count"),
        F.countDistinct(_link("warehouse_id")).alias("warehouse_count"), _days("days_in_range"))


def by_cluster(gold: DataFrame, start: str, end: str, cost: str = "net_unblended_cost", limit: int = 100) -> DataFrame:
    """X2, and X8 with the other cloud's cost column."""
    def part(kind: str, name: str) -> Column:
        return F.sum(F.when(F.col("charge_type") == kind, F.col(cost)).otherwise(0)).alias(name)
    rows = (_range(gold, start, end).filter(_link("cluster_id").isNotNull()).groupBy(_link("cluster_id").alias("cluster_id"))
            .agg(part("Compute", "compute_cost"), part("Storage", "storage_cost"), part("Networking", "network_cost"),
                 F.sum(cost).alias("total_cost"), _days("days_active")))
    return top(rows, "total_cost", limit, "cluster_id")


def by_warehouse(gold: DataFrame, start: str, end: str, cost: str = "net_unblended_cost", limit: int = 50) -> DataFrame:
    """X3, X8."""
    rows = (_range(gold, start, end).filter(_link("warehouse_id").isNotNull())
            .groupBy(_link("warehouse_id").alias("warehouse_id")).agg(F.sum(cost).alias("total_cost"), _days("days_active")))
    return top(rows, "total_cost", limit, "warehouse_id")


def aws_by_charge_type(gold: DataFrame, start: str, end: str) -> DataFrame:
    """X4."""
    measures = ["unblended_cost", "net_unblended_cost", "amortized_cost", "net_amortized_cost"]
    return (_range(gold, start, end).groupBy("charge_type").agg(*[F.sum(m).alias(m) for m in measures])
            .orderBy(F.desc("net_unblended_cost")))


def charge_series(gold: DataFrame, start: str, end: str, cost: str = "net_unblended_cost") -> DataFrame:
    """Day x charge type."""
    return (_range(gold, start, end).groupBy(F.col("usage_date").alias("date"), "charge_type")
            .agg(F.sum(cost).alias("daily_cost")).orderBy("date", "charge_type"))


def series_wide(series: DataFrame, names: str, labels: list[str] | None = None) -> DataFrame:
    """One column per label, 0 filled."""
    return wide(series, "date", names, "daily_cost", labels or names_of(series, names))


def aws_daily(gold: DataFrame, start: str, end: str) -> DataFrame:
    """X6."""
    shown = {"unblended": "unblended_cost", "net_unblended": "net_unblended_cost", "amortized": "amortized_cost",
             "net_amortized": "net_amortized_cost"}
    return (_range(gold, start, end).groupBy(F.col("usage_date").alias("date"))
            .agg(*[F.sum(c).alias(n) for n, c in shown.items()]).orderBy("date"))


def azure_summary(gold: DataFrame, start: str, end: str) -> DataFrame:
    """X7."""
    return _range(gold, start, end).agg(
        F.sum("cost_in_billing_currency").alias("total_cost"), F.sum("cost_in_usd").alias("total_cost_usd"),
        F.countDistinct(_link("cluster_id")).alias("cluster_count"),
        F.countDistinct(_link("warehouse_id")).alias("warehouse_count"), _days("days_in_range"))


def azure_by_charge_type(gold: DataFrame, start: str, end: str) -> DataFrame:
    """X9."""
    return (_range(gold, start, end).groupBy("charge_type")
            .agg(F.sum("cost_in_billing_currency").alias("total_cost"), F.sum("cost_in_usd").alias("total_cost_usd"))
            .orderBy(F.desc("total_cost")))


def azure_by_pricing_model(gold: DataFrame, start: str, end: str) -> DataFrame:
    """X9, second result."""
    return (_range(gold, start, end).groupBy("pricing_model").agg(F.sum("cost_in_billing_currency").alias("total_cost"))
            .orderBy(F.desc("total_cost")))


def _gcp(export: DataFrame, start: str, end: str) -> DataFrame:
    """Positive lines of the range by a plain timestamp filter; credits are left out."""
    begun = F.col("usage_start_time")
    return (export.filter((begun >= day(start).cast("timestamp")) & (begun < day(end).cast("timestamp")) & (F.col("cost") > 0))
            .select(F.to_date(begun).alias("date"), F.col("service.description").alias("service"),
                    F.col("sku.description").alias("sku"), F.col("project.id").alias("project_id"),
                    F.col("project.name").alias("project_name"), "cost", "currency"))


def gcp_summary(export: DataFrame, start: str, end: str) -> DataFrame:
    """X11: the currency with the largest cost."""
    rows = _gcp(export, start, end).groupBy("currency").agg(
        F.sum("cost").alias("total_cost"), F.countDistinct("project_id").alias("project_count"),
        F.countDistinct("service").alias("service_count"), F.countDistinct("date").alias("days_in_range"))
    return top(rows.select("total_cost", "currency", "project_count", "service_count", "days_in_range"), "total_cost", 1, "currency")


def gcp_by_service(export: DataFrame, start: str, end: str, limit: int = 50) -> DataFrame:
    """X12."""
    rows = _gcp(export, start, end).groupBy("service").agg(F.sum("cost").alias("total_cost"), F.countDistinct("date").alias("days_active"))
    return top(rows, "total_cost", limit, "service")


def gcp_by_project(export: DataFrame, start: str, end: str, limit: int = 50) -> DataFrame:
    """X12, second result."""
    rows = _gcp(export, start, end).groupBy("project_id", "project_name").agg(
        F.sum("cost").alias("total_cost"), F.countDistinct("service").alias("service_count"))
    return top(rows, "total_cost", limit, "project_id")


def gcp_by_sku(export: DataFrame, start: str, end: str, limit: int = 100) -> DataFrame:
    """X12, third result."""
    return top(_gcp(export, start, end).groupBy("service", "sku").agg(F.sum("cost").alias("total_cost")), "total_cost", limit, "service", "sku")


def gcp_series(export: DataFrame, start: str, end: str) -> DataFrame:
    """X13."""
    return _gcp(export, start, end).groupBy("date", "service").agg(F.sum("cost").alias("daily_cost")).orderBy("date", "service")
