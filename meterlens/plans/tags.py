"""Cost tags (T)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from meterlens.functions import classify as C
from meterlens.functions.shape import listed_values, top
from meterlens.operators.pricing import day, meta, metered, totals


def _tagged() -> Column:
    return C.has_tags().alias("tagged")


def _spend(tagged: bool, name: str) -> Column:
    keep = F.col("tagged") if tagged else ~F.col("tagged")
    return F.sum(F.when(keep, F.col("spend")).otherwise(0)).alias(name)


def coverage(usage: DataFrame, prices: DataFrame, start: str, end: str) -> DataFrame:
    """T1."""
    rows = metered(usage, prices, start, end, ["workspace_id", _tagged()])
    return rows.agg(_spend(True, "tagged_spend"), _spend(False, "untagged_spend"), F.sum("spend").alias("total_spend"),
                    F.countDistinct(F.when(F.col("tagged"), F.col("workspace_id"))).alias("tagged_workspaces"),
                    F.countDistinct(F.when(~F.col("tagged"), F.col("workspace_id"))).alias("untagged_workspaces"))


def _untagged(usage: DataFrame, prices: DataFrame, start: str, end: str, ident: str, *extra: str) -> DataFrame:
    """Untagged usage of one object type, per object."""
    where = F.col(f"usage_metadata.{ident}").isNotNull() & ~C.has_tags()
    rows = metered(usage, prices, start, end, ["usage_date", "workspace_id", meta(ident), *[meta(e) for e in extra]], where)
    return rows.groupBy(ident).agg(F.max("workspace_id").alias("workspace_id"), *[F.max(e).alias(e) for e in extra],
                                   *totals(), F.countDistinct("usage_date").alias("days_active"))


def _existing(table: DataFrame, key: str, **columns: str) -> DataFrame:
    """Largest value per object over rows that are not deleted."""
    return (table.filter(F.col("delete_time").isNull()).groupBy(key)
            .agg(*[F.max(c).alias(name) for name, c in columns.items()]))


def untagged_clusters(usage: DataFrame, prices: DataFrame, clusters: DataFrame | None, start: str, end: str,
                      limit: int = 500) -> DataFrame:
    """T2; without the cluster table its columns are null."""
    rows = _untagged(usage, prices, start, end, "cluster_id")
    if clusters is None:
        nothing = F.lit(None).cast("string")
        rows = rows.withColumns({"cluster_name": nothing, "cluster_source": nothing, "owner": nothing})
    else:
        facts = _existing(clusters, "cluster_id", _name="cluster_name", cluster_source="cluster_source", owner="owned_by")
        rows = rows.join(facts, "cluster_id", "left").withColumn("cluster_name", F.coalesce("_name", "cluster_id"))
    shown = rows.select("cluster_id", "cluster_name", "cluster_source", "owner", "workspace_id", "total_dbus",
                        "total_spend", "days_active")
    return top(shown, "total_spend", limit, "cluster_id")


def untagged_jobs(usage: DataFrame, prices: DataFrame, jobs: DataFrame | None, start: str, end: str, limit: int = 500) -> DataFrame:
    """T3; with the job table unknown and deleted jobs are dropped."""
    rows = _untagged(usage, prices, start, end, "job_id", "job_name")
    if jobs is not None:
        facts = _existing(jobs.withColumn("job_id", F.col("job_id").cast("string")), "job_id", _name="name")
        rows = rows.join(facts, "job_id").withColumn("job_name", F.coalesce("_name", "job_id"))
    else:
        rows = rows.withColumn("job_name", F.coalesce("job_name", "job_id"))
    shown = rows.select("job_id", "job_name", "workspace_id", "total_dbus", "total_spend", "days_active")
    return top(shown, "total_spend", limit, "job_id")


def untagged_pipelines(usage: DataFrame, prices: DataFrame, pipelines: DataFrame | None, start: str, end: str,
                       limit: int = 500) -> DataFrame:
    """T4; with the pipeline table unknown and deleted pipelines are dropped."""
    rows = _untagged(usage, prices, start, end, "dlt_pipeline_id").withColumnRenamed("dlt_pipeline_id", "pipeline_id")
    if pipelines is None:
        rows = rows.withColumn("pipeline_name", F.lit(None).cast("string"))
    else:
        rows = rows.join(_existing(pipelines, "pipeline_id", pipeline_name="name"), "pipeline_id")
    shown = rows.select("pipeline_id", "pipeline_name", "workspace_id", "total_dbus", "total_spend", "days_active")
    return top(shown, "total_spend", limit, "pipeline_id")


def untagged_warehouses(usage: DataFrame, prices: DataFrame, warehouses: DataFrame | None, start: str, end: str,
                        limit: int = 500) -> DataFrame:
    """T5; unknown warehouses stay, named by their id."""
    rows = _untagged(usage, prices, start, end, "warehouse_id")
    if warehouses is None:
        rows = rows.withColumn("warehouse_name", F.lit(None).cast("string"))
    else:
        rows = (rows.join(_existing(warehouses, "warehouse_id", _name="warehouse_name"), "warehouse_id", "left")
                .withColumn("warehouse_name", F.coalesce("_name", "warehouse_id")))
    shown = rows.select("warehouse_id", "warehouse_name", "workspace_id", "total_dbus", "total_spend", "days_active")
    return top(shown, "total_spend", limit, "warehouse_id")


def untagged_endpoints(usage: DataFrame, prices: DataFrame, start: str, end: str, limit: int = 500) -> DataFrame:
    """T6."""
    return top(_untagged(usage, prices, start, end, "endpoint_name"), "total_spend", limit, "endpoint_name")


def _per_tag(usage: DataFrame, prices: DataFrame, start: str, end: str, dims: list[str | Column]) -> DataFrame:
    """Collapsed usage per tag.  The map is exploded before grouping, since a map cannot be a grouping key;
    the pairs of a row leave the scan stage already summed."""
    exploded = usage.filter(C.has_tags()).select("*", F.explode("custom_tags").alias("tag_key", "tag_value"))
    return metered(exploded, prices, start, end, ["tag_key", "tag_value", *dims])


def cost_by_tag(usage: DataFrame, prices: DataFrame, start: str, end: str, limit: int | None = 500) -> DataFrame:
    """A record with n tags counts n times.  Roll-ups (T8b, T12) need every row, ``limit=None``."""
    grouped = (_per_tag(usage, prices, start, end, ["usage_date", "workspace_id"]).groupBy("tag_key", "tag_value")
               .agg(*totals(), F.countDistinct("workspace_id").alias("workspace_count"),
                    F.countDistinct("usage_date").alias("days_active")))
    return top(grouped, "total_spend", limit, "tag_key", "tag_value")


def cost_by_tag_key(usage: DataFrame, prices: DataFrame, start: str, end: str, limit: int = 50) -> DataFrame:
    """T8."""
    grouped = (_per_tag(usage, prices, start, end, ["workspace_id"]).groupBy("tag_key")
               .agg(*totals(), F.countDistinct("workspace_id").alias("workspace_count")))
    return top(grouped, "total_spend", limit, "tag_key")


def keys_of_tags(cost_by_tag_report: DataFrame, limit: int = 8) -> DataFrame:
    """A T7 report per key."""
    return top(cost_by_tag_report.groupBy("tag_key").agg(F.sum("total_spend").alias("total_spend")), "total_spend", limit, "tag_key")


def top_objects_of_tag(usage: DataFrame, prices: DataFrame, start: str, end: str, tag_key: str, tag_value: str,
                       limit: int = 5) -> DataFrame:
    """Looked up in the map, so nothing is exploded."""
    ident, kind, name = C.object_fields()
    where = F.col("custom_tags").getItem(tag_key) == tag_value
    rows = metered(usage, prices, start, end, ["usage_date", "workspace_id", ident.alias("object_id"),
                                               kind.alias("object_type"), name.alias("object_name")], where)
    grouped = (rows.groupBy("object_id", "object_type", "object_name")
               .agg(F.max("workspace_id").alias("workspace_id"), *totals(), F.countDistinct("usage_date").alias("days_active")))
    return top(grouped, "total_spend", limit, "object_type", "object_id", "object_name")


def tag_catalogue(usage: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """Values per key, sorted; a key with very many values takes several rows."""
    recent = usage.filter((F.col("usage_date") >= F.date_sub(day(as_of), days)) & C.has_tags())
    pairs = recent.select(F.explode("custom_tags").alias("tag_key", "tag_value"))
    return listed_values(pairs, "tag_key", "tag_value", "tag_values")


def coverage_series(usage: DataFrame, prices: DataFrame, start: str, end: str) -> DataFrame:
    """T11."""
    return (metered(usage, prices, start, end, ["usage_date", _tagged()]).groupBy("usage_date")
            .agg(_spend(True, "tagged_spend"), _spend(False, "untagged_spend")).orderBy("usage_date"))


def suggested_tags(cost_by_tag_report: DataFrame, limit: int = 5, examples: int = 3) -> DataFrame:
    """Keys by workspace use, with the dearest values as examples; only those are ever collected."""
    rank = F.row_number().over(W.partitionBy("tag_key").orderBy(F.desc("total_spend"), "tag_value"))
    ranked = cost_by_tag_report.withColumn("rank", rank)
    values = F.array_sort(F.collect_list(F.when(F.col("rank") <= examples, F.struct("rank", "tag_value"))))
    keys = ranked.groupBy(F.col("tag_key").alias("key")).agg(
        F.sum(F.when(F.col("workspace_count") > 0, F.col("workspace_count")).otherwise(1)).alias("usage_count"),
        F.transform(values, lambda v: v["tag_value"]).alias("examples"))
    return top(keys, "usage_count", limit, "key")
