"""Spend overview (S)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from meterlens.functions import classify as C
from meterlens.functions.shape import latest_rows, share_of_total, top, wide
from meterlens.operators.allocate import tool_attribution, tool_work, work_shares
from meterlens.operators.pricing import day, has_pipeline, in_window, meta, metered, run_as, totals

def categorised(usage: DataFrame, prices: DataFrame, start: str, end: str, category: Column,
                dims: list[str | Column], where: Column | None = None) -> DataFrame:
    """Collapsed usage with a ``product_category``, computed on the collapsed rows."""
    rows = metered(usage, prices, start, end, ["billing_origin_product", "sku_name", has_pipeline(), *dims], where)
    return rows.withColumn("product_category", category)


def account_info(usage: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """One account and cloud of the last days; the smallest, so the answer is stable."""
    recent = usage.filter((F.col("usage_date") >= F.date_sub(day(as_of), days)))
    return recent.select("account_id", "cloud").distinct().orderBy("account_id", "cloud").limit(1)


def billing_summary(usage: DataFrame, prices: DataFrame, start: str, end: str) -> DataFrame:
    """S2 and S2b.  Both distinct counts run on rows already collapsed per day and workspace."""
    rows = metered(usage, prices, start, end, ["usage_date", "workspace_id"])
    return rows.agg(*totals(), F.countDistinct("workspace_id").alias("workspace_count"),
                    F.countDistinct("usage_date").alias("days_in_range"), F.min("usage_date").alias("first_date"),
                    F.max("usage_date").alias("last_date")).withColumn(
        "avg_daily_spend", F.try_divide(F.col("total_spend").cast("double"), F.col("days_in_range")))


def _in_workspace(workspace_id: str | None) -> Column | None:
    return None if workspace_id is None else F.col("workspace_id").cast("string") == workspace_id


def _split_by_tool(usage: DataFrame, prices: DataFrame, history: DataFrame, start: str, end: str, category: Column,
                   dims: list[str]) -> DataFrame:
    """Collapsed usage with SQL rows split over the two tools: product_category, dbus, spend, and the dims.

    One scan of the bill: only SQL rows keep their day and warehouse, which are
    the keys of the work shares.  SQL cost without queries has no share and is
    dropped.  A tool that worked but cost nothing keeps a row without cost.
    """
    sql = F.col("billing_origin_product") == "SQL"
    keys = [F.when(sql, F.col("usage_date")).alias("_day"), F.when(sql, F.col("usage_metadata.warehouse_id")).alias("_wh")]
    rows = categorised(usage, prices, start, end, category, [*dims, *keys])
    work = tool_work(history, start, end, C.sql_tool("SQL - Genie", "SQL - DBSQL"))
    shares = work_shares(work, ["usage_date", "warehouse_id"]).select(
        "sql_product", F.col("usage_date").alias("_day"), F.col("warehouse_id").alias("_wh"), "share")
    split = rows.join(shares, ["_day", "_wh"], "left").filter(~sql | F.col("sql_product").isNotNull())

    def cost(name: str) -> Column:
        part = F.when(F.col("share") == 0, F.lit(0.0)).otherwise(F.col("share") * F.col(name).cast("double"))
        return F.when(sql, part).otherwise(F.col(name).cast("double")).alias(name)
    kept = split.select(F.when(sql, F.col("sql_product")).otherwise(F.col("product_category")).alias("product_category"),
                        *dims, cost("dbus"), cost("spend"))
    worked = work.select(F.col("sql_product").alias("product_category"), *[d for d in dims if d == "usage_date"]).distinct()
    return kept.unionByName(worked, allowMissingColumns=True)


def by_product(usage: DataFrame, prices: DataFrame, history: DataFrame, start: str, end: str,
               workspace_id: str | None = None) -> DataFrame:
    """Spend per category with SQL cost split between its two tools by work.

    Cost is allocated per (day, warehouse) and then attributed, so a warehouse
    billed in several workspaces keeps its whole cost.  With a workspace, only
    the usage side is filtered, query work is not.
    """
    if workspace_id is not None:
        usage = usage.filter(_in_workspace(workspace_id))
    rows = _split_by_tool(usage, prices, history, start, end, C.non_sql_category(), ["workspace_id"])
    return (rows.groupBy("product_category").agg(*totals(), F.countDistinct("workspace_id").alias("workspace_count"))
            .orderBy(F.desc_nulls_last("total_spend")))


def by_product_fast(usage: DataFrame, prices: DataFrame, start: str, end: str) -> DataFrame:
    """One scan, SQL as a single category."""
    return (categorised(usage, prices, start, end, C.product_category(), ["workspace_id"])
            .groupBy("product_category").agg(*totals(), F.countDistinct("workspace_id").alias("workspace_count"))
            .orderBy(F.desc("total_spend")))


def by_workspace(usage: DataFrame, prices: DataFrame, workspaces: DataFrame | None, start: str, end: str) -> DataFrame:
    """Workspaces with their three largest products and users (largest first), and the K25 flag.

    Totals, products and users come from one scan: records are collapsed first,
    and a collapsed row counts for its workspace, its product and its user.
    Only three names per workspace are ever collected.
    """
    product, user = F.col("billing_origin_product"), F.col("run_as")

    def entry(kind: str, name: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), name.alias("name"))
    entries = F.array(entry("total", F.lit(None).cast("string")), F.when(product.isNotNull(), entry("product", product)),
                      F.when(user != "", entry("user", user)))
    rows = metered(usage, prices, start, end, ["workspace_id", "billing_origin_product", run_as()])
    grouped = (rows.select("workspace_id", "dbus", "spend", F.explode(entries).alias("e")).filter(F.col("e").isNotNull())
               .groupBy("workspace_id", F.col("e.kind").alias("kind"), F.col("e.name").alias("name")).agg(*totals()))
    rank = F.row_number().over(W.partitionBy("workspace_id", "kind").orderBy(F.desc("total_spend"), "name"))
    kept = grouped.withColumn("rank", rank).filter(F.col("rank") <= 3)

    def total(name: str) -> Column:
        return F.max(F.when(F.col("kind") == "total", F.col(name))).alias(name)

    def names(kind: str, alias: str) -> Column:
        pairs = F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("rank", "name"))))
        return F.transform(pairs, lambda p: p["name"]).alias(alias)
    out = kept.groupBy("workspace_id").agg(total("total_dbus"), total("total_spend"), names("product", "top_products"),
                                           names("user", "top_users"))
    if workspaces is None:
        out = out.withColumn("workspace_name", F.lit(None).cast("string"))
    else:
        out = out.join(workspaces.select("workspace_id", "workspace_name"), "workspace_id", "left")
    return out.select("workspace_id", "workspace_name", "total_dbus", "total_spend", "top_products", "top_users",
                      C.is_historical(F.col("workspace_name")).alias("is_historical")).orderBy(F.desc("total_spend"))


def timeseries(usage: DataFrame, prices: DataFrame, history: DataFrame, start: str, end: str) -> DataFrame:
    """Day x category with the SQL split."""
    rows = _split_by_tool(usage, prices, history, start, end, C.non_sql_series_category(), ["usage_date"])
    return rows.groupBy("usage_date", "product_category").agg(*totals()).orderBy("usage_date", "product_category")


def timeseries_fast(usage: DataFrame, prices: DataFrame, start: str, end: str) -> DataFrame:
    """S8."""
    return (categorised(usage, prices, start, end, C.series_category(), ["usage_date"])
            .groupBy("usage_date", "product_category").agg(*totals()).orderBy("usage_date", "product_category"))


SERIES_LABELS = [r.label for r in C.SERIES_CATEGORY] + ["Other"]


def timeseries_wide(series: DataFrame, labels: list[str] = SERIES_LABELS) -> DataFrame:
    """One row per day, one column per category, 0 where nothing was spent.

    The category list is fixed, so the pivot needs no extra pass over the data.
    """
    return wide(series.withColumnRenamed("usage_date", "date"), "date", "product_category", "total_spend", labels)


def sql_tool_totals(usage: DataFrame, prices: DataFrame, history: DataFrame, start: str, end: str) -> DataFrame:
    """S10."""
    return (tool_attribution(usage, prices, history, start, end).groupBy("sql_product")
            .agg(F.sum("attributed_dbus").alias("total_dbus"), F.sum("attributed_spend").alias("total_spend"))
            .orderBy(F.desc_nulls_last("total_spend")))


def pipeline_objects(usage: DataFrame, prices: DataFrame, start: str, end: str, pipelines: DataFrame | None = None,
                     limit: int = 100) -> DataFrame:
    """S11 without, S12 with the pipeline table: jobs and pipelines by spend.

    Runs are the unbounded dimension: they are counted on rows collapsed per
    (object, run), and the name tables join the collapsed objects.
    """
    dims = ["workspace_id", meta("dlt_pipeline_id"), meta("job_id"), meta("job_run_id"), meta("job_name"), run_as("run_as_user")]
    rows = metered(usage, prices, start, end, dims, C.is_etl()).filter(
        F.col("dlt_pipeline_id").isNotNull() | F.col("job_id").isNotNull())
    pipeline, job = F.col("dlt_pipeline_id"), F.col("job_id")
    if pipelines is None:
        name, owner = F.coalesce("job_name", pipeline, job), F.col("_user")
        rows = rows.withColumn("pipeline_name", F.lit(None).cast("string")).withColumn("creator_name", F.lit(None).cast("string"))
    else:
        rows = rows.join(pipeline_names(pipelines), rows.dlt_pipeline_id == F.col("_pid"), "left")
        name = F.when(pipeline.isNotNull(), F.coalesce("pipeline_name", pipeline)).otherwise(F.coalesce("job_name", job))
        owner = F.coalesce("_creator", "_user")
    kind = F.when(pipeline.isNotNull(), "SDP Pipeline").when(job.isNotNull(), "Job").otherwise("Unknown")
    objects = (rows.groupBy(kind.alias("object_type"), F.coalesce(pipeline, job).alias("object_id"), name.alias("object_name"))
               .agg(F.max("workspace_id").alias("workspace_id"), F.max("creator_name").alias("_creator"),
                    F.max("run_as_user").alias("_user"), *totals(), F.countDistinct("job_run_id").alias("total_runs"))
               .select("object_type", "object_id", "object_name", "workspace_id",
                       F.lit(None).cast("string").alias("object_state"), owner.alias("owner"), "total_dbus",
                       "total_spend", "total_runs",
                       C.is_historical(F.col("object_name"), F.col("object_id")).alias("is_historical")))
    return top(objects, "total_spend", limit, "object_type", "object_id", "object_name")


def pipeline_names(pipelines: DataFrame) -> DataFrame:
    """Name and creator of the pipelines that still exist."""
    return (pipelines.filter(F.col("delete_time").isNull()).groupBy(F.col("pipeline_id").alias("_pid"))
            .agg(F.max("name").alias("pipeline_name"), F.max("creator_name").alias("creator_name")))


def fill_pipeline_names(objects: DataFrame, pipelines: DataFrame) -> DataFrame:
    """Put names on the pipelines of an S11 report; jobs keep theirs."""
    named = objects.join(pipeline_names(pipelines).select("_pid", "pipeline_name"),
                         (F.col("object_type") == "SDP Pipeline") & (F.col("object_id") == F.col("_pid")), "left")
    name = F.coalesce("pipeline_name", "object_name")
    return (named.withColumn("object_name", name)
            .withColumn("is_historical", C.is_historical(F.col("object_name"), F.col("object_id")))
            .select(*objects.columns))


def etl_breakdown(usage: DataFrame, prices: DataFrame, start: str, end: str) -> DataFrame:
    """S13."""
    rows = categorised(usage, prices, start, end, C.etl_type(), [], C.is_etl())
    return (rows.filter(F.col("product_category").isNotNull()).groupBy(F.col("product_category").alias("etl_type"))
            .agg(*totals()).orderBy(F.desc("total_spend")))


def _interactive(usage: DataFrame, prices: DataFrame, clusters: DataFrame, start: str, end: str) -> DataFrame:
    dims = ["usage_date", "workspace_id", meta("cluster_id"), meta("notebook_path"), meta("notebook_id"), run_as("run_as_user")]
    rows = metered(usage, prices, start, end, dims, F.col("sku_name").contains("ALL_PURPOSE"))
    names = latest_rows(clusters, "cluster_id", ["cluster_name"])
    return (rows.groupBy("cluster_id", "notebook_path", "run_as_user")
            .agg(F.max("workspace_id").alias("workspace_id"), *totals(), F.countDistinct("usage_date").alias("days_active"),
                 F.countDistinct("notebook_id").alias("notebook_count"))
            .join(names, "cluster_id", "left"))


def interactive_breakdown(usage: DataFrame, prices: DataFrame, clusters: DataFrame, start: str, end: str,
                          limit: int | None = 100) -> DataFrame:
    """S14; cluster names join the grouped rows.  Roll-ups (S15) need every row, ``limit=None``."""
    items = _interactive(usage, prices, clusters, start, end).select(
        "cluster_id", "cluster_name", "notebook_path", "run_as_user", "workspace_id",
        F.lit(None).cast("string").alias("cluster_state"), "total_dbus", "total_spend", "days_active", "notebook_count")
    return top(items, "total_spend", limit, "cluster_id", "notebook_path", "run_as_user")


# fixed values: key column and placeholder of each view
INTERACTIVE_VIEWS = {
    "user": ("run_as_user", "(Unknown User)"),
    "cluster": ("cluster_id", "(Unknown Cluster)"),
    "notebook": ("notebook_path", "(No Notebook)"),
}


def interactive_by(items: DataFrame, view: str) -> DataFrame:
    """Regroup an S14 report by user, cluster or notebook, with the top spender per key.

    The workspace and cluster shown are those of the key's largest item.
    """
    column, missing = INTERACTIVE_VIEWS[view]
    key = F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(missing))
    order = F.struct("total_spend", "cluster_id", "notebook_path", "run_as_user")

    def of_largest(name: str) -> Column:
        return F.max_by(name, F.when(F.col(name).isNotNull(), order)).alias(name)
    grouped = items.groupBy(key.alias("key")).agg(
        of_largest("workspace_id"), of_largest("cluster_name"), of_largest("run_as_user"),
        F.sum("total_dbus").alias("total_dbus"), F.sum("total_spend").alias("total_spend"),
        F.max("days_active").alias("days_active"), F.count("*").alias("count"))
    return (share_of_total(grouped.withColumnRenamed("run_as_user", "user"), "total_spend")
            .orderBy(F.desc("total_spend"), "key"))


def sku_breakdown(usage: DataFrame, prices: DataFrame, start: str, end: str, workspace_id: str | None = None,
                  limit: int = 100) -> DataFrame:
    """SKUs with their percent of all spend."""
    skus = (metered(usage, prices, start, end, ["sku_name", "workspace_id"], _in_workspace(workspace_id))
            .groupBy(F.col("sku_name").alias("product"))
            .agg(F.countDistinct("workspace_id").alias("workspaces_using"), *totals()))
    return top(share_of_total(skus, "total_spend", digits=2), "total_spend", limit, "product")


def user_totals(usage: DataFrame, prices: DataFrame, start: str, end: str) -> DataFrame:
    """Spend per user with a known identity and spend above 0."""
    return (metered(usage, prices, start, end, [run_as("user")], F.col("identity_metadata.run_as").isNotNull())
            .groupBy("user").agg(*totals()).filter(F.col("total_spend") > 0))


def spend_by_user(usage: DataFrame, prices: DataFrame, start: str, end: str, limit: int | None = 15) -> DataFrame:
    """The user report that stands in when there is no group table; ``limit=None`` lists all."""
    users = user_totals(usage, prices, start, end).select(
        F.col("user").alias("group_name"), "total_spend", "total_dbus", F.lit(1).alias("user_count"))
    return top(users, "total_spend", limit, "group_name")


def spend_by_group(usage: DataFrame, prices: DataFrame, user_groups: DataFrame | None, start: str, end: str,
                   limit: int = 15) -> DataFrame:
    """Each user's spend goes in full to every group they are in.

    Users without a group form 'No Group'.  The percentage uses the total of
    all groups, which counts members of several groups more than once; the list
    is cut after that.
    """
    if user_groups is None:
        users = share_of_total(spend_by_user(usage, prices, start, end, None), "total_spend", digits=1)
        return top(users, "total_spend", limit, "group_name")
    users = user_totals(usage, prices, start, end).filter(F.col("user") != "Unknown")
    member = user_groups.select(F.col("user_email").alias("user"), "group_name").distinct()
    groups = (users.join(member, "user", "left")
              .groupBy(F.coalesce("group_name", F.lit("No Group")).alias("group_name"))
              .agg(F.sum("total_spend").alias("total_spend"), F.sum("total_dbus").alias("total_dbus"),
                   F.countDistinct("user").alias("user_count")))
    return top(share_of_total(groups, "total_spend", digits=1), "total_spend", limit, "group_name")


def latest_day_workspace_count(usage: DataFrame, start: str, end: str) -> DataFrame:
    """S19."""
    days = in_window(usage, start, end).groupBy("usage_date").agg(F.countDistinct("workspace_id").alias("workspace_count"))
    return top(days, "usage_date", 1).select("workspace_count")


def monthly_consumption(usage: DataFrame, prices: DataFrame, start: str, end: str) -> DataFrame:
    """S20."""
    month = F.trunc("usage_date", "month").alias("month")
    return metered(usage, prices, start, end, [month]).groupBy("month").agg(*totals()).orderBy("month")


def go_live_markers(use_cases: DataFrame, start: str, end: str) -> DataFrame:
    """S20, second result: active use cases that went live in the window."""
    return (use_cases.filter((F.col("status") == "active") & F.col("live_date").between(day(start), day(end)))
            .select("use_case_id", "name", "live_date").orderBy("live_date", "use_case_id"))
