"""Spend of business use cases (C)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlens.functions.shape import listed_values, share_of_total
from meterlens.operators.joins import join_spread
from meterlens.operators.pricing import day, meta, metered

# fixed values: object types by priority, and the usage column that holds their id
OBJECT_COLUMNS = [("cluster", "cluster_id"), ("warehouse", "warehouse_id"), ("job", "job_id"), ("endpoint", "endpoint_id"),
                  ("pipeline", "dlt_pipeline_id")]
#: Use cases of one object that one task joins with all usage rows of that object.
MAPPED_PER_TASK = 2000
DETAIL = ["use_case_id", "name", "description", "owner", "created_at", "updated_at", "status", "tags", "stage",
          "start_date", "end_date", "live_date"]


def object_usage(usage: DataFrame, prices: DataFrame, start: str, end: str, per_day: bool = True) -> DataFrame:
    """Spend per combination of object ids, and per day unless only totals are asked for."""
    where = None
    for _, column in OBJECT_COLUMNS:
        present = F.col(f"usage_metadata.{column}").isNotNull()
        where = present if where is None else where | present
    ids = [meta(c) for _, c in OBJECT_COLUMNS]
    rows = metered(usage, prices, start, end, ["usage_date", *ids] if per_day else ids, where)
    return rows.drop("records", "effective_spend")


def _matches(rows: DataFrame, objects: DataFrame, custom_dates: bool = False) -> DataFrame:
    """One row per (use case, usage row) that is mapped to it, under the first mapped type of the priority list.

    The ids of a usage row are turned into (type, id) rows, so one equi join
    serves all types; a row reached through two of its ids is folded again.
    Each use case of an object gets all rows of that object, so the join makes far
    more rows than it reads: objects of many use cases are dealt to several tasks.
    """
    ids = [F.col(c) for _, c in OBJECT_COLUMNS]
    entries = [F.when(i.isNotNull(), F.struct(F.lit(r).alias("rank"), F.lit(t).alias("object_type"), i.alias("id")))
               for r, ((t, _), i) in enumerate(zip(OBJECT_COLUMNS, ids))]
    row_key = F.concat_ws("\x1f", *[F.coalesce(i, F.lit("\x1e")) for i in ids])
    typed = (rows.select("usage_date", "dbus", "spend", F.coalesce(*ids).alias("shown_id"), row_key.alias("row_key"),
                         F.explode(F.array(*entries)).alias("e")).filter(F.col("e").isNotNull())
             .select("usage_date", "dbus", "spend", "shown_id", "row_key", "e.rank", "e.object_type", F.col("e.id").alias("object_id")))
    mapping = (objects.select("use_case_id", "object_type", "object_id", "custom_start_date", "custom_end_date")
               .dropDuplicates(["use_case_id", "object_type", "object_id"]))
    joined = join_spread(mapping, typed, ["object_type", "object_id"], F.col("use_case_id"), task_rows=MAPPED_PER_TASK,
                         partitions=int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if custom_dates:
        joined = joined.filter((F.col("usage_date") >= F.coalesce("custom_start_date", "usage_date"))
                               & (F.col("usage_date") <= F.coalesce("custom_end_date", "usage_date")))
    best = joined.groupBy("use_case_id", "usage_date", "row_key", "shown_id").agg(
        F.min("rank").alias("rank"), F.max("dbus").alias("dbus"), F.max("spend").alias("spend"))
    kind = F.element_at(F.array(*[F.lit(t) for t, _ in OBJECT_COLUMNS]), F.col("rank") + 1)
    return best.select("use_case_id", "usage_date", kind.alias("object_type"), F.col("shown_id").alias("object_id"), "dbus", "spend")


def mapped_usage(usage: DataFrame, prices: DataFrame, objects: DataFrame, start: str, end: str,
                 custom_dates: bool = False) -> DataFrame:
    """(use case, day, type, id, dbus, spend) of mapped objects.

    Usage is collapsed per day and combination of objects before it meets the
    mapping.  Object-specific dates are stored with the mapping and used on
    request.
    """
    return (_matches(object_usage(usage, prices, start, end), objects, custom_dates)
            .groupBy("use_case_id", "usage_date", "object_type", "object_id")
            .agg(F.sum("dbus").alias("total_dbus"), F.sum("spend").alias("total_spend")))


def analytics(usage: DataFrame, prices: DataFrame, objects: DataFrame, use_case_id: str, start: str, end: str,
              custom_dates: bool = False) -> DataFrame:
    """C1 for one use case."""
    mine = objects.filter(F.col("use_case_id") == use_case_id)
    return (mapped_usage(usage, prices, mine, start, end, custom_dates)
            .select("usage_date", "object_type", "object_id", "total_dbus", "total_spend")
            .orderBy("usage_date", "object_type", "object_id"))


def _sums() -> list[Column]:
    return [F.sum("total_spend").alias("spend"), F.sum("total_dbus").alias("dbus")]


def daily(rows: DataFrame) -> DataFrame:
    """A C1 report per day."""
    return rows.groupBy(F.col("usage_date").alias("date")).agg(*_sums()).orderBy("date")


def by_component(rows: DataFrame) -> DataFrame:
    """Per object."""
    return rows.groupBy("object_type", "object_id").agg(*_sums()).orderBy(F.desc("spend"), "object_type", "object_id")


def by_object_type(rows: DataFrame) -> DataFrame:
    """Per object type, with the number of objects."""
    return (rows.groupBy("object_type").agg(*_sums(), F.countDistinct("object_id").alias("count"))
            .orderBy(F.desc("spend"), "object_type"))


def all_use_cases(usage: DataFrame, prices: DataFrame, use_cases: DataFrame, objects: DataFrame, start: str, end: str) -> DataFrame:
    """All active use cases in one pass instead of one query per case; cases without spend show 0.

    Only totals are shown, so the bill is grouped without its days; objects of other cases are left out beforehand.
    """
    active = use_cases.filter(F.col("status") == "active").select(
        "use_case_id", "name", "owner", F.coalesce("stage", F.lit("Development")).alias("stage"))
    rows = object_usage(usage, prices, start, end, per_day=False).withColumn("usage_date", F.lit(None).cast("date"))
    shown = objects.join(active.select("use_case_id"), "use_case_id", "left_semi")
    spent = (_matches(rows, shown).groupBy("use_case_id", "object_type", "object_id")
             .agg(F.sum("spend").alias("s"), F.sum("dbus").alias("d"))
             .groupBy("use_case_id").agg(F.round(F.sum("s").cast("double"), 2).alias("total_spend"),
                                         F.round(F.sum("d").cast("double"), 2).alias("total_dbus"),
                                         F.count("*").alias("object_count")))
    report = active.join(spent, "use_case_id", "left").na.fill(0, ["total_spend", "total_dbus", "object_count"])
    return share_of_total(report, "total_spend").orderBy(F.desc("total_spend"), "use_case_id")


# fixed values: id and name columns of each listed type
CATALOGUE = {
    "cluster": ("cluster_id", ("cluster_id",)), "warehouse": ("warehouse_id", ("warehouse_id",)),
    "pipeline": ("dlt_pipeline_id", ("dlt_pipeline_id",)), "endpoint": ("endpoint_id", ("endpoint_name", "endpoint_id")),
    "job": ("job_id", ("job_id",)),
}


def _page(rows: DataFrame, keys: list[str], limit: int | None, after: tuple | None) -> DataFrame:
    """Rows in order of ``keys``, beginning behind ``after``, the keys of the last row of the page before."""
    if after is not None:
        last = F.struct(*[F.lit(v).cast(rows.schema[k].dataType).alias(k) for k, v in zip(keys, after, strict=True)])
        rows = rows.filter(F.struct(*keys) > last)
    ordered = rows.orderBy(*keys)
    return ordered if limit is None else ordered.limit(limit)


def object_catalogue(usage: DataFrame, object_type: str, as_of: str, days: int = 90, limit: int | None = 100,
                     after: tuple | None = None) -> DataFrame:
    """C4: a page of the objects seen in recent usage; ``after`` is (object_id, object_name, workspace_id)."""
    ident, names = CATALOGUE[object_type]
    rows = usage.filter((F.col("usage_date") >= F.date_sub(day(as_of), days)) & (F.col("usage_quantity") > 0)
                        & F.col(f"usage_metadata.{ident}").isNotNull())
    found = rows.select(F.col(f"usage_metadata.{ident}").alias("object_id"),
                        F.coalesce(*[F.col(f"usage_metadata.{n}") for n in names]).alias("object_name"), "workspace_id",
                        F.lit(object_type).alias("object_type")).distinct()
    return _page(found, ["object_id", "object_name", "workspace_id"], limit, after)


def query_catalogue(history: DataFrame, as_of: str, days: int = 30, limit: int | None = 100, after: tuple | None = None,
                    with_start: bool = False) -> DataFrame:
    """A page of recent statements, latest first, one row per statement and workspace.

    ``after`` is (start_time, object_id, workspace_id) of the last row of the page before; ``with_start`` shows the start.
    """
    rows = history.filter(F.col("statement_id").isNotNull() & F.col("executed_as_user_id").isNotNull()
                          & (F.col("start_time") >= F.date_sub(day(as_of), days).cast("timestamp")))
    name = F.substring(F.coalesce("statement_text", F.concat(F.lit("Query "), F.col("statement_id"))), 1, 100)
    latest = rows.groupBy("statement_id", "workspace_id").agg(F.max("start_time").alias("_at"), F.max(name).alias("object_name"))
    if after is not None:
        at = F.lit(after[0]).cast("timestamp")
        behind = F.struct("statement_id", "workspace_id") > F.struct(
            F.lit(after[1]).alias("statement_id"), F.lit(after[2]).cast(latest.schema["workspace_id"].dataType).alias("workspace_id"))
        latest = latest.filter((F.col("_at") < at) | ((F.col("_at") == at) & behind))
    ordered = latest.orderBy(F.desc("_at"), "statement_id", "workspace_id")
    shown = (ordered if limit is None else ordered.limit(limit)).select(
        F.col("statement_id").alias("object_id"), "object_name", "workspace_id", F.lit("query").alias("object_type"), F.col("_at").alias("start_time"))
    return shown if with_start else shown.drop("start_time")


def dashboard_catalogue(dashboards: DataFrame, limit: int | None = 100, after: tuple | None = None) -> DataFrame:
    """C5, second result: a page of the dashboards; ``after`` is (object_name, object_id, workspace_id)."""
    rows = dashboards.filter(F.col("dashboard_id").isNotNull()).select(
        F.col("dashboard_id").alias("object_id"), F.col("name").alias("object_name"), "workspace_id",
        F.lit("dashboard").alias("object_type")).distinct()
    return _page(rows, ["object_name", "object_id", "workspace_id"], limit, after)


def use_case_list(use_cases: DataFrame, status: str | None = None, stage: str | None = None) -> DataFrame:
    """C6."""
    rows = use_cases
    for column, value in (("status", status), ("stage", stage)):
        if value is not None:
            rows = rows.filter(F.col(column) == value)
    return rows.select(*DETAIL).orderBy(F.desc("created_at"), "use_case_id")


def use_case_tags(use_cases: DataFrame) -> DataFrame:
    """Tag values in use, sorted; empty values are left out but their key stays."""
    active = use_cases.filter((F.col("status") == "active") & F.col("tags").isNotNull())
    pairs = active.select(F.explode("tags").alias("tag_key", "v")).select("tag_key", F.nullif("v", F.lit("")).alias("tag_value"))
    return listed_values(pairs, "tag_key", "tag_value", "tag_values")


def use_case(use_cases: DataFrame, use_case_id: str) -> DataFrame:
    """One use case."""
    return use_cases.filter(F.col("use_case_id") == use_case_id).select(*DETAIL)


def use_case_objects(objects: DataFrame, use_case_id: str) -> DataFrame:
    """C8, second result: its objects, last assigned first."""
    return (objects.filter(F.col("use_case_id") == use_case_id)
            .select("mapping_id", "object_type", "object_id", "object_name", "workspace_id", "assigned_at", "assigned_by",
                    "notes", "custom_start_date", "custom_end_date").orderBy(F.desc("assigned_at"), "mapping_id"))
