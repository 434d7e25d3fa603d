"""Plan shapes, and report parts that are not registered queries."""

import re

import pytest
from pyspark.sql import functions as F

import rows as R
from conftest import SMALL
from meterlens.functions.shape import listed_values, one_row, share_of_total
from meterlens.operators.joins import join_spread
from meterlens.plans import aiml, apps, health, infra, spend, tags, usecases, users, warehouse
from meterlens.registered.all import all_queries
from meterlens.sources.fixtures import FixtureTables

W = ("2023-08-04", "2024-01-30")
WRITES = ("l01", "l06", "l08")


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in all_queries() if not n.startswith(WRITES)])
def test_no_cross_join_and_no_python_in_any_plan(name, tables):
    plan = physical(all_queries()[name].plan(tables))
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|EvalPython|MapInPandas|Python", plan)


def test_scan_reads_only_what_a_report_needs(spark):
    t = FixtureTables(spark, SMALL)
    plan = physical(spend.timeseries_fast(t.usage, t.list_prices, *W))
    read = re.search(r"lineitem.*?ReadSchema: struct<([^>]*)>", plan, re.S).group(1)
    assert "l_extendedprice" not in read and "l_tax" not in read and "l_returnflag" not in read


def test_filter_on_a_stored_day_prunes_partitions(spark, tmp_path):
    R.usage(spark, R.usage_row(day="2024-01-01"), R.usage_row(day="2024-01-02")).write.partitionBy("usage_date").parquet(str(tmp_path / "usage"))
    stored = spark.read.schema(R.USAGE).parquet(str(tmp_path / "usage"))
    plan = physical(spend.by_product_fast(stored, R.prices(spark), "2024-01-02", "2024-01-02"))
    assert re.search(r"PartitionFilters: \[isnotnull\(usage_date#\d+\), \(usage_date#\d+ >= 2024-01-02\)", plan)


def test_priced_in_the_scan_stage(tables):
    """Only one shuffle separates the bill from the grouped, priced rows."""
    plan = physical(spend.sku_breakdown(tables.usage, tables.list_prices, *W))
    scan_stage = plan[plan.rindex("Exchange hashpartitioning"):]
    assert "_sku" in scan_stage and "partial_sum" in scan_stage and "SortMergeJoin" not in plan


def test_share_of_nothing_is_zero(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 0.0)], "k int, v double")
    assert [r.percentage for r in share_of_total(df, "v").collect()] == [0.0, 0.0]
    assert share_of_total(df.filter("false"), "v").count() == 0


def test_one_row(spark):
    a, b = spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([("x",)], "b string")
    assert one_row(a, b).first() == (1, "x")


def test_ties_at_a_cut_are_broken_by_name(spark):
    usage = R.usage(spark, *[R.usage_row(user=f"u{i}") for i in range(20)])
    assert [r.group_name for r in spend.spend_by_user(usage, R.prices(spark), "2024-01-01", "2024-01-01", 3).collect()] == ["u0", "u1", "u10"]


def test_users_in_no_one_and_two_groups(spark):
    usage = R.usage(spark, *[R.usage_row(user=u, qty=q) for u, q in (("a", 1), ("b", 2), ("c", 4), (None, 8))])
    groups = spark.createDataFrame([("b", "G1"), ("c", "G1"), ("c", "G2")], "user_email string, group_name string")
    out = {r.group_name: (float(r.total_spend), r.user_count, r.percentage) for r in spend.spend_by_group(usage, R.prices(spark), groups, "2024-01-01", "2024-01-01").collect()}
    assert out == {"G1": (12.0, 2, 54.5), "G2": (8.0, 1, 36.4), "No Group": (2.0, 1, 9.1)}
    detail = users.workspace_detail(usage, R.prices(spark), "2024-01-01", "2024-01-01")
    rolled = {r.group_name: r for r in users.group_rollup(detail, groups).collect()}
    assert (rolled["G1"].member_count, rolled["G1"].distinct_spend) == (2, 12.0)
    assert [float(r.spend) for r in users.ungrouped(detail, groups).collect()] == [2.0]


def test_wide_reports_discover_their_names(tables):
    daily = users.daily_of_top_users(tables.usage, tables.list_prices, *W)
    table = users.daily_of_top_users_wide(daily)
    assert len(table.columns) == 7
    total = sum(float(v or 0) for r in table.collect() for v in r[1:])
    assert round(total, 4) == round(sum(float(r.daily_spend) for r in daily.collect()), 4)
    series = infra.aws_cost_series(tables.usage, tables.clusters, tables.estimate_prices, *W)
    assert infra.aws_cost_series_wide(series).columns[:2] == ["date", "total"]
    kinds = warehouse.warehouse_type_timeseries(tables.usage, tables.list_prices, tables.warehouses, *W)
    assert warehouse.series_wide(kinds, "warehouse_type").columns[0] == "date"


def test_missing_optional_inputs(tables):
    none = aiml.ml_clusters(tables.usage, tables.list_prices, None, *W)
    with_table = aiml.ml_clusters(tables.usage, tables.list_prices, tables.clusters, *W)
    assert none.count() == 0 and none.columns == with_table.columns
    assert tags.untagged_clusters(tables.usage, tables.list_prices, None, *W).first().cluster_name is None
    assert spend.by_workspace(tables.usage, tables.list_prices, None, *W).filter("is_historical").count() == 25
    assert spend.spend_by_group(tables.usage, tables.list_prices, None, *W).count() == 15


def test_tagged_usage_counts_once_per_tag(spark):
    usage = R.usage(spark, R.usage_row(tags={"team": "a", "env": "x"}), R.usage_row(tags={"team": "a"}), R.usage_row(tags={}), R.usage_row())
    out = {(r.tag_key, r.tag_value): float(r.total_spend) for r in tags.cost_by_tag(usage, R.prices(spark), "2024-01-01", "2024-01-01").collect()}
    assert out == {("team", "a"): 4.0, ("env", "x"): 2.0}
    row = tags.coverage(usage, R.prices(spark), "2024-01-01", "2024-01-01").first()
    assert (float(row.tagged_spend), float(row.untagged_spend), float(row.total_spend)) == (4.0, 4.0, 8.0)


def test_a_key_with_many_values_is_split_and_complete(spark):
    pairs = spark.range(1000).selectExpr("if(id < 990, 'hot', 'cold') as k", "concat('v', id) as v")
    out = listed_values(pairs.unionAll(pairs), "k", "v", "vs", per_row=100).collect()
    hot = [r.vs for r in out if r.k == "hot"]
    assert len(hot) == 10 and max(map(len, hot)) < 200 and all(v == sorted(v) for v in hot)
    assert len({v for vs in hot for v in vs}) == 990 and [len(r.vs) for r in out if r.k == "cold"] == [10]


def test_pages_of_a_catalogue_join_up(tables):
    keys = ["object_id", "object_name", "workspace_id"]
    whole = [tuple(r[k] for k in keys) for r in usecases.object_catalogue(tables.usage, "job", W[1], limit=None).collect()]
    size, found, last = -(-len(whole) // 3), [], None
    while page := [tuple(r[k] for k in keys) for r in usecases.object_catalogue(tables.usage, "job", W[1], limit=size, after=last).collect()]:
        found += page
        last = page[-1]
    assert len(whole) > 100 and found == whole


def test_exact_median_of_durations(spark):
    rows = [R.query_row(f"q{i}", "2024-01-01 05:00:00", s) for i, s in enumerate([1, 2, 2, 3, 9, 9, 9, 9, 9, 9, 1, 1])]
    log = spark.createDataFrame([("w1", "W", "Large", 1, "PRO", 1)], "warehouse_id string, warehouse_name string, warehouse_size string, workspace_id bigint, warehouse_type string, change_time int")
    assert health.oversized(log, R.history(spark, *rows), "2024-01-02").first().median_duration_seconds == 3
    assert health.oversized(log, R.history(spark, *rows[:9]), "2024-01-02").count() == 0


def test_app_states(spark):
    usage = R.usage(spark, *[R.usage_row(day=d, product="APPS", app_id=a) for d, a in
                             (("2024-01-30", "live"), ("2024-01-02", "idle"), ("2024-01-03", "gone"), ("2024-01-29", "stray"))])
    registry = spark.createDataFrame([("live", "Live", "u"), ("idle", "Idle", "u"), ("new", "New", "u")], "app_id string, name string, url string")
    report = apps.by_app(usage, R.prices(spark), "2024-01-01", "2024-01-30")
    rows = {r.app_id: (r.status, r.is_registered, r.total_spend) for r in apps.app_status(report, registry, "2024-01-30").collect()}
    assert rows == {"live": ("active", True, 2.0), "idle": ("inactive", True, 2.0), "gone": ("inactive", False, 2.0), "new": ("inactive", True, 0.0)}
    assert [r.app_id for r in apps.app_status(report, registry, "2024-01-30", active_only=True).collect()] == ["live"]
    parts = {r.part: (r["count"], r.total_spend) for r in apps.app_status_summary(report, registry, "2024-01-30").collect()}
    assert parts == {"inactive": (2, 4.0), "unregistered": (2, 4.0)}


def test_change_logs_show_their_latest_row(spark):
    """A warehouse resized from X-Large to Small is Small, whatever its older rows say."""
    from meterlens.plans import warehouse as WH
    log = spark.createDataFrame([("w1", "old name", "X-Large", 5, "PRO", 1), ("w1", "a new name", "Small", 2, None, 2)],
                                "warehouse_id string, warehouse_name string, warehouse_size string, workspace_id long, warehouse_type string, change_time long")
    spaces = spark.createDataFrame([(2, "two"), (5, "five")], "workspace_id long, workspace_name string")
    assert tuple(WH.warehouse_facts(log, spaces).first()) == ("w1", "a new name", "CLASSIC", "Small", "2", "two")


def test_totals_share_the_stage_of_their_report(spark, tmp_path):
    """A percentage scans its input once: the subquery reuses the report's shuffle."""
    from meterlens.functions.shape import share_of_total
    spark.range(1000).selectExpr("id % 7 AS k", "id AS v", "id % 13 AS u").write.parquet(f"{tmp_path}/t")
    rows = spark.read.parquet(f"{tmp_path}/t")
    report = share_of_total(rows.groupBy("k").agg(F.sum("v").alias("s"), F.countDistinct("u").alias("n")), "s")
    got = report.collect()
    assert round(sum(r.percentage for r in got), 9) == 100 and len(got) == 7
    plan = report._jdf.queryExecution().executedPlan().toString()
    final = plan.split("Initial Plan")[0]
    assert "ReusedExchange" in plan or final.count("Scan parquet") == 1, plan


def test_many_rows_of_few_keys_are_joined_in_several_tasks(spark):
    mapping = spark.range(4000).select((F.col("id") % 2).alias("k"), F.col("id").alias("case"))
    typed = spark.range(60).select((F.col("id") % 3).alias("k"), F.col("id").alias("row"))
    found = join_spread(mapping, typed, ["k"], F.col("case"), task_rows=100, partitions=8).withColumn("task", F.spark_partition_id())
    assert sorted(map(tuple, found.select("k", "case", "row").collect())) == sorted(map(tuple, mapping.join(typed, "k").select("k", "case", "row").collect()))
    rows = [r["count"] for r in found.groupBy("task").count().collect()]
    assert len(rows) == 8 and max(rows) <= sum(rows) / 2


def test_series_of_top_users_are_not_gathered_for_all_users(tables):
    found = users.daily_of_top_users(tables.usage, tables.list_prices, "2023-08-04", "2024-01-30")
    assert {r.user_email for r in found.collect()} == {r.user_email for r in users.by_spend(tables.usage, tables.list_prices, "2023-08-04", "2024-01-30").limit(6).collect()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "ReusedExchange" in plan
