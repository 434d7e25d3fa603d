from datetime import date

from pyspark.sql import functions as F

import rows as R
from meterlens.operators import allocate as A
from meterlens.operators.joins import hot_keys, join_spread
from meterlens.plans import quality as D
from meterlens.plans import spend as S

W = ("2024-01-01", "2024-01-31")


def sql_row(day="2024-01-01", hour=0, qty=10, wh="w1", ws=1):
    return R.usage_row(day=day, hour=hour, qty=qty, product="SQL", warehouse_id=wh, ws=ws)


def test_tool_split_by_work(spark):
    usage = R.usage(spark, sql_row(), sql_row(day="2024-01-02"))
    history = R.history(spark, R.query_row("a", "2024-01-01 05:00:00", 5, task_ms=3000, client="Genie X"),
                        R.query_row("b", "2024-01-01 06:00:00", 5, task_ms=1000), R.query_row("c", "2024-01-03 06:00:00", 5))
    out = {(r.sql_product, r.usage_date): r.attributed_spend for r in A.tool_attribution(usage, R.prices(spark), history, *W).collect()}
    # the second day has cost and no query: dropped; the third a query and no cost: null
    assert out == {("Genie", date(2024, 1, 1)): 15.0, ("DBSQL", date(2024, 1, 1)): 5.0, ("DBSQL", date(2024, 1, 3)): None}
    gap = D.sql_attribution(usage, R.prices(spark), history, *W).first()
    assert (gap.billing_spend, gap.attributed_spend, gap.difference_pct, gap.status) == (40.0, 20.0, 50.0, "info")


def test_zero_and_null_work_cost_nothing(spark):
    usage = R.usage(spark, sql_row())
    history = R.history(spark, R.query_row("a", "2024-01-01 05:00:00", 5, task_ms=0), R.query_row("b", "2024-01-01 05:00:00", 5, task_ms=None))
    assert [r.attributed_spend for r in A.tool_attribution(usage, R.prices(spark), history, *W).collect()] == [0.0]


def test_warehouse_in_two_workspaces_keeps_its_cost(spark):
    usage = R.usage(spark, sql_row(ws=1), sql_row(ws=2), R.usage_row(product="JOBS", qty=3))
    history = R.history(spark, R.query_row("a", "2024-01-01 05:00:00", 5))
    out = {r.product_category: r for r in S.by_product(usage, R.prices(spark), history, *W).collect()}
    assert (out["SQL - DBSQL"].total_spend, out["SQL - DBSQL"].workspace_count) == (40.0, 2)
    one = {r.product_category: r for r in S.by_product(usage, R.prices(spark), history, *W, workspace_id="2").collect()}
    assert (one["SQL - DBSQL"].total_spend, one["SQL - DBSQL"].workspace_count) == (20.0, 1) and "ETL - Batch" not in one


def test_cost_per_query_uses_the_start_hour(spark):
    usage = R.usage(spark, sql_row(hour=5), sql_row(hour=6, qty=100), sql_row(hour=5, qty=-2))
    history = R.history(spark, R.query_row("long", "2024-01-01 05:59:00", 7200, task_ms=3000), R.query_row("none", "2024-01-01 05:10:00", 1, task_ms=None),
                        R.query_row("idle", "2024-01-01 09:10:00", 0, task_ms=5), R.query_row("cancelled", "2024-01-01 05:10:00", 9, kind="CANCEL"),
                        R.query_row("late", "2024-01-01 09:10:00", 3))
    out = {r.statement_id: r for r in A.cost_per_query(usage, R.prices(spark), history, *W).collect()}
    assert set(out) == {"long", "none", "late"}
    # missing task time counts as the duration; the negative correction nets out
    assert (out["long"].query_attributed_dollars_estimation, out["none"].query_attributed_dollars_estimation) == (12.0, 4.0)
    assert out["late"].query_attributed_dollars_estimation is None
    assert out["long"].query_profile_url.endswith("queryStartTimeMs=1704088740000")


def test_shares_of_each_hour_add_up_to_its_bill(spark, tables):
    mart = A.cost_per_query(tables.usage, tables.list_prices, tables.query_history, "2023-08-04", "2024-01-30")
    spent = mart.agg(F.sum("query_attributed_dollars_estimation")).first()[0]
    work = F.coalesce("total_task_duration_ms", (F.unix_timestamp("end_time") - F.unix_timestamp("start_time")) * 1000)
    hours = (tables.query_history.filter("compute.warehouse_id is not null and statement_type != 'CANCEL' and coalesce(executed_by, executed_as_user_id) is not null")
             .groupBy(F.date_trunc("hour", "start_time").alias("h"), F.col("compute.warehouse_id").alias("w")).agg(F.sum(work).alias("work"))
             .filter("work > 0"))
    u = tables.usage.filter("billing_origin_product = 'SQL'").select(F.date_trunc("hour", "usage_start_time").alias("h"),
                                                                    F.col("usage_metadata.warehouse_id").alias("w"), "sku_name", "cloud", "usage_quantity")
    billed = (u.join(hours, ["h", "w"]).join(tables.list_prices.select("sku_name", "cloud", F.col("pricing.default").alias("p")), ["sku_name", "cloud"])
              .agg(F.sum(F.col("usage_quantity") * F.col("p"))).first()[0])
    assert abs(spent - float(billed)) < 1e-6


def test_salted_join_equals_the_plain_join_on_a_hot_key(spark):
    big = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(0)).when(F.col("id") % 50 > 1, F.col("id") % 50).alias("k"),
                                   F.col("id").alias("u"))
    small = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left"):
        plain = sorted(map(tuple, big.join(small, "k", how).select("k", "u", "v").collect()), key=str)
        for task_rows in (100, 100_000):
            joined = join_spread(big, small, ["k"], F.col("u"), how, task_rows=task_rows).select("k", "u", "v")
            assert sorted(map(tuple, joined.collect()), key=str) == plain
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    parts = (join_spread(big, small, ["k"], F.col("u"), task_rows=50).filter("k = 0")
             .select(F.spark_partition_id()).distinct().count())
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert parts > 1


def test_copies_follow_the_rows_of_a_key(spark):
    counts = spark.createDataFrame([("median", 1_000), ("warm", 30_000), ("hot", 1_000_000), (None, 500_000)], "k string, rows long")
    found = {r.k: r._copies for r in hot_keys(counts, ["k"], "rows", 1_000).collect()}
    assert found == {"warm": 30, "hot": 1_000}
    assert [r.k for r in hot_keys(counts, ["k"], "rows", 1_000, most=1).collect()] == ["hot"]
    assert hot_keys(counts, ["k"], "rows", 2_000_000).count() == 0
    assert hot_keys(counts.limit(0), ["k"], "rows").count() == 0


def test_hot_keys_are_counted_by_the_stage_that_adds_up_the_work(spark, tables):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    plan = A.cost_per_query(tables.usage, tables.list_prices, tables.query_history, *W)._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("ReusedExchange [hour_bucket") == 2
