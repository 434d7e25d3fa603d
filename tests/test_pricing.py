from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import rows as R
from meterlens.operators import pricing as P

W = ("2024-01-01", "2024-01-31")


def totals(df):
    row = df.agg(F.sum("dbus").alias("d"), F.sum("spend").alias("s"), F.sum("records").alias("n")).first()
    return float(row.d or 0), float(row.s or 0), row.n


@pytest.fixture(params=["broadcast", "shuffled"])
def way(request, spark):
    """Both ways of pricing: with a small price list, and with one that is too large to broadcast."""
    if request.param == "shuffled":
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield request.param
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_missing_price_is_zero_and_zero_quantity_is_left_out(spark, way):
    u = R.usage(spark, R.usage_row(qty=3), R.usage_row(qty=0), R.usage_row(qty=-1), R.usage_row(qty=5, sku="SKU_NONE"))
    assert totals(P.metered(u, R.prices(spark), *W, ["workspace_id"])) == (8.0, 6.0, 2)


def test_corrections_are_kept_on_request(spark, way):
    u = R.usage(spark, R.usage_row(qty=3), R.usage_row(qty=-1))
    assert totals(P.metered(u, R.prices(spark), *W, [], positive=False)) == (2.0, 4.0, 2)


def test_window_includes_both_ends(spark, way):
    u = R.usage(spark, *[R.usage_row(day=d) for d in ("2023-12-31", "2024-01-01", "2024-01-31", "2024-02-01")])
    assert totals(P.metered(u, R.prices(spark), *W, []))[2] == 2


def test_two_open_prices_double_usage(spark, way):
    u = R.usage(spark, R.usage_row(qty=10))
    assert totals(P.metered(u, R.prices(spark, R.price_row(price="2"), R.price_row(price="3")), *W, [])) == (20.0, 50.0, 2)


def test_closed_price_is_not_used(spark, way):
    u = R.usage(spark, R.usage_row(qty=10))
    assert totals(P.metered(u, R.prices(spark, R.price_row(end="2024-01-15")), *W, []))[1] == 0


def test_price_is_per_cloud(spark, way):
    u = R.usage(spark, R.usage_row(cloud="AWS"), R.usage_row(cloud="GCP"))
    assert totals(P.metered(u, R.prices(spark, R.price_row(), R.price_row(cloud="GCP", price="7")), *W, []))[1] == 9


def test_effective_price_falls_back_to_list(spark, way):
    u = R.usage(spark, R.usage_row(), R.usage_row(sku="SKU_B"))
    p = R.prices(spark, R.price_row(effective="1.5"), R.price_row(sku="SKU_B", price="4"))
    assert float(P.metered(u, p, *W, []).agg(F.sum("effective_spend")).first()[0]) == 5.5


def test_both_ways_agree_on_the_test_tables(spark, tables):
    def spend():
        rows = P.metered(tables.usage, tables.list_prices, "2023-08-04", "2024-01-30", ["usage_date", "workspace_id"])
        return rows.groupBy("usage_date", "workspace_id").agg(F.sum("spend").alias("s"), F.sum("dbus").alias("d")).collect()
    first = {(r[0], r[1]): (r[2], r[3]) for r in spend()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    second = {(r[0], r[1]): (r[2], r[3]) for r in spend()}
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert first == second


def test_small_quantities_and_prices_are_not_rounded(spark, way):
    u = R.usage(spark, R.usage_row(qty=1), R.usage_row(qty=1)).withColumn("usage_quantity", F.lit("0.00004").cast("decimal(38,18)"))
    assert totals(P.metered(u, R.prices(spark), *W, [])) == (0.00008, 0.00016, 2)
    tiny = F.struct(F.lit("0.0000004").cast("decimal(38,18)").alias("default"),
                    F.struct(F.lit("0.0000002").cast("decimal(38,18)").alias("default")).alias("effective_list"))
    many = R.usage(spark, R.usage_row(qty=10_000_000))
    assert totals(P.metered(many, R.prices(spark).withColumn("pricing", tiny), *W, []))[1] == 4.0


def test_price_as_of_is_closed_at_both_ends(spark):
    u = R.usage(spark, R.usage_row(hour=9), R.usage_row(hour=11), R.usage_row(hour=12))
    p = R.prices(spark, R.price_row(price="1", end="2024-01-01 12:00"), R.price_row(price="2", start="2024-01-01 12:00"),
                 R.price_row(price="9", currency="EUR"))
    out = P.with_price_as_of(u, p, "2024-01-31").orderBy("usage_end_time", "as_of_price").collect()
    assert [(r.usage_end_time.hour, float(r.as_of_price)) for r in out] == [(10, 1.0), (12, 1.0), (12, 2.0), (13, 2.0)]


def test_open_price_ends_the_day_after_as_of(spark):
    u = R.usage(spark, R.usage_row(day="2024-01-10"))
    assert P.with_price_as_of(u, R.prices(spark), "2024-01-08").first().as_of_price is None
    assert float(P.with_price_as_of(u, R.prices(spark), "2024-01-10").first().as_of_price) == 2


def test_price_list_keeps_open_and_future_prices(spark):
    p = R.prices(spark, R.price_row("A"), R.price_row("B", end="2024-01-05"), R.price_row("C", end="2024-03-01"))
    out = P.price_list(p, "2024-02-01").collect()
    assert [r.sku_name for r in out] == ["A", "C"]
    assert P.negotiated_price_list(None, p, "2024-02-01").count() == 2
    assert out[0].end_time is None and out[1].end_time == datetime(2024, 3, 1)


def test_multiplier_uses_only_skus_with_both_prices(spark):
    u = R.usage(spark, R.usage_row(qty=10), R.usage_row(qty=10, sku="SKU_B"), R.usage_row(qty=99, sku="SKU_C"))
    lists = R.prices(spark, R.price_row(), R.price_row("SKU_B", "4"), R.price_row("SKU_C", "1"))
    account = R.prices(spark, R.price_row(price="1"), R.price_row("SKU_B", "4"))
    m = P.price_multiplier(u, lists, account, "2024-01-02")
    row = m.first()
    assert (round(row.multiplier, 6), row.sku_count, row.discount_percent) == (round(50 / 60, 6), 2, 16.67)
    report = spark.createDataFrame([(Decimal(12), 5)], "total_spend decimal(10,2), total_dbus int")
    assert P.apply_multiplier(report, m, ["total_spend"]).first() == (10.0, 5)
    none = P.price_multiplier(u, lists, account.filter("false"), "2024-01-02")
    assert P.apply_multiplier(report, none, ["total_spend"]).first().total_spend == 12


def test_wide_quantities_keep_their_digits(spark):
    """decimal(38,18) quantities times 12-digit prices, against Python's own decimals."""
    from decimal import Decimal, localcontext
    quantities = ["0.123456789012345678", "123456789.000000000000000001", "999999999.999999999999999999", "1", "-2.5", "0.000000000000000001"]
    price = Decimal("0.123456789012")
    base = R.usage(spark, *[R.usage_row(qty=1, sku="SKU_A") for _ in quantities]).limit(1).drop("usage_quantity")
    wide = spark.createDataFrame([(Decimal(q),) for q in quantities], "usage_quantity decimal(38,18)")
    usage = base.join(wide, how="cross")
    prices = R.prices(spark, R.price_row("SKU_A", "1")).withColumn("pricing", F.expr(
        f"named_struct('default', CAST({price}BD AS decimal(38,18)), 'effective_list', named_struct('default', CAST(NULL AS decimal(38,18))))"))
    with localcontext() as context:
        context.prec = 60
        each = [Decimal(q) * price for q in quantities]
        positive = sum(p for p in each if p > 0)
    rows = P.priced_usage(usage, prices, "2024-01-01", "2024-01-01").select("usage_quantity", "spend").collect()
    assert all(abs(r.spend - r.usage_quantity * price) < Decimal("1e-16") for r in rows) and len(rows) == 5
    total = P.metered(usage, prices, "2024-01-01", "2024-01-01", []).first()
    assert abs(total.spend - positive) < Decimal("1e-15") and total.spend == total.effective_spend
    net = P.metered(usage, prices, "2024-01-01", "2024-01-01", [], positive=False).first()
    assert abs(net.spend - sum(each)) < Decimal("1e-15")


def test_interval_join_meets_few_versions(spark):
    """A SKU with 400 daily versions: results as a plain interval join, closed ends, and few pairs compared."""
    from meterlens.operators.intervals import join_intervals
    start = datetime(2023, 1, 1)
    from datetime import timedelta
    versions = spark.createDataFrame([("a", i, start + timedelta(days=i), start + timedelta(days=i + 1)) for i in range(400)] + [
        ("a", -1, datetime(1969, 12, 1), datetime(2030, 1, 1)), ("a", -2, start, None), ("a", -3, datetime(2023, 2, 1), start),
        ("b", -4, datetime(1960, 1, 1), datetime(1960, 1, 1))], "k2 string, v int, lo timestamp, hi timestamp")
    points = spark.createDataFrame([("a", i, start + timedelta(hours=12 * i)) for i in range(-3, 803)] + [
        ("b", 0, datetime(1960, 1, 1)), ("c", 0, start), (None, 0, start), ("a", 9999, None)], "k string, p int, at timestamp")
    plain = points.join(versions, (F.col("k") == F.col("k2")) & F.col("at").between(F.col("lo"), F.col("hi")), "left")
    key = lambda df: sorted(map(tuple, df.select("k", "p", "v").collect()), key=str)
    for width in (3600 * 24, 30 * 86400, 10**9):
        assert key(join_intervals(points, versions, [("k", "k2")], "at", "lo", "hi", seconds=width)) == key(plain)
