from datetime import date
from decimal import Decimal

import pytest

import rows as R
from meterlens.operators import trend as T
from meterlens.plans import alerts as N
from meterlens.plans import kpis as K


def series(spark, *pairs):
    return spark.createDataFrame([(date.fromisoformat(d), v) for d, v in pairs], "date date, value double")


def test_weeks_start_on_monday(spark):
    s = series(spark, ("2024-01-07", 1.0), ("2024-01-08", 2.0), ("2024-01-14", 4.0))
    assert [tuple(r) for r in T.roll_up(s, "weekly").collect()] == [(date(2024, 1, 1), 1.0), (date(2024, 1, 8), 6.0)]
    assert [tuple(r) for r in T.roll_up(s, "monthly", average=True).collect()] == [(date(2024, 1, 1), 7 / 3)]


@pytest.mark.parametrize("last,label", [(104.9, "flat"), (105.0, "increasing"), (95.0, "decreasing"), (95.1, "flat")])
def test_trend_label(spark, last, label):
    row = T.summarize(series(spark, ("2024-01-02", last), ("2024-01-01", 100.0))).first()
    assert (row.trend, row.period_start_value, row.period_end_value) == (label, 100.0, last)


def test_summary_of_nothing_and_of_a_zero_start(spark):
    assert T.summarize(series(spark)).first() == (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, "flat")
    row = T.summarize(series(spark, ("2024-01-01", 0.0), ("2024-01-02", 5.0), ("2024-01-03", 0.0))).first()
    assert (row.change_percent, row.trend) == (0.0, "flat")
    row = T.summarize(series(spark, ("2024-01-01", 0.0), ("2024-01-02", 5.0), ("2024-01-03", 8.0), ("2024-01-04", 0.0)), positive_only=True).first()
    assert (row.period_start_value, row.period_end_value, row.change_percent, row.min_value) == (5.0, 8.0, 60.0, 5.0)
    assert T.summarize(series(spark, ("2024-01-01", 0.0)), positive_only=True).first().max_value == 0.0


def test_burndown(spark):
    daily = spark.createDataFrame([(date(2024, 1, 1), Decimal(10)), (date(2024, 1, 3), Decimal(20))], "usage_date date, total_spend decimal(10,2)")
    args = (daily, "2024-01-01", "2024-01-11", 100.0, "2024-01-06")
    rows = T.burndown(*args).collect()
    assert [r.actual_cumulative for r in rows] == [10, 10, 30, 30, 30, 30, None, None, None, None, None]
    assert [r.ideal_cumulative for r in rows][:3] == [0, 10, 20]
    k = T.burndown_kpis(*args).first()
    assert (k.spent_to_date, k.remaining, k.days_elapsed, k.days_remaining, k.pace_status) == (30, 70, 5, 5, "under")
    assert k.projected_end_date == date(2024, 1, 17)
    line = T.burndown_projection(*args).collect()
    assert line[4].projected_cumulative is None and line[5].projected_cumulative == 30 and line[10].projected_cumulative == round(30 + 70 / 11 * 5, 2)


def spend(spark, *days):
    return R.usage(spark, *[R.usage_row(day=d, qty=q) for d, q in days])


def test_previous_day_is_the_previous_day_with_rows(spark):
    u = spend(spark, ("2024-01-01", 10), ("2024-01-04", 15), ("2024-01-05", 14))
    rows = N.spend_anomalies(u, R.prices(spark), "2024-01-01", "2024-01-31").collect()
    assert [(r.usage_date.day, float(r.prev_day_spend), r.change_percent) for r in rows] == [(4, 20.0, 50.0), (5, 30.0, -6.67)]


def test_unpriced_previous_day_gives_no_spike(spark):
    u = R.usage(spark, R.usage_row(day="2024-01-01", sku="SKU_NONE"), R.usage_row(day="2024-01-02", qty=5))
    assert N.spend_spikes(u, R.prices(spark), "2024-01-05").count() == 0
    assert N.spend_anomalies(u, R.prices(spark), "2024-01-01", "2024-01-05").count() == 0


def test_alerts(spark):
    u = spend(spark, ("2024-01-01", 10), ("2024-01-02", 20), ("2024-01-03", 21))
    p = R.prices(spark)
    spikes = N.spend_spikes(u, p, "2024-01-03").collect()
    assert [(r.usage_date.day, r.severity) for r in spikes] == [(2, "high")]
    assert [r.excess_amount for r in N.threshold_breaches(u, p, "2024-01-03", 40).collect()] == [2.0]
    assert N.spike_alert(u, p, "2024-01-03", 50).first().percent_change == 100.0
    assert N.spike_alert(u, p, "2024-01-04", 50).first().alert_date is None
    assert N.daily_threshold_alert(u, p, "2024-01-03", 39).first().excess_amount == 1.0
    assert N.daily_threshold_alert(u, p, "2024-01-03", 40).count() == 0
    assert N.workspace_threshold_alert(u, p, "2024-01-03", 100).first().days_active == 3
    assert N.workspace_threshold_alert(u, p, "2024-01-03", 102).count() == 0


def test_weekly_distinct_is_not_a_sum_of_days(spark):
    u = R.usage(spark, *[R.usage_row(day=f"2024-01-0{d}", job_id="j1") for d in (1, 2, 3)])
    assert [r.value for r in K.usage_kpi(u, R.prices(spark), "2024-01-01", "2024-01-07", "total_jobs", "weekly").collect()] == [1]


def test_kpis_of_an_empty_window(spark):
    u = R.usage(spark, R.usage_row())
    runs = spark.createDataFrame([], "run_id string, period_start_time timestamp, result_state string")
    row = K.platform_kpis(u, R.history(spark, R.query_row("a", "2024-01-01 05:00:00", 5)), runs, "2025-01-01", "2025-01-02").first()
    assert (row.total_queries, row.total_jobs, row.total_serving_dbus, row.successful_runs) == (0, 0, 0, 0)
