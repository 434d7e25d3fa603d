"""The cell-wise timeline against a second-by-second simulation."""

import random
from collections import defaultdict
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

import rows as R
from meterlens.operators import timeline as T

START, END = datetime(2024, 1, 1, 1), datetime(2024, 1, 2, 3)
BOUNDS = T.Bounds(START.replace(tzinfo=timezone.utc), END.replace(tzinfo=timezone.utc))


def whole(ts):
    return ts.replace(microsecond=0)


def simulate(queries, events):
    """Seconds per (warehouse, hour, flag), one second at a time."""
    seconds = int((END - START).total_seconds())
    active, state = defaultdict(lambda: [0] * seconds), {}
    for wh, begin, end in queries:
        a, b = whole(begin), whole(end)
        if a == b:
            b += timedelta(seconds=1)
        for s in range(max(0, int((a - START).total_seconds())), min(seconds, int((b - START).total_seconds()))):
            active[wh][s] += 1
        active[wh]
    for wh in list(active):
        mine = sorted((whole(ts), i, n) for i, (w, ts, n) in enumerate(sorted(events, key=lambda e: e[1]))
                      if w == wh and ts <= END)
        line, now, k = [], None, 0
        for s in range(seconds):
            at = START + timedelta(seconds=s)
            while k < len(mine) and mine[k][0] <= at:
                now, k = mine[k][2], k + 1
            line.append(now)
        state[wh] = line
    out = defaultdict(int)
    for wh in active:
        for s in range(seconds):
            flag = "OFF" if not state[wh][s] else "UTILIZED" if active[wh][s] else "ON_IDLE"
            out[wh, (START + timedelta(seconds=s)).replace(minute=0, second=0), flag] += 1
    return dict(out)


def frames(spark, queries, events):
    q = [R.query_row(f"q{i}", a.isoformat(), (b - a).total_seconds(), wh) for i, (wh, a, b) in enumerate(queries)]
    work = T.work_queries(R.history(spark, *q), BOUNDS)
    return R.events(spark, *[(w, ts.isoformat(), n) for w, ts, n in events]), work


def check(spark, queries, events):
    ev, work = frames(spark, queries, events)
    found = {}
    for r in T.utilization(ev, work, BOUNDS).collect():
        assert r.total_seconds == 3600
        for flag, n in (("UTILIZED", r.utilized_seconds), ("ON_IDLE", r.idle_seconds), ("OFF", r.off_seconds)):
            if n:
                found[r.warehouse_id, r.warehouse_hour, flag] = n
    assert found == simulate(queries, events)


def at(text):
    return datetime.fromisoformat(f"2024-01-{text}")


def test_one_query_crossing_hour_and_midnight(spark):
    check(spark, [("w1", at("01 22:30"), at("02 00:15"))], [("w1", at("01 20:00"), 1), ("w1", at("02 00:05"), 0)])


def test_warehouse_without_events_is_off(spark):
    check(spark, [("w1", at("01 05:00"), at("01 05:10"))], [("w2", at("01 04:00"), 1)])


def test_repeated_states_and_event_from_the_day_before(spark):
    check(spark, [("w1", at("01 05:00:10.5"), at("01 05:00:10.9"))],
          [("w1", at("01 00:30"), 2), ("w1", at("01 04:00"), 3), ("w1", at("01 05:00:10"), 0), ("w1", at("01 05:00:40"), 1)])


def test_warehouse_switched_on_a_month_before(spark):
    queries, events = [("w1", at("01 05:00"), at("01 05:20")), ("w2", at("01 06:00"), at("01 06:20"))], [
        ("w1", at("01 00:00") - timedelta(days=31), 1), ("w2", at("01 00:00") - timedelta(days=40), 1), ("w2", at("01 00:00") - timedelta(days=39), 0)]
    check(spark, queries, events)
    ev, work = frames(spark, queries, events)
    windows = {r.warehouse_id: r.window_state for r in T.on_off_windows(ev, work, BOUNDS).collect()}
    assert windows == {"w1": "ON", "w2": "OFF"}


def test_only_hours_asked_for_are_cut(spark):
    """Rows follow events, queries and bills, not warehouses times hours; states run on over hours without a row."""
    ev, work = frames(spark, [("w1", at("01 02:10"), at("01 02:20")), ("w1", at("02 01:10"), at("02 01:20"))], [("w1", at("01 02:00"), 1)])
    asked = spark.createDataFrame([("w1", at("02 01:00")), ("w1", at("01 20:00"))], "warehouse_id string, hour timestamp")
    rows = {r.warehouse_hour: (r.utilized_seconds, r.idle_seconds, r.off_seconds) for r in T.utilization(ev, work, BOUNDS, hours=asked).collect()}
    assert rows == {at("02 01:00"): (600, 3000, 0), at("01 20:00"): (0, 3600, 0)}
    opening = spark.createDataFrame([("w1", 1, 2)], "warehouse_id string, state int, active long")
    later = T.Bounds(datetime(2024, 1, 2, tzinfo=timezone.utc), BOUNDS.end)
    rows = {r.warehouse_hour: (r.utilized_seconds, r.idle_seconds, r.off_seconds)
            for r in T.utilization(ev.filter("false"), work, later, hours=asked.filter("day(hour) = 2"), opening=opening).collect()}
    assert rows == {at("02 01:00"): (3600, 0, 0)}


def test_queries_starting_in_the_same_second_and_out_of_range(spark):
    check(spark, [("w1", at("01 05:00:00.1"), at("01 05:00:03")), ("w1", at("01 05:00:00.8"), at("01 06:30")),
                  ("w1", at("01 00:10"), at("01 01:20")), ("w1", at("02 02:50"), at("02 04:00"))], [("w1", at("01 00:00"), 1)])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_against_simulation(spark, seed):
    rng = random.Random(seed)

    def moment():
        return START + timedelta(seconds=rng.uniform(-1800, (END - START).total_seconds() - 1))
    queries = []
    for _ in range(120):
        begin = moment()
        end = begin + timedelta(seconds=rng.choice([0.2, 3.7, 61, 900, 9000]) * rng.random())
        if end > START and begin < END:
            # one warehouse owns most queries
            queries.append((rng.choice(["hot", "hot", "hot", "w2", "w3"]), begin, end))
    events = [(rng.choice(["hot", "w2", "w4"]), moment(), rng.choice([0, 0, 1, 2])) for _ in range(60)]
    check(spark, queries, events)


def test_windows_and_steps(spark):
    ev, work = frames(spark, [("w1", at("01 22:30"), at("02 01:00")), ("w1", at("01 23:00"), at("01 23:30"))],
                      [("w1", at("01 20:00"), 1), ("w1", at("01 21:00"), 2), ("w1", at("02 00:05"), 0)])
    windows = [(r.window_state, r.event_window_start, r.event_window_end) for r in T.on_off_windows(ev, work, BOUNDS).orderBy("event_window_start").collect()]
    assert windows == [("ON", at("01 20:00"), at("02 00:05")), ("OFF", at("02 00:05"), END)]
    steps = T.concurrency_steps(work, BOUNDS)
    assert [(r.query_start, r.query_end, r.queries_active) for r in steps.orderBy("query_start").collect()] == [
        (at("01 22:30"), at("01 23:00"), 1), (at("01 23:00"), at("01 23:30"), 2), (at("01 23:30"), at("02 01:00"), 1), (at("02 01:00"), END, 0)]
    pieces = T.steps_by_day(steps).filter("queries_active = 1").orderBy("query_start").collect()
    assert [(r.query_start, r.query_end) for r in pieces][1:] == [(at("01 23:30"), at("02 00:00")), (at("02 00:00"), at("02 01:00"))]


def test_cost_is_split_over_hours_by_use(spark):
    """An hour half used costs half; the query that ran 3 of 4 busy work seconds gets three quarters."""
    history = R.history(spark, R.query_row("a", "2024-01-01 05:00:00", 1800, "w1", 3000), R.query_row("b", "2024-01-01 05:10:00", 60, "w1", 1000))
    events = R.events(spark, ("w1", "2024-01-01 00:30:00", 1), ("w1", "2024-01-02 05:00:00", 1))
    usage = R.usage(spark, *[R.usage_row(day="2024-01-01", hour=h, qty=10, sku="SQL_A", product="SQL", warehouse_id="w1") for h in range(24)],
                    R.usage_row(day="2024-01-02", hour=4, qty=1, sku="SQL_A", product="SQL", warehouse_id="w1"))
    prices = R.prices(spark, R.price_row("SQL_A", "2"))
    out = {r.statement_id: r for r in T.utilized_cost_per_query(usage, prices, history, events, "2024-01-31", BOUNDS).collect()}
    assert round(out["a"].query_attributed_dollars_estimation, 6) == 20 * 0.5 * 0.75
    assert round(out["b"].query_attributed_dbus_estimation, 6) == 10 * 0.5 * 0.25
    assert out["a"].billing_record_check == "Has Billing Record"
    assert [h.hour_bucket for h in out["a"].statement_hour_bucket_costs] == [at("01 05:00")]


def test_work_by_hour_adds_up(spark):
    _, work = frames(spark, [("w1", at("01 05:20"), at("01 08:10")), ("w1", at("01 06:00"), at("01 06:00"))], [])
    parts = T.work_by_hour(work).groupBy("statement_id").agg(F.sum("attributed_query_work").alias("s"), F.count("*").alias("n")).orderBy("statement_id").collect()
    assert (round(parts[0].s, 9), parts[0].n) == (1.0, 4)
    assert (parts[1].s, parts[1].n) == (0.0, 1)


def test_time_bounds(spark):
    history = R.history(spark, R.query_row("a", "2024-01-01 02:30:00", 60))
    events = R.events(spark, ("w1", "2024-01-01 01:10:00", 1), ("w1", "2024-01-05 01:10:00", 1))
    usage = R.usage(spark, R.usage_row(hour=0), R.usage_row(day="2024-01-04", hour=5))
    assert T.time_bounds(usage, history, events).first() == (at("01 03:00"), at("01 02:00"))
