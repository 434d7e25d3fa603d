"""The utilisation mart: built forward in steps, at once, and as the live plan."""

import random
from datetime import datetime, timedelta, timezone
from types import SimpleNamespace

import pytest

import rows as R
from meterlens.operators import timeline as T
from meterlens.plans import utilized as U

START, DAYS = datetime(2024, 1, 1, tzinfo=timezone.utc), 4
END = START + timedelta(days=DAYS)


@pytest.fixture(scope="module")
def inputs(spark):
    rng = random.Random(5)

    def moment(first=-40):
        return START + timedelta(hours=rng.uniform(first, 24 * DAYS))
    queries = []
    for i in range(150):
        begin = moment(-3)
        queries.append(R.query_row(f"q{i}", begin.replace(tzinfo=None).isoformat(), rng.choice([0.3, 40, 4000, 90000]) * rng.random(),
                                   rng.choice(["hot", "hot", "w2", "w3"]), 1 + rng.randrange(5000)))
    # one that runs over midnight into a third day, one that starts and ends at midnight
    queries += [R.query_row("long", "2024-01-01 22:30:00", 100000, "w2", 500), R.query_row("at", "2024-01-02 00:00:00", 0, "w3", 500)]
    events = [(rng.choice(["hot", "w2", "w4"]), moment().replace(tzinfo=None).isoformat(), rng.choice([0, 1, 2])) for _ in range(80)]
    events += [("w3", "2023-11-01 00:00:00", 2), ("hot", "2024-01-03 00:00:00", 0), ("hot", "2024-01-03 00:00:01", 1)]
    usage = [R.usage_row(day=str((START + timedelta(hours=h)).date()), hour=h % 24, qty=1 + h % 7, sku="SQL_A", product="SQL", warehouse_id=w)
             for h in range(24 * DAYS) for w in ("hot", "w2", "w3") if (h * 7 + len(w)) % 5]
    return SimpleNamespace(usage=R.usage(spark, *usage), price_history=R.prices(spark, R.price_row("SQL_A", "2")),
                           query_history=R.history(spark, *queries), warehouse_events=R.events(spark, *events))


def hours_of(df):
    return sorted((r.statement_id, str(r.hour_bucket), None if r.hour_cost is None else round(r.hour_cost, 9),
                   None if r.hour_dbus is None else round(r.hour_dbus, 9), r.billed) for r in df.collect())


def test_steps_give_what_one_run_gives(spark, inputs, tmp_path):
    at_once, stepped = str(tmp_path / "once"), str(tmp_path / "steps")
    U.extend(inputs, at_once, END, "2024-02-01", START)
    for step in (1, 1, 24, 25, 60, 60, 96):
        U.extend(inputs, stepped, START + timedelta(hours=step), "2024-02-01", START)
    once, steps = U.store_of(inputs, at_once), U.store_of(inputs, stepped)
    assert hours_of(U.hourly_costs(once)) == hours_of(U.hourly_costs(steps))
    assert sorted(map(str, U.costs(once).select("statement_id", "start_time").collect())) == sorted(map(str, U.costs(steps).select("statement_id", "start_time").collect()))
    states = [sorted(map(tuple, s.open(U.STATE).select("warehouse_id", "state", "active").collect())) for s in (once, steps)]
    assert states[0] == states[1]
    assert (steps.current().number, steps.current().notes["until"]) == (5, END.isoformat())
    assert steps.current().notes["latest_bill"] == once.current().notes["latest_bill"]


def test_mart_gives_what_the_live_plan_gives(spark, inputs, tmp_path):
    U.extend(inputs, str(tmp_path), END, "2024-02-01", START)
    store = U.store_of(inputs, str(tmp_path))
    live = T.utilized_cost_per_query(inputs.usage, inputs.price_history, inputs.query_history, inputs.warehouse_events, "2024-02-01", T.Bounds(START, END))

    def shown(df):
        return sorted((r.statement_id, r.most_recent_billing_hour, r.billing_record_check, r.duration_seconds,
                       *[None if x is None else round(x, 9) for x in (r.query_attributed_dollars_estimation, r.query_attributed_dbus_estimation)]) for r in df.collect())
    assert shown(U.cost_per_query(store)) == shown(live)
    assert len(shown(live)) > 100 and any(r[4] for r in shown(live))


def test_next_run_reads_its_own_events_only(spark, inputs, tmp_path):
    U.extend(inputs, str(tmp_path), START + timedelta(days=1), "2024-02-01", START)
    kept = inputs.warehouse_events.filter("event_time >= '2024-01-02'")
    later = SimpleNamespace(**{**vars(inputs), "warehouse_events": kept, "query_history": inputs.query_history.filter("start_time >= '2024-01-02'")})
    U.extend(later, str(tmp_path), END, "2024-02-01")
    whole = str(tmp_path / "whole")
    U.extend(inputs, whole, END, "2024-02-01", START)
    assert hours_of(U.hourly_costs(U.store_of(inputs, str(tmp_path)))) == hours_of(U.hourly_costs(U.store_of(inputs, whole)))


def test_a_new_mart_needs_a_start(spark, inputs, tmp_path):
    assert U.costs(U.store_of(inputs, str(tmp_path))) is None and U.cost_per_query(U.store_of(inputs, str(tmp_path))) is None
    with pytest.raises(ValueError):
        U.extend(inputs, str(tmp_path), END, "2024-02-01")
