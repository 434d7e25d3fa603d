"""The utilisation-aware cost mart (A4), built forward hour by hour, and the reports that read it.

A run starts where the last one ended.  It is given what holds at that moment: the
state of every warehouse with its number of active queries, and the queries whose work
was not over.  So it reads the events, bills and new queries of its own hours only,
and building day by day gives what building at once gives.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlens.operators import timeline as T
from meterlens.operators.timeline import Bounds
from meterlens.sources.versions import DAY, Manifest, Store

#: Tables of the mart; the last two hold what the next run starts from.
BY_HOUR, QUERIES, OPEN, STATE = "cost_by_hour", "queries", "open_queries", "warehouse_state"
SUMS = {BY_HOUR: ["hour_cost", "hour_dbus"]}


def store_of(tables, root: str) -> Store:
    return Store(tables.usage.sparkSession, f"{root}/utilized_cost")


def _states(events: DataFrame, queries: DataFrame, bounds: Bounds, opening: DataFrame | None) -> DataFrame:
    """State and active queries of every warehouse at the end of the range."""
    state = F.when(F.col("cluster_count") == 0, 0).when(F.col("cluster_count") > 0, 1)
    known = events.filter((F.col("event_time") < bounds.lit_end()) & state.isNotNull())
    deltas = T.query_deltas(queries).filter(F.col("second") < bounds.lit_end())
    nothing = F.lit(0).cast("long").alias("active")
    if opening is not None:
        known = known.filter(F.col("event_time") >= bounds.lit_start())
        deltas = deltas.filter(F.col("second") >= bounds.lit_start())
    last = known.groupBy("warehouse_id").agg(F.max_by(state, "event_time").alias("state")).select("warehouse_id", "state", nothing, F.lit(1).alias("at"))
    net = deltas.groupBy("warehouse_id").agg(F.sum("delta").alias("active")).select("warehouse_id", F.lit(None).cast("int").alias("state"), "active", F.lit(2).alias("at"))
    rows = last.unionByName(net)
    if opening is not None:
        rows = rows.unionByName(opening.select("warehouse_id", "state", "active", F.lit(0).alias("at")))
    return rows.groupBy("warehouse_id").agg(F.max_by("state", F.when(F.col("state").isNotNull(), F.col("at"))).alias("state"), F.sum("active").alias("active"))


def _still_open(queries: DataFrame, bounds: Bounds) -> DataFrame:
    """Queries that can have work, or an end, after the range."""
    last = F.greatest("query_work_start_time", "query_work_end_time")
    return queries.filter(last >= bounds.lit_end() - F.expr("interval 1 second"))


def extend(tables, root: str, until: datetime, as_of: str, since: datetime | None = None, exact: bool = False) -> Manifest:
    """Build the mart up to the whole hour ``until``, from its last hour, or from ``since`` if there is no mart yet.

    The new version appears at once.  A run that is repeated, or that ends where the mart ends, changes nothing.
    """
    store = store_of(tables, root)
    base = store.current()
    if base is None and since is None:
        raise ValueError("a new mart needs the hour it starts at")
    start = since if base is None else datetime.fromisoformat(base.notes["until"])
    if until <= start:
        return base or Manifest()
    bounds = Bounds(start, until)
    opening = carried = None
    if base is not None:
        opening, carried = store.open(STATE, manifest=base), store.open(OPEN, manifest=base)
        opening = opening.drop(DAY) if opening is not None else None
    queries = T.work_queries(tables.query_history, bounds, from_start=base is not None)
    if carried is not None:
        queries = queries.unionByName(carried.drop(DAY))
    pieces = T.cost_by_hour(tables.usage, tables.price_history, queries, tables.warehouse_events, as_of, bounds, exact, opening)
    pieces = pieces.filter((F.col("hour_bucket") >= bounds.lit_start()) & (F.col("hour_bucket") < bounds.lit_end()))
    hourly = pieces.withColumn(DAY, F.to_date("hour_bucket"))
    fresh = queries if carried is None else T.work_queries(tables.query_history, bounds, from_start=True)
    fresh = fresh.withColumn(DAY, F.to_date("start_time"))
    if base is not None:  # a day may be built in parts
        hourly = _with_old(store, base, BY_HOUR, hourly, start)
        fresh = _with_old(store, base, QUERIES, fresh, start)
    end_day = F.lit(str((until - timedelta(seconds=1)).date())).cast("date")
    made = store.stage({BY_HOUR: hourly, QUERIES: fresh, OPEN: _still_open(queries, bounds).withColumn(DAY, end_day),
                        STATE: _states(tables.warehouse_events, queries, bounds, opening).withColumn(DAY, end_day)}, SUMS)
    latest = T.warehouse_rows(tables.usage, bounds).agg(F.unix_micros(F.max(F.date_trunc("hour", "usage_start_time")))).first()[0]
    old = base.days if base else {}
    days = {BY_HOUR: old.get(BY_HOUR, {}) | made[BY_HOUR], QUERIES: old.get(QUERIES, {}) | made[QUERIES], OPEN: made[OPEN], STATE: made[STATE]}
    bill = str(latest) if latest is not None else (base.notes["latest_bill"] if base else "")
    return store.commit(base, days, {"until": until.isoformat(), "since": (base.notes["since"] if base else start.isoformat()), "latest_bill": bill})


def _with_old(store: Store, base: Manifest, table: str, rows: DataFrame, start: datetime) -> DataFrame:
    day = str(start.date())
    old = store.open(table, day, day, base)
    return rows if old is None else rows.unionByName(old.select(*rows.columns))


def hourly_costs(store: Store, start: str | None = None, end: str | None = None) -> DataFrame | None:
    """A4h from the mart, for some days."""
    return store.open(BY_HOUR, start, end)


def costs(store: Store) -> DataFrame | None:
    """Start and cost of every query: what A15 and A16 read."""
    manifest = store.current()
    if manifest is None or not manifest.of(QUERIES):
        return None
    names = {"query_attributed_dollars_estimation": "hour_cost", "query_attributed_dbus_estimation": "hour_dbus"}
    sums = store.open(BY_HOUR, manifest=manifest).groupBy("statement_id", "warehouse_id").agg(*[F.sum(c).alias(n) for n, c in names.items()])
    return store.open(QUERIES, manifest=manifest).select("statement_id", "warehouse_id", "start_time").join(sums, ["statement_id", "warehouse_id"], "left")


def cost_per_query(store: Store, host: str = "") -> DataFrame | None:
    """A4 from the mart, with the attributes of the queries."""
    manifest = store.current()
    if manifest is None or not manifest.of(BY_HOUR):
        return None
    bill = manifest.notes["latest_bill"]
    latest = F.timestamp_micros(F.lit(int(bill) if bill else None).cast("long"))
    return T.cost_per_query(store.open(QUERIES, manifest=manifest).drop(DAY), store.open(BY_HOUR, manifest=manifest).drop(DAY), latest, host, "left")


def hour_of(text: str) -> datetime:
    """A whole hour of the UTC day, as the mart names it."""
    return datetime.fromisoformat(text).replace(tzinfo=timezone.utc)
