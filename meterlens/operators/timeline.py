"""Utilisation of warehouses over time, and cost by utilised time (A4).

The raw definition is a sweep over each warehouse's whole life: gaps and
islands of on/off events, a running count of active queries, and an interval
join of both with every boundary.  A warehouse may own a third of all queries,
so none of that runs over a whole warehouse here.  Time is cut into
(warehouse, hour) cells:

* events and query starts/ends are first grouped per second, so a cell holds
  at most 3,600 points whatever the traffic; all events before the range count
  as one, the last;
* each cell gets the state and the number of active queries it opens with, from
  a window over one row per (warehouse, hour) that has points or is asked for.
  Hours in which nothing happens have no row: the state runs on over them;
* the points of a cell are one array, and a single pass over it adds up the
  seconds of each kind.

No interval join is left, events are read once, and every step is an aggregate or
a bounded window.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec

from meterlens.functions import classify as C
from meterlens.operators.allocate import meta_warehouse, source_url
from meterlens.operators.joins import join_spread
from meterlens.operators.pricing import with_price_as_of


@dataclass(frozen=True)
class Bounds:
    """Whole hours covered by events, queries and bills alike: [start, end)."""
    start: datetime
    end: datetime

    def lit_start(self) -> Column:
        return F.lit(self.start).cast("timestamp")

    def lit_end(self) -> Column:
        return F.lit(self.end).cast("timestamp")


def time_bounds(usage: DataFrame, history: DataFrame, events: DataFrame) -> DataFrame:
    """One row (selected_start_time, selected_end_time)."""
    def ends(df: DataFrame, low: str, high: str) -> DataFrame:
        return df.agg(F.min(low).alias("low"), F.max(high).alias("high"))
    parts = (ends(events, "event_time", "event_time")
             .unionByName(ends(history, "start_time", "end_time"))
             .unionByName(ends(usage, "usage_end_time", "usage_end_time")))
    return parts.agg(
        (F.date_trunc("hour", F.max("low")) + F.expr("interval 1 hour")).alias("selected_start_time"),
        F.date_trunc("hour", F.min("high")).alias("selected_end_time"))


def read_bounds(usage: DataFrame, history: DataFrame, events: DataFrame) -> Bounds:
    """The two bound values, as literals for the plans below so that scans can prune on them."""
    spark = usage.sparkSession
    micros = time_bounds(usage, history, events).select(
        F.unix_micros("selected_start_time"), F.unix_micros("selected_end_time")).first()
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone != "UTC":
        raise ValueError("the timeline expects a UTC session")
    from datetime import timezone
    return Bounds(*(datetime.fromtimestamp(m / 1_000_000, tz=timezone.utc) for m in micros))


def work_queries(history: DataFrame, bounds: Bounds, from_start: bool = False) -> DataFrame:
    """Queries of the range with their work time and the window the work ran in.

    These are the queries that ran in the range, or (``from_start``) only those that started in it.
    """
    ran = F.col("start_time") >= bounds.lit_start() if from_start else F.col("end_time") > bounds.lit_start()
    def ms(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)).cast("long")

    def shifted(ts: str, millis: Column) -> Column:
        return F.timestamp_micros(F.unix_micros(ts) + millis * 1000)
    waits = ms("waiting_at_capacity_duration_ms") + ms("waiting_for_compute_duration_ms") + ms("compilation_duration_ms")
    work = ms("total_task_duration_ms") + ms("result_fetch_duration_ms") + ms("compilation_duration_ms")
    return (history
            .filter(F.col("statement_type").isNotNull() & (F.col("start_time") < bounds.lit_end())
                    & ran & (F.col("total_task_duration_ms") > 0)
                    & F.col("compute.warehouse_id").isNotNull())
            .select("statement_id", C.recorded_source_id().alias("query_source_id"),
                    C.recorded_source_type().alias("query_source_type"),
                    F.coalesce("client_application", F.lit("Unknown")).alias("client_application"),
                    F.coalesce("executed_by", "executed_as_user_id").alias("executed_by"), meta_warehouse(),
                    "statement_text", "workspace_id", "start_time", "end_time",
                    shifted("start_time", waits).alias("query_work_start_time"),
                    shifted("end_time", ms("result_fetch_duration_ms")).alias("query_work_end_time"),
                    (work / 1000.0).cast("double").alias("query_work_task_time")))


def _second(ts: str) -> Column:
    return F.date_trunc("second", ts)


def _hour(ts: str) -> Column:
    return F.date_trunc("hour", ts)


def _cell() -> WindowSpec:
    """Points of one (warehouse, hour), in time order: at most 3,600 rows."""
    return W.partitionBy("warehouse_id", "hour").orderBy("second")


def _hours() -> WindowSpec:
    """Hours of one warehouse, one row each: bounded by the calendar."""
    return W.partitionBy("warehouse_id").orderBy("hour")


def state_seconds(events: DataFrame, queries: DataFrame, bounds: Bounds, opening: DataFrame | None = None) -> DataFrame:
    """Last state per (warehouse, second), 1 on and 0 off: all events of the range, and the last one before it.

    Only warehouses that ran queries count.  The state is a number because a
    number can be kept in a hash aggregate, where text would need a sort.  With
    ``opening``, known states at the start of the range, older events are not read.
    """
    seen = queries.select("warehouse_id").distinct()
    state = F.when(F.col("cluster_count") == 0, 0).when(F.col("cluster_count") > 0, 1)
    known = events.filter((F.col("event_time") <= bounds.lit_end()) & state.isNotNull())
    if opening is not None:
        known = known.filter(F.col("event_time") >= bounds.lit_start())
    before = F.col("event_time") < bounds.lit_start()
    return (known.join(seen, "warehouse_id", "left_semi")
            .groupBy("warehouse_id", F.when(~before, _second("event_time")).alias("second"))
            .agg(F.max_by(state, "event_time").alias("state"), F.max("event_time").alias("_last"))
            .select("warehouse_id", F.coalesce("second", _second("_last")).alias("second"), "state")
            .withColumn("hour", _hour("second")))


def _state_name(state: Column) -> Column:
    return F.when(state == 1, "ON").when(state == 0, "OFF")


def on_off_windows(events: DataFrame, queries: DataFrame, bounds: Bounds) -> DataFrame:
    """Maximal ON / OFF windows per warehouse, at second precision.

    The previous state is looked up inside the hour, then at the end of the last
    hour that had events; the end of a window likewise.
    """
    seconds = state_seconds(events, queries, bounds)
    carried = (seconds.groupBy("warehouse_id", "hour").agg(F.max_by("state", "second").alias("last_state"))
               .withColumn("carried", F.lag("last_state").over(_hours())).drop("last_state"))
    previous = F.coalesce(F.lag("state").over(_cell()), F.col("carried"))
    changes = (seconds.join(carried, ["warehouse_id", "hour"])
               .withColumn("previous", previous)
               .filter(F.col("previous").isNull() | (F.col("previous") != F.col("state"))))
    following = _next_in_later_cell(changes)
    end = F.coalesce(F.lead("second").over(_cell()), F.col("next_second"), bounds.lit_end())
    return (changes.join(following, ["warehouse_id", "hour"])
            .withColumn("event_window_end", end)
            .filter(F.col("second") < F.col("event_window_end"))
            .select("warehouse_id", _state_name(F.col("state")).alias("window_state"), F.col("second").alias("event_window_start"),
                    "event_window_end"))


def _next_in_later_cell(points: DataFrame) -> DataFrame:
    """Per (warehouse, hour): the first point of the next hour that has any."""
    return (points.groupBy("warehouse_id", "hour").agg(F.min("second").alias("first_second"))
            .withColumn("next_second", F.lead("first_second").over(_hours())).drop("first_second"))


def query_deltas(queries: DataFrame) -> DataFrame:
    """Change in the number of active queries per (warehouse, second); a query counts for at least a second."""
    begin, end = _second("query_work_start_time"), _second("query_work_end_time")
    end = F.when(begin == end, end + F.expr("interval 1 second")).otherwise(end)
    marks = F.array(F.struct(begin.alias("second"), F.lit(1).alias("num")),
                    F.struct(end.alias("second"), F.lit(-1).alias("num")))
    return (queries.select("warehouse_id", F.explode(marks).alias("m"))
            .groupBy("warehouse_id", F.col("m.second").alias("second")).agg(F.sum("m.num").alias("delta"))
            .withColumn("hour", _hour("second")))


def concurrency_steps(queries: DataFrame, bounds: Bounds) -> DataFrame:
    """A4d: step function of active queries per warehouse."""
    deltas = query_deltas(queries)
    opening = (deltas.groupBy("warehouse_id", "hour").agg(F.sum("delta").alias("net"), F.min("second").alias("first_second"))
               .withColumn("opening", F.sum("net").over(_hours().rowsBetween(W.unboundedPreceding, -1)))
               .withColumn("next_second", F.lead("first_second").over(_hours())))
    running = F.coalesce("opening", F.lit(0)) + F.sum("delta").over(_cell().rowsBetween(W.unboundedPreceding, 0))
    return (deltas.join(opening.drop("net", "first_second"), ["warehouse_id", "hour"])
            .withColumn("queries_active", running)
            .withColumn("query_end", F.coalesce(F.lead("second").over(_cell()), F.col("next_second"), bounds.lit_end()))
            .select("warehouse_id", F.col("second").alias("query_start"), "query_end", "queries_active"))


def steps_by_day(steps: DataFrame) -> DataFrame:
    """A4e: steps cut at midnight; empty pieces are dropped."""
    first = F.to_date("query_start")
    span = F.greatest(F.datediff("query_end", "query_start"), F.lit(0))
    pieces = steps.withColumn("d", F.explode(F.transform(F.sequence(F.lit(0), span), lambda n: F.date_add(first, n))))
    begin = F.greatest("query_start", F.col("d").cast("timestamp"))
    end = F.least("query_end", F.date_add("d", 1).cast("timestamp"))
    return (pieces.select("warehouse_id", F.col("d").alias("query_start_dt"), begin.alias("query_start"),
                          end.alias("query_end"), "queries_active")
            .filter(F.col("query_start") < F.col("query_end")))


def every_hour(queries: DataFrame, bounds: Bounds) -> DataFrame:
    """All (warehouse, hour) of the range, for reports that show them all."""
    hours = F.sequence(bounds.lit_start(), bounds.lit_end() - F.expr("interval 1 hour"), F.expr("interval 1 hour"))
    return queries.select("warehouse_id").distinct().select("warehouse_id", F.explode(hours).alias("hour"))


def cells(events: DataFrame, queries: DataFrame, bounds: Bounds, hours: DataFrame, opening: DataFrame | None = None) -> DataFrame:
    """One row per (warehouse, hour) of ``hours``: the state and query count it opens with, and its points in order.

    ``opening`` gives (warehouse_id, state, active) at the start of the range; without it both follow from older events and queries.
    """
    nothing = {"state": F.lit(None).cast("int"), "delta": F.lit(0).cast("long"), "wanted": F.lit(False)}

    def marks(df: DataFrame, **given: Column) -> DataFrame:
        return df.select("warehouse_id", "hour", "second", *[(nothing | given)[n].alias(n) for n in nothing])
    points = marks(state_seconds(events, queries, bounds, opening), state=F.col("state"))
    deltas = query_deltas(queries)
    if opening is not None:
        deltas = deltas.filter(F.col("second") >= bounds.lit_start())
        last = bounds.lit_start() - F.expr("interval 1 second")
        given = opening.withColumn("second", last).withColumn("hour", _hour("second"))
        points = points.unionByName(marks(given, state=F.col("state"), delta=F.col("active")))
    points = points.unionByName(marks(deltas, delta=F.col("delta")))
    points = points.groupBy("warehouse_id", "hour", "second").agg(F.max("state").alias("state"), F.sum("delta").alias("delta"))
    at = F.struct((F.unix_timestamp("second") - F.unix_timestamp("hour")).cast("int").alias("at"), "state", "delta")
    asked = marks(hours.select("warehouse_id", "hour", F.lit(None).cast("timestamp").alias("second")), wanted=F.lit(True))
    rows = (points.withColumn("wanted", F.lit(False)).unionByName(asked).groupBy("warehouse_id", "hour")
            .agg(F.array_sort(F.collect_list(F.when(F.col("second").isNotNull(), at))).alias("points"), F.max("wanted").alias("wanted")))
    before = _hours().rowsBetween(W.unboundedPreceding, -1)
    last_state = F.aggregate("points", F.lit(None).cast("int"), lambda a, p: F.coalesce(p["state"], a))
    net = F.aggregate("points", F.lit(0).cast("long"), lambda a, p: a + p["delta"])
    return (rows.withColumn("last_state", last_state).withColumn("net", net)
            .withColumn("opening_state", F.last("last_state", ignorenulls=True).over(before))
            .withColumn("opening_count", F.coalesce(F.sum("net").over(before), F.lit(0).cast("long")))
            .filter("wanted").select("warehouse_id", "hour", "opening_state", "opening_count", "points"))


def periods(events: DataFrame, queries: DataFrame, bounds: Bounds) -> DataFrame:
    """A4f: elementary periods of the range with state, active queries and utilisation flag.

    A period before the first event of its warehouse counts as OFF.
    """
    found = cells(events, queries, bounds, every_hour(queries, bounds))
    opens = F.array(F.struct(F.lit(0).alias("at"), F.lit(None).cast("int").alias("state"), F.lit(0).cast("long").alias("delta")))
    whole = F.when(F.coalesce(F.try_element_at("points", F.lit(1))["at"], F.lit(1)) > 0, F.concat(opens, "points")).otherwise(F.col("points"))
    points = (found.select("warehouse_id", "hour", "opening_state", "opening_count", F.explode(whole).alias("p"))
              .withColumn("second", F.timestamp_seconds(F.unix_timestamp("hour") + F.col("p.at"))))
    so_far = _cell().rowsBetween(W.unboundedPreceding, 0)
    state = F.coalesce(F.last("p.state", ignorenulls=True).over(so_far), F.col("opening_state"))
    active = F.col("opening_count") + F.sum("p.delta").over(so_far)
    flag = (F.when(F.col("window_state").isNull() | (F.col("window_state") == "OFF"), "OFF")
             .when(F.col("queries_active") > 0, "UTILIZED").otherwise("ON_IDLE"))
    return points.select(
        "warehouse_id", F.col("hour").alias("ts_hour"), F.col("second").alias("ts_start"),
        F.coalesce(F.lead("second").over(_cell()), F.col("hour") + F.expr("interval 1 hour")).alias("ts_end"),
        _state_name(state).alias("window_state"), active.alias("queries_active")).withColumn("utilization_flag", flag)


def utilization(events: DataFrame, queries: DataFrame, bounds: Bounds, exact: bool = False, hours: DataFrame | None = None,
                opening: DataFrame | None = None) -> DataFrame:
    """A4g: seconds utilised, idle and off per (warehouse, hour), and utilised / on.

    The report shows every hour; a caller that needs only some passes them as ``hours``.  The proportion is rounded to two
    decimals, unless ``exact``.
    """
    found = cells(events, queries, bounds, every_hour(queries, bounds) if hours is None else hours, opening)
    kinds = ("utilized", "idle", "off")
    start = F.struct(F.lit(0).alias("at"), F.col("opening_state").alias("state"), F.col("opening_count").alias("active"),
                     *[F.lit(0).alias(k) for k in kinds])
    end = F.array(F.struct(F.lit(3600).alias("at"), F.lit(None).cast("int").alias("state"), F.lit(0).cast("long").alias("delta")))

    def passed(a: Column, p: Column) -> Column:
        on, busy, length = F.coalesce(a["state"] == 1, F.lit(False)), a["active"] > 0, p["at"] - a["at"]
        counted = {"utilized": on & busy, "idle": on & ~busy, "off": ~on}
        return F.struct(p["at"].alias("at"), F.coalesce(p["state"], a["state"]).alias("state"), (a["active"] + p["delta"]).alias("active"),
                        *[(a[k] + F.when(counted[k], length).otherwise(0)).alias(k) for k in kinds])
    ratio = F.try_divide(F.col("utilized_seconds"), F.col("utilized_seconds") + F.col("idle_seconds"))
    return (found.withColumn("s", F.aggregate(F.concat("points", end), start, passed))
            .select("warehouse_id", F.col("hour").alias("warehouse_hour"), *[F.col(f"s.{k}").cast("long").alias(f"{k}_seconds") for k in kinds])
            .withColumn("total_seconds", F.col("utilized_seconds") + F.col("idle_seconds") + F.col("off_seconds"))
            .withColumn("utilization_proportion", ratio if exact else ratio.cast("decimal(3,2)")))


def work_by_hour(queries: DataFrame) -> DataFrame:
    """Query work spread over the hours its window overlaps, in proportion to whole seconds of overlap."""
    first = _hour("query_work_start_time")
    span = F.floor((F.unix_timestamp("query_work_end_time") - F.unix_timestamp(first)) / 3600).cast("int")
    hours = F.explode(F.transform(F.sequence(F.lit(0), F.greatest(span, F.lit(0))),
                                  lambda h: F.timestamp_seconds(F.unix_timestamp(first) + h * 3600)))
    # whole microseconds: seconds since the epoch as doubles would lose digits of a short query
    length = (F.unix_micros("query_work_end_time") - F.unix_micros("query_work_start_time")) / 1_000_000
    hour_end = F.col("hour_bucket") + F.expr("interval 1 hour")
    overlap = F.greatest(F.lit(0), F.unix_timestamp(F.least("query_work_end_time", hour_end))
                         - F.unix_timestamp(F.greatest("query_work_start_time", "hour_bucket")))
    return (queries.select("statement_id", "warehouse_id", "query_work_start_time", "query_work_end_time",
                           "query_work_task_time", hours.alias("hour_bucket"))
            .select("statement_id", "warehouse_id", "hour_bucket",
                    F.when(length <= 0, F.lit(0.0)).otherwise(F.col("query_work_task_time") * (overlap / length))
                     .alias("attributed_query_work")))


def warehouse_rows(usage: DataFrame, bounds: Bounds) -> DataFrame:
    """Bill rows of warehouses within the range."""
    return usage.filter(F.col("usage_metadata.warehouse_id").isNotNull() & (F.col("usage_start_time") >= bounds.lit_start())
                        & (F.col("usage_end_time") <= bounds.lit_end()))


def hourly_bills(usage: DataFrame, price_history: DataFrame, bounds: Bounds, as_of: str) -> DataFrame:
    """Billed dbus and dollars per (warehouse, hour), at the price valid when the usage ended.

    Grouped per hour before the queries meet it, so several bill rows for one
    hour do not multiply the query rows; the sums per query are the same.
    """
    rows = warehouse_rows(usage, bounds)
    dollars = F.col("usage_quantity") * F.col("as_of_price")
    return (with_price_as_of(rows, price_history, as_of)
            .groupBy(F.col("usage_metadata.warehouse_id").alias("warehouse_id"), _hour("usage_start_time").alias("hour_bucket"))
            .agg(F.sum("usage_quantity").cast("double").alias("period_dbus"), F.sum(dollars).cast("double").alias("period_dollars")))


def cost_by_hour(usage: DataFrame, price_history: DataFrame, queries: DataFrame, events: DataFrame, as_of: str, bounds: Bounds,
                 exact: bool = False, opening: DataFrame | None = None) -> DataFrame:
    """A4h: one row per query and hour of its work, with the share of the utilised part of the hour's bill."""
    key = ["warehouse_id", "hour_bucket"]
    work = work_by_hour(queries)
    bills = hourly_bills(usage, price_history, bounds, as_of).withColumn("billed", F.lit(True))
    counts = work.groupBy(*key).agg(F.sum("attributed_query_work").alias("total_work"), F.count("*").alias("rows"))
    cost = counts.join(bills, key, "left")
    # only hours that have work and a bill are cut out of the timeline
    hours = cost.filter("billed").select("warehouse_id", F.col("hour_bucket").alias("hour"))
    use = (utilization(events, queries, bounds, exact, hours, opening)
           .select("warehouse_id", F.col("warehouse_hour").alias("hour_bucket"), F.col("utilization_proportion").cast("double").alias("proportion")))
    share = F.when(F.col("total_work") != 0, F.col("attributed_query_work") / F.col("total_work"))
    return (join_spread(work, cost.join(use, key, "left"), key, F.col("statement_id"), counts=counts)
            .select("statement_id", *key, (F.col("proportion") * F.col("period_dollars") * share).alias("hour_cost"),
                    (F.col("proportion") * F.col("period_dbus") * share).alias("hour_dbus"), F.coalesce("billed", F.lit(False)).alias("billed")))


def cost_per_query(queries: DataFrame, pieces: DataFrame, latest: Column, host: str = "", how: str = "inner") -> DataFrame:
    """A4 from its hourly pieces: one row per query; ``how="left"`` also shows queries without a piece."""
    hours = F.array_sort(F.collect_list(F.struct(
        "hour_bucket", F.col("hour_cost").alias("hour_attributed_cost"), F.col("hour_dbus").alias("hour_attributed_dbus"))))
    # hours of one statement: bounded by how long a statement runs
    costs = pieces.groupBy("statement_id", "warehouse_id").agg(
        hours.alias("statement_hour_bucket_costs"), F.sum("hour_cost").alias("query_attributed_dollars_estimation"),
        F.sum("hour_dbus").alias("query_attributed_dbus_estimation"), F.max("billed").alias("billed"))

    def seconds_between(a: str, b: str) -> Column:
        millis = F.floor((F.unix_micros(b) - F.unix_micros(a)) / 1000)
        return F.coalesce(millis / 1000, F.lit(0.0))
    check = F.when(F.col("billed"), "Has Billing Record").otherwise(
        "No Billing Record for this hour and warehouse yet available")
    profile = F.concat(F.lit(f"{host}/sql/history?queryId="), F.col("statement_id"), F.lit("&queryStartTimeMs="),
                       (F.unix_timestamp("start_time") * 1000).cast("string"))
    return queries.join(costs, ["statement_id", "warehouse_id"], how).select(
        "statement_id", "query_source_id", "query_source_type", "client_application", "executed_by", "warehouse_id",
        "statement_text", "workspace_id", "statement_hour_bucket_costs", "start_time", "end_time",
        "query_work_start_time", "query_work_end_time",
        seconds_between("start_time", "end_time").alias("duration_seconds"),
        seconds_between("query_work_start_time", "query_work_end_time").alias("query_work_duration_seconds"),
        F.col("query_work_task_time").alias("query_work_task_time_seconds"),
        "query_attributed_dollars_estimation", "query_attributed_dbus_estimation",
        F.coalesce(source_url(host), F.lit("")).alias("url_helper"), profile.alias("query_profile_url"),
        latest.alias("most_recent_billing_hour"), check.alias("billing_record_check"),
        _hour("start_time").alias("query_start_hour"))


def utilized_cost_per_query(usage: DataFrame, price_history: DataFrame, history: DataFrame, events: DataFrame,
                            as_of: str, bounds: Bounds | None = None, exact: bool = False, host: str = "") -> DataFrame:
    """A4: cost of each query, counting only the utilised part of every hour it ran in."""
    bounds = bounds or read_bounds(usage, history, events)
    queries = work_queries(history, bounds)
    latest = warehouse_rows(usage, bounds).select(_hour("usage_start_time").alias("h")).select(F.max("h")).scalar()
    return cost_per_query(queries, cost_by_hour(usage, price_history, queries, events, as_of, bounds, exact), latest, host)
