"""Billing inputs derived from the star-schema test tables.

Each property is a lazy DataFrame with the columns and types a real billing
export has (structs, maps, decimals, timestamps).  Nothing is collected; a
report that reads two of the inputs scans only the files behind those two.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from meterlens.session import apply_settings
from meterlens.sources import values as V


def _pick(items: list[str], position: Column) -> Column:
    return F.element_at(F.array(*[F.lit(i) for i in items]), (position + 1).cast("int"))


def _tag(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), number.cast("string"))


def _usage_day(date: Column) -> Column:
    """Fold seven years of ship dates onto the 180 days of the usage window."""
    return F.date_add(F.lit(V.FIRST_DAY).cast("date"),
                      (F.datediff(date, F.lit("1995-01-01").cast("date")) % 180).cast("int"))


#: Schemas of files already opened in this process; the test tables never change.
_SCHEMAS: dict[str, StructType] = {}


class FixtureTables:
    """The inputs of every report, over one folder of test tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = apply_settings(spark)
        self.sf_dir = sf_dir

    def _read(self, name: str) -> DataFrame:
        path = f"{self.sf_dir}/{name}.parquet"
        if path not in _SCHEMAS:
            _SCHEMAS[path] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(_SCHEMAS[path]).parquet(path)

    # -- billing -----------------------------------------------------------

    @cached_property
    def usage(self) -> DataFrame:
        li = self._read("lineitem")
        orders = self._read("orders").select("o_orderkey", "o_custkey", "o_orderpriority")
        customer = self._read("customer").select("c_custkey", "c_nationkey", "c_mktsegment")
        part, line, supp = F.col("l_partkey"), F.col("l_linenumber"), F.col("l_suppkey")
        by_order, by_customer = li.l_orderkey == orders.o_orderkey, F.col("o_custkey") == F.col("c_custkey")
        # the line items meet orders that already know their customer: one shuffle of them at most
        joined = li.join(orders.join(customer, by_customer), by_order)
        rows = (joined.withColumn("k", (part + line) % 24)
                  .withColumn("billing_origin_product", _pick([p for _, p in V.SKUS], F.col("k")))
                  .withColumn("usage_date", _usage_day(F.col("l_shipdate"))))
        product = F.col("billing_origin_product")
        is_sql, is_jobs = product == "SQL", product == "JOBS"
        is_serving = product.isin("MODEL_SERVING", "AGENT_BRICKS")
        start = F.timestamp_seconds(F.unix_date("usage_date").cast("long") * 86400
                                    + ((line * 3 + supp) % 24) * 3600)
        team = (F.lit("team"), F.col("c_mktsegment"))
        env = (F.lit("env"), F.col("o_orderpriority"))
        has_team, has_env = F.col("l_returnflag") == "A", F.col("l_linestatus") == "F"
        empty = F.create_map().cast("map<string,string>")
        tags = (F.when(has_team & has_env, F.create_map(*team, *env))
                 .when(has_team, F.create_map(*team))
                 .when(has_env, F.create_map(*env))
                 .when(line % 2 == 0, empty))
        offering = F.when(product.isin("MODEL_SERVING", "VECTOR_SEARCH") & (part % 5 == 0),
                          F.lit("BATCH_INFERENCE"))
        return rows.select(
            F.lit("acct-1").alias("account_id"),
            F.when(is_sql, part % 8).otherwise(F.col("c_nationkey")).cast("long").alias("workspace_id"),
            _pick(V.CLOUDS, supp % 3).alias("cloud"),
            _pick([s for s, _ in V.SKUS], F.col("k")).alias("sku_name"),
            "billing_origin_product",
            "usage_date",
            start.alias("usage_start_time"),
            (start + F.expr("interval 1 hour")).alias("usage_end_time"),
            (F.col("l_quantity") - 1).cast("decimal(18,4)").alias("usage_quantity"),
            F.lit("DBU").alias("usage_unit"),
            F.when(F.col("k").isin(13, 21), "STORAGE_SPACE").otherwise("COMPUTE_TIME").alias("usage_type"),
            tags.alias("custom_tags"),
            F.struct(F.when(F.col("l_tax") != 0, F.concat(_tag("user", F.col("o_custkey")), F.lit("@example.com")))
                      .alias("run_as")).alias("identity_metadata"),
            F.struct(F.struct(offering.alias("offering_type")).alias("model_serving")).alias("product_features"),
            F.struct(
                F.when(product.isin("ALL_PURPOSE", "JOBS"), _tag("cl-", (part * 3 + supp) % 40)).alias("cluster_id"),
                F.when(is_sql, _tag("wh-", part % 8)).alias("warehouse_id"),
                F.when(is_jobs, _tag("job-", part % 30)).alias("job_id"),
                F.when(is_jobs, F.col("l_orderkey").cast("string")).alias("job_run_id"),
                F.when(is_jobs & (part % 30 < 25), _tag("Job ", part % 30)).alias("job_name"),
                F.when(product == "DLT", _tag("pl-", part % 12)).alias("dlt_pipeline_id"),
                F.when(product == "ALL_PURPOSE", _tag("/nb/", part % 25)).alias("notebook_path"),
                F.when(product == "ALL_PURPOSE", _tag("nb-", part % 25)).alias("notebook_id"),
                F.when(is_serving & (part % 10 != 9), _pick(V.ENDPOINTS, part % 9)).alias("endpoint_name"),
                F.when(is_serving, _tag("ep-", part % 9)).alias("endpoint_id"),
                F.when((product == "APPS") & (part % 11 != 10), _tag("app-", part % 10)).alias("app_id"),
            ).alias("usage_metadata"),
        )

    @cached_property
    def machine_prices(self) -> DataFrame:
        """Hourly prices of the machine types of the cluster table."""
        return self.spark.createDataFrame(V.MACHINE_PRICES, "cloud string, instance_type string, hourly_cost double")

    @cached_property
    def estimate_prices(self) -> DataFrame:
        """The shorter list the AWS-only estimate knows."""
        return self.machine_prices.filter(F.col("instance_type").isin(*V.ESTIMATE_MACHINES))

    def _price_row(self, k: Column, cloud: Column, extra: Column) -> list[Column]:
        def dollars(unit: str) -> Column:
            return ((k + 1).cast("decimal(4,0)") * F.lit(unit).cast("decimal(4,2)") + extra).cast("decimal(12,6)")
        return [
            _pick([s for s, _ in V.SKUS], k).alias("sku_name"), cloud.alias("cloud"),
            F.lit("USD").alias("currency_code"), F.lit("DBU").alias("usage_unit"),
            F.struct(dollars("0.05").alias("default"),
                     F.struct(dollars("0.04").alias("default")).alias("effective_list")).alias("pricing"),
        ]

    @cached_property
    def list_prices(self) -> DataFrame:
        """One open price per SKU and cloud; the preview SKU has none."""
        k = (F.col("id") / 3).cast("int")
        return (self.spark.range(0, 3 * len(V.SKUS), 1, 1).filter(k != V.UNPRICED_SKU)
                .select(*self._price_row(k, _pick(V.CLOUDS, F.col("id") % 3), F.lit(0).cast("decimal(4,2)")),
                        F.lit("2023-01-01").cast("timestamp").alias("price_start_time"),
                        F.lit(None).cast("timestamp").alias("price_end_time")))

    @cached_property
    def price_history(self) -> DataFrame:
        """Four 45-day price versions per SKU, read off ``part``; some third versions were never closed."""
        keys = (self._read("part").select((F.col("p_partkey") % 24).alias("k"),
                                          ((F.col("p_partkey") / 24).cast("long") % 4).alias("v")).distinct()
                .filter(F.col("k") != V.UNPRICED_SKU)
                .select("k", "v", F.explode(F.array(*[F.lit(c) for c in V.CLOUDS])).alias("c")))
        step = F.col("v").cast("decimal(4,0)") * F.lit("0.01").cast("decimal(4,2)")
        begin = F.date_add(F.lit(V.FIRST_DAY).cast("date"), (F.col("v") * 45).cast("int")).cast("timestamp")
        finish = F.date_add(F.lit(V.FIRST_DAY).cast("date"), ((F.col("v") + 1) * 45).cast("int")).cast("timestamp")
        never_closed = (F.col("v") == 3) | ((F.col("v") == 2) & (F.col("k") % 12 == 5))
        return keys.select(*self._price_row(F.col("k"), F.col("c"), step),
                           begin.alias("price_start_time"),
                           F.when(~never_closed, finish).alias("price_end_time"))

    @cached_property
    def account_prices(self) -> DataFrame:
        """Negotiated prices: a fifth off list for every second SKU."""
        k = F.col("p_partkey") % 24
        keys = self._read("part").select(k.alias("k")).distinct().filter(F.col("k") % 2 == 0)
        keys = keys.select("k", F.explode(F.array(*[F.lit(c) for c in V.CLOUDS])).alias("c"))

        def dollars(unit: str) -> Column:
            return ((F.col("k") + 1).cast("decimal(4,0)") * F.lit(unit).cast("decimal(4,2)")).cast("decimal(12,6)")
        return keys.select(
            _pick([s for s, _ in V.SKUS], F.col("k")).alias("sku_name"), F.col("c").alias("cloud"),
            F.lit("USD").alias("currency_code"), F.lit("DBU").alias("usage_unit"),
            F.struct(dollars("0.04").alias("default"),
                     F.struct(dollars("0.03").alias("default")).alias("effective_list")).alias("pricing"),
            F.lit("2023-01-01").cast("timestamp").alias("price_start_time"),
            F.lit(None).cast("timestamp").alias("price_end_time"))

    # -- query history and warehouses ----------------------------------------

    @cached_property
    def query_history(self) -> DataFrame:
        e, uid, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
        ev = self._read("events").withColumn("start_time", F.col("ts").cast("timestamp"))
        ms = F.round(F.col("value") * 1000).cast("long")
        run_ms = ms + F.when(e % 37 == 0, 3 * 3600 * 1000).otherwise(0)
        source = [F.when(e % 8 == i, _tag(f"{name}-", e % 100)).alias(name) for i, name in
                  ((1, "legacy_dashboard_id"), (2, "dashboard_id"), (3, "alert_id"), (4, "notebook_id"),
                   (5, "sql_query_id"), (6, "genie_space_id"))]
        client = (F.when(kind == "view", "Genie Space").when(kind == "click", "SQL Editor")
                   .when(kind == "purchase", "dashboard/aibi-12").when(kind == "error", "mcp-client"))
        tags = (F.when((kind == "error") & (e % 3 == 0) | (e % 29 == 0),
                       F.create_map(F.lit("authoring_tool"), F.lit("ide")))
                 .when((kind == "error") & (e % 3 == 1), F.create_map(F.lit("origin"), F.lit("MCP"))))
        return ev.select(
            F.lit("acct-1").alias("account_id"),
            (uid % 8).cast("long").alias("workspace_id"),
            _tag("st-", e).alias("statement_id"),
            F.concat(F.lit("SELECT * FROM t"), (e % 100).cast("string"), F.lit(" WHERE kind = '"), kind,
                     F.lit("' --"), F.repeat(F.lit("x"), (e % 250).cast("int"))).alias("statement_text"),
            F.when(e % 53 == 0, "CANCEL").when(e % 59 != 0, "SELECT").alias("statement_type"),
            F.when(e % 31 != 0, F.when(uid % 3 == 0, _tag("sp-", uid))
                   .otherwise(F.concat(_tag("user", uid), F.lit("@example.com")))).alias("executed_by"),
            F.when(e % 67 != 0, _tag("id-", uid)).alias("executed_as_user_id"),
            client.alias("client_application"),
            F.lit("FINISHED").alias("execution_status"),
            F.struct(F.when(e % 61 != 0, _tag("wh-", uid % 8)).alias("warehouse_id")).alias("compute"),
            "start_time",
            F.timestamp_micros(F.unix_micros("start_time") + run_ms * 1000).alias("end_time"),
            F.when(e % 43 == 0, F.lit(0).cast("long")).when(e % 41 != 0, ms).alias("total_task_duration_ms"),
            F.when(e % 5 != 0, e % 13 * 20).alias("result_fetch_duration_ms"),
            F.when(e % 6 != 0, e % 7 * 100).alias("compilation_duration_ms"),
            (e % 11 * 50).alias("waiting_at_capacity_duration_ms"),
            F.when(e % 4 != 0, e % 3 * 400).alias("waiting_for_compute_duration_ms"),
            F.when(e % 19 != 0, e * 7 % 100000).alias("read_rows"),
            F.when(e % 19 != 0, e * 7 % 100000 * 128).alias("read_bytes"),
            F.struct(F.struct(F.when(e % 8 == 0, _tag("job-", e % 30)).alias("job_id")).alias("job_info"),
                     *source).alias("query_source"),
            tags.alias("query_tags"),
        )

    @cached_property
    def warehouse_events(self) -> DataFrame:
        """Scaling events; warehouse wh-8 has events but never a query."""
        e = F.col("event_id")
        return self._read("events").select(
            _tag("wh-", (e / 4).cast("long") % 9).alias("warehouse_id"),
            F.when(e % 5 == 0, "STOPPED").otherwise("SCALED").alias("event_type"),
            F.col("ts").cast("timestamp").alias("event_time"),
            F.when(e % 5 == 0, 0).otherwise(1 + e % 3).cast("int").alias("cluster_count"))

    @cached_property
    def warehouses(self) -> DataFrame:
        """Warehouse change log, one row per supplier."""
        s = F.col("s_suppkey")
        w = s % 9
        return self._read("supplier").select(
            _tag("wh-", w).alias("warehouse_id"),
            F.when(w != 7, F.concat(_tag("Warehouse ", w), _tag(" rev ", s))).alias("warehouse_name"),
            _pick(V.WAREHOUSE_SIZES, s % 5).alias("warehouse_size"),
            (w % 8).cast("long").alias("workspace_id"),
            F.when(w != 6, _pick(V.WAREHOUSE_TYPES, (s + 1) % 3)).alias("warehouse_type"),
            F.when(w == 5, F.lit("2024-01-20").cast("timestamp")).alias("delete_time"),
            F.timestamp_seconds(F.lit(1690000000) + s * 60).alias("change_time"))

    @cached_property
    def clusters(self) -> DataFrame:
        """Cluster change log, one row per part; cl-37 .. cl-39 are missing on purpose."""
        p = F.col("p_partkey")
        c = p % 37
        return self._read("part").select(
            _tag("cl-", c).alias("cluster_id"),
            F.when(c != 30, F.concat(_tag("Cluster ", c), _tag(" rev ", (p / 37).cast("long") % 3))).alias("cluster_name"),
            F.when(c != 31, _pick(V.NODE_TYPES, p % 7)).alias("driver_node_type"),
            F.when(c != 32, _pick(V.NODE_TYPES, (p / 7).cast("long") % 7)).alias("worker_node_type"),
            F.when(c % 2 == 0, "UI").otherwise("JOB").alias("cluster_source"),
            F.concat(_tag("user", c), F.lit("@example.com")).alias("owned_by"),
            F.when(c == 33, F.lit("2024-01-15").cast("timestamp")).alias("delete_time"),
            F.when(c % 5 == 0, "14.3.x-cpu-ml-scala2.12").when(c % 5 == 1, "15.1.x-GPU-ML-x")
             .when(c % 5 != 4, "14.3.x-scala2.12").alias("dbr_version"),
            F.timestamp_seconds(F.lit(1690000000) + p * 60).alias("change_time"))

    # -- objects and people ----------------------------------------------------

    @cached_property
    def pipelines(self) -> DataFrame:
        p = F.col("p_partkey") % 12
        return self._read("part").select(
            F.when(p == 11, "pl-gone").otherwise(_tag("pl-", p)).alias("pipeline_id"),
            _tag("Pipeline ", p).alias("name"), F.concat(_tag("owner", p), F.lit("@example.com")).alias("creator_name"),
            F.when(p.isin(3, 7), F.lit("2024-01-10").cast("timestamp")).alias("delete_time"))

    @cached_property
    def jobs(self) -> DataFrame:
        p = F.col("p_partkey") % 30
        return self._read("part").select(
            F.when(p == 29, "job-gone").otherwise(_tag("job-", p)).alias("job_id"),
            _tag("Nightly ", p).alias("name"), F.concat(_tag("owner", p), F.lit("@example.com")).alias("creator_name"),
            F.when(p.isin(4, 9), F.lit("2024-01-10").cast("timestamp")).alias("delete_time"))

    @cached_property
    def job_run_timeline(self) -> DataFrame:
        state = F.col("o_orderstatus")
        return self._read("orders").select(
            F.col("o_orderkey").cast("string").alias("run_id"),
            _usage_day(F.col("o_orderdate")).cast("timestamp").alias("period_start_time"),
            F.when(state == "F", "SUCCEEDED").when(state == "O", "FAILED").otherwise("CANCELLED").alias("result_state"))

    @cached_property
    def served_entities(self) -> DataFrame:
        p = F.col("p_partkey") % 9
        return self._read("part").select(
            F.when(p != 4, _tag("ep-", p)).alias("endpoint_id"), _pick(V.ENDPOINTS, p).alias("endpoint_name"))

    @cached_property
    def workspaces(self) -> DataFrame:
        """Three nations have no workspace row, so their spend shows as historical."""
        n = F.col("n_nationkey")
        return self._read("nation").filter(n < 22).select(
            n.cast("long").alias("workspace_id"), F.col("n_name").alias("workspace_name"))

    @cached_property
    def user_groups(self) -> DataFrame:
        """Group membership: every seventh user in none, every tenth in two."""
        c = F.col("c_custkey")
        groups = (F.when(c % 7 == 0, F.array().cast("array<string>"))
                   .when(c % 10 == 0, F.array(F.col("c_mktsegment"), F.lit("ADMINS")))
                   .otherwise(F.array(F.col("c_mktsegment"))))
        return self._read("customer").select(
            F.concat(_tag("user", c), F.lit("@example.com")).alias("user_email"), F.explode(groups).alias("group_name"))

    @cached_property
    def app_registry(self) -> DataFrame:
        s = F.col("s_suppkey") % 8
        return self._read("supplier").select(
            F.when(s == 7, "app-unused").otherwise(_tag("app-", s)).alias("app_id"),
            _tag("App ", s).alias("name"), F.concat(_tag("https://apps.example.com/", s)).alias("url")).distinct()

    @cached_property
    def use_cases(self) -> DataFrame:
        c = F.col("c_custkey")
        created = F.timestamp_seconds(F.lit(1690000000) + c * 3600)
        return self._read("customer").select(
            _tag("uc-", c).alias("use_case_id"), _tag("Use case ", c).alias("name"),
            F.concat(F.lit("For "), F.col("c_name")).alias("description"),
            F.concat(_tag("owner", F.col("c_nationkey")), F.lit("@example.com")).alias("owner"),
            created.alias("created_at"), created.alias("updated_at"),
            F.when(F.col("c_acctbal") >= 0, "active").otherwise("archived").alias("status"),
            F.when(c % 4 != 0, F.create_map(F.lit("segment"), F.col("c_mktsegment"),
                                            F.lit("region"), _tag("n", F.col("c_nationkey") % 5))).alias("tags"),
            F.when(c % 5 != 0, _pick(V.STAGES, c % 3)).alias("stage"),
            F.lit(V.FIRST_DAY).cast("date").alias("start_date"), F.lit(None).cast("date").alias("end_date"),
            F.when(c % 3 == 0, F.date_add(F.lit(V.FIRST_DAY).cast("date"), (c % 200).cast("int"))).alias("live_date"))

    @cached_property
    def use_case_objects(self) -> DataFrame:
        c = F.col("c_custkey")
        objects = [("cluster", _tag("cl-", c % 40)), ("warehouse", _tag("wh-", c % 8)), ("job", _tag("job-", c % 30)),
                   ("endpoint", _tag("ep-", c % 9)), ("pipeline", _tag("pl-", c % 12))]
        entries = F.array(*[F.struct(F.lit(t).alias("object_type"), o.alias("object_id")) for t, o in objects])
        long_enough = F.datediff(F.lit(V.LAST_DAY).cast("date"), F.lit(V.FIRST_DAY).cast("date"))
        return (self._read("customer").select(c.alias("c"), F.explode(F.slice(entries, 1, (1 + c % 5).cast("int"))).alias("o"))
                .select(F.concat(_tag("map-", F.col("c")), F.lit("-"), F.col("o.object_type")).alias("mapping_id"),
                        _tag("uc-", F.col("c")).alias("use_case_id"), "o.object_type", "o.object_id",
                        F.col("o.object_id").alias("object_name"), F.lit(None).cast("string").alias("workspace_id"),
                        F.timestamp_seconds(F.lit(1690000000) + F.col("c") * 60).alias("assigned_at"),
                        F.lit("admin").alias("assigned_by"), F.lit(None).cast("string").alias("notes"),
                        F.when(F.col("c") % 6 == 0, F.date_add(F.lit(V.FIRST_DAY).cast("date"), (F.col("c") % 90).cast("int")))
                         .alias("custom_start_date"),
                        F.when(F.col("c") % 6 == 0, F.date_add(F.lit(V.FIRST_DAY).cast("date"),
                                                             (F.lit(90) + F.col("c") % long_enough).cast("int")))
                         .alias("custom_end_date")))

    @cached_property
    def dashboards(self) -> DataFrame:
        s = F.col("s_suppkey")
        return self._read("supplier").select(
            _tag("dash-", s).alias("dashboard_id"), F.col("s_name").alias("name"),
            F.col("s_nationkey").cast("long").alias("workspace_id"))

    # -- cloud invoices ----------------------------------------------------------

    def _invoice_lines(self) -> DataFrame:
        part = self._read("part").select("p_partkey", "p_type", "p_brand")
        li = self._read("lineitem")
        return (li.join(part, li.l_partkey == part.p_partkey)
                .withColumn("day", _usage_day(F.col("l_shipdate")))
                .withColumn("cost", F.col("l_extendedprice").cast("decimal(18,2)"))
                .withColumn("net", F.col("cost") * (1 - F.col("l_discount").cast("decimal(4,2)"))))

    @cached_property
    def aws_bronze(self) -> DataFrame:
        line, p, s = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
        flag, kind = F.col("l_returnflag"), F.col("p_type")
        none = F.lit(None).cast("string")
        start = F.timestamp_seconds(F.unix_date("day").cast("long") * 86400 + ((line * 3 + s) % 24) * 3600)
        item = (F.when(line == 1, "Tax").when((line == 2) & (p % 7 == 0), F.lit(None))
                 .when((line == 6) & (p % 3 == 0), "Fee").when((line == 7) & (p % 3 == 0), "Credit")
                 .when((line == 7) & (p % 3 == 1), "Refund").when(flag == "A", "Usage")
                 .when(flag == "N", "SavingsPlanCoveredUsage").otherwise("DiscountedUsage"))
        family = (F.when(kind == "ECONOMY", "Compute Instance").when(kind == "LARGE", "Storage Snapshot")
                   .when(kind == "MEDIUM", "Data Transfer").when(kind == "PROMO", "Network Gateway")
                   .when(kind == "SMALL", "Support"))
        itype = _pick(V.NODE_TYPES, p % 7)
        month = F.trunc("day", "month")
        return self._invoice_lines().select(
            start.alias("line_item_usage_start_date"),
            month.cast("timestamp").alias("bill_billing_period_start_date"),
            F.add_months(month, 1).cast("timestamp").alias("bill_billing_period_end_date"),
            F.lit("payer-1").alias("bill_payer_account_id"), _tag("acc-", s % 5).alias("line_item_usage_account_id"),
            _tag("i-", F.col("l_orderkey")).alias("line_item_resource_id"), F.lit("EC2").alias("line_item_product_code"),
            F.lit("Elastic Compute").alias("product_product_name"), kind.alias("line_item_usage_type"),
            F.lit("RunInstances").alias("line_item_operation"), F.lit("us-east-1a").alias("line_item_availability_zone"),
            _tag("region-", s % 3).alias("product_region"), itype.alias("product_instance_type"),
            F.substring_index(itype, ".", 1).alias("product_instance_type_family"),
            F.lit("Linux").alias("product_operating_system"), F.lit("Shared").alias("product_tenancy"),
            family.alias("product_product_family"), item.alias("line_item_line_item_type"),
            F.when(line % 3 == 0, _tag("cl-", p % 40)).alias("resource_tags_user_cluster_id"),
            F.when(line % 3 == 0, _tag("Cluster ", p % 40)).alias("resource_tags_user_cluster_name"),
            F.when(line % 3 == 1, _tag("wh-", p % 8)).alias("resource_tags_user_warehouse_id"),
            F.when(line % 3 == 2, _tag("job-", p % 30)).alias("resource_tags_user_job_id"),
            none.alias("resource_tags_user_instance_pool_id"), none.alias("resource_tags_user_creator"),
            _tag("cc-", s % 4).alias("resource_tags_user_cost_center"),
            F.when(flag == "A", "prod").alias("resource_tags_user_environment"),
            none.alias("resource_tags_user_project"), none.alias("resource_tags_user_team"),
            F.when(flag == "R", "Reserved").alias("pricing_term"), F.lit("USD").alias("line_item_currency_code"),
            F.col("l_quantity").cast("decimal(18,4)").alias("line_item_usage_amount"),
            (F.col("l_quantity") * 2).cast("decimal(18,4)").alias("line_item_normalized_usage_amount"),
            F.when(p % 17 != 0, F.col("cost")).cast("decimal(20,4)").alias("line_item_unblended_cost"),
            F.when(p % 5 != 0, F.col("net")).cast("decimal(20,4)").alias("line_item_net_unblended_cost"),
            F.col("cost").cast("decimal(20,4)").alias("line_item_blended_cost"),
            F.when(flag == "R", F.lit("1.25").cast("decimal(20,4)")).alias("reservation_amortized_upfront_cost_for_usage"),
            F.when((flag == "R") & (p % 2 == 0), F.lit("1.10").cast("decimal(20,4)"))
             .alias("reservation_net_amortized_upfront_cost_for_usage"),
            F.when(flag == "N", F.lit("0.75").cast("decimal(20,4)"))
             .alias("savings_plan_amortized_upfront_commitment_for_billing_period"),
            F.when((flag == "N") & (p % 2 == 0), F.lit("0.70").cast("decimal(20,4)"))
             .alias("savings_plan_net_amortized_upfront_commitment_for_billing_period"),
            F.when(flag == "R", F.col("net")).cast("decimal(20,4)").alias("reservation_effective_cost"),
            F.when(flag == "N", F.col("net")).cast("decimal(20,4)").alias("savings_plan_savings_plan_effective_cost"),
            F.lit("2024-02-01").cast("timestamp").alias("_loaded_at"))

    @cached_property
    def azure_bronze(self) -> DataFrame:
        line, p, s = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
        kind = F.col("p_type")
        category = (F.when(kind == "ECONOMY", "Virtual Machines").when(kind == "LARGE", "Storage")
                     .when(kind == "MEDIUM", "Bandwidth").when(kind == "PROMO", "Virtual Network").otherwise("Functions"))
        info = F.when(p % 4 != 3, F.concat(F.lit('{"Usage":"x","ServiceType":"'), _pick(V.NODE_TYPES, p % 7),
                                         F.lit('","Line":"'), line.cast("string"), F.lit('"}')))
        none = F.lit(None).cast("string")
        return self._invoice_lines().select(
            F.col("day").alias("Date"), _tag("sub-", s % 3).alias("SubscriptionId"),
            _tag("Subscription ", s % 3).alias("SubscriptionName"), _tag("rg-", s % 4).alias("ResourceGroup"),
            F.lit("eastus").alias("ResourceLocation"), category.alias("MeterCategory"), kind.alias("MeterSubCategory"),
            F.lit("Compute").alias("ConsumedService"), F.when(F.col("l_returnflag") == "R", "Reservation").alias("PricingModel"),
            info.alias("AdditionalInfo"), _tag("cc-", s % 4).alias("CostCenter"),
            F.when(line % 3 == 0, _tag("cl-", p % 40)).alias("tag_cluster_id"),
            F.when(line % 3 == 0, _tag("Cluster ", p % 40)).alias("tag_cluster_name"),
            F.when(line % 3 == 1, _tag("wh-", p % 8)).alias("tag_warehouse_id"),
            F.when(line % 3 == 2, _tag("job-", p % 30)).alias("tag_job_id"),
            none.alias("tag_instance_pool_id"), none.alias("tag_creator"),
            F.col("net").cast("decimal(20,4)").alias("CostInBillingCurrency"),
            F.col("cost").cast("decimal(20,4)").alias("CostInUsd"),
            (F.col("l_quantity") / 10).cast("decimal(18,4)").alias("EffectivePrice"),
            (F.col("l_quantity") / 5).cast("decimal(18,4)").alias("UnitPrice"),
            F.col("l_quantity").cast("decimal(18,4)").alias("Quantity"), F.lit("EUR").alias("BillingCurrency"))

    @cached_property
    def gcp_export(self) -> DataFrame:
        line, s = F.col("l_linenumber"), F.col("l_suppkey")
        start = F.timestamp_seconds(F.unix_date("day").cast("long") * 86400 + ((line * 3 + s) % 24) * 3600)
        return self._invoice_lines().select(
            start.alias("usage_start_time"),
            F.struct(F.col("p_type").alias("description")).alias("service"),
            F.struct(F.col("p_brand").alias("description")).alias("sku"),
            F.struct(_tag("prj-", s % 6).alias("id"), _tag("Project ", s % 6).alias("name")).alias("project"),
            F.when(line % 7 == 3, -F.col("net")).otherwise(F.col("net")).alias("cost"),
            _pick(["USD", "EUR", "JPY"], s % 3).alias("currency"))
