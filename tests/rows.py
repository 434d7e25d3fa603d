"""Hand-made billing rows for the edge cases."""

from __future__ import annotations

from datetime import date, datetime, timedelta
from decimal import Decimal

USAGE = ("account_id string, workspace_id bigint, cloud string, sku_name string, billing_origin_product string, usage_date date, "
         "usage_start_time timestamp, usage_end_time timestamp, usage_quantity decimal(18,4), usage_unit string, usage_type string, "
         "custom_tags map<string,string>, identity_metadata struct<run_as:string>, "
         "product_features struct<model_serving:struct<offering_type:string>>, "
         "usage_metadata struct<cluster_id:string,warehouse_id:string,job_id:string,job_run_id:string,job_name:string,"
         "dlt_pipeline_id:string,notebook_path:string,notebook_id:string,endpoint_name:string,endpoint_id:string,app_id:string>")
META = ("cluster_id", "warehouse_id", "job_id", "job_run_id", "job_name", "dlt_pipeline_id", "notebook_path", "notebook_id",
        "endpoint_name", "endpoint_id", "app_id")
PRICES = ("sku_name string, cloud string, currency_code string, usage_unit string, "
          "pricing struct<default:decimal(12,6),effective_list:struct<default:decimal(12,6)>>, price_start_time timestamp, price_end_time timestamp")
HISTORY = ("account_id string, workspace_id bigint, statement_id string, statement_text string, statement_type string, executed_by string, "
           "executed_as_user_id string, client_application string, execution_status string, compute struct<warehouse_id:string>, "
           "start_time timestamp, end_time timestamp, total_task_duration_ms bigint, result_fetch_duration_ms bigint, "
           "compilation_duration_ms bigint, waiting_at_capacity_duration_ms bigint, waiting_for_compute_duration_ms bigint, "
           "read_rows bigint, read_bytes bigint, query_source struct<job_info:struct<job_id:string>,legacy_dashboard_id:string,"
           "dashboard_id:string,alert_id:string,notebook_id:string,sql_query_id:string,genie_space_id:string>, query_tags map<string,string>")


def usage_row(day="2024-01-01", hour=0, qty=1, sku="SKU_A", product="JOBS", cloud="AWS", ws=1, tags=None, user=None, offering=None, **meta):
    start = datetime.fromisoformat(day) + timedelta(hours=hour)
    return ("acct", ws, cloud, sku, product, date.fromisoformat(day), start, start + timedelta(hours=1), Decimal(str(qty)), "DBU",
            "COMPUTE_TIME", tags, (user,), ((offering,),), tuple(meta.get(m) for m in META))


def usage(spark, *rows):
    return spark.createDataFrame(list(rows), USAGE)


def price_row(sku="SKU_A", price="2", cloud="AWS", start="2023-01-01", end=None, effective=None, currency="USD"):
    eff = None if effective is None else Decimal(effective)
    return (sku, cloud, currency, "DBU", (Decimal(price), (eff,)), datetime.fromisoformat(start),
            None if end is None else datetime.fromisoformat(end))


def prices(spark, *rows):
    return spark.createDataFrame(list(rows) or [price_row()], PRICES)


def query_row(sid, start, seconds, wh="w1", task_ms=1000, client=None, user="a@b", kind="SELECT", fetch=0, wait=0, ws=1, source=None, tags=None):
    begin = datetime.fromisoformat(start)
    fields = ["legacy_dashboard_id", "dashboard_id", "alert_id", "notebook_id", "sql_query_id", "genie_space_id"]
    src = source or {}
    return ("acct", ws, sid, "SELECT 1", kind, user, "id", client, "FINISHED", (wh,), begin, begin + timedelta(seconds=seconds), task_ms,
            fetch, 0, wait, 0, 1, 1, ((src.get("job_id"),), *[src.get(f) for f in fields]), tags)


def history(spark, *rows):
    return spark.createDataFrame(list(rows), HISTORY)


def events(spark, *rows):
    data = [(w, "SCALED", datetime.fromisoformat(ts), n) for w, ts, n in rows]
    return spark.createDataFrame(data, "warehouse_id string, event_type string, event_time timestamp, cluster_count int")
