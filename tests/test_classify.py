"""First-match order of the rule tables, and the name-based kinds."""

import pytest
from pyspark.sql import functions as F

from meterlens.functions import classify as C
from meterlens.functions import machines as M


def labels(spark, column, *cases):
    """cases: (product, sku, has_pipeline, offering)"""
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)],
                               "i int, billing_origin_product string, sku_name string, has_pipeline boolean, offering_type string")
    return [r[0] for r in df.orderBy("i").select(column()).collect()]


def case(product, sku="X", pipeline=False, offering=None):
    return product, sku, pipeline, offering


def test_product_category_order(spark):
    assert labels(spark, C.product_category, case("SQL", "SERVERLESS_SQL", True), case("JOBS", pipeline=True), case("JOBS", "ALL_PURPOSE"),
                  case("X", "ALL_PURPOSE_SERVING"), case("SERVING"), case("X", "A_SERVING_VECTOR_SEARCH"), case("X", "FOUNDATION_MODEL"),
                  case("X", "AI_BI_SERVERLESS"), case("X", "SERVERLESS"), case(None, "SERVERLESS"), case("X")) == [
        "SQL", "ETL - Streaming", "ETL - Batch", "Interactive", "Model Serving", "Model Serving", "Fine-Tuning", "AI Functions", "Serverless",
        "Other", "Other"]


def test_series_tests_serverless_before_serving(spark):
    both = case("MODEL_SERVING", "SERVERLESS_INFERENCE")
    assert labels(spark, C.series_category, both, case("X", "INFERENCE"), case("MODEL_SERVING")) == ["Serverless", "Model Serving", "Other"]
    assert labels(spark, C.product_category, both) == ["Model Serving"]


def test_group_report_and_etl(spark):
    assert labels(spark, C.group_report_category, case("SQL", "X_SERVING"), case("SQL"), case("X", "INFERENCE")) == ["Model Serving", "SQL", "Other"]
    assert labels(spark, C.etl_type, case("X", pipeline=True), case("JOBS"), case("SQL")) == ["Streaming (SDP)", "Batch Jobs", None]


def test_aiml_categories(spark):
    assert labels(spark, C.aiml_category, case("MODEL_SERVING", "ANTHROPIC_X"), case("MODEL_SERVING", offering="BATCH_INFERENCE"),
                  case("VECTOR_SEARCH"), case("X", "FINE_TUNING"), case("MODEL_SERVING"), case("X", "Y_INFERENCE")) == [
        "FMAPI - Anthropic", "Batch Inference", "Vector Search", "Fine Tuning", "Model Serving", "Other AI/ML"]
    assert labels(spark, C.model_type, case("X", "FEATURE_TRAINING"), case("FOUNDATION_MODEL_SERVING"), case("X", "LLAMA"), case("X")) == [
        "Feature Store", "Foundation Model API", "Foundation Model API", None]


@pytest.mark.parametrize("name,kind", [("ka-1", "Knowledge Assistant"), ("x-ka-1", "Agent"), ("My Knowledge Base Assistant", "Knowledge Assistant"),
                                       ("kie-genie", "Knowledge Assistant"), ("GENIE room", "Genie Space"), ("the-Orchestrator", "Supervisor Agent"),
                                       (None, "Agent")])
def test_agent_type(spark, name, kind):
    df = spark.createDataFrame([(name,)], "n string")
    assert df.select(C.agent_type(F.col("n"))).first()[0] == kind


def test_client_source(spark):
    clients = ["genie/ab-1", "Genie", "GENIE", "dashboard/lakeview-9", "Dashboard", "my notebook", "Job run", "Alert", "sql-editor", None]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(clients)], "i int, c string").orderBy("i")
    kinds = [r[0] for r in df.select(C.client_source_type(F.col("c"), F.lit("SELECT"))).collect()]
    assert kinds == ["GENIE SPACE", "GENIE SPACE", "SQL QUERY", "AI/BI DASHBOARD", "LEGACY DASHBOARD", "NOTEBOOK", "JOB", "ALERT", "SQL QUERY", "SQL QUERY"]
    ids = [r[0] for r in df.select(C.client_source_id(F.col("c"))).collect()]
    assert ids[0] == "ab-1" and ids[3] == "lakeview-9" and ids[4] is None
    assert df.select(C.client_source_type(F.lit("x"), F.lit("JOB"))).first()[0] == "JOB"


def test_has_tags(spark):
    df = spark.createDataFrame([(1, None), (2, {}), (3, {"a": "b"}), (4, {"a": "b", "c": "d"})], "i int, custom_tags map<string,string>")
    assert [r[0] for r in df.orderBy("i").select(C.has_tags()).collect()] == [False, False, True, True]


@pytest.mark.parametrize("machine,cloud,family", [("m5.xlarge", "AWS", "m5"), ("m5", "aws", "m5"), (".x", "AWS", "unknown"), (None, "AWS", "unknown"),
                                                  ("Standard_E16ds_v4", "AZURE", "Standard_E"), ("Standard_NC6s_v3", "azure", "Standard_NC"),
                                                  ("Standard_1x", "AZURE", "unknown"), ("m5.xlarge", "AZURE", "unknown"), ("n2-standard-4", "GCP", "n2")])
def test_instance_family(spark, machine, cloud, family):
    df = spark.createDataFrame([(machine, cloud)], "m string, c string")
    assert df.select(C.instance_family(F.col("m"), F.col("c"))).first()[0] == family


def test_worker_family_of_a_type_without_dot_is_empty(spark):
    df = spark.createDataFrame([(1, "Standard_D8s_v3"), (2, None), (3, "r5.large")], "i int, m string")
    assert [r[0] for r in df.orderBy("i").select(C.worker_family(F.col("m"))).collect()] == ["", "unknown", "r5"]


def test_charge_types(spark):
    cases = [("Usage", "Compute Instance", "Compute"), ("Usage", "Data Transfer", "Networking"), ("Usage", None, "Other"), ("RIFee", None, "ReservedInstance"),
             ("SavingsPlanNegation", "Compute", "SavingsPlan"), ("Refund", None, "Refund"), ("New", "Storage", "Other"), (None, "Storage", "Other")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string").orderBy("i")
    assert [r[0] for r in df.select(C.invoice_charge_type(F.col("a"), F.col("b"))).collect()] == [c for *_, c in cases]
    meters = spark.createDataFrame([(1, "Virtual Machines Licenses"), (2, "Blob Storage"), (3, "VPN Network"), (4, None)], "i int, m string")
    assert [r[0] for r in meters.orderBy("i").select(C.meter_charge_type(F.col("m"))).collect()] == ["Compute", "Storage", "Networking", "Other"]


def test_machine_prices(spark):
    prices = spark.createDataFrame([("AWS", "a.large", 1.0), ("Azure", "a.large", 2.0), ("GCP", "g-1", 3.0), ("AZURE", "z", 4.0)],
                                   "cloud string, instance_type string, hourly_cost double")
    cases = [("a.large", "AWS", 1.0), ("a.large", "azure", 2.0), ("a.large", None, 1.0), ("a.large", "GCP", 0.5), ("z", "else", 4.0),
             ("g-1", "GCP", 3.0), ("g-1", "else", 0.5), (None, "AWS", 0.5)]
    df = spark.createDataFrame([(i, m, c) for i, (m, c, _) in enumerate(cases)], "i int, m string, c string")
    found = M.with_hourly_price(df, prices, "m", F.col("c"), "p").orderBy("i").collect()
    assert [r.p for r in found] == [p for *_, p in cases]


def test_historical(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "a", "a"), (4, "b", "a")], "i int, n string, id string").orderBy("i")
    assert [r[0] for r in df.select(C.is_historical(F.col("n"), F.col("id"))).collect()] == [True, True, True, False]
    assert [r[0] for r in df.select(C.is_historical(F.col("n"))).collect()] == [True, True, False, False]
