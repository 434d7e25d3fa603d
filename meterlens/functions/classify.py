"""First-match classification of usage and queries, as Column expressions.

Every classifier is an ordered rule table.  A rule matches when any of its
conditions does: the billing product is listed, the SKU name contains one of
the marks, or a flag column is true.  Reports call these *after* usage has been
collapsed to (product, SKU, flag), so the string tests run on a few thousand
rows and not on the raw records.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    label: str
    products: tuple[str, ...] = ()
    marks: tuple[str, ...] = ()
    pipeline: bool = False
    not_products: tuple[str, ...] = ()
    offering: str | None = None


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def contains_any(text: Column, marks: tuple[str, ...]) -> Column:
    return any_of([text.contains(m) for m in marks])


def _matches(rule: Rule) -> Column:
    product, sku = F.col("billing_origin_product"), F.col("sku_name")
    conditions = []
    if rule.products:
        conditions.append(product.isin(*rule.products))
    if rule.pipeline:
        conditions.append(F.col("has_pipeline"))
    if rule.marks:
        conditions.append(contains_any(sku, rule.marks))
    if rule.offering:
        conditions.append(F.col("offering_type") == rule.offering)
    matched = any_of(conditions)
    return matched & ~product.isin(*rule.not_products) if rule.not_products else matched


def first_match(rules: list[Rule], default: str | None) -> Column:
    """The label of the first rule that matches.

    Reads billing_origin_product and sku_name, and has_pipeline or
    offering_type where a rule asks for them.
    """
    labels = [F.when(_matches(rule), rule.label) for rule in rules]
    return F.coalesce(*labels, F.lit(default))


# fixed values: rule tables
_STREAMING = Rule("ETL - Streaming", products=("DLT",), pipeline=True)
_BATCH = Rule("ETL - Batch", products=("JOBS",))
_INTERACTIVE = Rule("Interactive", marks=("ALL_PURPOSE",))
_SERVERLESS = Rule("Serverless", marks=("SERVERLESS",), not_products=("JOBS", "SQL", "DLT"))

NON_SQL_CATEGORY = [
    _STREAMING, _BATCH, _INTERACTIVE,
    Rule("Model Serving", products=("SERVING", "MODEL_SERVING"), marks=("SERVING", "INFERENCE", "PROVISIONED_THROUGHPUT")),
    Rule("Vector Search", marks=("VECTOR_SEARCH",)),
    Rule("Fine-Tuning", marks=("FOUNDATION_MODEL", "FINE_TUNING")),
    Rule("AI Functions", marks=("AI_BI", "AI_QUERY", "AI_FUNCTIONS")),
    _SERVERLESS,
]
PRODUCT_CATEGORY = [Rule("SQL", products=("SQL",)), *NON_SQL_CATEGORY]
NON_SQL_SERIES = [_STREAMING, _BATCH, _INTERACTIVE, _SERVERLESS, Rule("Model Serving", marks=("INFERENCE",))]
SERIES_CATEGORY = [Rule("SQL", products=("SQL",)), *NON_SQL_SERIES]
GROUP_REPORT_CATEGORY = [
    _STREAMING, _BATCH, _INTERACTIVE,
    Rule("Model Serving", products=("SERVING", "MODEL_SERVING"), marks=("SERVING",)),
    Rule("SQL", products=("SQL",)),
]
ETL_TYPE = [Rule("Streaming (SDP)", products=("DLT",), pipeline=True), Rule("Batch Jobs", products=("JOBS",))]
PROVIDERS = [Rule("Anthropic", marks=("ANTHROPIC",)), Rule("OpenAI", marks=("OPENAI",)), Rule("Gemini", marks=("GEMINI",))]
_INFERENCE = Rule("Serverless Inference", marks=("SERVERLESS_REAL_TIME_INFERENCE",))
AIML_CATEGORY = [
    *[Rule(f"FMAPI - {r.label}", marks=r.marks) for r in PROVIDERS], _INFERENCE,
    Rule("Batch Inference", offering="BATCH_INFERENCE"),
    Rule("Vector Search", products=("VECTOR_SEARCH",)),
    Rule("Fine Tuning", marks=("FINE_TUNING",)),
    Rule("Model Serving", products=("MODEL_SERVING",)),
]
AIML_SERIES = [*PROVIDERS, _INFERENCE, Rule("Vector Search", products=("VECTOR_SEARCH",)),
               Rule("Fine Tuning", marks=("FINE_TUNING",))]
AIML_MARKS = ("SERVERLESS_REAL_TIME_INFERENCE", "ANTHROPIC", "OPENAI", "GEMINI", "INFERENCE")
MODEL_MARKS = ("ANTHROPIC", "OPENAI", "GEMINI", "META", "COHERE", "MISTRAL", "AI21", "MOSAIC", "DBRX", "LLAMA")
MODEL_TYPE = [
    Rule("Feature Store", marks=("FEATURE",)),
    Rule("Model Training", marks=("TRAINING",)),
    Rule("Foundation Model API", marks=MODEL_MARKS, products=("FOUNDATION_MODEL_SERVING",)),
]


def product_category() -> Column:
    """K4, ten categories."""
    return first_match(PRODUCT_CATEGORY, "Other")


def series_category() -> Column:
    """K5: the coarser category of time series; serverless is tested before model serving."""
    return first_match(SERIES_CATEGORY, "Other")


def non_sql_category() -> Column:
    """K6: K4 for usage from which SQL was already removed."""
    return first_match(NON_SQL_CATEGORY, "Other")


def non_sql_series_category() -> Column:
    return first_match(NON_SQL_SERIES, "Other")


def group_report_category() -> Column:
    """K7: the short list of the group report."""
    return first_match(GROUP_REPORT_CATEGORY, "Other")


def etl_type() -> Column:
    """K8; null for anything that is not ETL."""
    return first_match(ETL_TYPE, None)


def is_etl() -> Column:
    return F.col("billing_origin_product").isin("JOBS", "DLT") | F.col("usage_metadata.dlt_pipeline_id").isNotNull()


def is_aiml() -> Column:
    """K9 predicate."""
    return (F.col("billing_origin_product").isin("MODEL_SERVING", "VECTOR_SEARCH")
            | contains_any(F.col("sku_name"), (*AIML_MARKS, "FINE_TUNING")))


def is_model_serving() -> Column:
    """The narrower AI predicate used by the KPI series and the SKU catalogue."""
    return (F.col("billing_origin_product") == "MODEL_SERVING") | contains_any(F.col("sku_name"), AIML_MARKS)


def is_serving_endpoint() -> Column:
    return (F.col("billing_origin_product") == "MODEL_SERVING") | F.col("sku_name").contains("INFERENCE")


def aiml_category() -> Column:
    """K9 category."""
    return first_match(AIML_CATEGORY, "Other AI/ML")


def aiml_series_category() -> Column:
    """Series labels differ from the category report."""
    return first_match(AIML_SERIES, "Other Model Serving")


def provider() -> Column:
    return first_match(PROVIDERS, "Other")


def is_provider() -> Column:
    return contains_any(F.col("sku_name"), tuple(m for r in PROVIDERS for m in r.marks))


def model_type() -> Column:
    """K11; null when the SKU is neither a model nor a feature store."""
    return first_match(MODEL_TYPE, None)


def agent_type(name: Column) -> Column:
    """Kind of agent, read off the endpoint name."""
    text = F.coalesce(name, F.lit(""))
    low = F.lower(text)
    assistant = text.startswith("ka-") | text.startswith("kie-") | low.rlike("knowledge.*assistant")
    supervisor = contains_any(low, ("supervisor", "multi-agent", "orchestrator"))
    return (F.when(assistant, "Knowledge Assistant").when(low.contains("genie"), "Genie Space")
             .when(supervisor, "Supervisor Agent").otherwise("Agent"))


def _either_case(text: Column, word: str) -> Column:
    return text.contains(word) | text.contains(word.capitalize())


def client_source_type(client: Column, statement_type: Column) -> Column:
    """Source type guessed from the client string; only the two usual spellings count."""
    board = F.when(client.contains("lakeview") | client.contains("aibi"), "AI/BI DASHBOARD").otherwise("LEGACY DASHBOARD")
    return (F.when(_either_case(client, "genie"), "GENIE SPACE")
             .when(_either_case(client, "dashboard"), board)
             .when(_either_case(client, "notebook"), "NOTEBOOK")
             .when(_either_case(client, "job") | (statement_type == "JOB"), "JOB")
             .when(_either_case(client, "alert"), "ALERT")
             .otherwise("SQL QUERY"))


def client_source_id(client: Column) -> Column:
    """The id after ``genie/`` or ``dashboard/``; an empty string when the client names none."""
    def after(word: str) -> Column:
        return F.regexp_extract(client, word + "[/-]([a-zA-Z0-9-]+)", 1)
    return F.when(client.contains("genie"), after("genie")).when(client.contains("dashboard"), after("dashboard"))


# fixed values: fields of query_source, by priority
SOURCE_FIELDS = [
    ("query_source.job_info.job_id", "JOB"),
    ("query_source.legacy_dashboard_id", "LEGACY DASHBOARD"),
    ("query_source.dashboard_id", "AI/BI DASHBOARD"),
    ("query_source.alert_id", "ALERT"),
    ("query_source.notebook_id", "NOTEBOOK"),
    ("query_source.sql_query_id", "SQL QUERY"),
    ("query_source.genie_space_id", "GENIE SPACE"),
]


def recorded_source_type() -> Column:
    """Source type recorded with the query, else the client string."""
    labels = [F.when(F.col(f).isNotNull(), label) for f, label in SOURCE_FIELDS]
    return F.coalesce(*labels, F.col("client_application"), F.lit("UNKNOWN"))


def recorded_source_id() -> Column:
    return F.coalesce(*[F.col(f) for f, _ in SOURCE_FIELDS], F.lit("UNKNOWN"))


def query_origin() -> Column:
    """Who or what wrote the query."""
    client = F.lower(F.coalesce(F.col("client_application"), F.lit("")))
    tag_origin = F.lower(F.coalesce(F.col("query_tags").getItem("origin"), F.lit("")))
    tool = F.col("query_tags").getItem("authoring_tool").isNotNull() | (tag_origin == "mcp") | client.contains("mcp")
    genie = F.col("query_source.genie_space_id").isNotNull() | client.contains("genie")
    robot = F.col("executed_by").isNotNull() & ~F.col("executed_by").contains("@")
    return F.when(tool, "MCP_TOOL").when(genie, "GENIE").when(robot, "SERVICE_PRINCIPAL").otherwise("HUMAN")


def sql_tool(genie: str = "Genie", other: str = "DBSQL") -> Column:
    """K16; a null client counts as the other tool."""
    return F.when(F.col("client_application").contains("Genie"), genie).otherwise(other)


def has_tags() -> Column:
    """A map that is there and not empty."""
    return F.coalesce(F.size("custom_tags") > 0, F.lit(False))


def object_fields() -> tuple[Column, Column, Column]:
    """(id, type, name) of the billed object, by priority."""
    m = "usage_metadata."
    order = [("cluster_id", "Cluster", "cluster_id"), ("warehouse_id", "SQL Warehouse", "warehouse_id"),
             ("endpoint_name", "Serving Endpoint", "endpoint_name"), ("dlt_pipeline_id", "Pipeline", "dlt_pipeline_id"),
             ("job_id", "Job", "job_name")]
    kind = F.coalesce(*[F.when(F.col(m + i).isNotNull(), label) for i, label, _ in order], F.lit("Other"))
    ident = F.coalesce(*[F.col(m + i) for i, _, _ in order], F.col("sku_name"))
    name = F.coalesce(*[F.col(m + n) for _, _, n in order], F.col("sku_name"))
    return ident, kind, name


def instance_family(instance_type: Column, cloud: Column) -> Column:
    """Family part of a machine type; 'unknown' when there is none."""
    azure = F.when(instance_type.startswith("Standard_"),
                   F.nullif(F.regexp_extract(instance_type, "^(Standard_[^0-9]+)", 1), F.lit("")))
    gcp = F.substring_index(instance_type, "-", 1)
    aws = F.nullif(F.substring_index(instance_type, ".", 1), F.lit(""))
    family = F.when(F.upper(cloud) == "AZURE", azure).when(F.upper(cloud) == "GCP", gcp).otherwise(aws)
    return F.coalesce(family, F.lit("unknown"))


def worker_family(instance_type: Column) -> Column:
    """Family of the AWS-only reports: letters and digits before the dot.

    A type without a dot gives an empty string, only a missing type 'unknown'.
    """
    return F.coalesce(F.regexp_extract(instance_type, r"^([a-z0-9]+)\.", 1), F.lit("unknown"))


# fixed values: invoice line types and product families
_USAGE_FAMILIES = [("Compute", "Compute"), ("Storage", "Storage"), ("Data Transfer", "Networking"), ("Network", "Networking")]
_LINE_TYPES = [
    (("SavingsPlanCoveredUsage", "SavingsPlanRecurringFee", "SavingsPlanNegation"), "SavingsPlan"),
    (("DiscountedUsage", "RIFee"), "ReservedInstance"),
    (("Fee",), "Fee"), (("Tax",), "Tax"), (("Credit",), "Credit"), (("Refund",), "Refund"),
]


def invoice_charge_type(line_type: Column, family: Column) -> Column:
    """K21."""
    by_family = F.coalesce(*[F.when(family.contains(mark), label) for mark, label in _USAGE_FAMILIES], F.lit("Other"))
    by_type = [F.when(line_type.isin(*types), label) for types, label in _LINE_TYPES]
    return F.coalesce(F.when(line_type == "Usage", by_family), *by_type, F.lit("Other"))


def meter_charge_type(category: Column) -> Column:
    """K22."""
    return (F.when(contains_any(category, ("Virtual Machine", "Compute")), "Compute")
             .when(category.contains("Storage"), "Storage")
             .when(contains_any(category, ("Bandwidth", "Network")), "Networking").otherwise("Other"))


def is_historical(name: Column, ident: Column | None = None) -> Column:
    """The object has no current name, or its name is only its id."""
    gone = name.isNull() | (name == "")
    return gone if ident is None else gone | (name == ident)


def is_infra_sku() -> Column:
    """Classic compute SKUs: what the infrastructure summary counts."""
    return contains_any(F.col("sku_name"), ("ALL_PURPOSE", "JOBS", "DLT"))


def is_infra_or_sql_sku() -> Column:
    """The wider predicate of the infrastructure cost series, which also counts SQL SKUs."""
    return contains_any(F.col("sku_name"), ("ALL_PURPOSE", "JOBS", "SQL", "DLT"))


def is_agent() -> Column:
    return F.lower("sku_name").contains("agent") | (F.col("billing_origin_product") == "AGENT_BRICKS")


def is_ml_runtime(version: Column) -> Column:
    return contains_any(F.lower(version), ("-ml-", "-gpu-"))
