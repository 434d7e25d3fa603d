"""Fixed values of the test mapping and of the price model."""

# fixed values: SKU dimension, position k = 0..23 (name, product)
SKUS = [
    ("ENTERPRISE_SQL_PRO_COMPUTE", "SQL"),
    ("ENTERPRISE_SERVERLESS_SQL_COMPUTE", "SQL"),
    ("PREMIUM_SQL_COMPUTE", "SQL"),
    ("PREMIUM_JOBS_COMPUTE", "JOBS"),
    ("PREMIUM_JOBS_SERVERLESS_COMPUTE", "JOBS"),
    ("PREMIUM_DLT_CORE_COMPUTE", "DLT"),
    ("PREMIUM_ALL_PURPOSE_COMPUTE", "ALL_PURPOSE"),
    ("ENTERPRISE_ALL_PURPOSE_COMPUTE", "ALL_PURPOSE"),
    ("PREMIUM_SERVERLESS_REAL_TIME_INFERENCE", "MODEL_SERVING"),
    ("PREMIUM_SERVERLESS_REAL_TIME_INFERENCE_LAUNCH", "MODEL_SERVING"),
    ("PREMIUM_ANTHROPIC_MODEL_SERVING", "MODEL_SERVING"),
    ("PREMIUM_OPENAI_MODEL_SERVING", "MODEL_SERVING"),
    ("PREMIUM_GEMINI_MODEL_SERVING", "MODEL_SERVING"),
    ("PREMIUM_VECTOR_SEARCH_STORAGE", "VECTOR_SEARCH"),
    ("PREMIUM_FINE_TUNING", "FINE_TUNING"),
    ("PREMIUM_AI_QUERY", "AI_FUNCTIONS"),
    ("PREMIUM_SERVERLESS_APPS", "APPS"),
    ("PREMIUM_APPS_CAPACITY", "APPS"),
    ("PREMIUM_AGENT_EVALUATION", "AGENT_BRICKS"),
    ("PREMIUM_MODEL_TRAINING", "MODEL_TRAINING"),
    ("PREMIUM_FEATURE_STORE", "FEATURE_STORE"),
    ("PREMIUM_DATABASE_STORAGE", "DEFAULT_STORAGE"),
    ("UNPRICED_PREVIEW_SKU", "PREVIEW"),
    ("PREMIUM_LLAMA_PROVISIONED_THROUGHPUT", "FOUNDATION_MODEL_SERVING"),
]
UNPRICED_SKU = 22

# fixed values: clouds, by position
CLOUDS = ["AWS", "AZURE", "GCP"]

# fixed values: endpoint names, position = endpoint number
ENDPOINTS = ["ka-support", "kie-invoices", "sales-genie", "Team-Supervisor", "churn-model",
             "multi-agent-desk", "fraud-model", "Knowledge-Base-Assistant", "rank-model"]

# fixed values: machine types of the cluster change log, by position
NODE_TYPES = ["i3.xlarge", "m5.2xlarge", "Standard_D8s_v3", "n2-standard-8", "r7i.4xlarge", "zz9.huge", "Standard_1x"]

# fixed values: hourly prices of those machine types (cloud, type, dollars)
MACHINE_PRICES = [
    ("AWS", "i3.xlarge", 0.312),
    ("AWS", "m5.2xlarge", 0.384),
    ("AWS", "r7i.4xlarge", 1.0584),
    ("AZURE", "Standard_D8s_v3", 0.384),
    ("GCP", "n2-standard-8", 0.3885),
]
ESTIMATE_MACHINES = ["i3.xlarge", "m5.2xlarge"]

# fixed values: warehouse sizes and types, by position
WAREHOUSE_SIZES = ["Small", "Large", "X-Large", "Medium", "2X-Large"]
WAREHOUSE_TYPES = ["PRO", "CLASSIC", "SERVERLESS"]

# fixed values: use-case stages, by position
STAGES = ["Development", "Testing", "Production"]

#: First day of the usage data and the last day it can reach.
FIRST_DAY = "2023-08-04"
LAST_DAY = "2024-01-30"
#: First day after the data, for reports whose end is exclusive.
DAY_AFTER = "2024-01-31"
