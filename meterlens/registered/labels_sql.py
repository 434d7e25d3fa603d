"""Expected label of every SKU of the test mapping, written out by hand.

The Spark side derives labels from rules; here each product or SKU is simply
given the label it must get.
"""

SERVERLESS_APPS = "sku_name = 'PREMIUM_SERVERLESS_APPS'"
INFERENCE = "sku_name IN ('PREMIUM_SERVERLESS_REAL_TIME_INFERENCE', 'PREMIUM_SERVERLESS_REAL_TIME_INFERENCE_LAUNCH')"

CATEGORY = f"""CASE product WHEN 'SQL' THEN 'SQL' WHEN 'DLT' THEN 'ETL - Streaming' WHEN 'JOBS' THEN 'ETL - Batch'
 WHEN 'ALL_PURPOSE' THEN 'Interactive' WHEN 'MODEL_SERVING' THEN 'Model Serving' WHEN 'FOUNDATION_MODEL_SERVING' THEN 'Model Serving'
 WHEN 'VECTOR_SEARCH' THEN 'Vector Search' WHEN 'FINE_TUNING' THEN 'Fine-Tuning' WHEN 'AI_FUNCTIONS' THEN 'AI Functions'
 ELSE CASE WHEN {SERVERLESS_APPS} THEN 'Serverless' ELSE 'Other' END END"""
SERIES = f"""CASE WHEN product = 'SQL' THEN 'SQL' WHEN product = 'DLT' THEN 'ETL - Streaming' WHEN product = 'JOBS' THEN 'ETL - Batch'
 WHEN product = 'ALL_PURPOSE' THEN 'Interactive' WHEN {SERVERLESS_APPS} OR {INFERENCE} THEN 'Serverless' ELSE 'Other' END"""
GROUP_REPORT = """CASE product WHEN 'SQL' THEN 'SQL' WHEN 'DLT' THEN 'ETL - Streaming' WHEN 'JOBS' THEN 'ETL - Batch'
 WHEN 'ALL_PURPOSE' THEN 'Interactive' WHEN 'MODEL_SERVING' THEN 'Model Serving' ELSE 'Other' END"""
ETL = "CASE product WHEN 'DLT' THEN 'Streaming (SDP)' WHEN 'JOBS' THEN 'Batch Jobs' END"
IS_ETL = "product IN ('DLT', 'JOBS')"
IS_AIML = "product IN ('MODEL_SERVING', 'VECTOR_SEARCH', 'FINE_TUNING')"
IS_SERVING = "product = 'MODEL_SERVING'"
PROVIDER = """CASE sku_name WHEN 'PREMIUM_ANTHROPIC_MODEL_SERVING' THEN 'Anthropic' WHEN 'PREMIUM_OPENAI_MODEL_SERVING' THEN 'OpenAI'
 WHEN 'PREMIUM_GEMINI_MODEL_SERVING' THEN 'Gemini' END"""
AIML = f"""CASE WHEN {PROVIDER} IS NOT NULL THEN 'FMAPI - ' || {PROVIDER} WHEN {INFERENCE} THEN 'Serverless Inference'
 WHEN offering = 'BATCH_INFERENCE' THEN 'Batch Inference' WHEN product = 'VECTOR_SEARCH' THEN 'Vector Search' ELSE 'Fine Tuning' END"""
AIML_SERIES = f"""CASE WHEN {PROVIDER} IS NOT NULL THEN {PROVIDER} WHEN {INFERENCE} THEN 'Serverless Inference'
 WHEN product = 'VECTOR_SEARCH' THEN 'Vector Search' ELSE 'Fine Tuning' END"""
MODEL_TYPE = f"""CASE WHEN product = 'FEATURE_STORE' THEN 'Feature Store' WHEN product = 'MODEL_TRAINING' THEN 'Model Training'
 WHEN product = 'FOUNDATION_MODEL_SERVING' OR {PROVIDER} IS NOT NULL THEN 'Foundation Model API' END"""
IS_AGENT = "product = 'AGENT_BRICKS'"
IS_INFRA = "product IN ('ALL_PURPOSE', 'JOBS', 'DLT')"
IS_INFRA_OR_SQL = "product IN ('ALL_PURPOSE', 'JOBS', 'DLT', 'SQL')"
AGENT = """CASE {name} WHEN 'ka-support' THEN 'Knowledge Assistant' WHEN 'kie-invoices' THEN 'Knowledge Assistant'
 WHEN 'Knowledge-Base-Assistant' THEN 'Knowledge Assistant' WHEN 'sales-genie' THEN 'Genie Space'
 WHEN 'Team-Supervisor' THEN 'Supervisor Agent' WHEN 'multi-agent-desk' THEN 'Supervisor Agent' ELSE 'Agent' END"""
