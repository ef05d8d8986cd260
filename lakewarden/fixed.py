"""Fixed values.

These lists, rates, patterns and templates are part of the data model: results
are only right when they hold exactly these values.  Everything that is a
policy choice (weights, thresholds, tolerances) is a parameter whose default
is stated here.
"""

from __future__ import annotations

# Exchange rates in thousandths of a US dollar per unit; any other or missing
# currency counts as 1000.
FX_THOUSANDTHS = {"USD": 1000, "EUR": 1080, "GBP": 1270, "INR": 12}

# Marks of the library itself, beside those of the customer rules.
FLAG_UNKNOWN_CURRENCY = "UNKNOWN_CURRENCY"
FLAG_CAST_FAILED = "CAST_FAILED"

# Accepted customer states; anything else becomes UNKNOWN_LABEL.
CUSTOMER_STATES = ["ACTIVE", "INACTIVE", "SUSPENDED", "CHURNED"]
UNKNOWN_LABEL = "UNKNOWN"
NO_TIER_LABEL = "NONE"

# Patterns.  \z is Java's absolute end of input ($ would allow a trailing newline).
EMAIL_PATTERN = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\z"
INCIDENT_ID_PATTERN = r"^INC-[0-9]{8}-[0-9]{3}\z"
STRATEGY_ID_PATTERN = r"^REC-[0-9]{3}\z"
ACTOR_NAME_PATTERN = r"^[A-Za-z0-9 ._-]{1,64}\z"

# Thresholds.
HIGH_VALUE_USD = 2000
AOV_TOLERANCE_TENTHS = 1  # stated order value may differ by one tenth
CHURN_HIGH = 67
CHURN_MEDIUM = 34

# Quality flags, in the order in which they are joined.
FLAG_INVALID_EMAIL = "INVALID_EMAIL"
FLAG_NEGATIVE_REVENUE = "NEGATIVE_REVENUE_CORRECTED"
FLAG_CHURN_RANGE = "CHURN_SCORE_OUT_OF_RANGE_CLAMPED"
FLAG_AOV_MISMATCH = "AOV_MISMATCH_RECALCULATED"
CLEAN_LABEL = "CLEAN"

# Metadata columns added at ingestion.
INGEST_COLUMNS = ["ingestion_timestamp", "source_file_name", "ingestion_batch_id"]

# Raw customer file: column name and Spark type, in file order.
RAW_CUSTOMER_SCHEMA = """
    customer_id bigint, customer_name string, email string, phone string, gender string,
    date_of_birth string, country string, state_province string, city string, postal_code string,
    registration_date string, registration_channel string, customer_segment string,
    loyalty_tier string, status string, marketing_opt_in string, preferred_payment_method string,
    preferred_channel string, total_orders string, total_revenue string, avg_order_value string,
    first_purchase_date string, last_purchase_date string, lifetime_value string,
    churn_risk_score string, returns_count string, support_tickets_count string, currency string,
    acquisition_channel string, data_source_system string, last_updated_at string
"""

# Columns of the published customer table, in contract order.
CUSTOMER_CONTRACT_COLUMNS = [
    "customer_id",
    "customer_name",
    "email",
    "phone",
    "gender",
    "date_of_birth",
    "country",
    "state_province",
    "city",
    "postal_code",
    "registration_date",
    "registration_channel",
    "customer_segment",
    "loyalty_tier",
    "status",
    "marketing_opt_in",
    "preferred_payment_method",
    "preferred_channel",
    "total_orders",
    "total_revenue_local",
    "total_revenue_usd",
    "avg_order_value_local",
    "avg_order_value_usd",
    "first_purchase_date",
    "last_purchase_date",
    "lifetime_value_local",
    "lifetime_value_usd",
    "churn_risk_score",
    "churn_risk_label",
    "returns_count",
    "support_tickets_count",
    "currency",
    "acquisition_channel",
    "data_source_system",
    "last_updated_at",
    "customer_tenure_days",
    "days_since_last_purchase",
    "is_high_value_customer",
    "is_valid_email",
    "data_quality_flags",
]

# Contract verdicts.
VERDICT_DRIFT = "SCHEMA DRIFT DETECTED"
VERDICT_MISSING = "SCHEMA CONTRACT VIOLATION: MISSING COLUMNS"
VERDICT_PASSED = "SCHEMA CONTRACT PASSED"

# Legal actions of the audit log.
AUDIT_ACTIONS = [
    "incident_detected",
    "evidence_collected",
    "rca_completed",
    "lineage_calculated",
    "impact_calculated",
    "strategy_generated",
    "risk_evaluated",
    "decision_generated",
    "simulation_started",
    "simulation_completed",
    "approval_requested",
    "approval_granted",
    "approval_rejected",
    "execution_started",
    "execution_completed",
    "execution_blocked",
    "verification_started",
    "verification_completed",
    "incident_resolved",
    "prevention_generated",
    "agent_invoked",
]

# A detail key holding any of these words is dropped before logging.
SECRET_HINTS = ["password", "token", "secret", "api_key", "apikey", "credential"]

# Lifecycle stages in order, with the audit action that records each of them.
LIFECYCLE_STAGES = [
    ("DETECTED", "incident_detected"),
    ("INVESTIGATED", "rca_completed"),
    ("RECOVERY_PLANNED", "decision_generated"),
    ("SANDBOX_VERIFIED", "verification_completed"),
    ("HUMAN_APPROVED", "approval_granted"),
    ("EXECUTED_SANDBOX", "execution_completed"),
    ("RECOVERY_VERIFIED", "verification_completed"),
    ("RESOLVED", "incident_resolved"),
]

# Points of the ordinal risk levels; an unrated level counts as MEDIUM.
LEVEL_POINTS = {"HIGH": 3, "MEDIUM": 2, "LOW": 1}
UNRATED_POINTS = 2

# Default weights and class bounds (inclusive lower bounds, checked from the top).
RISK_WEIGHTS = {"execution": 1, "runtime": 1, "data_loss": 1, "impact_scope": 1}
RISK_BOUNDS = [("BLOCKED", 999), ("HIGH_RISK", 10), ("MEDIUM_RISK", 7)]
RISK_FLOOR_CLASS = "LOW_RISK"

# Margin to the runner-up -> confidence.
CONFIDENCE_BOUNDS = [("HIGH", 3), ("MEDIUM", 1)]
CONFIDENCE_FLOOR = "LOW"

# Recovery strategy templates: id, name, scope, risk, runtime, data loss.
STRATEGY_TEMPLATES = [
    ("REC-001", "Full Rebuild",
     ["bronze.customers", "silver.customers", "customer_gold_pipeline", "gold.customer_summary"],
     "HIGH", "HIGH", "LOW"),
    ("REC-002", "Targeted Rebuild",
     ["silver.customers", "customer_gold_pipeline", "gold.customer_summary"],
     "MEDIUM", "MEDIUM", "LOW"),
    ("REC-003", "Rollback",
     ["raw.customers", "bronze.customers", "silver.customers", "customer_gold_pipeline",
      "gold.customer_summary"],
     "MEDIUM", "MEDIUM", "MEDIUM"),
]

# Assets upstream of the published table, in order.
UPSTREAM_ASSETS = ["raw.customers", "bronze.customers"]

# Impact catalogue: asset, type, criticality, impact level, reason.
IMPACT_CATALOGUE = [
    ("customer_gold_pipeline", "PIPELINE", "HIGH", "HIGH",
     "Direct downstream dependency of silver.customers."),
    ("gold.customer_summary", "GOLD_DATASET", "HIGH", "HIGH",
     "Produced by the affected customer_gold_pipeline."),
]

# Customer lineage: upstream asset, downstream asset.
CUSTOMER_LINEAGE = [
    ("raw.customers", "bronze.customers"),
    ("bronze.customers", "silver.customers"),
    ("silver.customers", "customer_gold_pipeline"),
    ("customer_gold_pipeline", "gold.customer_summary"),
]

# Root causes: error type, classification, text, confidence.
ROOT_CAUSES = [
    ("SCHEMA_DRIFT", "SCHEMA_CONTRACT_VIOLATION",
     "Upstream source schema changed without an approved schema contract update.", 1.0),
]
UNKNOWN_CAUSE = ("UNKNOWN", "Unable to determine root cause.", 0.0)
RCA_HIGH_CONFIDENCE = 0.8

# Prevention controls: classification, id, name, type, trigger.
PREVENTION_CONTROLS = [
    ("SCHEMA_CONTRACT_VIOLATION", "PREV-001", "Schema Contract Enforcement", "PREVENTION",
     "Schema contract violation"),
    ("SCHEMA_CONTRACT_VIOLATION", "PREV-002", "Schema Compatibility Test", "TEST",
     "Pipeline deployment"),
    ("SCHEMA_CONTRACT_VIOLATION", "PREV-003", "Schema Drift Alert", "MONITORING",
     "Runtime schema inspection"),
    ("SCHEMA_CONTRACT_VIOLATION", "PREV-004", "Deployment Gate", "GOVERNANCE",
     "CI/CD pipeline"),
]

# Reasons of the publish gate, in the order in which they are checked.
PUBLISH_REASONS = [
    ("no_authorization", "No authorization record found."),
    ("incident_mismatch", "Authorization does not match the requested incident."),
    ("strategy_mismatch", "Authorization does not match the requested strategy."),
    ("not_authorized", "Recovery is not authorized."),
    ("execution_check_failed", "Execution safety check failed."),
    ("scope_not_allowed", "SANDBOX_ONLY execution scope is not allowlisted by policy."),
    ("silver_missing", "Sandbox Silver output not found."),
    ("gold_missing", "Sandbox Gold output not found."),
]
ALLOWED_SCOPES = ["SANDBOX_ONLY"]
