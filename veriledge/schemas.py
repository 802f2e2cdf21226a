"""Fixed vocabularies and row types of the data model."""
from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values: vocabularies, limits and patterns that results depend on -----------------
CLAIM_STATES = ("PROPOSED", "SUPPORTED", "CHALLENGED", "SURVIVED", "NARROWED", "REFUTED",
                "UNRESOLVED")
TERMINAL_CLAIM_STATES = ("SURVIVED", "NARROWED", "REFUTED", "UNRESOLVED")
CLAIM_TRANSITIONS = {
    "PROPOSED": ("SUPPORTED", "CHALLENGED", "UNRESOLVED"),
    "SUPPORTED": ("CHALLENGED", "UNRESOLVED"),
    "CHALLENGED": ("SURVIVED", "NARROWED", "REFUTED", "UNRESOLVED"),
}
RELATIONS = ("SUPPORTS", "CONTRADICTS", "BOUNDS", "PRECEDENT_FOR", "CHECKED")
COUNTER_RELATIONS = ("CONTRADICTS", "BOUNDS", "PRECEDENT_FOR")
GOLD_RELATIONS = ("SUPPORTS", "CONTRADICTS", "BOUNDS", "PRECEDENT_FOR")
DECISIONS = ("SURVIVED", "NARROWED", "REFUTED", "UNRESOLVED")
DECISION_GOLD = {"SURVIVED": ("SUPPORTS",), "NARROWED": ("BOUNDS",),
                 "REFUTED": ("CONTRADICTS", "PRECEDENT_FOR")}
TRACKS = ("known_answer", "temporal_holdout")
SPLITS = ("development", "test")
ORACLE_SCOPES = ("available_by_cutoff", "post_cutoff_validation")
CURATION_STATUSES = ("draft", "independently_checked", "frozen")
LICENSE = "CC-BY-4.0"
SNAPSHOT_MAX_WORDS = 120

JOB_STATUSES = ("QUEUED", "RUNNING", "VALIDATING", "RETRY_WAIT", "SUCCEEDED", "FAILED",
                "CANCELLED")
TERMINAL_JOB_STATUSES = ("SUCCEEDED", "FAILED", "CANCELLED")
JOB_TRANSITIONS = {
    "QUEUED": ("RUNNING", "CANCELLED"),
    "RUNNING": ("VALIDATING", "RETRY_WAIT", "FAILED", "CANCELLED"),
    "RETRY_WAIT": ("RUNNING", "FAILED", "CANCELLED"),
    "VALIDATING": ("SUCCEEDED", "RETRY_WAIT", "FAILED", "CANCELLED"),
}
STAGES = ("PLAN", "RETRIEVE", "READ", "PROPOSE", "CHALLENGE", "DECIDE", "SYNTHESIZE",
          "VALIDATE")
EXECUTION_STAGES = STAGES[:-1]

STRATEGY_STATUSES = ("CANDIDATE", "ACTIVE", "SUSPENDED", "RETIRED")
STRATEGY_KINDS = ("counter_query_template", "boundary_probe", "precedent_probe")
EVALUATORS = ("known_answer", "expert_blind", "temporal_holdout")
MEMORY_MODES = ("none", "uncredited_replay", "delayed_external_credit")
DECISION_MODES = ("direct", "self_critic", "verifier")
MEMORY_MARKER = "[RECALLED_FALSIFICATION_STRATEGY]"

OBJECTIVES = ("predictive_utility", "evidence_sufficiency", "counterevidence_survival",
              "database_validation", "falsifiability", "physical_validity", "simplicity")
WEIGHT_BANK = (
    (1, 1, 1, 1, 1, 1, 1),
    (2, 1, 2, 1, 2, 2, 1),
    (1, 2, 1, 2, 1, 2, 1),
    (2, 2, 2, 0.5, 1, 1, 0.5),
    (0.5, 1, 1, 2, 2, 1, 2),
)

LATENCY_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0)
HTTP_METHODS = ("GET", "POST")
HTTP_ROUTES = ("healthz", "readyz", "metrics", "jobs_collection", "job_item", "job_cancel",
               "not_found")
DRIFT_METHODS = ("publisher_api", "publisher_page", "repository", "web_archive", "manual")

TASK_FIELDS = ("schema_version", "challenge_id", "benchmark_track", "split", "task_family",
               "prompt", "cutoff_date")
FORBIDDEN_GOLD_KEYS = ("accepted_evidence", "counterevidence_exists", "expected_decision",
                       "construction_provenance", "leakage_group", "oracle_scope",
                       "evidence_id")
STOPWORDS = (
    "a", "all", "alone", "and", "are", "as", "at", "be", "by", "can", "for",
    "from", "in", "is", "it", "no", "not", "of", "on", "or", "so", "that",
    "the", "their", "this", "to", "under", "using", "with", "without",
)
SENSITIVE_KEY = r"(?i)(^|_)(api_?key|authorization|cookie|credential|password|secret|token)($|_)"
HEX64 = "^[0-9a-f]{64}$"
SAFE_ID = r"^[A-Za-z0-9._:-]{1,200}$"
TRACEPARENT = "^00-([0-9a-f]{32})-([0-9a-f]{16})-([0-9a-f]{2})$"
ZONE_SUFFIX = r"(Z|[+-]\d{2}:?\d{2}(:?\d{2}(\.\d+)?)?)$"
WILSON_Z = 1.959963984540054
SUBMISSION_LIMITS = {"idempotency_key": 200, "task": 20_000, "max_calls": 10_000,
                     "max_tokens": 100_000_000, "max_cost_microunits": 1_000_000_000_000_000}
# ---------------------------------------------------------------------------------------------

VIOLATION = T.StructType([
    T.StructField("code", T.StringType()),
    T.StructField("detail", T.StringType()),
])

LOCATOR = T.StructType([
    T.StructField("offset", T.LongType()),
    T.StructField("page_no", T.LongType()),
])


_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(),
          "double": T.DoubleType(), "boolean": T.BooleanType()}


def flat(spec: str, **nested: T.DataType) -> T.StructType:
    """``"name type, ..."`` of plain types, followed by nested members."""
    members = [item.split() for item in spec.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in members]
                        + [T.StructField(name, kind) for name, kind in nested.items()])


EVENT = flat(
    "schema_version int, sequence bigint, event_id string, occurred_at string, "
    "tenant_id string, job_id string, aggregate_type string, aggregate_id string, "
    "event_type string, payload string, idempotency_key string, previous_hash string, "
    "event_hash string"
)
GOLD_EVIDENCE = flat(
    "evidence_id string, doc_id string, relation string, content_sha256 string, "
    "publication_date string, oracle_scope string, snapshot_id string, source_url string, "
    "doi string, license_spdx string, source_locator string", locator=LOCATOR)
CHALLENGE = flat(
    "schema_version int, challenge_id string, benchmark_track string, split string, "
    "task_family string, leakage_group string, prompt string, cutoff_date string, "
    "counterevidence_exists boolean, expected_decision string",
    accepted_evidence=T.ArrayType(GOLD_EVIDENCE),
    construction_provenance=flat("source string, curator string, status string"))
SNAPSHOT = flat(
    "schema_version int, snapshot_id string, content string, content_sha256 string, "
    "source_url string, doi string, source_locator string, publication_date string, "
    "retrieved_at string, license_spdx string, attribution string, normalization string")
OBSERVATION = flat(
    "schema_version int, snapshot_id string, source_url string, doi string, "
    "source_locator string, observed_at string, status string, content string, "
    "content_sha256 string",
    retrieval=flat("method string, actor string, independently_verified boolean, "
                   "receipt_sha256 string"))
CITATION = T.StructType([
    T.StructField("doc_id", T.StringType()), T.StructField("relation", T.StringType()),
    T.StructField("locator", LOCATOR), T.StructField("content_sha256", T.StringType()),
])
PREDICTION = flat(
    "schema_version int, challenge_id string, run_id string, method_id string, status string, "
    "predicted_decision string, counterevidence_probability double, "
    "calls bigint, tokens bigint, ledger_head string, ledger_event_count bigint, "
    "ledger_relpath string, prediction_commitment_sha256 string",
    evidence=T.ArrayType(CITATION))
METHOD = flat("method_id string, support_retrieval boolean, external_counter_retrieval boolean, "
              "cedg boolean, memory string, decision_mode string")
METHOD_REGISTRY = flat("schema_version int", methods=T.ArrayType(METHOD),
                       budget=flat("max_calls bigint, max_tokens bigint"))

# Table catalogue: columns, keys and references. Spark does not enforce keys, so
# sources.registry.table_violations checks them.
RUNTIME_TABLES = {
    "jobs": {
        "schema": flat(
            "job_id string, tenant_id string, idempotency_key string, task string, "
            "status string, stage string, version bigint, lease_owner string, "
            "lease_expires_at double, attempts bigint, max_calls bigint, max_tokens bigint, "
            "max_cost_microunits bigint, used_calls bigint, used_tokens bigint, "
            "used_cost_microunits bigint, last_error_code string, created_at double, "
            "updated_at double"),
        "keys": [("job_id",), ("tenant_id", "idempotency_key")],
        "refs": [],
        "nullable": ("lease_owner", "lease_expires_at", "last_error_code"),
    },
    "checkpoints": {
        "schema": flat("job_id string, stage string, checkpoint_key string, "
                          "payload string, created_at double"),
        "keys": [("job_id", "checkpoint_key")],
        "refs": [(("job_id",), "jobs", ("job_id",))],
        "nullable": (),
    },
    "usage_ledger": {
        "schema": flat("job_id string, charge_key string, provider string, calls bigint, "
                          "tokens bigint, cost_microunits bigint, created_at double"),
        "keys": [("job_id", "charge_key")],
        "refs": [(("job_id",), "jobs", ("job_id",))],
        "nullable": (),
    },
    "artifacts": {
        "schema": flat("tenant_id string, job_id string, logical_key string, "
                          "content_sha256 string, size_bytes bigint, media_type string, "
                          "created_at double"),
        "keys": [("tenant_id", "job_id", "logical_key")],
        "refs": [],
        "nullable": (),
    },
    "strategies": {
        "schema": flat("strategy_id string, tenant_id string, strategy_key string, "
                          "kind string, pattern string, source_job_id string, "
                          "source_task_family string, status string, created_at double, "
                          "updated_at double"),
        "keys": [("strategy_id",), ("tenant_id", "strategy_key")],
        "refs": [],
        "nullable": (),
    },
    "applications": {
        "schema": flat("application_id string, strategy_id string, tenant_id string, "
                          "target_job_id string, target_task_family string, "
                          "rendered_query_sha256 string, idempotency_key string, "
                          "created_at double"),
        "keys": [("application_id",), ("tenant_id", "idempotency_key")],
        "refs": [(("strategy_id",), "strategies", ("strategy_id",))],
        "nullable": (),
    },
    "outcomes": {
        "schema": flat("application_id string, evaluator_kind string, success boolean, "
                          "false_gap_avoided boolean, valid_finding_delta double, "
                          "calls bigint, tokens bigint, evidence_ref string, "
                          "recorded_at double"),
        "keys": [("application_id",)],
        "refs": [(("application_id",), "applications", ("application_id",))],
        "nullable": (),
    },
    "policy_outbox": {
        "schema": flat("event_id string, tenant_id string, event_type string, "
                          "aggregate_type string, aggregate_id string, payload string, "
                          "idempotency_key string, created_at double, dispatched_at double"),
        "keys": [("event_id",), ("tenant_id", "idempotency_key")],
        "refs": [],
        "nullable": ("dispatched_at",),
    },
    "sequence_interventions": {
        "schema": flat("tenant_id string, run_id string, method_id string, "
                          "sequence_index bigint, challenge_id string, order_sha256 string, "
                          "memory_mode string, strategy_ids string, created_at double"),
        "keys": [("tenant_id", "run_id", "method_id", "sequence_index"),
                 ("tenant_id", "run_id", "method_id", "challenge_id")],
        "refs": [],
        "nullable": (),
    },
    "model_operations": {
        "schema": flat("operation_id string, request_sha256 string, status string, "
                          "response_text string, input_tokens bigint, output_tokens bigint, "
                          "request_id string, created_at double, completed_at double"),
        "keys": [("operation_id",)],
        "refs": [],
        "nullable": ("response_text", "input_tokens", "output_tokens", "request_id",
                     "completed_at"),
    },
    "retrieval_operations": {
        "schema": flat("operation_id string, request_sha256 string, status string, "
                          "response_json string, created_at double, completed_at double"),
        "keys": [("operation_id",)],
        "refs": [],
        "nullable": ("response_json", "completed_at"),
    },
    "operation_reconciliations": {
        "schema": flat("reconciliation_id bigint, operation_kind string, "
                          "operation_id string, request_sha256 string, prior_status string, "
                          "action string, actor string, reason string, "
                          "evidence_receipt_sha256 string, reconciled_at double"),
        "keys": [("reconciliation_id",)],
        "refs": [],
        "nullable": (),
    },
    "circuit_events": {
        "schema": flat("event_id bigint, circuit_id string, operation_id string, "
                          "event_type string, prior_state string, next_state string, "
                          "reason_code string, occurred_at double"),
        "keys": [("event_id",)],
        "refs": [],
        "nullable": (),
    },
}
