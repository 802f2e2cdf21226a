"""Logical tables of the data model, derived from the generic tables of a data folder.

Each table is one SQL text that Spark and an ANSI engine both run, so a query and its check start
from the same rows. ``Tables`` gives them as DataFrames, ``with_tables`` as a WITH clause.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriledge import schemas as S
from veriledge.session import checkpoint_dir

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
        "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

SQL: dict[str, str] = {
    # Evidence capsules and tasks.
    "corpus": """
        SELECT 'd' || doc_id AS snapshot_id, text AS content, sha256(text) AS content_sha256,
               CAST(date '2015-01-01' + CAST(doc_id % 3650 AS INT) AS DATE) AS publication_date,
               '10.' || (1000 + doc_id % 97) || '/' || doc_id AS doi, lang, source, doc_id
        FROM documents""",
    "tasks": """
        SELECT 1 AS schema_version, 't' || item_id AS challenge_id,
               'known_answer' AS benchmark_track, 'development' AS split,
               'f' || (item_id % 5) AS task_family, text AS prompt,
               CAST(date '2020-01-01' + CAST(item_id % 1000 AS INT) AS DATE) AS cutoff_date
        FROM benchmark""",
    "snapshots": """
        SELECT 1 AS schema_version, 'd' || doc_id AS snapshot_id, text AS content,
               CASE WHEN doc_id % 19 = 0 THEN sha256(source) ELSE sha256(text) END
                   AS content_sha256,
               CASE WHEN doc_id % 23 = 0 THEN 'http://' ELSE 'https://' END || source
                   AS source_url,
               CASE WHEN doc_id % 29 = 0 THEN 'x' ELSE '10.' END || doc_id AS doi,
               'p' || doc_id AS source_locator,
               CAST(date '2015-01-01' + CAST(doc_id % 3650 AS INT) AS STRING)
                   AS publication_date,
               CASE WHEN doc_id % 31 = 0 THEN '2024-01-01T00:00:00'
                    ELSE '2024-01-01T00:00:00Z' END AS retrieved_at,
               CASE WHEN doc_id % 37 = 0 THEN 'MIT' ELSE 'CC-BY-4.0' END AS license_spdx,
               CASE WHEN doc_id % 41 = 0 THEN '' ELSE source END AS attribution,
               'none' AS normalization
        FROM documents""",
    "observations": """
        SELECT 1 AS schema_version,
               CASE WHEN doc_id % 43 = 0 THEN 'x' ELSE 'd' END || doc_id AS snapshot_id,
               CASE WHEN doc_id % 23 = 0 THEN 'http://' ELSE 'https://' END || source
                   AS source_url,
               CASE WHEN doc_id % 29 = 0 THEN 'x' ELSE '10.' END || doc_id AS doi,
               CASE WHEN doc_id % 5 = 0 THEN 'q' ELSE 'p' END || doc_id AS source_locator,
               CASE WHEN doc_id % 47 = 0 THEN '2023-01-01T00:00:00Z'
                    ELSE '2025-01-01T00:00:00+01:00' END AS observed_at,
               CASE WHEN doc_id % 11 = 0 THEN 'unavailable' ELSE 'available' END AS status,
               CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN text || '  '
                    WHEN doc_id % 7 = 1 THEN text || ' changed' ELSE text END AS content,
               CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 53 = 0 THEN sha256(source)
                    WHEN doc_id % 7 = 0 THEN sha256(text || '  ')
                    WHEN doc_id % 7 = 1 THEN sha256(text || ' changed')
                    ELSE sha256(text) END AS content_sha256,
               CASE WHEN doc_id % 59 = 0 THEN 'rumour' ELSE 'repository' END AS method,
               source AS actor, doc_id % 3 <> 0 AS independently_verified,
               sha256(source) AS receipt_sha256
        FROM documents""",
    # Gold and predictions over labelled documents.
    "gold": """
        SELECT 1 AS schema_version, 'c' || d.doc_id AS challenge_id,
               CASE WHEN d.doc_id % 3 = 0 THEN 'temporal_holdout' ELSE 'known_answer' END
                   AS benchmark_track,
               CASE WHEN d.doc_id % 3 = 1 AND d.doc_id % 7 = 0 THEN 'test'
                    ELSE 'development' END AS split,
               d.lang AS task_family, d.lang || '-' || (d.doc_id % 3) AS leakage_group,
               d.text AS prompt,
               CAST(date '2018-01-01' + CAST(d.doc_id % 1000 AS INT) AS STRING) AS cutoff_date,
               l.toxic = 1 OR d.doc_id % 2 = 0 AS counterevidence_exists,
               CASE WHEN d.doc_id % 4 = 0 THEN 'NARROWED' WHEN l.toxic = 1 THEN 'REFUTED'
                    WHEN d.doc_id % 4 = 3 THEN 'UNRESOLVED' ELSE 'SURVIVED' END
                   AS expected_decision,
               d.doc_id AS doc_id, l.toxic AS toxic, l.quality AS quality,
               d.n_chars AS n_chars, d.source AS source
        FROM documents d JOIN labels l ON l.doc_id = d.doc_id""",
    "gold_evidence": """
        SELECT g.challenge_id, 'e' || g.doc_id AS evidence_id,
               ' DOI:10.1/' || g.doc_id AS doc_id,
               CASE WHEN g.toxic = 1 THEN 'CONTRADICTS' ELSE 'SUPPORTS' END AS relation,
               CAST(0 AS BIGINT) AS locator_offset, CAST(NULL AS BIGINT) AS page_no,
               s.content_sha256, s.publication_date,
               CASE WHEN CAST(s.publication_date AS DATE) <= CAST(g.cutoff_date AS DATE)
                    THEN 'available_by_cutoff' ELSE 'post_cutoff_validation' END AS oracle_scope,
               s.snapshot_id, s.source_url, s.doi, s.license_spdx, s.source_locator
        FROM gold g JOIN snapshots s ON s.snapshot_id = 'd' || g.doc_id
        UNION ALL
        SELECT g.challenge_id, 'b' || (g.doc_id - g.doc_id % 20) AS evidence_id,
               'doi:10.2/' || g.doc_id AS doc_id, 'BOUNDS' AS relation,
               CAST(NULL AS BIGINT) AS locator_offset,
               CASE WHEN g.doc_id % 26 = 0 THEN NULL ELSE g.doc_id % 9 END AS page_no,
               s.content_sha256, '2016-05-05' AS publication_date,
               'available_by_cutoff' AS oracle_scope,
               s.snapshot_id, s.source_url, s.doi, s.license_spdx,
               CASE WHEN g.doc_id % 8 = 0 THEN 'elsewhere' ELSE s.source_locator END
                   AS source_locator
        FROM gold g JOIN snapshots s ON s.snapshot_id = 'd' || g.doc_id
        WHERE g.doc_id % 2 = 0""",
    "predicted": """
        SELECT g.challenge_id, m.method_id, 'run:' || m.method_id AS run_id, g.doc_id, g.toxic,
               g.n_chars,
               CASE WHEN (g.doc_id + m.shift) % 11 = 0 THEN 'failed' ELSE 'completed' END
                   AS status,
               CASE WHEN (g.doc_id + m.shift) % 11 = 0 THEN 'UNRESOLVED'
                    WHEN (g.doc_id + m.shift) % 5 = 0 THEN 'SURVIVED'
                    ELSE g.expected_decision END AS predicted_decision,
               CASE WHEN (g.doc_id + m.shift) % 11 = 0 THEN 5e-1
                    ELSE ((g.n_chars + m.shift * 17) % 101) / 1e2 END
                   AS counterevidence_probability,
               (g.doc_id + m.shift) % 30 AS calls, (g.n_chars * (1 + m.shift)) % 40000 AS tokens,
               m.shift
        FROM gold g CROSS JOIN (SELECT 'alpha' AS method_id, 0 AS shift
                                UNION ALL SELECT 'beta', 1 UNION ALL SELECT 'gamma', 3) m""",
    "predicted_evidence": """
        SELECT p.challenge_id, p.method_id, p.run_id,
               'doi:10.1/' || p.doc_id || CASE WHEN p.doc_id % 13 = 0 THEN ' ' ELSE '' END
                   AS doc_id,
               CASE WHEN p.toxic = 1 THEN 'CONTRADICTS' ELSE 'SUPPORTS' END AS relation,
               CAST(0 AS BIGINT) AS locator_offset, CAST(NULL AS BIGINT) AS page_no,
               s.content_sha256
        FROM predicted p JOIN snapshots s ON s.snapshot_id = 'd' || p.doc_id
        WHERE p.status = 'completed' AND (p.doc_id + p.shift) % 3 <> 0
        UNION ALL
        SELECT p.challenge_id, p.method_id, p.run_id, 'doi:10.2/' || p.doc_id AS doc_id,
               'BOUNDS' AS relation, CAST(NULL AS BIGINT) AS locator_offset,
               p.doc_id % 9 AS page_no, s.content_sha256
        FROM predicted p JOIN snapshots s ON s.snapshot_id = 'd' || p.doc_id
        WHERE p.status = 'completed' AND (p.doc_id + p.shift) % 4 < 2""",
    # Event logs.
    "raw_events": """
        SELECT 't' || (user_id % 4) AS tenant_id, 'u' || user_id AS job_id,
               'e' || event_id AS event_id,
               strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS occurred_at,
               'session' AS aggregate_type, 'a' || (event_id % 2) AS aggregate_id,
               event_type, CASE WHEN event_id % 5 = 0 THEN replace(props, '}', ',"x":1.0}')
                   ELSE props END AS payload,
               event_type || ':' || props AS idempotency_key, event_id AS n
        FROM events""",
    "claim_log": """
        SELECT 'chat' AS tenant_id, 'j' || conv_id AS job_id, turn + 1 AS sequence,
               'm' || conv_id || '-' || turn AS event_id,
               CASE WHEN turn % 5 = 0 AND turn > 0 THEN 'claim.transitioned'
                    WHEN turn % 5 = 0 THEN 'claim.proposed' WHEN turn % 5 = 1 THEN 'query.executed'
                    WHEN turn % 5 = 2 THEN 'passage.observed'
                    WHEN turn % 5 = 3 THEN 'evidence.linked' ELSE 'claim.transitioned' END
                   AS event_type,
               CASE WHEN turn = 0 THEN
                        '{"claim_id":"c' || conv_id || '","text":"' || sha256(text)
                        || '","scope":"' || role || '"}'
                    WHEN turn % 5 = 1 THEN
                        '{"query_id":"q' || turn || '","claim_id":"c'
                        || (conv_id + CASE WHEN conv_id % 17 = 0 THEN 1 ELSE 0 END)
                        || '","text":"x","intent":"'
                        || CASE WHEN conv_id % 2 = 0 THEN 'counterevidence' ELSE 'support' END
                        || '","n_hits":' || (length(text) % 7) || '}'
                    WHEN turn % 5 = 2 THEN
                        '{"passage_id":"p' || turn || '","doc_id":"d' || conv_id
                        || '","query_id":"q' || (turn - 1) || '","offset":'
                        || (length(text) - CASE WHEN conv_id % 19 = 3 THEN 9999 ELSE 0 END)
                        || ',"content_sha256":"' || sha256(text) || '"}'
                    WHEN turn % 5 = 3 THEN
                        '{"claim_id":"c' || conv_id || '","passage_id":"p' || (turn - 1)
                        || '","relation":"'
                        || CASE WHEN conv_id % 2 = 1 THEN 'SUPPORTS'
                                WHEN conv_id % 4 = 0 THEN 'BOUNDS' ELSE 'CONTRADICTS' END || '"}'
                    ELSE '{"claim_id":"c' || conv_id || '","to_state":"'
                        || CASE WHEN turn = 4 AND conv_id % 2 = 1 THEN 'SUPPORTED'
                                WHEN turn = 4 THEN 'CHALLENGED'
                                WHEN conv_id % 2 = 1 THEN 'UNRESOLVED'
                                WHEN conv_id % 4 = 0 THEN 'NARROWED' ELSE 'REFUTED' END
                        || '","reason":"r","boundary":"'
                        || CASE WHEN conv_id % 8 = 0 THEN '' ELSE role END || '"}' END AS payload
        FROM conversations""",
    # Job control.
    "jobs": """
        SELECT 'j' || o_orderkey AS job_id, 't' || (o_custkey % 8) AS tenant_id,
               o_orderpriority || '-' || o_orderkey AS idempotency_key, o_orderpriority AS task,
               CASE WHEN o_orderstatus = 'F' THEN 'SUCCEEDED' WHEN o_orderstatus = 'O'
                    THEN 'QUEUED' ELSE 'RUNNING' END AS status,
               CASE WHEN o_orderstatus = 'F' THEN 'VALIDATE' WHEN o_orderkey % 3 = 0 THEN 'READ'
                    ELSE 'PLAN' END AS stage,
               CAST(1 AS BIGINT) AS version,
               CASE WHEN o_orderstatus = 'P' THEN 'w' || (o_custkey % 5) ELSE NULL END
                   AS lease_owner,
               CASE WHEN o_orderstatus = 'P' THEN epoch_us(o_orderdate) / 1e6 + 86400e0
                    ELSE NULL END AS lease_expires_at,
               CAST(1 AS BIGINT) AS attempts, CAST(100 AS BIGINT) AS max_calls,
               CAST(6000 AS BIGINT) AS max_tokens,
               CAST(round(o_totalprice * 50) AS BIGINT) AS max_cost_microunits,
               o_custkey % 50 AS used_calls, o_custkey AS used_tokens,
               CAST(round(o_totalprice) AS BIGINT) AS used_cost_microunits,
               CAST(NULL AS STRING) AS last_error_code,
               epoch_us(o_orderdate) / 1e6 AS created_at,
               epoch_us(o_orderdate) / 1e6 + (o_orderkey % 1000) AS updated_at
        FROM orders""",
    "charges": """
        SELECT 'j' || l_orderkey AS job_id, CAST(l_linenumber AS STRING) AS charge_key,
               's' || l_suppkey AS provider, CAST(l_quantity AS BIGINT) AS calls,
               l_partkey AS tokens, CAST(round(l_extendedprice * 100) AS BIGINT)
                   AS cost_microunits,
               epoch_us(l_shipdate) / 1e6 AS created_at
        FROM lineitem""",
    "checkpoints": """
        SELECT 'j' || l_orderkey AS job_id,
               CASE WHEN l_linenumber = 1 THEN 'PLAN' WHEN l_linenumber = 2 THEN 'RETRIEVE'
                    WHEN l_linenumber = 3 THEN 'READ' WHEN l_linenumber = 4 THEN 'PROPOSE'
                    WHEN l_linenumber = 5 THEN 'CHALLENGE' WHEN l_linenumber = 6 THEN 'DECIDE'
                    ELSE 'SYNTHESIZE' END AS stage,
               'stage:' || CASE WHEN l_linenumber = 1 THEN 'PLAN' WHEN l_linenumber = 2
                    THEN 'RETRIEVE' WHEN l_linenumber = 3 THEN 'READ' WHEN l_linenumber = 4
                    THEN 'PROPOSE' WHEN l_linenumber = 5 THEN 'CHALLENGE' WHEN l_linenumber = 6
                    THEN 'DECIDE' ELSE 'SYNTHESIZE' END || ':v1' AS checkpoint_key,
               CASE WHEN l_suppkey % 17 = 0 THEN '{"api_key":"x"}'
                    WHEN l_suppkey % 23 = 0 THEN '[1]'
                    ELSE '{"flag":"' || l_returnflag || '","n":' || l_linenumber || '}' END
                   AS payload,
               epoch_us(l_shipdate) / 1e6 AS created_at
        FROM lineitem""",
    "job_log": """
        SELECT 'c' || o_custkey AS job_id,
               CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
                   AS BIGINT) AS version,
               CASE WHEN o_orderkey % 7 = 0 THEN 'RETRY_WAIT' WHEN o_orderstatus = 'F'
                    THEN 'SUCCEEDED' WHEN o_orderstatus = 'O' THEN 'QUEUED' ELSE 'RUNNING' END
                   AS status,
               CASE WHEN o_orderkey % 8 = 0 THEN 'PLAN' WHEN o_orderkey % 8 = 1 THEN 'RETRIEVE'
                    WHEN o_orderkey % 8 = 2 THEN 'READ' WHEN o_orderkey % 8 = 3 THEN 'PROPOSE'
                    WHEN o_orderkey % 8 = 4 THEN 'CHALLENGE' WHEN o_orderkey % 8 = 5
                    THEN 'DECIDE' WHEN o_orderkey % 8 = 6 THEN 'SYNTHESIZE' ELSE 'VALIDATE' END
                   AS stage,
               CASE WHEN o_orderkey % 13 = 0 THEN CAST(0 AS BIGINT) ELSE NULL END
                   AS expected_version
        FROM orders""",
    "artifacts": """
        SELECT source AS tenant_id, 'j' || (doc_id % 50) AS job_id,
               'doc-' || (doc_id - doc_id % 2) AS logical_key,
               sha256(text) AS content_sha256, CAST(octet_length(encode(text)) AS BIGINT)
                   AS size_bytes,
               CASE WHEN doc_id % 30 = 0 THEN 'application/json' ELSE 'text/plain' END
                   AS media_type,
               doc_id / 1e0 AS created_at
        FROM documents""",
    "tenant_jobs": """
        SELECT DISTINCT source AS tenant_id, 'j' || (doc_id % 50) AS job_id,
               CASE WHEN doc_id % 50 < 20 THEN 'SUCCEEDED' WHEN doc_id % 50 < 25 THEN 'FAILED'
                    ELSE 'RUNNING' END AS status, (doc_id % 50) * 1e0 AS updated_at
        FROM documents""",
    "doc_receipts": """
        SELECT DISTINCT source AS tenant_id, 'j' || (doc_id % 50) AS job_id,
               doc_id % 50 <> 7 AS ok, CAST(doc_id % 50 AS BIGINT) AS event_count,
               sha256('j' || (doc_id % 50)) AS head_hash
        FROM documents WHERE doc_id % 50 <> 9""",
    # Strategy memory.
    "strategies": """
        SELECT 'p' || p_partkey AS strategy_id, 't' || (p_partkey % 4) AS tenant_id,
               sha256(p_name || p_partkey) AS strategy_key,
               CASE WHEN p_size % 4 = 0 THEN 'counter_query_template' WHEN p_size % 4 = 1
                    THEN 'boundary_probe' WHEN p_size % 4 = 2 THEN 'precedent_probe'
                    ELSE 'other_kind' END AS kind,
               p_name || '  ' || upper(p_type) AS pattern, 'j' || p_size AS source_job_id,
               p_brand AS source_task_family,
               CASE WHEN p_partkey % 50 = 0 THEN 'RETIRED' WHEN p_partkey % 3 = 0 THEN 'ACTIVE'
                    ELSE 'CANDIDATE' END AS status,
               (p_partkey % 977) * 1e0 AS created_at, (p_partkey % 977) * 1e0 AS updated_at
        FROM part""",
    "applications": """
        SELECT 'a' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey
                   AS application_id,
               'p' || (l_partkey + CASE WHEN l_orderkey % 101 = 0 THEN 1000000000 ELSE 0 END)
                   AS strategy_id,
               't' || (l_partkey % 4) AS tenant_id, 'j' || l_orderkey AS target_job_id,
               'Brand#' || (l_suppkey % 25 + 1) AS target_task_family,
               sha256('q' || l_orderkey) AS rendered_query_sha256,
               'k' || l_orderkey || '-' || l_linenumber AS idempotency_key,
               epoch_us(l_shipdate) / 1e6 AS created_at
        FROM lineitem""",
    "outcomes": """
        SELECT 'a' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey
                   AS application_id,
               CASE WHEN l_orderkey % 89 = 0 THEN 'self_rating' ELSE 'known_answer' END
                   AS evaluator_kind,
               l_returnflag = 'N' AS success, l_returnflag = 'R' AS false_gap_avoided,
               l_discount AS valid_finding_delta, CAST(l_quantity AS BIGINT) AS calls,
               l_suppkey AS tokens,
               CASE WHEN l_orderkey % 97 = 0 THEN ' ' ELSE 'ref-' || l_orderkey END
                   AS evidence_ref,
               epoch_us(l_shipdate) / 1e6 AS recorded_at
        FROM lineitem WHERE l_linestatus = 'F'""",
    "families": """
        SELECT DISTINCT 't' || (s_suppkey % 4) AS tenant_id,
               'Brand#' || (s_nationkey + 1) AS target_task_family
        FROM supplier""",
    "steps": """
        SELECT 't' || (s_suppkey % 4) AS tenant_id, 'run' || (s_suppkey % 3) AS run_id,
               'cedg' AS method_id, s_suppkey AS sequence_index, 'ch' || s_suppkey
                   AS challenge_id,
               'Brand#' || (s_nationkey + 1) AS target_task_family,
               CASE WHEN s_suppkey % 5 = 0 THEN 'uncredited_replay' WHEN s_suppkey % 11 = 0
                    THEN 'none' ELSE 'delayed_external_credit' END AS memory_mode,
               sha256('order') AS order_sha256
        FROM supplier""",
    "interventions": """
        SELECT 't' || (o_custkey % 4) AS tenant_id, 'run' || (o_custkey % 7) AS run_id,
               o_orderpriority AS method_id, o_orderkey AS sequence_index,
               'ch' || o_orderkey AS challenge_id,
               CASE WHEN o_orderkey % 10 = 0 THEN 'short' ELSE sha256('order') END
                   AS order_sha256,
               'delayed_external_credit' AS memory_mode,
               '["p' || (o_custkey % 1500) || '","p' || ((o_custkey + o_orderkey % 5) % 1500)
                   || '"]' AS strategy_ids,
               epoch_us(o_orderdate) / 1e6 AS created_at
        FROM orders""",
    "outbox": """
        SELECT 'o' || event_id AS event_id, 't' || (user_id % 4) AS tenant_id,
               'policy.' || event_type AS event_type, 'strategy' AS aggregate_type,
               's' || (event_id % 10) AS aggregate_id, props AS payload,
               'x' || event_id AS idempotency_key, epoch_us(ts) / 1e6 AS created_at,
               CASE WHEN event_id % 3 = 0 THEN epoch_us(ts) / 1e6 ELSE NULL END
                   AS dispatched_at
        FROM events""",
    # Ranking.
    "results": """
        SELECT 'h' || l_partkey AS hypothesis_id,
               l_orderkey * 100000 + l_linenumber * 10000 + l_suppkey AS iteration,
               round(l_quantity / 5e1, 6) AS o1, round(l_discount * 1e1, 6) AS o2,
               round(1e0 - l_tax * 1e1, 6) AS o3,
               round((l_orderkey % 1000) / 1e3, 6) AS o4,
               round((l_suppkey % 100) / 1e2, 6) AS o5,
               round((CAST(floor(l_extendedprice) AS BIGINT) % 997) / 997e0, 6) AS o6,
               round(l_linenumber / 7e0, 6) AS o7,
               l_orderkey AS orderkey, l_suppkey AS suppkey
        FROM lineitem""",
    # Service logs.
    "requests": """
        SELECT event_id, ts, 't' || (user_id % 4) AS tenant_id, 'u' || user_id AS principal_id,
               CASE WHEN event_id % 3 = 0 THEN 'POST' WHEN event_id % 101 = 1 THEN 'PUT'
                    ELSE 'GET' END AS method,
               CASE WHEN event_type = 'signup' THEN 'jobs_collection' WHEN event_type = 'purchase'
                    THEN 'job_item' WHEN event_type = 'error' THEN 'not_found'
                    WHEN event_type = 'view' THEN 'healthz' ELSE 'metrics' END AS route,
               CASE WHEN event_type = 'error' THEN 404 WHEN event_id % 97 = 0 THEN 700
                    ELSE 200 END AS status,
               value / 1e2 AS duration_seconds,
               epoch_us(ts) / 1e6 AS moment, 'r' || event_id AS request_id,
               CASE WHEN event_id % 4 = 0 THEN '00-' || md5('t' || event_id) || '-'
                        || substr(md5('s' || event_id), 1, 16) || '-01'
                    WHEN event_id % 4 = 1 THEN '00-00000000000000000000000000000000-'
                        || substr(md5('s' || event_id), 1, 16) || '-01'
                    WHEN event_id % 4 = 2 THEN upper('00-' || md5('t' || event_id) || '-'
                        || substr(md5('s' || event_id), 1, 16) || '-00')
                    ELSE '' END AS traceparent
        FROM events""",
    "calls": """
        SELECT 'svc' || user_id AS circuit_id, event_id, 'op' || event_id AS operation_id,
               CASE WHEN event_type = 'error' OR event_type = 'click' THEN 'failure'
                    WHEN event_type = 'view' OR event_type = 'signup' THEN 'before'
                    ELSE 'success' END AS kind,
               event_type AS reason_code, epoch_us(ts) / 1e6 / 1e4 AS moment
        FROM events""",
    "leases": """
        SELECT 'j' || user_id AS job_id, event_id,
               CASE WHEN event_type = 'error' THEN 'status' WHEN event_type = 'view'
                    THEN 'heartbeat' ELSE 'acquire' END AS kind,
               'w' || (event_id % 2) AS worker_id, epoch_us(ts) / 1e6 / 1e4 AS moment,
               6e0 AS lease_seconds,
               CASE WHEN event_id % 5 = 0 THEN 'RETRY_WAIT' ELSE 'RUNNING' END AS status
        FROM events""",
    # Search audit.
    "search_audit": """
        SELECT conv_id * 100 + turn AS ts, 'r' || conv_id || '-' || turn AS request_id,
               CASE WHEN role = 'user' THEN 'agentic-search' WHEN role = 'system'
                    THEN 'meta-search' ELSE 'content' END AS tool,
               text AS query, 'd' || (conv_id % 40) AS doc_id
        FROM conversations""",
    "declared": """
        SELECT 'f' || (conv_id % 7) || '.jsonl' AS file, 'id' || conv_id AS id,
               CASE WHEN turn % 3 = 0 THEN '  ' || text WHEN turn % 3 = 1
                    THEN text || ' never searched' ELSE ' ' END AS query, turn
        FROM conversations""",
    "operations": """
        SELECT 'op' || event_id AS operation_id, sha256('req' || event_id) AS request_sha256,
               CASE WHEN event_type = 'error' THEN 'ABANDONED' WHEN event_type = 'view'
                    THEN 'RETRY_AUTHORIZED' WHEN event_type = 'click' THEN 'COMPLETED'
                    ELSE 'PENDING' END AS status,
               props AS response_json, epoch_us(ts) / 1e6 AS created_at,
               CASE WHEN event_type = 'click' THEN epoch_us(ts) / 1e6 ELSE NULL END
                   AS completed_at
        FROM events""",
}
DEPENDS = {
    "gold_evidence": ("gold", "snapshots"), "predicted": ("gold",),
    "predicted_evidence": ("predicted", "snapshots"),
}


def _call(sql: str, name: str, rewrite) -> str:
    """Replace calls ``name(args)`` with ``rewrite(args)``, respecting nested parentheses."""
    out, at = [], 0
    while (found := sql.find(name + "(", at)) >= 0:
        depth, end = 0, found + len(name)
        while True:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
            if depth == 0:
                break
        inner = sql[found + len(name) + 1:end - 1]
        out += [sql[at:found], rewrite(inner)]
        at = end
    return "".join([*out, sql[at:]])


def spark_sql(name: str) -> str:
    sql = SQL[name]
    for _ in range(3):  # calls nest at most this deep
        sql = _call(sql, "sha256", lambda a: f"sha2({a}, 256)")
    sql = _call(sql, "epoch_us", lambda a: (
        f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {a})"))
    sql = sql.replace("octet_length(encode(text))", "octet_length(text)")
    return sql.replace("strftime(ts, '%Y-%m-%dT%H:%M:%S')",
                       "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\")")


def _needed(names, seen=None) -> list[str]:
    seen = [] if seen is None else seen
    for name in names:
        _needed(DEPENDS.get(name, ()), seen)
        if name not in seen:
            seen.append(name)
    return seen


def with_tables(*names: str, sql: str, recursive: bool = False) -> str:
    """An oracle query over logical tables as one self-contained text."""
    parts = [f"{n} AS ({SQL[n].strip()})" for n in _needed(names)]
    head = "WITH RECURSIVE " if recursive else "WITH "
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return head + ",\n".join(parts + [body[5:]])
    return (head + ",\n".join(parts) + "\n" + body) if parts else body


class Tables:
    """Base and logical tables of one data folder as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name not in SQL:
            raise AttributeError(name)
        sources = {n: getattr(self, n) for n in (*BASE, *DEPENDS.get(name, ()))
                   if f" {n} " in SQL[name].replace("\n", " ") + " "}
        text = spark_sql(name).replace("{", "{{").replace("}", "}}")
        for source in sources:
            for word in ("FROM", "JOIN"):
                text = text.replace(f"{word} {source}", f"{word} {{{source}}}")
        return self.spark.sql(text, **sources)

    def challenges(self) -> DataFrame:
        """Nested challenge rows built from gold and its evidence."""
        item = F.struct(
            "evidence_id", "doc_id", "relation",
            F.struct(F.col("locator_offset").alias("offset"), "page_no").alias("locator"),
            "content_sha256", "publication_date", "oracle_scope", "snapshot_id", "source_url",
            "doi", "license_spdx", "source_locator")
        packed = self.gold_evidence.groupBy("challenge_id").agg(
            F.array_sort(F.collect_list(item)).alias("accepted_evidence"))
        status = F.when(F.col("doc_id") % 3 == 0, "draft").otherwise("frozen")
        return self.gold.join(packed, "challenge_id", "left").withColumn(
            "construction_provenance", F.struct(
                F.col("source").alias("source"), F.lit("curator").alias("curator"),
                status.alias("status"))).select(*S.CHALLENGE.fieldNames())

    def predictions(self) -> DataFrame:
        """Nested prediction rows of three methods."""
        item = F.struct(
            "doc_id", "relation",
            F.struct(F.col("locator_offset").alias("offset"), "page_no").alias("locator"),
            "content_sha256")
        packed = self.predicted_evidence.groupBy("challenge_id", "method_id").agg(
            F.array_sort(F.collect_list(item)).alias("evidence"))
        joined = self.predicted.join(packed, ["challenge_id", "method_id"], "left")
        empty = F.array().cast(S.PREDICTION["evidence"].dataType)
        return joined.select(
            F.lit(1).alias("schema_version"), "challenge_id", "run_id", "method_id", "status",
            "predicted_decision", "counterevidence_probability",
            F.coalesce(F.col("evidence").cast(S.PREDICTION["evidence"].dataType), empty)
            .alias("evidence"), F.col("calls").cast("bigint").alias("calls"),
            F.col("tokens").cast("bigint").alias("tokens"))

    def observed(self) -> DataFrame:
        return self.observations.select(
            *[c for c in S.OBSERVATION.fieldNames() if c != "retrieval"],
            F.struct("method", "actor", "independently_verified", "receipt_sha256")
            .alias("retrieval"))

    def methods(self) -> DataFrame:
        """Two treatments, keyed by suppliers' nation parity of the data folder."""
        return self.supplier.groupBy((F.col("s_nationkey") % 2).alias("k")).agg(
            F.count(F.lit(1)).alias("n")).select(
            F.concat(F.lit("method"), F.col("k").cast("string")).alias("method_id"),
            F.lit(True).alias("support_retrieval"),
            (F.col("k") == 1).alias("external_counter_retrieval"),
            (F.col("k") == 1).alias("cedg"), F.lit("none").alias("memory"),
            F.when(F.col("k") == 1, "verifier").otherwise("direct").alias("decision_mode"))

    def hypotheses(self) -> DataFrame:
        names = [f"o{i}" for i in range(1, 8)]
        return self.results.select("hypothesis_id", "iteration",
                                   F.array(*names).alias("objectives"), "orderkey", "suppkey")

    def scratch(self) -> str:
        """A new folder below the shared checkpoint folder, for sinks that are read back."""
        return f"{checkpoint_dir(self.spark)}/tables-{uuid.uuid4().hex}"
