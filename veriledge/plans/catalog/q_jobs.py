"""Job control, retention and service logs."""
from __future__ import annotations

from pyspark.sql import functions as F

from veriledge import schemas as S
from veriledge.functions import scalars as fn
from veriledge.functions.contracts import violation_codes
from veriledge.operators import jobs, rows, service
from veriledge.plans.catalog.registry import query
from veriledge.sources import artifacts as store
from veriledge.sources import registry as catalogue

NOW = 946_684_800.0  # 2000-01-01, inside the order dates


SNAPSHOT_SQL = f"""
    WITH r AS (SELECT *, status IN ('QUEUED', 'RETRY_WAIT') OR (status = 'RUNNING' AND
        lease_expires_at <= {NOW}) AS runnable FROM jobs)
    SELECT 'jobs_by_status' AS field, s AS key, CAST((SELECT count(*) FROM jobs WHERE status = s)
        AS DOUBLE) AS value FROM (SELECT unnest({list(S.JOB_STATUSES)}) AS s)
    UNION ALL SELECT 'jobs_by_stage', s, CAST((SELECT count(*) FROM jobs WHERE stage = s)
        AS DOUBLE) FROM (SELECT unnest({list(S.STAGES)}) AS s)
    UNION ALL SELECT 'jobs_total', '', count(*) FROM jobs
    UNION ALL SELECT 'active_leases', '', count(*) FROM jobs WHERE status = 'RUNNING'
        AND lease_expires_at > {NOW}
    UNION ALL SELECT 'expired_leases', '', count(*) FROM jobs WHERE status = 'RUNNING'
        AND lease_expires_at <= {NOW}
    UNION ALL SELECT 'oldest_runnable_age_seconds', '', greatest(0, {NOW} - min(created_at))
        FROM r WHERE runnable
    UNION ALL SELECT 'used_calls', '', sum(used_calls) FROM jobs
    UNION ALL SELECT 'used_tokens', '', sum(used_tokens) FROM jobs
    UNION ALL SELECT 'used_cost_microunits', '', sum(used_cost_microunits) FROM jobs
    UNION ALL SELECT 'checkpoint_records', '', count(*) FROM checkpoints
    UNION ALL SELECT 'usage_records', '', count(*) FROM charges"""


@query("A05_operational_snapshot", "jobs", "charges", "checkpoints", sql=SNAPSHOT_SQL)
def snapshot(t):
    return jobs.operational_snapshot(t.jobs, t.checkpoints, t.charges, NOW)


@query("A24_usage_totals", "charges", sql="""
    SELECT job_id, provider, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(tokens) AS BIGINT)
        AS tokens, CAST(sum(cost_microunits) AS BIGINT) AS cost_microunits
    FROM charges GROUP BY 1, 2""")
def _(t):
    return jobs.usage_totals(t.charges)


@query("A25_usage_reconciliation", sql="""
    WITH h AS (SELECT 'o' || l_orderkey AS operation_id, count(*) AS r FROM lineitem
        WHERE l_orderkey % 5 <> 0 GROUP BY 1),
    d AS (SELECT 'o' || o_orderkey AS operation_id, o_custkey % 9 AS c, o_custkey AS tok
        FROM orders WHERE o_orderkey % 7 <> 0)
    SELECT COALESCE(h.operation_id, d.operation_id) AS operation_id, COALESCE(r, 0)
        AS reserved_calls, c AS reported_calls,
        CASE WHEN c >= COALESCE(r, 0) THEN c - COALESCE(r, 0) END AS charge_calls,
        CASE WHEN c >= COALESCE(r, 0) THEN tok END AS charge_tokens,
        CASE WHEN c IS NULL THEN 'unreported_reservation' WHEN c < COALESCE(r, 0)
            THEN 'fewer_calls_than_reserved' ELSE '' END AS codes
    FROM h FULL OUTER JOIN d ON d.operation_id = h.operation_id""")
def _(t):
    held = t.lineitem.where("l_orderkey % 5 <> 0").select(
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("operation_id"),
        F.lit(1).cast("bigint").alias("calls"))
    told = t.orders.where("o_orderkey % 7 <> 0").select(
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("operation_id"),
        (F.col("o_custkey") % 9).alias("calls"), F.col("o_custkey").alias("tokens"))
    return jobs.usage_reconciliation(held, told).select(
        "operation_id", "reserved_calls", "reported_calls", "charge_calls", "charge_tokens",
        violation_codes().alias("codes"))


@query("K07_runnable_jobs", "jobs", sql=f"""
    SELECT job_id, created_at FROM jobs WHERE status IN ('QUEUED', 'RETRY_WAIT')
        OR (status = 'RUNNING' AND lease_expires_at <= {NOW})
    ORDER BY created_at, job_id LIMIT 100""")
def _(t):
    return jobs.runnable_jobs(t.jobs, NOW, 100)


@query("W15_checkpoint_progress", "jobs", "checkpoints", sql=f"""
    SELECT j.job_id, s.stage, j.job_id || ':' || s.stage || ':v1' AS operation_id
    FROM jobs j CROSS JOIN (SELECT unnest({list(S.EXECUTION_STAGES)}) AS stage) s
    WHERE NOT EXISTS (SELECT 1 FROM checkpoints c WHERE c.job_id = j.job_id
        AND c.checkpoint_key = 'stage:' || s.stage || ':v1')""")
def _(t):
    return jobs.checkpoint_progress(t.jobs, t.checkpoints).select("job_id", "stage",
                                                                  "operation_id")


@query("W04_job_status_legality", "job_log", sql="""
    WITH p AS (SELECT *, lag(status) OVER (PARTITION BY job_id ORDER BY version) AS prior
        FROM job_log)
    SELECT job_id, version, concat_ws(',',
        CASE WHEN version = 1 AND status <> 'QUEUED' THEN 'initial_status' END,
        CASE WHEN expected_version <> version - 1 THEN 'version_mismatch' END,
        CASE WHEN version > 1 AND NOT (prior = 'QUEUED' AND status = 'RUNNING'
            OR prior = 'RUNNING' AND status = 'RETRY_WAIT'
            OR prior = 'RETRY_WAIT' AND status = 'RUNNING') THEN 'illegal_transition' END,
        CASE WHEN status = 'SUCCEEDED' AND stage <> 'VALIDATE'
            THEN 'succeeded_before_validate' END) AS codes FROM p""")
def _(t):
    return jobs.job_status_legality(t.job_log).select("job_id", "version",
                                                      violation_codes().alias("codes"))


@query("W05_stage_monotonic", "job_log", sql=f"""
    WITH p AS (SELECT *, list_position({list(S.STAGES)}, stage) AS s FROM job_log)
    SELECT job_id, version, COALESCE(s < max(s) OVER (PARTITION BY job_id ORDER BY version
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS backwards FROM p""")
def _(t):
    return jobs.stage_monotonic(t.job_log).select(
        "job_id", "version", (F.size("violations") > 0).alias("backwards"))


_ORDER = ["created_at", "tokens", "provider"]


BUDGET = """
    WITH c AS (SELECT c.*, row_number() OVER (PARTITION BY c.job_id ORDER BY c.created_at, c.tokens,
            c.provider) AS rn FROM (SELECT DISTINCT * FROM charges) c
        JOIN (SELECT job_id, charge_key, created_at, tokens, provider FROM (SELECT *,
            row_number() OVER (PARTITION BY job_id, charge_key ORDER BY created_at, tokens,
            provider) AS k FROM charges) WHERE k = 1) o
        ON o.job_id = c.job_id AND o.charge_key = c.charge_key AND o.created_at = c.created_at
        AND o.tokens = c.tokens AND o.provider = c.provider),
    b AS (SELECT c.*, j.max_calls, j.max_tokens, j.max_cost_microunits FROM c
        JOIN jobs j ON j.job_id = c.job_id),
    walk AS (SELECT job_id, charge_key, rn, calls <= max_calls AND tokens <= max_tokens AND
            cost_microunits <= max_cost_microunits AS ok,
            CASE WHEN calls <= max_calls AND tokens <= max_tokens AND cost_microunits <=
                max_cost_microunits THEN [calls, tokens, cost_microunits] ELSE [0, 0, 0] END AS u
        FROM b WHERE rn = 1
        UNION ALL SELECT b.job_id, b.charge_key, b.rn, w.u[1] + calls <= max_calls AND w.u[2]
            + tokens <= max_tokens AND w.u[3] + cost_microunits <= max_cost_microunits,
            CASE WHEN w.u[1] + calls <= max_calls AND w.u[2] + tokens <= max_tokens AND w.u[3]
                + cost_microunits <= max_cost_microunits THEN [w.u[1] + calls, w.u[2] + tokens,
                w.u[3] + cost_microunits] ELSE w.u END
        FROM walk w JOIN b ON b.job_id = w.job_id AND b.rn = w.rn + 1)
    SELECT job_id, charge_key, ok AS admitted FROM walk"""


@query("W06_budget_admission", "jobs", "charges", recursive=True, sql=BUDGET)
def _(t):
    return jobs.budget_admission(t.charges, t.jobs, _ORDER).select("job_id", "charge_key",
                                                                   "admitted")


@query("W07_lease_audit", "leases", recursive=True, sql="""
    WITH b AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY moment, event_id) AS rn
        FROM leases),
    walk AS (
        SELECT job_id, event_id, rn,
            CASE WHEN kind = 'heartbeat' THEN 'heartbeat_rejected' ELSE '' END AS problem,
            CASE WHEN kind = 'status' THEN status WHEN kind = 'acquire' THEN 'RUNNING'
                ELSE 'QUEUED' END AS st,
            CASE WHEN kind = 'acquire' THEN worker_id END AS owner,
            CASE WHEN kind = 'acquire' THEN moment + lease_seconds END AS expiry,
            CASE WHEN kind = 'acquire' THEN 1 ELSE 0 END AS attempts
        FROM b WHERE rn = 1
        UNION ALL
        SELECT b.job_id, b.event_id, b.rn,
            CASE WHEN kind = 'acquire' AND owner <> worker_id AND expiry > moment
                THEN 'leased_elsewhere' WHEN kind = 'heartbeat' AND NOT COALESCE(owner = worker_id
                AND st = 'RUNNING' AND expiry >= moment, FALSE) THEN 'heartbeat_rejected' ELSE '' END,
            CASE WHEN kind = 'status' THEN b.status WHEN kind = 'acquire' AND NOT COALESCE(owner
                <> worker_id AND expiry > moment, FALSE) AND st IN ('QUEUED', 'RETRY_WAIT')
                THEN 'RUNNING' ELSE st END,
            CASE WHEN kind = 'status' THEN NULL WHEN kind = 'acquire' AND NOT COALESCE(owner <>
                worker_id AND expiry > moment, FALSE) THEN worker_id ELSE owner END,
            CASE WHEN kind = 'status' THEN NULL WHEN kind = 'acquire' AND NOT COALESCE(owner <>
                worker_id AND expiry > moment, FALSE) THEN moment + lease_seconds
                WHEN kind = 'heartbeat' AND COALESCE(owner = worker_id AND st = 'RUNNING'
                AND expiry >= moment, FALSE) THEN moment + lease_seconds ELSE expiry END,
            attempts + CASE WHEN kind = 'acquire' AND NOT COALESCE(owner <> worker_id AND
                expiry > moment, FALSE) THEN 1 ELSE 0 END
        FROM walk w JOIN b ON b.job_id = w.job_id AND b.rn = w.rn + 1)
    SELECT event_id, problem, st AS job_status, owner AS lease_owner, CAST(attempts AS BIGINT)
        AS attempts FROM walk""")
def _(t):
    return jobs.lease_audit(t.leases.withColumnRenamed("moment", "at"), ["at", "event_id"]).select(
        "event_id", "problem", "job_status", "lease_owner", "attempts")


CIRCUIT = """
    WITH b AS (SELECT *, row_number() OVER (PARTITION BY circuit_id ORDER BY moment, event_id) AS rn
        FROM calls),
    walk AS (
        SELECT circuit_id, event_id, rn, moment, CASE WHEN kind = 'failure' THEN 'call_failed' END
            AS ev, 'CLOSED' AS st, CASE WHEN kind = 'failure' THEN 1 ELSE 0 END AS fails,
            CAST(NULL AS DOUBLE) AS opened, CAST(NULL AS VARCHAR) AS probe,
            CAST(NULL AS DOUBLE) AS began
        FROM b WHERE rn = 1
        UNION ALL
        SELECT b.circuit_id, b.event_id, b.rn, b.moment,
            CASE WHEN kind = 'before' AND st = 'HALF_OPEN' AND b.moment - began >= 20
                    THEN 'probe_expired'
                WHEN kind = 'before' AND st = 'OPEN' AND b.moment - opened >= 5
                    THEN 'probe_admitted'
                WHEN kind = 'success' AND st = 'CLOSED' AND fails > 0 THEN 'call_succeeded'
                WHEN kind = 'success' AND st = 'HALF_OPEN' AND probe = operation_id
                    THEN 'call_succeeded'
                WHEN kind = 'failure' AND st = 'CLOSED' THEN 'call_failed'
                WHEN kind = 'failure' AND st = 'HALF_OPEN' AND probe = operation_id
                    THEN 'call_failed' END,
            CASE WHEN kind = 'before' AND st = 'HALF_OPEN' AND b.moment - began >= 20 THEN 'OPEN'
                WHEN kind = 'before' AND st = 'OPEN' AND b.moment - opened >= 5 THEN 'HALF_OPEN'
                WHEN kind = 'success' AND st = 'HALF_OPEN' AND probe = operation_id THEN 'CLOSED'
                WHEN kind = 'failure' AND st = 'CLOSED' AND fails + 1 >= 2 THEN 'OPEN'
                WHEN kind = 'failure' AND st = 'HALF_OPEN' AND probe = operation_id THEN 'OPEN'
                ELSE st END,
            CASE WHEN kind = 'success' AND (st = 'CLOSED' OR st = 'HALF_OPEN' AND probe =
                    operation_id) THEN 0
                WHEN kind = 'failure' AND (st = 'CLOSED' OR st = 'HALF_OPEN' AND probe =
                    operation_id) THEN fails + 1 ELSE fails END,
            CASE WHEN kind = 'before' AND st = 'HALF_OPEN' AND b.moment - began >= 20 THEN b.moment
                WHEN kind = 'success' AND (st = 'CLOSED' OR st = 'HALF_OPEN' AND probe =
                    operation_id) THEN NULL
                WHEN kind = 'failure' AND st = 'CLOSED' THEN CASE WHEN fails + 1 >= 2 THEN b.moment
                    END
                WHEN kind = 'failure' AND st = 'HALF_OPEN' AND probe = operation_id THEN b.moment
                ELSE opened END,
            CASE WHEN kind = 'before' AND st = 'HALF_OPEN' AND b.moment - began >= 20 THEN NULL
                WHEN kind = 'before' AND st = 'OPEN' AND b.moment - opened >= 5 THEN operation_id
                WHEN kind <> 'before' AND (st = 'CLOSED' OR st = 'HALF_OPEN' AND probe =
                    operation_id) THEN NULL ELSE probe END,
            CASE WHEN kind = 'before' AND st = 'HALF_OPEN' AND b.moment - began >= 20 THEN NULL
                WHEN kind = 'before' AND st = 'OPEN' AND b.moment - opened >= 5 THEN b.moment
                WHEN kind <> 'before' AND (st = 'CLOSED' OR st = 'HALF_OPEN' AND probe =
                    operation_id) THEN NULL ELSE began END
        FROM walk w JOIN b ON b.circuit_id = w.circuit_id AND b.rn = w.rn + 1)"""


def calls(t):
    return t.calls.withColumnRenamed("moment", "at")


def replayed(t):
    return service.circuit_states(calls(t), ["at", "event_id"], threshold=2, cooldown=5.0,
                                  probe_timeout=20.0)


@query("W08_circuit_states", "calls", recursive=True, sql=CIRCUIT + """
    SELECT event_id, ev AS event_type, st AS next_state, CAST(fails AS BIGINT) AS failures
    FROM walk""")
def _(t):
    return replayed(t).select("event_id", "event_type", "next_state", "failures")


@query("A26_circuit_snapshot", "calls", recursive=True, sql=CIRCUIT + """
    SELECT circuit_id, max_by(st, rn) AS state, CAST(max_by(fails, rn) AS BIGINT)
        AS consecutive_failures, count(ev) AS events FROM walk GROUP BY 1""")
def _(t):
    return service.circuit_snapshot(replayed(t), ["at", "event_id"]).select(
        "circuit_id", "state", "consecutive_failures", "events")


BUCKET = """
    WITH b AS (SELECT *, moment / 1e4 AS t, row_number() OVER (PARTITION BY tenant_id, principal_id
        ORDER BY moment, event_id) AS rn FROM requests),
    walk AS (
        SELECT tenant_id, principal_id, event_id, rn, t, TRUE AS ok, 0 AS retry, 1e0 AS left_
        FROM b WHERE rn = 1
        UNION ALL
        SELECT b.tenant_id, b.principal_id, b.event_id, b.rn, b.t,
            least(2e0, left_ + greatest(0e0, b.t - w.t) * (2e0 / 60e0)) >= 1,
            CASE WHEN least(2e0, left_ + greatest(0e0, b.t - w.t) * (2e0 / 60e0)) >= 1 THEN 0
                ELSE greatest(1, CAST(ceil((1e0 - least(2e0, left_ + greatest(0e0, b.t - w.t)
                * (2e0 / 60e0))) / (2e0 / 60e0)) AS INTEGER)) END,
            least(2e0, left_ + greatest(0e0, b.t - w.t) * (2e0 / 60e0)) - CASE WHEN least(2e0,
                left_ + greatest(0e0, b.t - w.t) * (2e0 / 60e0)) >= 1 THEN 1 ELSE 0 END
        FROM walk w JOIN b ON b.tenant_id = w.tenant_id AND b.principal_id = w.principal_id
            AND b.rn = w.rn + 1)"""


@query("W11_token_bucket", "requests", recursive=True, sql=BUCKET + """
    SELECT event_id, ok AS allowed, CAST(retry AS BIGINT) AS retry_after FROM walk""")
def _(t):
    log = t.requests.withColumn("at", F.col("moment") / 1e4)
    return service.token_bucket(log, ["at", "event_id"], 2, 2).select(
        "event_id", "allowed", "retry_after")


@query("W13_operation_reconciliation", "operations", sql="""
    WITH q AS (SELECT event_id AS rid, 'op' || (event_id - event_id % 2) AS operation_id,
        sha256('req' || (event_id - event_id % 2 + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END))
            AS sha, CASE event_id % 3 WHEN 0 THEN 'complete' WHEN 1 THEN 'authorize_retry'
            ELSE 'abandon' END AS action, event_id % 14 = 0 AS no_actor FROM events),
    c AS (SELECT q.*, o.status, concat_ws(',', CASE WHEN no_actor THEN 'actor' END,
        CASE WHEN o.operation_id IS NULL THEN 'unknown_operation' END,
        CASE WHEN o.request_sha256 <> q.sha THEN 'digest_mismatch' END,
        CASE WHEN o.status <> 'PENDING' THEN 'not_pending' END) AS codes
        FROM q LEFT JOIN operations o ON o.operation_id = q.operation_id),
    w AS (SELECT operation_id, min(rid) AS win FROM c WHERE codes = '' GROUP BY 1)
    SELECT rid AS reconciliation_id, CASE WHEN codes <> '' OR rid > win THEN NULL
        WHEN action = 'complete' THEN 'COMPLETED' WHEN action = 'abandon' THEN 'ABANDONED'
        ELSE 'RETRY_AUTHORIZED' END AS next_status,
        CASE WHEN codes = '' AND rid > win THEN 'already_resolved' ELSE codes END AS codes
    FROM c LEFT JOIN w ON w.operation_id = c.operation_id""")
def _(t):
    i = F.col("event_id")
    base = i - i % 2
    kind = F.when(i % 3 == 0, "complete").when(i % 3 == 1, "authorize_retry").otherwise(
        "abandon")
    asks = t.events.select(
        i.alias("reconciliation_id"),
        F.concat(F.lit("op"), base.cast("string")).alias("operation_id"),
        fn.sha256(F.concat(F.lit("req"), (base + F.when(i % 10 == 0, 1).otherwise(0))
                           .cast("string"))).alias("request_sha256"), kind.alias("action"),
        F.when(i % 14 == 0, " ").otherwise("ops").alias("actor"), F.lit("why").alias("reason"),
        fn.sha256(F.lit("x")).alias("evidence_receipt_sha256"),
        (kind == "complete").alias("has_response"))
    return jobs.operation_reconciliation(asks, t.operations).select(
        "reconciliation_id", "next_status", violation_codes().alias("codes"))


HISTOGRAM_SQL = f"""
    SELECT 'bucket' AS series, method, route, le, CAST(count(*) FILTER (WHERE duration_seconds
        <= CAST(le AS DOUBLE)) AS DOUBLE) AS value FROM requests CROSS JOIN (SELECT unnest(
        {[repr(e) for e in S.LATENCY_BUCKETS]}) AS le) GROUP BY 1, 2, 3, 4
    UNION ALL SELECT 'bucket', method, route, '+Inf', CAST(count(*) AS DOUBLE) FROM requests
    GROUP BY 2, 3
    UNION ALL SELECT 'count', method, route, '', CAST(count(*) AS DOUBLE) FROM requests
    GROUP BY 2, 3
    UNION ALL SELECT 'sum', method, route, '', round(sum(CAST(duration_seconds AS DOUBLE)), 4)
    FROM requests GROUP BY 2, 3"""


@query("A06_latency_histogram", "requests", sql=HISTOGRAM_SQL)
def _(t):
    return service.latency_histogram(t.requests).withColumn("value", F.round("value", 4))


_USERS = """u AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type <> 'error')
        AS ok, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) * 4 AS p99,
        count(*) FILTER (WHERE event_type = 'signup') AS failed FROM events GROUP BY 1)"""


@query("A12_slo_alerts", sql=f"""WITH {_USERS},
    a AS (SELECT user_id, user_id % 10 = 0 AS bad,
        CASE WHEN ok / n < 0.999 THEN 1 ELSE 0 END + CASE WHEN p95 >= 300 THEN 1 ELSE 0 END
        + CASE WHEN user_id % 4 = 0 THEN failed > 0 ELSE FALSE END::INT
        + CASE WHEN user_id % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0
        END AS crit,
        CASE WHEN p99 >= 1000 THEN 1 ELSE 0 END + CASE WHEN user_id % 7 = 0 THEN 1 ELSE 0 END
        + CASE WHEN user_id % 6 = 0 THEN 1 ELSE 0 END AS warn FROM u)
    SELECT 'u' || user_id AS scope, CASE WHEN bad THEN 'INVALID' WHEN crit > 0 THEN 'FAIL'
        WHEN warn > 0 THEN 'WARN' ELSE 'PASS' END AS status,
        CASE WHEN bad THEN 0 ELSE crit END AS critical, CASE WHEN bad THEN 0 ELSE warn END
        AS warning FROM a""")
def _(t):
    u = F.col("user_id")
    base = t.events.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(F.col("event_type") != "error").alias("successes"),
        F.percentile("value", F.lit(0.95)).alias("p95"),
        (F.percentile("value", F.lit(0.99)) * 4).alias("p99"),
        F.count_if(F.col("event_type") == "signup").alias("signups"))
    observed = base.select(
        F.concat(F.lit("u"), u.cast("string")).alias("scope"), "requests", "successes",
        (F.col("successes") / F.col("requests")
         + F.when(u % 10 == 0, 0.01).otherwise(0.0)).alias("success_rate"),
        "p95", "p99", F.col("requests").alias("scenarios"),
        (F.col("requests") - F.when(u % 4 == 0, F.col("signups")).otherwise(0)).alias("passed"),
        F.when(u % 4 == 0, F.col("signups")).otherwise(0).alias("failed"),
        F.when(u % 7 == 0, "2024-01-01T00:00:00Z").otherwise("2024-02-01T00:00:00Z")
        .alias("backup_created_at"), (u % 5 != 0).alias("backup_verified"),
        F.lit(True).alias("restore_verified"),
        F.lit(True).alias("source_restore_snapshot_equal"),
        F.lit(1706745600.0).alias("now_epoch"), F.lit(0).alias("expired_leases"),
        F.when(u % 3 == 0, 301.0).otherwise(0.0).alias("oldest_runnable_age_seconds"),
        F.lit(0).alias("circuits_open"),
        F.when(u % 6 == 0, 1).otherwise(0).alias("circuits_half_open"))
    return service.slo_status(service.slo_alerts(observed))


@query("P27_fixed_vocabulary", "requests", sql="""
    SELECT event_id, concat_ws(',', CASE WHEN method = 'PUT' THEN 'method' END,
        CASE WHEN status = 700 THEN 'status' END) AS codes FROM requests""")
def _(t):
    return rows.fixed_vocabulary(t.requests, "duration_seconds", with_ids=False).select(
        "event_id", violation_codes().alias("codes"))


@query("P22_validate_submission", sql="""
    SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderkey % 11 = 0 THEN 'not_object' END,
        CASE WHEN o_orderkey % 11 > 0 AND o_orderkey % 7 = 0 THEN 'unknown_fields' END,
        CASE WHEN o_orderkey % 11 > 0 AND o_orderkey % 5 = 0 THEN 'task' END,
        CASE WHEN o_orderkey % 11 > 0 AND o_custkey > 1000 THEN 'max_calls' END,
        CASE WHEN o_orderkey % 11 > 0 AND o_orderkey % 3 = 0 THEN 'max_tokens' END) AS codes
    FROM orders""")
def _(t):
    i = F.col("o_orderkey")
    body = F.when(i % 11 == 0, F.lit("[]")).otherwise(F.concat(
        F.lit('{"idempotency_key":"k'), i.cast("string"), F.lit('","task":"'),
        F.when(i % 5 == 0, " ").otherwise(F.col("o_orderpriority")), F.lit('","max_calls":'),
        (F.col("o_custkey") * 10).cast("string"), F.lit(',"max_tokens":'),
        F.when(i % 3 == 0, "true").otherwise("5"), F.lit(',"max_cost_microunits":0'),
        F.when(i % 7 == 0, ',"extra":1').otherwise(""), F.lit("}")))
    return rows.validate_submission(t.orders.select("o_orderkey", body.alias("body"))).select(
        "o_orderkey", violation_codes().alias("codes"))


@query("P23_tenant_scope", "jobs", sql="""
    SELECT job_id, status FROM jobs WHERE tenant_id = 't3'""")
def _(t):
    return rows.tenant_scope(t.jobs, "t3").select("job_id", "status")


@query("P25_validate_checkpoints", "checkpoints", sql="""
    WITH k AS (SELECT job_id, checkpoint_key, count(DISTINCT stage || replace(payload, ': ', ':'))
        AS n FROM checkpoints GROUP BY 1, 2)
    SELECT c.job_id, c.checkpoint_key, c.created_at, concat_ws(',', CASE WHEN payload = '[1]'
        THEN 'payload_not_object' END, CASE WHEN payload LIKE '%api_key%' THEN
        'payload_sensitive' END, CASE WHEN n > 1 THEN 'key_conflict' END) AS codes
    FROM checkpoints c JOIN k ON k.job_id = c.job_id AND k.checkpoint_key = c.checkpoint_key""")
def _(t):
    return rows.validate_checkpoints(t.checkpoints).select(
        "job_id", "checkpoint_key", "created_at", violation_codes().alias("codes"))


@query("P28_provenance_manifest", sql="""
    SELECT n_regionkey, count(*) AS runs, bool_and(n_nationkey % 3 <> 0 AND n_nationkey % 5 <> 0)
        AS publication_ready FROM nation JOIN customer ON c_nationkey = n_nationkey
    GROUP BY n_regionkey""")
def _(t):
    i = F.col("n_nationkey")
    runs = t.customer.join(t.nation, F.col("c_nationkey") == i).select(
        "n_regionkey", F.when(i % 5 == 0, " ").otherwise(F.col("n_name")).alias("route_id"),
        F.lit("alias").alias("request_alias"), F.lit("b").alias("operator_declared_backend"),
        F.lit("snap").alias("index_snapshot_id"), (i % 3 != 0).alias("index_snapshot_attested"))
    return rows.publication_ready(rows.provenance_manifest(runs), ["n_regionkey"])


# --- retention -------------------------------------------------------------------------------

TENANT, CUTOFF = "src4", 18.0
_TARGETS = f"""tg AS (SELECT * FROM tenant_jobs WHERE tenant_id = '{TENANT}'
        AND updated_at <= {CUTOFF} AND status IN ('SUCCEEDED', 'FAILED'))"""
_BLOBS = """bl AS (SELECT a.tenant_id, a.content_sha256, max(size_bytes) AS size_bytes
        FROM artifacts a LEFT JOIN tg ON tg.tenant_id = a.tenant_id AND tg.job_id = a.job_id
        GROUP BY 1, 2 HAVING bool_and(tg.job_id IS NOT NULL))"""


def _plan(t):
    return jobs.retention_plan(t.tenant_jobs, t.artifacts, t.doc_receipts, TENANT, CUTOFF)


@query("J12_exclusive_blobs", "tenant_jobs", "artifacts", sql=f"""WITH {_TARGETS}, {_BLOBS}
    SELECT * FROM bl""")
def _(t):
    targets = jobs.retention_targets(t.tenant_jobs, TENANT, CUTOFF)
    return jobs.exclusive_blobs(targets, t.artifacts)


@query("C06_retention_plan", "tenant_jobs", "artifacts", "doc_receipts", sql=f"""
    WITH {_TARGETS} SELECT tg.job_id, tg.status, tg.updated_at,
        (SELECT count(*) FROM artifacts a WHERE a.tenant_id = tg.tenant_id
            AND a.job_id = tg.job_id) AS bindings,
        COALESCE(r.event_count, 0) AS event_count, COALESCE(r.head_hash, '') AS head_hash,
        CASE WHEN r.job_id IS NULL THEN 'ledger_missing' WHEN NOT r.ok THEN 'ledger_invalid'
            ELSE '' END AS codes
    FROM tg LEFT JOIN doc_receipts r ON r.tenant_id = tg.tenant_id AND r.job_id = tg.job_id""")
def _(t):
    return _plan(t).select("job_id", "status", "updated_at", "bindings", "event_count",
                           "head_hash", violation_codes().alias("codes"))


@query("J14_stale_plan", "tenant_jobs", "artifacts", "doc_receipts", sql=f"""
    WITH {_TARGETS}, {_BLOBS}
    SELECT 'job' AS kind, job_id AS id, concat_ws(',',
        CASE WHEN CAST(substr(job_id, 2) AS INT) % 4 = 0 THEN 'job_changed' END,
        CASE WHEN CAST(substr(job_id, 2) AS INT) % 14 = 0 THEN 'changed_bindings' END,
        CASE WHEN CAST(substr(job_id, 2) AS INT) % 14 = 0 THEN 'changed_bindings_sha256' END)
        AS codes
    FROM tg WHERE CAST(substr(job_id, 2) AS INT) % 4 = 0
        OR CAST(substr(job_id, 2) AS INT) % 14 = 0
    UNION ALL SELECT DISTINCT 'blob', b.content_sha256, 'blob_referenced' FROM bl b
    JOIN artifacts a ON a.tenant_id = b.tenant_id AND a.content_sha256 = b.content_sha256
    WHERE b.tenant_id = '{TENANT}' AND CAST(substr(a.job_id, 2) AS INT) % 4 = 0""")
def _(t):
    """Jobs that changed, jobs with new bindings, and planned blobs that a new job refers to."""
    n = F.expr("cast(substr(job_id, 2) as int)")
    later = t.tenant_jobs.withColumn("status", F.when(n % 4 == 0, "RUNNING").otherwise(
        F.col("status")))
    new_keys = t.artifacts.where(n % 14 == 0).withColumn(
        "logical_key", F.concat("logical_key", F.lit("-new")))
    new_job = t.artifacts.where(n % 4 == 0).withColumn("job_id", F.lit("later"))
    plan = _plan(t)
    blobs = jobs.exclusive_blobs(plan.select("tenant_id", "job_id"), t.artifacts)
    return jobs.stale_plan(plan, blobs, later, t.artifacts.unionByName(new_keys).unionByName(new_job),
                           t.doc_receipts, TENANT, CUTOFF)


@query("C07_apply_retention", "tenant_jobs", "artifacts", sql=f"""
    WITH {_TARGETS}, {_BLOBS}
    SELECT 'RETENTION_COMPLETED' AS event_type, sha256('{TENANT}') AS tenant_sha256,
        (SELECT count(*) FROM tg) AS deleted_jobs,
        (SELECT count(*) FROM artifacts a JOIN tg ON tg.tenant_id = a.tenant_id AND tg.job_id =
            a.job_id) AS deleted_artifact_bindings,
        (SELECT count(*) FROM bl) AS deleted_exclusive_blobs,
        (SELECT count(*) FROM tenant_jobs) - (SELECT count(*) FROM tg) AS surviving_jobs""")
def _(t):
    from veriledge.session import materialise

    plan = materialise(_plan(t))
    blobs = jobs.exclusive_blobs(plan.select("tenant_id", "job_id"), t.artifacts)
    digest = jobs.plan_digest(plan, blobs).first()["plan_sha256"]
    out = jobs.apply_retention(plan, blobs, t.tenant_jobs, t.artifacts, t.doc_receipts, TENANT,
                               CUTOFF, digest)
    left = out["jobs"].agg(F.count(F.lit(1)).alias("surviving_jobs"))
    return out["receipt"].crossJoin(left).select(  # one row each
        "event_type", "tenant_sha256", "deleted_jobs", "deleted_artifact_bindings",
        "deleted_exclusive_blobs", "surviving_jobs")


@query("J15_manifest_verify", "artifacts", sql="""
    WITH f AS (SELECT doc_id, sha256(text) AS sha FROM documents)
    SELECT 'blobs/' || doc_id AS path, concat_ws(',', CASE WHEN doc_id % 13 = 0 THEN
        'missing_file' END, CASE WHEN doc_id % 13 <> 0 AND doc_id % 7 = 0 THEN
        'unmanifested_file' END, CASE WHEN doc_id % 13 <> 0 AND doc_id % 7 <> 0 AND doc_id % 5 = 0
        THEN 'sha256' END) AS codes FROM f WHERE NOT (doc_id % 13 = 0 AND doc_id % 7 = 0)""")
def _(t):
    i = F.col("doc_id")
    facts = t.documents.select(
        "doc_id", F.concat(F.lit("blobs/"), i.cast("string")).alias("path"),
        F.octet_length("text").cast("bigint").alias("size_bytes"),
        fn.sha256("text").alias("sha256"))
    manifest = facts.where(i % 7 != 0).select(
        "path", F.lit("artifact_blob").alias("kind"), "size_bytes",
        F.when(i % 5 == 0, "0").otherwise(F.col("sha256")).alias("sha256"))
    files = facts.where(i % 13 != 0).drop("doc_id")
    return jobs.manifest_verify(manifest, files).select("path",
                                                        violation_codes().alias("codes"))


# --- artifacts and tables --------------------------------------------------------------------

def _incoming(t):
    return t.documents.select(
        F.col("source").alias("tenant_id"),
        F.concat(F.lit("j"), (F.col("doc_id") % 50).cast("string")).alias("job_id"),
        F.concat(F.lit("doc-"), (F.col("doc_id") % 10).cast("string")).alias("logical_key"),
        F.col("text").cast("binary").alias("content"), F.lit("text/plain").alias("media_type"),
        F.col("doc_id").cast("double").alias("created_at"))


@query("S12_artifact_put", sql="""
    SELECT source AS tenant_id, 'j' || (doc_id % 50) AS job_id, 'doc-' || (doc_id % 10)
        AS logical_key, arg_min(sha256(text), doc_id) AS content_sha256,
        CASE WHEN count(DISTINCT text) > 1 THEN 'logical_key_conflict' ELSE '' END AS codes
    FROM documents GROUP BY 1, 2, 3""")
def _(t):
    return store.artifact_put(_incoming(t)).select(
        "tenant_id", "job_id", "logical_key", "content_sha256",
        violation_codes().alias("codes"))


@query("S13_artifact_verify", "artifacts", sql="""
    WITH a AS (SELECT source AS tenant_id, doc_id, sha256(text) AS sha, doc_id % 30 = 0 AS js
        FROM documents),
    b AS (SELECT tenant_id, sha, bool_or(doc_id % 6 = 0) AS torn, bool_and(doc_id % 11 = 0)
        AS gone FROM a GROUP BY 1, 2)
    SELECT a.doc_id, CASE WHEN gone THEN 'blob_missing' ELSE concat_ws(',', CASE WHEN torn
        THEN 'blob_size,blob_digest' END, CASE WHEN js THEN 'json_root' END) END AS codes
    FROM a JOIN b ON b.tenant_id = a.tenant_id AND b.sha = a.sha""")
def _(t):
    index = t.artifacts.withColumn("doc_id", F.col("created_at").cast("bigint")).withColumn(
        "violations", F.array().cast("array<string>"))
    d = t.documents.groupBy(F.col("source").alias("tenant_id"), fn.sha256("text")
                            .alias("blob_name")).agg(
        F.first("text").alias("text"), F.bool_or(F.col("doc_id") % 6 == 0).alias("torn"),
        F.bool_and(F.col("doc_id") % 11 == 0).alias("gone")).where("NOT gone")
    blobs = d.select("tenant_id", "blob_name", F.when(F.col("torn"), F.concat(
        "text", F.lit("!"))).otherwise(F.col("text")).cast("binary").alias("content"))
    return store.artifact_verify(index, blobs).select("doc_id",
                                                      violation_codes().alias("codes"))


@query("S19_runtime_tables", "jobs", "charges", sql="""
    SELECT 'usage_ledger' AS "table", 'unique:job_id,charge_key' AS rule, job_id || '|' ||
        charge_key AS key, count(*) AS rows FROM charges GROUP BY job_id, charge_key
        HAVING count(*) > 1
    UNION ALL SELECT 'usage_ledger', 'reference:jobs', job_id, count(*) FROM charges
        WHERE job_id NOT IN (SELECT job_id FROM jobs WHERE CAST(substr(job_id, 2) AS BIGINT) % 9
            <> 0) GROUP BY job_id""")
def _(t):
    known = t.jobs.where("cast(substr(job_id, 2) as bigint) % 9 <> 0")
    return catalogue.table_violations("usage_ledger", {"usage_ledger": t.charges,
                                                       "jobs": known})
