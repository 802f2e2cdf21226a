"""Ledgers and claim graphs."""
from __future__ import annotations

from pyspark.sql import functions as F

from veriledge.functions import hooks
from veriledge.functions import scalars as fn
from veriledge.functions.contracts import violation_codes
from veriledge.operators import graph, ledger, rows
from veriledge.plans import composites
from veriledge.plans.catalog.registry import query
from veriledge.session import materialise

# First event per (ledger, key); keys with another meaning; then the chain, hash by hash.
_FIRST = """
    marked AS (SELECT *, aggregate_type || aggregate_id || event_type || payload AS fp
        FROM raw_events),
    first AS (SELECT tenant_id, job_id, idempotency_key, min(n) AS n, min(fp) <> max(fp) AS conflict,
        count(*) AS occurrences FROM marked GROUP BY 1, 2, 3),
    kept AS (SELECT m.*, row_number() OVER (PARTITION BY m.tenant_id, m.job_id ORDER BY m.n) AS seq
        FROM marked m JOIN first f ON f.tenant_id = m.tenant_id AND f.job_id = m.job_id
        AND f.n = m.n WHERE NOT f.conflict)"""
_HASH = """sha256('{"aggregate_id":"' || k.aggregate_id || '","aggregate_type":"'
    || k.aggregate_type || '","event_id":"' || k.event_id || '","event_type":"' || k.event_type
    || '","idempotency_key":' || CAST(to_json(k.idempotency_key) AS VARCHAR) || ',"job_id":"'
    || k.job_id || '","occurred_at":"' || k.occurred_at || '","payload":'
    || replace(k.payload, ': ', ':') || ',"previous_hash":"' || @PREV
    || '","schema_version":1,"sequence":' || k.seq || ',"tenant_id":"' || k.tenant_id || '"}')"""
_CHAIN = f"""{_FIRST},
    chain AS (SELECT k.*, '' AS previous_hash, {_HASH.replace("@PREV", "''")} AS event_hash
        FROM kept k WHERE seq = 1
        UNION ALL SELECT k.*, c.event_hash, {_HASH.replace('@PREV', 'c.event_hash')}
        FROM chain c JOIN kept k ON k.tenant_id = c.tenant_id AND k.job_id = c.job_id
            AND k.seq = c.seq + 1)"""


def built(t):
    return ledger.build_ledger(t.raw_events, ["n"])


def chained(t):
    return built(t).where(F.size("violations") == 0).drop("violations")


def tampered(t):
    """A ledger log with changed payloads, dropped events and repeated ids."""
    n = F.expr("cast(substr(event_id, 2) as bigint)")
    return chained(t).where(n % 211 != 0).withColumn("payload", F.when(
        n % 307 == 0, F.lit('{"k":-1}')).otherwise(F.col("payload")))


_TAMPER = f"""{_CHAIN},
    live AS (SELECT *, lag(event_hash) OVER w AS lag_hash, lag(seq) OVER w AS lag_seq
        FROM chain WHERE n % 211 <> 0
        WINDOW w AS (PARTITION BY tenant_id, job_id ORDER BY seq)),
    bad AS (SELECT *, concat_ws(',',
        CASE WHEN n % 307 = 0 THEN 'event_hash_mismatch' END,
        CASE WHEN seq > 1 AND lag_seq IS DISTINCT FROM seq - 1 THEN 'sequence_gap' END,
        CASE WHEN seq > 1 AND lag_seq IS DISTINCT FROM seq - 1 THEN 'previous_hash' END) AS codes
        FROM live)"""


@query("S09_build_ledger", "raw_events", recursive=True, sql=f"""WITH {_CHAIN}
    SELECT tenant_id, job_id, event_id, seq AS sequence, previous_hash, event_hash FROM chain
    UNION ALL SELECT m.tenant_id, m.job_id, m.event_id, NULL, NULL, NULL FROM marked m
    JOIN first f ON f.tenant_id = m.tenant_id AND f.job_id = m.job_id AND f.n = m.n
    WHERE f.conflict""")
def _(t):
    return built(t).select("tenant_id", "job_id", "event_id", "sequence", "previous_hash",
                           "event_hash")


@query("S09_append_to_ledger", "raw_events", recursive=True, sql=f"""WITH {_CHAIN},
    heads AS (SELECT tenant_id, job_id, count(*) AS n_held, max_by(event_hash, seq) AS head
        FROM chain GROUP BY 1, 2),
    sent AS (SELECT c.tenant_id, c.job_id, c.event_id, c.n, c.seq, h.n_held,
        CAST(substr(c.job_id, 2) AS BIGINT) % 4 = 0 AS broken,
        CASE WHEN c.seq % 3 = 0 THEN 'new' WHEN c.seq % 3 = 1 THEN 'replay' ELSE 'conflict' END AS kind
        FROM chain c JOIN heads h ON h.tenant_id = c.tenant_id AND h.job_id = c.job_id)
    SELECT tenant_id, job_id, CASE kind WHEN 'new' THEN 'n' ELSE 'c' END || event_id AS event_id,
        concat_ws(',', CASE WHEN kind = 'conflict' THEN 'idempotency_conflict' END,
            CASE WHEN broken THEN 'ledger_invalid' END) AS codes,
        CASE WHEN kind = 'new' AND NOT broken THEN n_held + count(*) FILTER (WHERE kind = 'new')
            OVER (PARTITION BY tenant_id, job_id ORDER BY n) END AS sequence
    FROM sent WHERE kind <> 'replay'""")
def _(t):
    """A batch of replays, conflicts and new events for held ledgers, a quarter of them broken."""
    held = materialise(chained(t))
    kind = F.col("sequence") % 3
    broken = F.expr("cast(substr(job_id, 2) as bigint) % 4 = 0")
    receipts = ledger.verify_chain(held.withColumn("event_hash", F.when(
        broken, F.lit("0" * 64)).otherwise(F.col("event_hash"))))
    batch = held.withColumn("n", F.expr("cast(substr(event_id, 2) as bigint)")).withColumns({
        "event_id": F.when(kind == 1, F.col("event_id")).otherwise(
            F.concat(F.when(kind == 0, "n").otherwise("c"), "event_id")),
        "idempotency_key": F.when(kind == 0, F.concat(F.lit("new:"), "idempotency_key"))
        .otherwise(F.col("idempotency_key")),
        "aggregate_id": F.when(kind == 2, F.lit("other")).otherwise(F.col("aggregate_id"))})
    batch = batch.drop("sequence", "previous_hash", "event_hash", "schema_version")
    return ledger.build_ledger(batch, ["n"], receipts, held=held).select(
        "tenant_id", "job_id", "event_id", violation_codes().alias("codes"), "sequence")


@query("W01_verify_chain", "raw_events", recursive=True, sql=f"""WITH {_TAMPER}
    SELECT tenant_id, job_id, bool_and(codes = '') AS ok,
        CASE WHEN bool_and(codes = '') THEN count(*) ELSE 0 END AS event_count,
        CASE WHEN bool_and(codes = '') THEN max_by(event_hash, seq) ELSE '' END AS head_hash,
        COALESCE('sequence ' || min(CASE WHEN codes <> '' THEN seq END) || ': '
            || min_by(codes, seq) FILTER (WHERE codes <> ''), '') AS error
    FROM bad GROUP BY 1, 2""")
def _(t):
    return ledger.verify_chain(tampered(t))


@query("P06_validate_event", "raw_events", recursive=True, sql=f"""WITH {_CHAIN}
    SELECT event_id, concat_ws(',', CASE WHEN n % 10 = 0 THEN 'empty_aggregate_id' END,
        CASE WHEN n % 7 = 0 THEN 'occurred_at_zone' END,
        CASE WHEN n % 5 = 0 THEN 'payload_sensitive' END,
        CASE WHEN n % 3 = 0 THEN 'event_hash_shape' END,
        CASE WHEN n % 3 <> 0 AND (n % 10 = 0 OR n % 7 = 0 OR n % 5 = 0)
            THEN 'event_hash_mismatch' END) AS codes FROM chain""")
def _(t):
    n = F.expr("cast(substr(event_id, 2) as bigint)")
    e = chained(t)
    e = e.withColumn("aggregate_id", F.when(n % 10 == 0, " ").otherwise(F.col("aggregate_id"))) \
        .withColumn("occurred_at", F.when(n % 7 == 0, F.lit("2024-01-01T00:00:00"))
                    .otherwise(F.col("occurred_at"))) \
        .withColumn("payload", F.when(n % 5 == 0, F.lit('{"a":[{"api_key":1}]}'))
                    .otherwise(F.col("payload"))) \
        .withColumn("event_hash", F.when(n % 3 == 0, F.upper("event_hash"))
                    .otherwise(F.col("event_hash")))
    return rows.validate_events(e).select("event_id", violation_codes().alias("codes"))


@query("P03_sensitive_paths", sql="""
    SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'payload.a[1].api_key,payload.PASSWORD'
        WHEN event_id % 4 = 1 THEN 'payload.user_token' ELSE '' END AS paths FROM events""")
def _(t):
    i, k = F.col("event_id"), F.get_json_object("props", "$.k")
    text = (F.when(i % 4 == 0, F.concat(F.lit('{"a":[0,{"api_key":'), k,
                                        F.lit('}],"PASSWORD":"x"}')))
            .when(i % 4 == 1, F.concat(F.lit('{"user_token":'), k, F.lit("}")))
            .when(i % 4 == 2, F.concat(F.lit('{"tokens":'), k, F.lit(',"s":"password"}')))
            .otherwise(F.col("props")))
    return t.events.select("event_id", F.array_join(rows.sensitive_paths(text), ",")
                           .alias("paths"))


@query("W09_idempotent_dedup", "raw_events", sql=f"""WITH {_FIRST}
    SELECT tenant_id, job_id, idempotency_key, 'e' || n AS event_id, occurrences,
        conflict FROM first""")
def _(t):
    fp = F.concat("aggregate_type", "aggregate_id", "event_type", "payload")
    return ledger.idempotent_dedup(
        t.raw_events, ["tenant_id", "job_id", "idempotency_key"], ["n"], fp).select(
        "tenant_id", "job_id", "idempotency_key", "event_id", "occurrences", "conflict")


_PENDING = """pend AS (SELECT *, row_number() OVER (PARTITION BY tenant_id
        ORDER BY created_at, event_id) AS seq FROM outbox WHERE dispatched_at IS NULL
        AND NOT EXISTS (SELECT 1 FROM events e WHERE 'x' || e.event_id = idempotency_key
            AND e.event_id % 7 = 0))"""


@query("W14_outbox_flush", "outbox", sql=f"""WITH {_PENDING}
    SELECT tenant_id, 'policy-memory' AS job_id, event_id, seq AS sequence FROM pend""")
def _(t):
    held = t.events.where("event_id % 7 = 0").select(
        F.concat(F.lit("t"), (F.col("user_id") % 4).cast("string")).alias("tenant_id"),
        F.concat(F.lit("x"), F.col("event_id").cast("string")).alias("idempotency_key"))
    return ledger.flush_outbox(t.outbox, held, "policy-memory").select(
        "tenant_id", "job_id", "event_id", "sequence")


def _committed(t):
    """Commitment events of predictions, in one ledger per (method, parity)."""
    p = t.predictions().withColumn("sha", fn.prediction_commitment())
    i = F.expr("cast(substr(challenge_id, 2) as bigint)")
    payload = F.to_json(F.to_variant_object(F.struct(
        "challenge_id", "run_id", "method_id",
        F.when(i % 12 == 0, F.lit("0" * 64)).otherwise(F.col("sha"))
        .alias("prediction_commitment_sha256"))))
    job = F.concat("method_id", F.lit("-"), (i % 2).cast("string"))
    events = p.select(
        F.lit("bench").alias("tenant_id"), job.alias("job_id"),
        F.concat_ws("/", "method_id", "challenge_id").alias("event_id"),
        F.lit("2024-01-01T00:00:00+00:00").alias("occurred_at"),
        F.lit("benchmark_prediction").alias("aggregate_type"),
        F.col("challenge_id").alias("aggregate_id"),
        F.lit("benchmark.prediction_committed").alias("event_type"), payload.alias("payload"),
        F.concat_ws(":", "run_id", "challenge_id").alias("idempotency_key"), i.alias("n"))
    log = materialise(ledger.build_ledger(events, ["n"]).drop("violations"))
    log = log.withColumn("payload", F.when(
        (F.col("job_id") == "gamma-1") & (F.col("sequence") == 1), F.lit("{}"))
        .otherwise(F.col("payload")))
    return p.withColumn("tenant_id", F.lit("bench")).withColumn("job_id", job), log


@query("J06_prediction_ledger_binding", "predicted", sql="""
    SELECT challenge_id, method_id, concat_ws(',',
        CASE WHEN method_id = 'gamma' AND doc_id % 2 = 1 THEN 'ledger_invalid' END,
        CASE WHEN NOT (method_id = 'gamma' AND doc_id % 2 = 1) AND doc_id % 9 = 0
            THEN 'receipt_mismatch' END,
        CASE WHEN doc_id % 12 = 0 OR method_id = 'gamma' AND doc_id = (SELECT min(doc_id) FROM
            predicted WHERE doc_id % 2 = 1) THEN 'commitment_event' END) AS codes FROM predicted""")
def _(t):
    p, log = _committed(t)
    receipts = ledger.verify_chain(log)
    i = F.expr("cast(substr(challenge_id, 2) as bigint)")
    named = p.join(receipts.select("tenant_id", "job_id", "event_count", "head_hash"),
                   ["tenant_id", "job_id"]).select(
        *p.columns, F.col("sha").alias("prediction_commitment_sha256"),
        F.when(i % 9 == 0, F.lit("f" * 64)).otherwise(F.col("head_hash")).alias("ledger_head"),
        F.col("event_count").alias("ledger_event_count")).drop("sha")
    return ledger.prediction_ledger_binding(named, receipts, log).select(
        "challenge_id", "method_id", violation_codes().alias("codes"))


@query("J20_policy_audit_links", sql="""
    SELECT 'j' || conv_id AS job_id, count(*) FILTER (WHERE turn % 3 = 1) AS links,
        concat_ws(',', CASE WHEN count(*) FILTER (WHERE turn % 3 = 1) > 1 THEN 'multiple_links' END,
        CASE WHEN count(*) FILTER (WHERE turn % 3 = 1) > 0 AND conv_id % 5 = 0
            THEN 'unknown_policy_head' END,
        CASE WHEN count(*) FILTER (WHERE turn % 3 = 1) > 0 AND conv_id % 5 = 1
            THEN 'policy_ledger_invalid' END,
        CASE WHEN count(*) FILTER (WHERE turn % 3 = 1) > 0 AND conv_id % 5 > 0 AND conv_id % 7 = 0
            THEN 'policy_count' END,
        CASE WHEN conv_id % 11 = 0 THEN 'task_ledger_invalid' END) AS codes
    FROM conversations GROUP BY conv_id""")
def _(t):
    c = F.col("conv_id")
    events = t.conversations.select(
        F.lit("t").alias("tenant_id"), F.concat(F.lit("j"), c.cast("string")).alias("job_id"),
        F.when(F.col("turn") % 3 == 1, "policy.audit_linked").otherwise("other")
        .alias("event_type"),
        F.concat(F.lit('{"policy_ledger_head":"h'), (c % 5).cast("string"),
                 F.lit('","policy_ledger_events":'),
                 F.when(c % 7 == 0, "9").otherwise("4"), F.lit(',"newly_dispatched":1}'))
        .alias("payload"), "conv_id")
    receipts = events.select("tenant_id", "job_id", "conv_id").distinct().select(
        "tenant_id", "job_id", (c % 11 != 0).alias("ok"))
    policy = t.conversations.select((c % 5).alias("k")).distinct().where("k <> 0").select(
        F.lit("t").alias("tenant_id"), F.concat(F.lit("h"), F.col("k").cast("string"))
        .alias("head_hash"), (F.col("k") != 1).alias("ok"), F.lit(4).alias("event_count"))
    return ledger.policy_audit_links(events, receipts, policy).select(
        "job_id", "links", violation_codes().alias("codes"))


# --- claim graphs ----------------------------------------------------------------------------

_SIMPLE = """
    c AS (SELECT conv_id, turn, turn + 1 AS seq, text, role, CASE
            WHEN turn = 0 THEN 'claim.proposed' WHEN turn % 5 = 0 THEN 'claim.transitioned'
            WHEN turn % 5 = 1 THEN 'query.executed' WHEN turn % 5 = 2 THEN 'passage.observed'
            WHEN turn % 5 = 3 THEN 'evidence.linked' ELSE 'claim.transitioned' END AS kind,
            CASE WHEN turn = 4 AND conv_id % 2 = 1 THEN 'SUPPORTED' WHEN turn = 4 THEN
            'CHALLENGED' WHEN conv_id % 2 = 1 THEN 'UNRESOLVED' WHEN conv_id % 4 = 0 THEN
            'NARROWED' ELSE 'REFUTED' END AS target,
            conv_id % 17 = 0 AS stray, conv_id % 8 = 0 AS open_ended FROM conversations),
    r AS (SELECT *, max(CASE WHEN turn = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS has0,
        row_number() OVER (PARTITION BY conv_id, kind ORDER BY seq) AS nth,
        count(*) FILTER (WHERE turn = 1) OVER (PARTITION BY conv_id) > 0 AS has1,
        count(*) FILTER (WHERE turn = 2) OVER (PARTITION BY conv_id) > 0 AS has2 FROM c),
    v AS (SELECT *, CASE
        WHEN kind = 'query.executed' AND stray THEN 'unknown_claim'
        WHEN kind = 'passage.observed' AND length(text) - CASE WHEN conv_id % 19 = 3 THEN 9999
            ELSE 0 END < 0 THEN 'locator_value'
        WHEN kind = 'evidence.linked' AND stray THEN 'foreign_passage'
        WHEN kind = 'claim.transitioned' AND turn = 5 AND target = 'NARROWED' AND open_ended
            THEN 'boundary'
        WHEN kind = 'claim.transitioned' AND turn > 5 THEN 'illegal_transition'
        ELSE '' END AS code FROM r),
    stops AS (SELECT conv_id, min(seq) FILTER (WHERE code <> '') AS stop FROM v GROUP BY 1),
    a AS (SELECT v.*, s.stop, s.stop IS NULL OR v.seq < s.stop AS applied
        FROM v JOIN stops s ON s.conv_id = v.conv_id)"""


@query("W02_claim_projection", sql=f"""WITH {_SIMPLE}
    SELECT 'm' || conv_id || '-' || turn AS event_id, applied, seq = stop AS stopping FROM a""")
def _(t):
    p = graph.claim_projection(t.claim_log)
    stop = graph.first_violation(p).select("tenant_id", "job_id",
                                           F.col("sequence").alias("stop"))
    return p.join(stop, ["tenant_id", "job_id"], "left").select(
        "event_id", "applied", (F.col("sequence") == F.col("stop")).alias("stopping"))


@query("J13_graph_references", sql="""
    SELECT 'm' || conv_id || '-' || turn AS event_id, CASE
        WHEN turn % 5 = 1 AND conv_id % 17 = 0 THEN 'unknown_claim'
        WHEN turn % 5 = 3 AND conv_id % 17 = 0 THEN 'foreign_passage' ELSE '' END AS codes
    FROM conversations""")
def _(t):
    from veriledge.functions.contracts import with_violations

    refs = graph.graph_references(graph.parse_claim_log(t.claim_log))
    return with_violations(refs, graph.reference_rules()).select(
        "event_id", violation_codes().alias("codes"))


_STATES = f"""{_SIMPLE},
    m AS (SELECT conv_id, max_by(target, seq) AS state, max_by(CASE WHEN open_ended THEN ''
        ELSE role END, seq) AS boundary, count(*) AS n FROM a WHERE applied AND kind =
        'claim.transitioned' GROUP BY 1),
    st AS (SELECT p.conv_id, COALESCE(m.state, 'PROPOSED') AS state, COALESCE(m.boundary, '')
        AS boundary, COALESCE(m.n, 0) + 1 AS version FROM a p LEFT JOIN m ON m.conv_id = p.conv_id
        WHERE p.turn = 0 AND p.applied)"""


@query("W03_publication_issues", sql=f"""WITH {_STATES}
    SELECT 'j' || conv_id AS job_id, 'c' || conv_id || ': non-terminal state ' || state AS issue
    FROM st WHERE state IN ('PROPOSED', 'SUPPORTED', 'CHALLENGED')
    UNION ALL SELECT 'j' || conv_id, 'c' || conv_id || ': surviving decision has no boundary'
    FROM st WHERE state IN ('SURVIVED', 'NARROWED') AND boundary = ''
    UNION ALL SELECT DISTINCT 'j' || conv_id, 'graph contains no claims' FROM c
    WHERE conv_id NOT IN (SELECT conv_id FROM st)""")
def _(t):
    states = graph.claim_states(graph.claim_projection(t.claim_log))
    return graph.publication_issues(t.claim_log, states).select("job_id", "issue")


@query("A07_graph_metrics", sql=f"""WITH {_STATES}
    SELECT 'j' || a.conv_id AS job_id,
        count(*) FILTER (WHERE applied AND kind = 'claim.proposed') AS claims,
        count(*) FILTER (WHERE applied AND kind = 'query.executed') AS queries,
        count(*) FILTER (WHERE applied AND kind = 'passage.observed') AS passages,
        count(*) FILTER (WHERE applied AND kind = 'evidence.linked') AS evidence_edges,
        CASE WHEN any_value(state) = 'UNRESOLVED' THEN 1 ELSE 0 END AS claims_unresolved,
        CASE WHEN any_value(state) = 'CHALLENGED' THEN 1 ELSE 0 END AS claims_challenged,
        CASE WHEN any_value(state) = 'PROPOSED' THEN 1 ELSE 0 END AS claims_proposed
    FROM a LEFT JOIN st ON st.conv_id = a.conv_id GROUP BY a.conv_id""")
def _(t):
    m = graph.graph_metrics(graph.claim_projection(t.claim_log))
    return m.select("job_id", "claims", "queries", "passages", "evidence_edges", *[
        F.col(c).cast("int").alias(c) for c in (
            "claims_unresolved", "claims_challenged", "claims_proposed")])


_FINAL = f"""WITH {_STATES},
    i AS (SELECT conv_id, state IN ('PROPOSED', 'SUPPORTED', 'CHALLENGED') OR (state IN
        ('SURVIVED', 'NARROWED') AND boundary = '') AS bad FROM st)
    SELECT 'j' || s.conv_id AS job_id, CASE WHEN s.conv_id % 13 = 0 OR s.stop IS NOT NULL
        OR COALESCE(i.bad, TRUE) THEN 'FAILED' ELSE 'SUCCEEDED' END AS status
    FROM stops s LEFT JOIN i ON i.conv_id = s.conv_id"""


def _claim_receipts(t):
    return t.conversations.select("conv_id").distinct().select(
        F.lit("chat").alias("tenant_id"),
        F.concat(F.lit("j"), F.col("conv_id").cast("string")).alias("job_id"),
        (F.col("conv_id") % 13 != 0).alias("ok"), F.lit(1).alias("event_count"),
        F.lit("h").alias("head_hash"), F.lit("e").alias("error"))


@query("C14_finalize_jobs", sql=_FINAL)
def _(t):
    return graph.finalize_jobs(t.claim_log, receipts=_claim_receipts(t)).select("job_id",
                                                                                "status")


@query("E03_event_validator", sql=f"""WITH {_STATES}
    SELECT 'j' || conv_id AS job_id, count(*) AS issues FROM (
        SELECT conv_id FROM stops WHERE stop IS NOT NULL
        UNION ALL SELECT st.conv_id FROM st JOIN stops s ON s.conv_id = st.conv_id
        WHERE s.stop IS NULL AND (state IN ('PROPOSED', 'SUPPORTED', 'CHALLENGED')
            OR (state IN ('SURVIVED', 'NARROWED') AND boundary = ''))) GROUP BY 1""")
def _(t):
    _, issues = hooks.validate_events(t.claim_log, graph.claim_graph_validator)
    return issues.groupBy("job_id").agg(F.count(F.lit(1)).alias("issues"))


@query("P26_control_finalizer", "raw_events", sql="""
    SELECT tenant_id, job_id, count(*) FILTER (WHERE event_type = 'signup')
        AS benchmark_decisions, count(*) FILTER (WHERE event_type = 'purchase')
        AS prediction_candidates, concat_ws(',', CASE WHEN count(*) FILTER (WHERE event_type =
        'signup') <> 1 THEN 'decision_count' END, CASE WHEN count(*) FILTER (WHERE event_type =
        'purchase') <> 1 THEN 'candidate_count' END) AS codes FROM raw_events GROUP BY 1, 2""")
def _(t):
    named = t.raw_events.withColumn("event_type", F.when(
        F.col("event_type") == "signup", "benchmark.decision_recorded").when(
        F.col("event_type") == "purchase", "benchmark.prediction_candidate_recorded").otherwise(
        F.col("event_type")))
    return rows.control_finalizer(named).select(
        "tenant_id", "job_id", "benchmark_decisions", "prediction_candidates",
        violation_codes().alias("codes"))


@query("E04_retriever_protocol", "corpus", "tasks", sql="""
    SELECT 't' || item_id AS challenge_id, 'UNRESOLVED' AS decision FROM benchmark""")
def _(t):
    def retriever(queries):
        return queries.select("query_id", F.col("query_id").alias("passage_id"),
                              F.lit("d").alias("doc_id"))

    def rule(tasks, _passages):
        return tasks.select("challenge_id", F.lit("UNRESOLVED").alias("decision"))

    return hooks.retrieve_and_decide(t.tasks, composites.plan_queries(t.tasks), retriever, rule)
