"""Scans and sinks: data derived from the tables is written to the shared folder and read back."""
from __future__ import annotations

from pyspark.sql import functions as F

from veriledge import schemas as S
from veriledge.functions import scalars as fn
from veriledge.functions.contracts import violation_codes
from veriledge.operators import ledger, service
from veriledge.plans.catalog.q_benchmark import fold_sql
from veriledge.plans.catalog.q_jobs import HISTOGRAM_SQL, SNAPSHOT_SQL, snapshot
from veriledge.plans.catalog.q_ledger import _CHAIN, chained
from veriledge.plans.catalog.registry import query
from veriledge.sources import artifacts, jsonl, ledger_source, ledgers, logs, registry


def mixed_lines(t):
    """Event payloads as lines of which some are broken, arrays or blank."""
    i = F.col("event_id")
    line = (F.when(i % 10 == 3, F.concat("props", F.lit("x"))).when(i % 10 == 7, "[1, 2]")
            .when(i % 10 == 5, "  ").otherwise(F.col("props")))
    path = t.scratch()
    t.events.select(line.alias("value")).write.text(path)
    return path


_GOOD = "event_id % 10 NOT IN (3, 5, 7)"
_K = "CAST(json_extract(props, '$.k') AS BIGINT)"


@query("S01_read_jsonl_strict", sql=f"""
    SELECT 'row' AS outcome, count(*) AS rows, CAST(sum({_K}) AS BIGINT) AS total FROM events
        WHERE {_GOOD}
    UNION ALL SELECT 'invalid_json', count(*), NULL FROM events WHERE event_id % 10 = 3
    UNION ALL SELECT 'not_object', count(*), NULL FROM events WHERE event_id % 10 = 7""")
def _(t):
    good, bad = jsonl.read_jsonl_strict(t.spark, mixed_lines(t), strict=False)
    k = F.try_variant_get("v", "$.k", "bigint")
    return good.agg(F.lit("row").alias("outcome"), F.count(F.lit(1)).alias("rows"),
                    F.sum(k).alias("total")).unionByName(
        bad.groupBy(F.col("problem").alias("outcome")).agg(
            F.count(F.lit(1)).alias("rows")).withColumn("total", F.lit(None).cast("bigint")))


def _clean_lines(t):
    path = t.scratch()
    t.events.select(F.col("props").alias("value")).write.text(path)
    return path


_COUNTS = f"SELECT count(*) AS rows, CAST(sum({_K}) AS BIGINT) AS total FROM events"


def _counted(rows):
    return rows.agg(F.count(F.lit(1)).alias("rows"),
                    F.sum(F.try_variant_get("v", "$.k", "bigint")).alias("total"))


@query("S02_read_jsonl_nonempty", sql=_COUNTS)
def _(t):
    return _counted(jsonl.read_jsonl_nonempty(t.spark, _clean_lines(t), "events")[0])


@query("S03_read_jsonl_lenient", sql="""
    SELECT 'kept' AS side, count(*) AS rows FROM events WHERE event_id % 10 NOT IN (3, 5)
    UNION ALL SELECT 'skipped', count(*) FROM events WHERE event_id % 10 = 3""")
def _(t):
    kept, skipped = jsonl.read_jsonl_lenient(t.spark, mixed_lines(t))
    return kept.agg(F.lit("kept").alias("side"), F.count(F.lit(1)).alias("rows")).unionByName(
        skipped.agg(F.lit("skipped").alias("side"), F.count(F.lit(1)).alias("rows")))


@query("S04_read_jsonl_trusted", sql=_COUNTS)
def _(t):
    rows = jsonl.read_jsonl_trusted(t.spark, _clean_lines(t), "k bigint")
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.sum("k").alias("total"))


@query("S05_read_audit_jsonl", sql=_COUNTS)
def _(t):
    return _counted(jsonl.read_audit_jsonl(t.spark, _clean_lines(t)))


@query("S06_write_jsonl", sql="""
    SELECT conv_id, turn, role, sha256(text) AS text_sha256 FROM conversations""")
def _(t):
    path = t.scratch()
    jsonl.write_jsonl(t.conversations, path)
    back = jsonl.read_jsonl_trusted(t.spark, path, t.conversations.schema)
    return back.select("conv_id", "turn", "role", fn.sha256("text").alias("text_sha256"))


_LINE = """'{"o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority
    || '","o_orderstatus":"' || o_orderstatus || '"}'"""


@query("S07_write_canonical_jsonl", sql=f"""
    SELECT {fold_sql(_LINE, 'orders')} AS digest, (SELECT count(*) FROM orders) AS rows""")
def _(t):
    narrow = t.orders.select("o_orderstatus", "o_orderkey", "o_orderpriority")
    return jsonl.write_canonical_jsonl(narrow, t.scratch())


def _ledger_files(t):
    """Ledgers as JSON lines below tenant and job; a third torn, a third with a field too many."""
    path = t.scratch()
    part = F.expr("cast(substr(job_id, 2) as bigint) % 3")
    raw = F.concat(F.expr("substr(envelope, 1, length(envelope) - 1)"),
                   F.lit(',"event_hash":"'), "event_hash", F.lit('"}'))
    events = chained(t).withColumn("envelope", fn.envelope_json()).withColumn("value", raw)
    wide = F.concat(F.lit('{"extra":0,'), F.expr("substr(value, 2)"))
    first = F.col("sequence") == 1
    lines = events.select(
        "tenant_id", "job_id", F.floor(F.col("sequence") / 65_536).alias("part"), F.explode(
            F.when((part == 2) & first, F.array(wide))
            .when((part == 1) & first, F.array("value", F.expr("substr(value, 1, 40)")))
            .otherwise(F.array("value"))).alias("value"))
    ledgers.write_ledger_files(lines, path)
    return path


_RECEIPTS = f"""WITH {_CHAIN},
    jobs AS (SELECT DISTINCT tenant_id, job_id, CAST(substr(job_id, 2) AS BIGINT) % 3 AS part
        FROM chain)
    SELECT c.tenant_id, c.job_id, CASE j.part WHEN 1 THEN 'line_json' WHEN 2 THEN 'line_fields'
        ELSE '' END AS problems, j.part = 0 AS ok, CASE WHEN j.part = 0 THEN count(*) ELSE 0 END
        AS event_count, CASE WHEN j.part = 0 THEN max_by(event_hash, seq) ELSE '' END AS head_hash
    FROM chain c JOIN jobs j ON j.tenant_id = c.tenant_id AND j.job_id = c.job_id
    GROUP BY c.tenant_id, c.job_id, j.part"""


@query("S08_read_ledgers", "raw_events", recursive=True, sql=_RECEIPTS)
def _(t):
    """A third of the ledgers end in a torn line, a third have a field too many in the first."""
    return _checked(ledgers.read_ledgers(t.spark, _ledger_files(t)))


def _checked(events):
    """Receipts with the line problems of each ledger; the files are read once for both."""
    checked = ledger.chain_violations(events)
    line = F.filter("violations", lambda v: v["code"] == "line_invalid")
    problems = checked.groupBy("tenant_id", "job_id").agg(F.concat_ws(",", F.array_sort(
        F.collect_set(F.get(line, F.lit(0))["detail"]))).alias("problems"))
    return ledger.receipts_of(checked).drop("error").join(problems, ["tenant_id", "job_id"])


@query("S08_ledger_format", "raw_events", recursive=True, sql=_RECEIPTS)
def _(t):
    """The same ledgers by the registered format, read by byte ranges."""
    ledger_source.register(t.spark)
    lines = t.spark.read.format("ledger").option("split_bytes", 1 << 20).load(_ledger_files(t))
    return _checked(ledgers.ledger_events(lines))


@query("S10_write_receipts", "raw_events", recursive=True, sql=f"""WITH {_CHAIN}
    SELECT tenant_id, job_id, TRUE AS ok, count(*) AS event_count, max_by(event_hash, seq)
        AS head_hash FROM chain GROUP BY 1, 2""")
def _(t):
    return ledgers.write_receipts(chained(t), t.scratch()).drop("error")


@query("S11_search_audit_log", "search_audit", sql="""
    SELECT request_id, tool, 1 AS n_hits, doc_id, sha256('[{"doc_id":"' || doc_id
        || '","extra":1,"title":"t"}]') AS response_sha256 FROM search_audit""")
def _(t):
    responses = t.search_audit.select(
        "ts", "tool", "query", "request_id",
        F.concat(F.lit('[{"title":"t", "extra": 1,"doc_id":"'), "doc_id", F.lit('"}]'))
        .alias("hits_json"), F.lit(1.0).alias("started_ms"), F.lit(3.5).alias("ended_ms"))
    out = logs.search_audit_log(responses)
    return out.select("request_id", "tool", "n_hits",
                      F.get("hits", F.lit(0))["doc_id"].alias("doc_id"), "response_sha256")


@query("S11_content_audit_log", sql="""
    SELECT doc_id, octet_length(encode(text)) AS bytes, sha256(text) AS content_sha256
    FROM documents""")
def _(t):
    reads = t.documents.select(F.lit(0).alias("ts"), F.lit("r").alias("request_id"), "doc_id",
                               F.lit(0).alias("offset"), F.lit(4096).alias("limit"), "text")
    return logs.content_audit_log(reads).select("doc_id", F.col("bytes").cast("bigint")
                                                .alias("bytes"), "content_sha256")


@query("S14_trace_log", "requests", sql="""
    SELECT event_id, sha256(request_id) AS request_id_sha256, round(duration_seconds * 1000, 6)
        AS duration_ms, concat_ws(',', CASE WHEN method = 'PUT' THEN 'method' END,
        CASE WHEN status = 700 THEN 'status' END) AS codes FROM requests""")
def _(t):
    r = t.requests.withColumn("occurred_at", F.col("ts").cast("string"))
    out = logs.trace_records(r)
    keyed = t.requests.select("event_id", fn.sha256("request_id").alias("request_id_sha256"))
    return out.join(keyed, "request_id_sha256").select(
        "event_id", "request_id_sha256", "duration_ms", violation_codes().alias("codes"))


@query("S15_metrics_exposition", "requests", "jobs", "charges", "checkpoints", sql=f"""
    SELECT 'control_http_requests_total{{method="' || method || '",route="' || route ||
        '",status="' || status || '"}} ' || count(*) AS line FROM requests
        GROUP BY method, route, status
    UNION ALL SELECT 'control_http_request_duration_seconds_' || series || '{{method="' || method
        || '",route="' || route || CASE WHEN series = 'bucket' THEN '",le="' || le ELSE '' END
        || '"}} ' || CASE WHEN series = 'sum' THEN printf('%.4f', value)
                         ELSE CAST(CAST(value AS BIGINT) AS VARCHAR) END
        FROM ({HISTOGRAM_SQL})
    UNION ALL SELECT CASE field WHEN 'jobs_by_status' THEN 'control_jobs{{status="' || key || '"}} '
        WHEN 'jobs_by_stage' THEN 'control_jobs_by_stage{{stage="' || key || '"}} '
        ELSE 'control_' || field || ' ' END || CASE WHEN field = 'oldest_runnable_age_seconds'
        THEN printf('%.4f', value) ELSE CAST(CAST(value AS BIGINT) AS VARCHAR) END
        FROM ({SNAPSHOT_SQL})""")
def _(t):
    """All lines; sums and ages are compared to four decimals, as they are added in any order."""
    lines = logs.metrics_exposition(service.request_counts(t.requests),
                                    service.latency_histogram(t.requests), snapshot(t))
    inexact = F.col("line").contains("_sum{") | F.col("line").contains("_age_seconds ")
    value = F.regexp_extract("line", r" (\S+)$", 1).try_cast("double")
    return lines.select(F.when(inexact, F.concat(
        F.regexp_replace("line", r"\S+$", ""), F.format_string("%.4f", value)))
        .otherwise(F.col("line")).alias("line"))


def _registry(t):
    i = F.col("s_suppkey")
    method = F.struct(
        F.concat(F.lit("m"), (i - i % 50).cast("string"), F.when(i % 50 < 2, "").otherwise(
            i.cast("string"))).alias("method_id"),
        F.lit(True).alias("support_retrieval"), (i % 2 == 0).alias("external_counter_retrieval"),
        F.lit(False).alias("cedg"),
        F.when(i % 7 == 0, "forever").otherwise("none").alias("memory"),
        F.when(i % 3 == 0, "self_critic").when(i % 3 == 1, "verifier").otherwise("direct")
        .alias("decision_mode"))
    return t.supplier.select(
        F.lit(1).alias("schema_version"), F.array(method).alias("methods"),
        F.struct(F.when(i % 11 == 0, -1).otherwise(24).cast("bigint").alias("max_calls"),
                 F.lit(30000).cast("bigint").alias("max_tokens")).alias("budget"))


@query("S16_method_registry", sql="""
    SELECT 'm' || (i - i % 50) || CASE WHEN i % 50 < 2 THEN '' ELSE CAST(i AS VARCHAR) END
        AS method_id, concat_ws(',', CASE WHEN i % 50 < 2 THEN 'duplicate_method' END,
        CASE WHEN i % 7 = 0 THEN 'memory' END,
        CASE WHEN i % 3 = 0 AND i % 2 = 0 THEN 'self_critic_with_counter' END,
        CASE WHEN i % 3 = 1 AND i % 2 = 1 THEN 'verifier_without_counter' END,
        CASE WHEN i % 11 = 0 THEN 'budget' END) AS codes
    FROM (SELECT s_suppkey AS i FROM supplier)""")
def _(t):
    path = t.scratch()
    _registry(t).write.json(path)
    found = t.spark.read.schema(S.METHOD_REGISTRY).json(path)
    return registry.method_registry(found).select("method_id",
                                                  violation_codes().alias("codes"))


_REPORT = """SELECT l_suppkey AS method_id, count(*) AS n, round(avg(l_discount) + 1e-9, 6)
        AS mean_discount FROM lineitem GROUP BY 1"""


def _report(t):
    return t.lineitem.groupBy(F.col("l_suppkey").alias("method_id")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("l_discount") + 1e-9, 6)
        .alias("mean_discount"))


@query("S17_json_report", sql=_REPORT)
def _(t):
    path = t.scratch()
    jsonl.write_json_report(_report(t), path)
    return t.spark.read.schema("method_id bigint, n bigint, mean_discount double").json(path)


@query("S18_summary_long", sql=f"""WITH r AS ({_REPORT})
    SELECT method_id, 'n' AS metric, CAST(n AS DOUBLE) AS value FROM r
    UNION ALL SELECT method_id, 'mean_discount', mean_discount FROM r""")
def _(t):
    summaries = _report(t).withColumn("scientific_result", F.lit(False))
    return registry.summary_long(summaries, ["n", "mean_discount"])


@query("J15_file_manifest")
def _(t):
    """Files of the data folder against a manifest made from them; rows only."""
    from veriledge.operators.jobs import manifest_verify

    files = artifacts.scan_files(t.spark, t.folder, "*.parquet")
    manifest = files.withColumn("kind", F.lit("table"))
    return manifest_verify(manifest, files).select("path", violation_codes().alias("codes"))


def _folders(t, marked, texts):
    """Documents in one file per 64 ids, in folders k=<number>."""
    path = t.scratch()
    k = F.floor(F.col("doc_id") / 64)
    (t.documents.withColumn("k", k).where(marked).select("k", "doc_id", texts.alias("value"))
     .repartition("k").sortWithinPartitions("k", "doc_id").select("k", "value")
     .write.partitionBy("k").text(path))
    return artifacts.scan_files(t.spark, path, "*.txt").withColumn(
        "path", F.regexp_replace("path", "/[^/]*$", ""))


@query("J15_tampered_files", sql="""
    WITH f AS (SELECT DISTINCT doc_id // 64 AS k FROM documents)
    SELECT 'k=' || k AS path, CASE WHEN k % 9 = 4 THEN 'unmanifested_file' WHEN k % 11 = 3
        THEN 'missing_file' WHEN k % 5 = 0 THEN 'size,sha256' WHEN k % 7 = 0 THEN 'sha256'
        ELSE '' END AS codes FROM f WHERE NOT (k % 9 = 4 AND k % 11 = 3)""")
def _(t):
    """A manifest of written files against a copy with longer, changed, missing and new files."""
    from veriledge.operators.jobs import manifest_verify

    k, text = F.col("k"), F.col("text")
    manifest = _folders(t, k % 9 != 4, text).withColumn("kind", F.lit("artifact_blob"))
    altered = F.when(k % 5 == 0, F.concat(text, F.lit("!"))).when(
        k % 7 == 0, F.reverse(text)).otherwise(text)
    return manifest_verify(manifest, _folders(t, k % 11 != 3, altered)).select(
        "path", violation_codes().alias("codes"))
