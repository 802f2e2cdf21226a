"""Schemaless JSON tables and the search audit."""
from __future__ import annotations

from pyspark.sql import functions as F

from veriledge.operators import tables
from veriledge.plans.catalog.q_scalars import norm
from veriledge.plans.catalog.registry import query


def json_events(t):
    """Events as a JSON table: nested object, boolean, missing members."""
    i = F.col("event_id")
    text = F.concat(
        F.lit('{"id":'), i.cast("string"), F.lit(',"meta":'), F.col("props"),
        F.when(i % 3 == 0, F.lit(',"flag":true')).otherwise(""),
        F.when(i % 4 == 0, F.concat(F.lit(',"tag":"'), "event_type", F.lit('"'))).otherwise(""),
        F.when(i % 5 == 0, F.lit(',"items":[1,"x"]')).otherwise(F.lit(',"items":[1]')),
        F.lit("}"))
    return t.events.select("event_id", text.alias("value")).withColumn(
        "v", F.parse_json("value"))


@query("U01_merge", sql="""
    SELECT event_id, event_type, NULL AS extra FROM events
    UNION ALL SELECT event_id, NULL, 'again' FROM events WHERE event_type = 'error'""")
def _(t):
    again = t.events.where("event_type = 'error'").select("event_id", F.lit("again")
                                                          .alias("extra"))
    return tables.merge(t.events.select("event_id", "event_type"), again)


@query("P01_filter_eq", sql="""
    SELECT event_id, 'number' AS test FROM events WHERE CAST(json_extract(props, '$.k') AS INT)
        = 87
    UNION ALL SELECT event_id, 'flag' FROM events WHERE event_id % 3 = 0
    UNION ALL SELECT event_id, 'absent' FROM events WHERE event_id % 4 <> 0
    UNION ALL SELECT event_id, 'text' FROM events WHERE event_id % 4 = 0
        AND event_type = 'click'""")
def _(t):
    e = json_events(t)
    tests = {"number": "meta.k = 87", "flag": "flag=True", "absent": "tag=None",
             "text": "tag=click"}
    return tables.merge(*[tables.filter_eq(e, where).select("event_id", F.lit(name).alias("test"))
                          for name, where in tests.items()])


SCHEMA = {"type": "array", "items": {
    "type": "object", "required": ["id", "tag"], "properties": {
        "id": {"type": "integer"}, "flag": {"type": "string"},
        "tag": {"enum": ["view", "click", "error"]},
        "meta": {"type": "object", "properties": {"k": {"type": "number"}}},
        "items": {"type": "array", "minItems": 1, "items": {"type": "integer"}}}}}


@query("P02_validate_schema", sql="""
    SELECT event_id, concat_ws(';', CASE WHEN event_id % 4 <> 0 THEN 'row.tag: required' END,
        CASE WHEN event_id % 3 = 0 THEN 'row.flag: type string' END,
        CASE WHEN event_id % 4 = 0 AND event_type IN ('signup', 'purchase') THEN 'row.tag: enum'
        END, CASE WHEN event_id % 5 = 0 THEN 'row.items[]: type integer' END) AS errors
    FROM events""")
def _(t):
    return tables.validate_schema(json_events(t), SCHEMA).select(
        "event_id", F.array_join("errors", ";").alias("errors"))


@query("P02_schema_summary", sql="""
    SELECT count(*) AS rows, count(*) FILTER (WHERE event_id % 4 <> 0 OR event_id % 3 = 0
        OR event_id % 5 = 0 OR event_type IN ('signup', 'purchase')) AS invalid, FALSE AS ok
    FROM events""")
def _(t):
    return tables.schema_summary(tables.validate_schema(json_events(t), SCHEMA))


@query("W10_dedup_key", sql="""
    SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY
        event_id) AS rn FROM events WHERE event_id % 4 = 0) WHERE rn = 1
    UNION ALL SELECT event_id FROM events WHERE event_id % 4 <> 0""")
def _(t):
    return tables.dedup_key(json_events(t), tables.dotted("tag"), "event_id").select("event_id")


@query("A10_field_coverage", sql="""
    SELECT 'id' AS field, count(*) AS rows FROM events
    UNION ALL SELECT 'meta', count(*) FROM events
    UNION ALL SELECT 'items', count(*) FROM events
    UNION ALL SELECT 'flag', count(*) FROM events WHERE event_id % 3 = 0
    UNION ALL SELECT 'tag', count(*) FROM events WHERE event_id % 4 = 0""")
def _(t):
    return tables.field_coverage(json_events(t))


def audit(t):
    a = t.search_audit
    hits = F.when(F.col("tool") != "content", F.array("doc_id")).otherwise(
        F.array().cast("array<string>"))
    return a.select("ts", "tool", "query", "doc_id", hits.alias("hits"))


def declared(t):
    return t.declared.groupBy("file", "id").agg(F.collect_list("query").alias("queries"))


def outputs(t):
    return t.conversations.groupBy("conv_id").agg(
        F.collect_set(F.when(F.col("role") == "user", F.concat(F.lit("d"), F.col("turn")
                                                               .cast("string"))))
        .alias("counter_docs"),
        F.collect_set(F.when(F.col("turn") < 4, F.concat(F.lit("d"), F.col("turn")
                                                         .cast("string"))))
        .alias("checked_docs")).select(
        F.concat(F.lit("f"), (F.col("conv_id") % 7).cast("string"), F.lit(".jsonl"))
        .alias("file"), F.concat(F.lit("id"), F.col("conv_id").cast("string"))
        .alias("candidate_id"), "counter_docs", "checked_docs")


_OBSERVED = f"""o AS (SELECT DISTINCT {norm('query')} AS n FROM search_audit
        WHERE tool <> 'content' AND query <> ''),
    dq AS (SELECT file, id, query, {norm('query')} AS n FROM declared WHERE trim(query) <> '')"""
_MISSING = "SELECT file, id FROM dq WHERE n NOT IN (SELECT n FROM o)"
_SUBSET = """SELECT 'f' || (conv_id % 7) || '.jsonl' AS file, 'id' || conv_id AS id
        FROM conversations WHERE role = 'user' AND turn >= 4
        AND NOT EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = conversations.conv_id
            AND c.turn = conversations.turn AND c.turn < 4) GROUP BY conv_id"""


@query("J07_undeclared_queries", "search_audit", "declared", sql=f"""WITH {_OBSERVED}
    SELECT file, id, sha256(query) AS query_sha256 FROM dq WHERE n NOT IN (SELECT n FROM o)
    UNION ALL SELECT 'absent.jsonl', '?', sha256('<FILE_MISSING>')
    WHERE EXISTS (SELECT 1 FROM conversations)""")
def _(t):
    files = t.declared.select("file").distinct().unionByName(
        t.conversations.select(F.lit("absent.jsonl").alias("file")).distinct())
    found = tables.undeclared_queries(audit(t), declared(t), files)
    return found.select("file", "id", F.sha2("query", 256).alias("query_sha256"))


@query("J08_counter_subset", sql=_SUBSET)
def _(t):
    return tables.counter_subset(outputs(t))


@query("C05_audit_queries", "search_audit", "declared", sql=f"""WITH {_OBSERVED},
    h AS (SELECT {norm('query')} AS n, doc_id, min(ts) AS first_ts FROM search_audit
        WHERE tool <> 'content' GROUP BY 1, 2),
    r AS (SELECT doc_id, max(ts) AS last_read FROM search_audit WHERE tool = 'content'
        GROUP BY 1),
    late AS (SELECT dq.file, max(r.last_read) AS newest FROM dq JOIN h ON h.n = dq.n
        JOIN r ON r.doc_id = h.doc_id GROUP BY 1)
    SELECT 'MISSING' AS finding, file, id FROM ({_MISSING})
    UNION ALL SELECT DISTINCT 'MISSING_REPLAY', dq.file, dq.id FROM dq JOIN h ON h.n = dq.n
        LEFT JOIN r ON r.doc_id = h.doc_id WHERE r.last_read IS NULL OR r.last_read < h.first_ts
    UNION ALL SELECT 'INVALID_COUNTER_SUBSET', file, id FROM ({_SUBSET})
    UNION ALL SELECT 'STALE_DECISION_ARTIFACT', file, '' FROM late
        WHERE (CAST(substr(file, 2, 1) AS INT) % 2 = 0 AND newest > 5000)
           OR (CAST(substr(file, 2, 1) AS INT) % 2 = 1 AND newest > 1000000)""")
def _(t):
    odd = F.expr("cast(substr(file, 2, 1) as int) % 2") == 1
    files = t.declared.select("file").distinct().select(
        "file", F.when(odd, 1_000_000).otherwise(5000).alias("modified_at"))
    return tables.audit_queries(audit(t), declared(t), outputs(t), files)
