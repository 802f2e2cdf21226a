"""Scalar functions over whole tables."""
from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import functions as F

from veriledge.functions import scalars as fn
from veriledge.operators import score
from veriledge.plans.catalog.registry import query

SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
STOP = ("'a','all','alone','and','are','as','at','be','by','can','for','from','in','is','it',"
        "'no','not','of','on','or','so','that','the','their','this','to','under','using',"
        "'with','without'")


def norm(text: str) -> str:
    return f"trim(regexp_replace(lower({text}), '{SPACE}', ' ', 'g'))"


@query("F01_canonical_json", sql="""
    SELECT event_id, '{"a":' || CAST(json_extract(props, '$.k') AS VARCHAR) || ',"b":[true,null],"t":"'
           || event_type || '"}' AS canonical FROM events""")
def _(t):
    raw = F.concat(F.lit('{ "t": "'), "event_type", F.lit('" , "b": [true, null], "a": '),
                   F.get_json_object("props", "$.k"), F.lit("}"))
    return t.events.select("event_id", fn.canonical_json(raw, "exact").alias("canonical"))


_ENVELOPE = """'{"aggregate_id":"' || aggregate_id || '","aggregate_type":"' || aggregate_type
    || '","event_id":"' || event_id || '","event_type":"' || event_type
    || '","idempotency_key":' || CAST(to_json(idempotency_key) AS VARCHAR) || ',"job_id":"'
    || job_id || '","occurred_at":"' || occurred_at || '","payload":'
    || replace(payload, ': ', ':') || ',"previous_hash":"'"""


@query("F02_event_hash", "raw_events", sql=f"""
    SELECT event_id, sha256({_ENVELOPE} || '' || '","schema_version":1,"sequence":1,"tenant_id":"'
           || tenant_id || '"}}') AS event_hash FROM raw_events""")
def _(t):
    e = t.raw_events.withColumn("schema_version", F.lit(1)).withColumn(
        "sequence", F.lit(1)).withColumn("previous_hash", F.lit(""))
    return e.select("event_id", fn.event_hash().alias("event_hash"))


@query("F03_hypothesis_digest", sql="""
    SELECT p_partkey, sha256('{"boundary":"' || p_type || '","claim":"' || p_name
           || '","counter_queries":["' || p_brand || '"],"hypothesis_id":"h' || p_partkey
           || '","metadata":{},"physical_checks":[],"support_evidence":["d@' || p_size || '"]}')
           AS digest FROM part""")
def _(t):
    h = t.part.select(
        "p_partkey", F.concat(F.lit("h"), "p_partkey").alias("hypothesis_id"),
        F.col("p_name").alias("claim"), F.col("p_type").alias("boundary"),
        F.array(F.concat(F.lit("d@"), F.col("p_size").cast("string"))).alias("support_evidence"),
        F.array("p_brand").alias("counter_queries"),
        F.array().cast("array<string>").alias("physical_checks"))
    return h.select("p_partkey", fn.hypothesis_digest().alias("digest"))


_ITEM = """'{"content_sha256":"' || content_sha256 || '","doc_id":"' || doc_id
    || '","locator":{"' || CASE WHEN page_no IS NULL THEN 'offset' ELSE 'page_no' END || '":'
    || COALESCE(page_no, locator_offset) || '},"relation":"' || relation || '"}'"""
COMMITMENT = f"""
    SELECT p.challenge_id, p.method_id, sha256('{{"calls":' || p.calls || ',"challenge_id":"'
        || p.challenge_id || '","counterevidence_probability":'
        || CAST(p.counterevidence_probability AS VARCHAR)
        || ',"evidence":[' || COALESCE(e.items, '') || '],"method_id":"' || p.method_id
        || '","predicted_decision":"' || p.predicted_decision || '","run_id":"' || p.run_id
        || '","schema_version":1,"status":"' || p.status || '","tokens":' || p.tokens || '}}')
        AS prediction_commitment_sha256
    FROM predicted p LEFT JOIN (
        SELECT challenge_id, method_id, string_agg({_ITEM}, ',' ORDER BY doc_id) AS items
        FROM predicted_evidence GROUP BY challenge_id, method_id) e
    ON e.challenge_id = p.challenge_id AND e.method_id = p.method_id"""


@query("F04_prediction_commitment", "predicted_evidence", sql=COMMITMENT)
def _(t):
    return t.predictions().select(
        "challenge_id", "method_id",
        fn.prediction_commitment().alias("prediction_commitment_sha256"))


@query("F05_semantic_fingerprint", "raw_events", sql="""
    SELECT event_id, '{"aggregate_id":"' || aggregate_id || '","aggregate_type":"'
        || aggregate_type || '","event_type":"' || event_type || '","job_id":"' || job_id
        || '","payload":' || replace(payload, ': ', ':') || ',"tenant_id":"' || tenant_id
        || '"}' AS fingerprint FROM raw_events""")
def _(t):
    return t.raw_events.select("event_id", fn.semantic_fingerprint_json().alias("fingerprint"))


@query("F06_strategy_key", "strategies", sql=f"""
    SELECT strategy_id, sha256(kind || '|' || {norm('pattern')}) AS strategy_key
    FROM strategies""")
def _(t):
    return t.strategies.select("strategy_id", fn.strategy_key().alias("strategy_key"))


@query("F07_normalize_query", sql=f"""
    SELECT conv_id, turn, role, sha256({norm('text')}) AS norm_sha256 FROM conversations""")
def _(t):
    return t.conversations.select("conv_id", "turn", "role",
                                  fn.sha256(fn.normalize_query("text")).alias("norm_sha256"))


def nfkc(text: str) -> str:
    """SQL for NFKC: code points with a compatibility decomposition are replaced, NFC does the rest."""
    full = [(chr(i), unicodedata.normalize("NFKD", chr(i))) for i in range(sys.maxunicode + 1)
            if unicodedata.decomposition(chr(i))]
    full = [(c, d) for c, d in full if d != unicodedata.normalize("NFD", c)]
    pairs = ", ".join("'" + (c + d).replace("'", "''") + "'" for c, d in full)
    return (f"nfc_normalize(CASE WHEN regexp_matches({text}, '[{''.join(c for c, _ in full)}]') THEN "
            f"list_reduce(list_prepend({text}, [{pairs}]), lambda s, p: replace(s, p[1], p[2:])) "
            f"ELSE {text} END)")


@query("F08_normalize_passage", sql=f"""
    SELECT doc_id, sha256(trim(regexp_replace({nfkc("('  ' || text || ' x')")}, '{SPACE}', ' ', 'g')))
        AS norm_sha256
    FROM documents""")
def _(t):
    padded = F.concat(F.lit("  "), "text", F.lit(" x"))
    return t.documents.select("doc_id", fn.sha256(fn.normalize_passage(padded)).alias("norm_sha256"))


@query("F08_normalize_passage_all")
def _(t):
    """Every document, whatever its script; SQL has no NFKC."""
    padded = F.concat(F.lit("  "), "text", F.lit(" \u2460\ufb01 x"))
    return t.documents.select("doc_id", fn.sha256(fn.normalize_passage(padded)).alias("norm_sha256"))


_CLASS = f"""CASE WHEN o.status = 'unavailable' THEN 'UNAVAILABLE'
    WHEN sha256(o.content) = s.content_sha256 THEN
        CASE WHEN o.source_locator = s.source_locator THEN 'EXACT' ELSE 'LOCATOR_DRIFT' END
    WHEN trim(regexp_replace(nfc_normalize(o.content), '{SPACE}', ' ', 'g'))
         = trim(regexp_replace(nfc_normalize(s.content), '{SPACE}', ' ', 'g'))
        THEN 'NORMALIZATION_DRIFT' ELSE 'CONTENT_DRIFT' END"""


@query("F09_drift_class", "snapshots", "observations", sql=f"""
    SELECT s.snapshot_id, {_CLASS} AS classification
    FROM snapshots s JOIN observations o ON o.snapshot_id = s.snapshot_id""")
def _(t):
    pairs = score.observation_pairing(t.snapshots, t.observed())
    return pairs.where(F.col("s").isNotNull() & F.col("o").isNotNull()).select(
        "snapshot_id", fn.drift_class().alias("classification"))


@query("F10_publication_date", sql="""
    SELECT doc_id, CAST(CASE
        WHEN doc_id % 3 = 0 THEN TRY_CAST(CASE WHEN doc_id % 2 = 0 THEN '2019-13-01'
             ELSE '2019-0' || (doc_id % 9 + 1) || '-15' END AS DATE)
        WHEN doc_id % 3 = 1 THEN make_date(CAST(1990 + doc_id % 30 AS BIGINT), 12, 31)
        ELSE NULL END AS VARCHAR) AS published FROM documents""")
def _(t):
    i = F.col("doc_id")
    text = F.when(i % 3 == 0, F.when(i % 2 == 0, F.lit("2019-13-01T00:00")).otherwise(
        F.concat(F.lit("2019-0"), (i % 9 + 1).cast("string"), F.lit("-15T08:00"))))
    year = F.when(i % 3 == 1, (1990 + i % 30).cast("string")).when(i % 3 == 2, "99")
    return t.documents.select("doc_id", fn.publication_date(
        [F.lit(""), text, F.lit(None)], [year, F.lit(None)]).cast("string").alias("published"))


TERMS = (f"list_filter(regexp_extract_all(lower({{0}}), '[a-z0-9]+'), "
         f"lambda x: length(x) > 1 AND x NOT IN ({STOP}))")


@query("F11_terms", sql=f"""
    SELECT doc_id, len(x) AS n_terms, sha256(COALESCE(array_to_string(x, ' '), ''))
           AS terms_sha256
    FROM (SELECT doc_id, {TERMS.format('text')} AS x FROM documents)""")
def _(t):
    found = t.documents.select("doc_id", fn.terms("text").alias("x"))
    return found.select("doc_id", F.size("x").cast("bigint").alias("n_terms"),
                        fn.sha256(F.array_join("x", " ")).alias("terms_sha256"))


@query("F12_evidence_key", "gold_evidence", sql="""
    SELECT challenge_id, evidence_id, lower(trim(doc_id)) AS doc_key, relation,
        CASE WHEN page_no IS NULL AND locator_offset IS NOT NULL THEN 'offset'
             WHEN page_no IS NOT NULL AND locator_offset IS NULL THEN 'page_no' END AS kind,
        COALESCE(locator_offset, page_no) AS position, content_sha256 FROM gold_evidence""")
def _(t):
    c = t.challenges().select("challenge_id", F.explode("accepted_evidence").alias("e"))
    return c.select("challenge_id", "e.evidence_id", fn.evidence_key(F.col("e")).alias("k")) \
        .select("challenge_id", "evidence_id", F.col("k.doc_id").alias("doc_key"), "k.relation",
                F.col("k.locator_kind").alias("kind"), "k.position", "k.content_sha256")


WILSON = """greatest(0.0, ((s / n + 3.841458820694124 / (2 * n)) - 1.959963984540054 * sqrt(
    (s / n) * (1 - s / n) / n + 3.841458820694124 / (4 * n * n))) / (1 + 3.841458820694124 / n))"""


@query("F13_wilson_lower", sql=f"""
    SELECT l_suppkey, round({WILSON}, 6) AS wilson_lower FROM (
        SELECT l_suppkey, CAST(count(*) AS DOUBLE) AS n,
               CAST(sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS DOUBLE) AS s
        FROM lineitem GROUP BY l_suppkey)""")
def _(t):
    g = t.lineitem.groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "N").alias("s"))
    return g.select("l_suppkey", F.round(fn.wilson_lower("s", "n"), 6).alias("wilson_lower"))


@query("F14_request_digest", sql="""
    SELECT event_id, sha256('{"kind":"search","request":' || replace(props, ': ', ':') || '}')
        AS request_sha256 FROM events""")
def _(t):
    return t.events.select("event_id", fn.request_digest("search", "props")
                           .alias("request_sha256"))


TRACE = """
    SELECT request_id, CASE WHEN ok THEN x[1] ELSE substr(h, 1, 32) END AS trace_id,
           substr(h, 33, 16) AS span_id, CASE WHEN ok THEN x[2] ELSE '' END AS parent_span_id,
           CASE WHEN ok THEN x[3] ELSE '01' END AS flags
    FROM (SELECT *, regexp_full_match(lower(traceparent), '00-[0-9a-f]{32}-[0-9a-f]{16}-[0-9a-f]{2}')
                 AND split_part(traceparent, '-', 2) <> repeat('0', 32) AS ok,
                 [split_part(lower(traceparent), '-', 2), split_part(lower(traceparent), '-', 3),
                  split_part(lower(traceparent), '-', 4)] AS x, sha256(request_id) AS h
          FROM requests)"""


@query("F15_parse_traceparent", "requests", sql=TRACE)
def _(t):
    return t.requests.select("request_id", fn.parse_traceparent("traceparent", "request_id")
                             .alias("c")).select("request_id", "c.*")


@query("F16_passage_id", "corpus", sql="""
    SELECT snapshot_id, 'obs-' || substr(sha256('q1|' || snapshot_id || '|' || (doc_id % 100)
           || '|' || content_sha256), 1, 32) AS passage_id, snapshot_id || '@q1' AS capsule_id
    FROM corpus""")
def _(t):
    return t.corpus.select(
        "snapshot_id", fn.passage_id(F.lit("q1"), "snapshot_id", F.col("doc_id") % 100,
                                     "content_sha256").alias("passage_id"),
        fn.capsule_passage_id("snapshot_id", F.lit("q1")).alias("capsule_id"))


@query("F17_parse_zoned_timestamp", sql="""
    SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL
        ELSE CAST(epoch_us(o_orderdate) / 1000000 - CASE o_orderkey % 4 WHEN 1 THEN 19800
             WHEN 2 THEN -3600 ELSE 0 END AS BIGINT) END AS epoch FROM orders""")
def _(t):
    zone = F.element_at(F.array(F.lit("Z"), F.lit("+05:30"), F.lit("-01:00"), F.lit("")),
                        (F.col("o_orderkey") % 4 + 1).cast("int"))
    text = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), zone)
    return t.orders.select("o_orderkey", F.unix_seconds(fn.zoned_timestamp(text))
                           .alias("epoch"))


@query("F18_pattern_checks", sql="""
    SELECT page_id, regexp_full_match(url, '[A-Za-z0-9._:-]{1,200}') AS safe_id,
        regexp_full_match(CASE WHEN page_id % 2 = 0 THEN sha256(url) ELSE url END, '[0-9a-f]{64}')
            AS is_sha256,
        page_id % 3 <> 1 AND page_id % 5 <> 1 AND page_id % 7 <> 1 AS safe_relpath FROM pages""")
def _(t):
    i = F.col("page_id")
    path = F.concat(F.when(i % 3 == 1, "/").otherwise(""), F.lit("tenant/"),
                    F.when(i % 5 == 1, "../").otherwise(""), i.cast("string"),
                    F.when(i % 7 == 1, ".txt").otherwise("/events.jsonl"))
    return t.pages.select(
        "page_id", fn.safe_id("url").alias("safe_id"),
        fn.is_sha256(F.when(i % 2 == 0, fn.sha256("url")).otherwise(F.col("url")))
        .alias("is_sha256"), fn.safe_relpath(path).alias("safe_relpath"))


@query("F19_rendered_query", sql="""
    SELECT item_id, sha256(CASE WHEN item_id % 3 = 0 THEN text ELSE text || chr(10)
        || '[RECALLED_FALSIFICATION_STRATEGY]' || chr(10) || '- boundary_probe: a' || item_id
        || CASE WHEN item_id % 2 = 0 THEN chr(10) || '- precedent_probe: b' ELSE '' END END)
        AS query_sha256 FROM benchmark""")
def _(t):
    i = F.col("item_id")
    one = F.struct(F.lit("boundary_probe").alias("kind"),
                   F.concat(F.lit("a"), i.cast("string")).alias("pattern"))
    two = F.struct(F.lit("precedent_probe").alias("kind"), F.lit("b").alias("pattern"))
    listed = F.when(i % 2 == 0, F.array(one, two)).otherwise(F.array(one))
    b = t.benchmark.withColumn("strategies", listed).withColumn(
        "intent", F.when(i % 3 == 0, "support").otherwise("counterevidence"))
    return b.select("item_id", fn.sha256(fn.rendered_query("text", "strategies", "intent"))
                    .alias("query_sha256"))


@query("F20_order_digest", sql="""
    SELECT conv_id, sha256('["' || string_agg(CAST(turn AS VARCHAR) || role, '","' ORDER BY turn,
        role) || '"]') AS order_sha256 FROM conversations GROUP BY conv_id""")
def _(t):
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))),
                        lambda x: F.concat(x["turn"].cast("string"), x["role"]))
    return t.conversations.groupBy("conv_id").agg(turns.alias("ids")).select(
        "conv_id", fn.order_digest("ids").alias("order_sha256"))


@query("F21_idempotency_keys", "strategies", sql="""
    SELECT strategy_id, 'strategy:' || strategy_id || ':proposed' AS proposed_key,
        sha256('{"evaluations":3,"from_status":"' || status || '","strategy_id":"' || strategy_id
        || '","successes":2,"to_status":"ACTIVE","wilson_lower":0.2}') AS transition_sha256
    FROM strategies""")
def _(t):
    return t.strategies.select(
        "strategy_id", fn.idempotency_key("strategy", F.col("strategy_id"), "proposed")
        .alias("proposed_key"),
        fn.transition_hash("strategy_id", "status", F.lit("ACTIVE"), F.lit(3), F.lit(2),
                           F.lit(0.2)).alias("transition_sha256"))


@query("F22_evidence_ref", "tasks", sql="""
    SELECT challenge_id, 'sha256:' || sha256(prompt) || '#challenge:' || challenge_id
        AS evidence_ref FROM tasks""")
def _(t):
    return t.tasks.select("challenge_id", fn.evidence_ref(fn.sha256("prompt"), "challenge_id")
                          .alias("evidence_ref"))


@query("F23_label_escape", sql=r"""
    SELECT page_id, sha256(replace(replace(replace(html, '\', '\\'), chr(10), '\n'), '"', '\"'))
        AS escaped_sha256 FROM pages""")
def _(t):
    return t.pages.select("page_id", fn.sha256(fn.label_escape("html")).alias("escaped_sha256"))
