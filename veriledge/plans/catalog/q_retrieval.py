"""Retrieval: A13, J16-J18, K01, K02, P19-P21, C08, P15, P16."""
from __future__ import annotations

from pyspark.sql import functions as F

from veriledge.functions import scalars as fn
from veriledge.functions.contracts import violation_codes
from veriledge.operators import retrieve, rows
from veriledge.plans import composites
from veriledge.plans.catalog.q_scalars import TERMS
from veriledge.plans.catalog.registry import query

_SCORED = f"""
    doc_terms AS (SELECT snapshot_id, publication_date, term, count(*) AS tf FROM (
        SELECT snapshot_id, publication_date, unnest({TERMS.format('content')}) AS term
        FROM corpus) GROUP BY 1, 2, 3),
    frequency AS (SELECT term, count(*) AS df FROM doc_terms GROUP BY term),
    query_terms AS (SELECT query_id, cutoff_date, term, count(*) AS qtf FROM (
        SELECT query_id, cutoff_date, unnest({TERMS.format('query')}) AS term FROM q)
        GROUP BY 1, 2, 3),
    scored AS (SELECT x.query_id, d.snapshot_id, round(sum(least(x.qtf, d.tf) * (ln(
        ((SELECT count(*) FROM corpus) + 1) / (f.df + 1)) + 1)), 6) AS score
        FROM query_terms x JOIN doc_terms d ON d.term = x.term
             AND d.publication_date <= x.cutoff_date
        JOIN frequency f ON f.term = x.term GROUP BY 1, 2)"""
_TASK_QUERIES = ("q AS (SELECT challenge_id AS query_id, prompt AS query, cutoff_date "
                 "FROM tasks)")


def task_queries(t):
    return t.tasks.select(F.col("challenge_id").alias("query_id"),
                          F.col("prompt").alias("query"), "cutoff_date")


@query("K01_lexical_topk", "corpus", "tasks", sql=f"""WITH {_TASK_QUERIES}, {_SCORED}
    SELECT query_id, CAST(rank AS INTEGER) AS rank, snapshot_id, score FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, snapshot_id)
            AS rank FROM scored WHERE score <> 0) WHERE rank <= 3""")
def lexical(t):
    return retrieve.lexical_topk(task_queries(t), t.corpus, 3, digits=6)


@query("J18_lexical_term_join", "corpus", "tasks", sql=f"""WITH {_TASK_QUERIES}, {_SCORED}
    SELECT query_id, count(*) AS documents, round(sum(score), 3) AS total FROM scored
    GROUP BY query_id""")
def _(t):
    return retrieve.lexical_scores(task_queries(t), t.corpus).groupBy("query_id").agg(
        F.count(F.lit(1)).alias("documents"),
        F.round(F.sum(F.round("score", 6)), 3).alias("total"))


@query("A13_document_frequency", "corpus", sql=f"""
    SELECT term, count(DISTINCT snapshot_id) AS df FROM (
        SELECT snapshot_id, unnest({TERMS.format('content')}) AS term FROM corpus)
    GROUP BY term""")
def _(t):
    return retrieve.document_frequency(t.corpus)


@query("P19_cutoff_filter", sql="""
    SELECT doc_id FROM (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN NULL
        ELSE date '2015-01-01' + CAST(doc_id % 3650 AS INT) END AS published FROM documents)
    WHERE published <= date '2016-06-30'""")
def _(t):
    d = t.documents.select("doc_id", F.when(F.col("doc_id") % 10 != 0, F.date_add(
        F.lit("2015-01-01").cast("date"), (F.col("doc_id") % 3650).cast("int")))
        .alias("published"), F.lit("2016-06-30").cast("date").alias("cutoff_date"))
    return retrieve.cutoff_filter(d).select("doc_id")


@query("P20_metadata_filter", sql="""
    SELECT doc_id FROM documents WHERE lang = 'en' AND source = 'src3'
        AND 2000 + doc_id % 20 BETWEEN 2003 AND 2016""")
def _(t):
    d = t.documents.withColumn("year", 2000 + F.col("doc_id") % 20)
    return retrieve.metadata_filter(d, lang="en", venue="src3", venue_col="source",
                                    year_from=2003, year_to=2016).select("doc_id")


@query("P21_content_slice", sql="""
    SELECT conv_id, turn, role, d.doc_id, sha256(substr(d.text, CAST(turn * 10 + 1 AS BIGINT), 200))
        AS slice_sha256
    FROM conversations c JOIN documents d ON d.doc_id = c.conv_id""")
def _(t):
    asks = t.conversations.select(
        "conv_id", "turn", "role", F.col("conv_id").alias("doc_id"),
        (F.col("turn") * 10).alias("offset"), F.lit(200).alias("limit"))
    return retrieve.content_slice(asks, t.documents).select(
        "conv_id", "turn", "role", "doc_id", fn.sha256("slice").alias("slice_sha256"))


def _searches(t):
    """Each conversation is a search whose hits are documents near its number."""
    i = F.col("conv_id")
    null = F.lit(None).cast("string")

    def hit(doc, offset, date, year):
        return F.struct(doc.alias("doc_id"), offset.cast("bigint").alias("offset"),
                        null.alias("publication_date"), date.alias("publication_published_date"),
                        null.alias("published_at"), year.alias("publication_published_year"),
                        null.alias("year"))

    def doc(n):
        return F.concat(F.lit("d"), n.cast("string"))

    one_year = F.concat(F.lit("20"), F.lpad((i % 30).cast("string"), 2, "0"))
    hits = F.array(
        hit(doc(i), F.lit(0), F.lit("2019-06-01T00"), null),
        hit(doc(i), F.lit(0), F.lit("2018-06-01"), null),
        hit(doc(i + 1), F.lit(5), null, one_year),
        hit(doc(i + 2), F.when(i % 4 == 0, -1).otherwise(7), F.lit("2010-01-01"), null),
        hit(F.lit(" "), F.lit(0), F.lit("2010-01-01"), null))
    return t.conversations.where("turn = 0").select(
        F.concat(F.lit("q"), i.cast("string")).alias("query_id"),
        F.lit("2020-06-30").cast("date").alias("cutoff_date"), hits.alias("hits"))


@query("K02_reread_passages", "corpus", sql="""
    WITH s AS (SELECT DISTINCT conv_id FROM conversations WHERE turn = 0),
    hits AS (
        SELECT conv_id, 0 AS position, conv_id AS doc, 0 AS off, date '2019-06-01' AS pub FROM s
        UNION ALL SELECT conv_id, 2, conv_id + 1, 5, make_date(2000 + conv_id % 30, 12, 31) FROM s
        UNION ALL SELECT conv_id, 3, conv_id + 2, 7, date '2010-01-01' FROM s
        WHERE conv_id % 4 <> 0),
    p AS (SELECT 'q' || conv_id AS query_id, position, 'd' || doc AS doc_id, off, pub,
        trim(substr(content, off + 1, 4000)) AS text
        FROM hits JOIN corpus c ON c.doc_id = doc WHERE pub <= date '2020-06-30')
    SELECT query_id, CAST(position AS INTEGER) AS position, 'obs-' || substr(sha256(query_id || '|'
        || doc_id || '|' || off || '|' || sha256(text)), 1, 32) AS passage_id,
        CAST(pub AS VARCHAR) AS publication_date FROM p WHERE text <> ''""")
def _(t):
    docs = t.corpus.select(F.col("snapshot_id").alias("doc_id"), F.col("content").alias("text"))
    return retrieve.reread_passages(_searches(t), docs, k=5).select(
        "query_id", "position", "passage_id", F.col("publication_date").cast("string")
        .alias("publication_date"))


@query("J17_response_replay", "operations", sql="""
    WITH asks AS (SELECT 'op' || (event_id + CASE WHEN event_id % 9 = 0 THEN 100000000 ELSE 0 END)
        AS operation_id, sha256('req' || (event_id - CASE WHEN event_id % 8 = 0 THEN 1 ELSE 0
        END)) AS request_sha256, event_id FROM events)
    SELECT a.event_id, CASE WHEN o.operation_id IS NULL THEN 'miss'
        WHEN o.request_sha256 <> a.request_sha256 THEN 'digest_conflict'
        WHEN o.status IN ('PENDING', 'ABANDONED') THEN 'indeterminate'
        WHEN o.status = 'RETRY_AUTHORIZED' THEN 'retry_authorized' ELSE 'hit' END AS outcome,
        CASE WHEN o.request_sha256 = a.request_sha256 AND o.status = 'COMPLETED'
             THEN o.response_json END AS response
    FROM asks a LEFT JOIN operations o ON o.operation_id = a.operation_id""")
def _(t):
    i = F.col("event_id")
    asks = t.events.select(
        "event_id", F.concat(F.lit("op"), (i + F.when(i % 9 == 0, 100000000).otherwise(0))
                             .cast("string")).alias("operation_id"),
        fn.sha256(F.concat(F.lit("req"), (i - F.when(i % 8 == 0, 1).otherwise(0))
                           .cast("string"))).alias("request_sha256"))
    return retrieve.response_replay(asks, t.operations).select("event_id", "outcome", "response")


_RUN = f"""WITH q AS (
        SELECT challenge_id || '#support' AS query_id,
            prompt || ' evidence result mechanism' AS query, cutoff_date FROM tasks
        UNION ALL SELECT challenge_id || '#counterevidence',
            prompt || ' limitation failure counterexample boundary precedent', cutoff_date
        FROM tasks), {_SCORED},
    top AS (SELECT split_part(query_id, '#', 1) AS challenge_id,
            split_part(query_id, '#', 2) AS intent, snapshot_id, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, snapshot_id)
            AS rank FROM scored WHERE score <> 0) WHERE rank <= 3),
    firsts AS (SELECT challenge_id,
            max(CASE WHEN intent = 'support' THEN snapshot_id END) AS support,
            max(CASE WHEN intent = 'counterevidence' THEN snapshot_id END) AS counter
        FROM top WHERE rank = 1 GROUP BY challenge_id),
    m AS (SELECT DISTINCT 'method' || (s_nationkey % 2) AS method_id, s_nationkey % 2 = 1 AS ext
          FROM supplier),
    decided AS (SELECT t.challenge_id, m.method_id, m.ext, support, counter, CASE
            WHEN support IS NULL THEN 'UNRESOLVED' WHEN NOT m.ext THEN 'SURVIVED'
            WHEN counter IS NULL THEN 'UNRESOLVED' ELSE 'REFUTED' END AS decision
        FROM tasks t CROSS JOIN m LEFT JOIN firsts f ON f.challenge_id = t.challenge_id),
    cited AS (SELECT challenge_id, method_id, ext, decision, CASE
            WHEN decision = 'SURVIVED' THEN support WHEN decision = 'REFUTED' THEN counter END
            AS snapshot_id FROM decided)"""


def _decisions(t):
    passages = composites.retrieve_for_tasks(t.tasks, t.corpus)
    return passages, composites.rule_decisions(t.tasks, t.methods(), passages)


@query("C08_rule_decisions", "corpus", "tasks", sql=_RUN + """
    SELECT challenge_id, method_id, decision, snapshot_id || CASE WHEN decision = 'SURVIVED'
        THEN '@support-0' ELSE '@counterevidence-0' END AS cited FROM cited""")
def _(t):
    _, decisions = _decisions(t)
    return decisions.select("challenge_id", "method_id", "decision",
                            F.get("evidence", F.lit(0))["passage_id"].alias("cited"))


@query("J16_resolve_citations", "corpus", "tasks", sql=_RUN + """
    SELECT c.challenge_id, c.method_id, 'doi:' || k.doi AS doc_id, k.content_sha256
    FROM cited c JOIN corpus k ON k.snapshot_id = c.snapshot_id""")
def _(t):
    passages, decisions = _decisions(t)
    found = retrieve.resolve_citations(decisions, passages)
    return found.select("challenge_id", "method_id", F.explode("citations").alias("c")).select(
        "challenge_id", "method_id", "c.doc_id", "c.content_sha256")


@query("C09_run_methods", "corpus", "tasks", sql=_RUN + """
    SELECT c.challenge_id, c.method_id, sha256('{"calls":' || CASE WHEN ext THEN 2 ELSE 1 END
        || ',"challenge_id":"' || c.challenge_id || '","counterevidence_probability":'
        || CASE decision WHEN 'SURVIVED' THEN '0.1' WHEN 'REFUTED' THEN '0.9' ELSE '0.5' END
        || ',"evidence":[' || COALESCE('{"content_sha256":"' || k.content_sha256
        || '","doc_id":"doi:' || k.doi || '","locator":{"offset":0},"relation":"'
        || CASE decision WHEN 'SURVIVED' THEN 'SUPPORTS' ELSE 'CONTRADICTS' END || '"}', '')
        || '],"method_id":"' || c.method_id || '","predicted_decision":"' || decision
        || '","run_id":"r:' || c.method_id || '","schema_version":1,"status":"completed",'
        || '"tokens":0}') AS commitment
    FROM cited c LEFT JOIN corpus k ON k.snapshot_id = c.snapshot_id""")
def _(t):
    return composites.run_methods(t.tasks, t.methods(), t.corpus, "r").select(
        "challenge_id", "method_id", F.col("prediction_commitment_sha256").alias("commitment"))


@query("C10_task_events", "corpus", "tasks", sql=_RUN + """,
    n AS (SELECT challenge_id, intent, count(*) AS n FROM top GROUP BY 1, 2)
    SELECT d.challenge_id, d.method_id, CASE WHEN ext THEN 1 ELSE 0 END
        + 1 + COALESCE(s.n, 0) + CASE WHEN ext THEN 1 + COALESCE(c.n, 0) ELSE 0 END
        + 1 + CASE WHEN ext AND decision <> 'UNRESOLVED' THEN 1 ELSE 0 END
        + CASE WHEN ext THEN 2 ELSE 0 END + CASE WHEN ext AND decision = 'SURVIVED' THEN 1
          ELSE 0 END AS events
    FROM decided d LEFT JOIN n s ON s.challenge_id = d.challenge_id AND s.intent = 'support'
    LEFT JOIN n c ON c.challenge_id = d.challenge_id AND c.intent = 'counterevidence'""")
def _(t):
    passages, decisions = _decisions(t)
    events = composites.task_events(decisions, passages, "bench", "r")
    return events.groupBy(F.split_part("job_id", F.lit(":"), F.lit(3)).alias("challenge_id"),
                          F.split_part("job_id", F.lit(":"), F.lit(2)).alias("method_id")).agg(
        F.count(F.lit(1)).alias("events"))


@query("P16_build_decision_requests", "corpus", "tasks", sql=_RUN + """
    SELECT t.challenge_id, m.method_id, count(*) FILTER (WHERE m.ext OR top.intent = 'support')
        AS passages, count(*) FILTER (WHERE m.ext OR top.intent = 'support') > 5 AS too_many
    FROM tasks t CROSS JOIN m LEFT JOIN top ON top.challenge_id = t.challenge_id
    GROUP BY 1, 2""")
def _(t):
    passages, _ = _decisions(t)
    built = rows.build_decision_requests(t.tasks, passages, t.methods(), max_passages=5)
    return built.select("challenge_id", "method_id", "passages", F.exists(
        "violations", lambda v: v["code"] == "too_many_passages").alias("too_many"))


@query("P13_validate_passages", "corpus", sql="""
    SELECT snapshot_id, concat_ws(',', CASE WHEN doc_id % 7 = 0 THEN 'locator_position' END,
        CASE WHEN doc_id % 5 = 0 THEN 'content_digest' END,
        CASE WHEN doc_id % 4 < 2 AND lag_dup > 1 THEN 'duplicate_passage_id' END) AS codes
    FROM (SELECT *, count(*) OVER (PARTITION BY source, CASE WHEN doc_id % 4 < 2
        THEN doc_id - doc_id % 4 ELSE doc_id END) AS lag_dup FROM
        (SELECT * REPLACE ('s' AS source) FROM corpus))""")
def _(t):
    i = F.col("doc_id")
    p = t.corpus.select(
        "snapshot_id", F.lit("c").alias("challenge_id"), F.lit("q").alias("query_id"),
        F.concat(F.lit("p"), F.when(i % 4 < 2, i - i % 4).otherwise(i).cast("string"))
        .alias("passage_id"),
        F.col("snapshot_id").alias("doc_id"), F.col("content").alias("text"),
        F.struct(F.when(i % 7 == 0, -1).otherwise(i).cast("bigint").alias("offset"),
                 F.lit(None).cast("bigint").alias("page_no")).alias("locator"),
        F.when(i % 5 == 0, fn.sha256("source")).otherwise(F.col("content_sha256"))
        .alias("content_sha256"))
    return rows.validate_passages(p).select("snapshot_id", violation_codes().alias("codes"))


@query("P15_parse_model_output", sql="""
    SELECT event_id, concat_ws(',', CASE WHEN event_id % 11 = 0 THEN 'metadata' END,
        CASE WHEN event_id % 5 = 1 THEN 'code_fence' END,
        CASE WHEN event_id % 5 = 2 THEN 'invalid_json' END,
        CASE WHEN event_id % 5 = 3 THEN 'fields' END,
        CASE WHEN event_id % 5 = 4 THEN 'query_type' END) AS codes,
        CASE WHEN event_id % 5 = 0 THEN event_type END AS first_query, event_id % 7 + 10 AS tokens
    FROM events""")
def _(t):
    i, kind = F.col("event_id"), F.col("event_type")
    good = F.concat(F.lit('{"queries":["'), kind, F.lit('","b"]}'))
    text = (F.when(i % 5 == 0, good).when(i % 5 == 1, F.concat(F.lit(" ```json "), good))
            .when(i % 5 == 2, F.lit('{"queries":'))
            .when(i % 5 == 3, F.lit('{"queries":["a"],"more":1}'))
            .otherwise(F.lit('{"queries":[1,"a"]}')))
    r = t.events.select(
        "event_id", text.alias("text"), (i % 7).alias("input_tokens"),
        F.lit(10).cast("bigint").alias("output_tokens"),
        F.when(i % 11 == 0, " ").otherwise(F.lit("r")).alias("request_id"))
    parsed = rows.parse_model_output(r, "plan")
    return parsed.select("event_id", violation_codes().alias("codes"), F.when(
        i % 5 == 0, F.get("queries", F.lit(0))).alias("first_query"), "tokens")


@query("P12_validate_query_plan", sql="""
    SELECT conv_id, concat_ws(',', CASE WHEN conv_id % 6 = 0 THEN 'usage' END,
        CASE WHEN n > 8 THEN 'query_count' END, CASE WHEN longest > 1000 OR blank THEN 'query_text'
        END) AS codes FROM (SELECT conv_id, count(*) AS n, max(length(text)) AS longest,
        bool_or(trim(text) = '') AS blank FROM conversations GROUP BY conv_id)""")
def _(t):
    plans = t.conversations.groupBy("conv_id").agg(F.collect_list("text").alias("queries"))
    plans = plans.withColumn("calls", F.when(F.col("conv_id") % 6 == 0, -1).otherwise(1)) \
        .withColumn("tokens", F.lit(5))
    return rows.validate_query_plan(plans).select("conv_id", violation_codes().alias("codes"))


@query("P14_validate_decisions", "predicted", sql="""
    SELECT challenge_id, method_id, concat_ws(',',
        CASE WHEN doc_id % 17 = 0 THEN 'decision' END,
        CASE WHEN doc_id % 13 = 0 THEN 'reason' END,
        CASE WHEN doc_id % 7 = 0 THEN 'cites_unexposed' END,
        CASE WHEN doc_id % 5 = 0 THEN 'cited_twice' END,
        CASE WHEN doc_id % 17 <> 0 AND predicted_decision IN ('SURVIVED', 'NARROWED')
             AND doc_id % 3 = 0 THEN 'boundary' END,
        CASE WHEN doc_id % 11 = 0 THEN 'strategy_kind' END,
        CASE WHEN doc_id % 2 = 0 THEN 'duplicate_strategy' END) AS codes FROM predicted""")
def _(t):
    i = F.col("doc_id")

    def cite(name):
        return F.struct(F.lit(name).alias("passage_id"), F.lit("SUPPORTS").alias("relation"))

    def plan(kind, pattern):
        return F.struct(kind.alias("kind"), F.lit(pattern).alias("pattern"))

    base = F.when(i % 7 == 0, F.array(cite("p9"))).otherwise(F.array(cite("p1")))
    second = F.when(i % 2 == 0, plan(F.lit("boundary_probe"), " A  b")).otherwise(
        plan(F.lit("boundary_probe"), "other"))
    third = F.when(i % 11 == 0, "guess").otherwise("precedent_probe")
    d = t.predicted.select(
        "challenge_id", "method_id",
        F.when(i % 17 == 0, "MAYBE").otherwise(F.col("predicted_decision")).alias("decision"),
        "counterevidence_probability",
        F.when(i % 5 == 0, F.concat(base, base)).otherwise(base).alias("evidence"),
        F.when(i % 13 == 0, "").otherwise(F.lit("r")).alias("reason"),
        F.when(i % 3 == 0, " ").otherwise(F.lit("b")).alias("boundary"), "calls", "tokens",
        F.array(plan(F.lit("boundary_probe"), "a b"), second, plan(third, "c"))
        .alias("strategy_candidates"),
        F.array(F.lit("p1"), F.lit("p2")).alias("exposed"))
    return rows.validate_decisions(d).select("challenge_id", "method_id",
                                             violation_codes().alias("codes"))
