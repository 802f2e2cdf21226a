"""Search audit records, trace records and metric exposition."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriledge import schemas as S
from veriledge.functions import scalars as fn
from veriledge.operators.rows import fixed_vocabulary

HIT_FIELDS = (("doc_id", "doc_id"), ("chunk_id", "chunk_id"), ("title", "title"),
              ("offset", "offset"), ("page_no", "page_no"), ("score", "score"), ("doi", "doi"),
              ("year", "publication_published_year"),
              ("venue", "publication_venue_name_unified"))


def search_audit_log(responses: DataFrame) -> DataFrame:
    """Audit rows of search responses.

    ``responses``: ts, tool, query, request_id, hits_json (array text), started_ms, ended_ms.
    Nine fields of each hit are kept, the whole response only as a digest.
    """
    hits = F.try_variant_get(F.try_parse_json(F.col("hits_json")), "$", "array<variant>")
    kept = F.transform(hits, lambda h: F.struct(*[
        F.try_variant_get(h, f"$.{source}", "string").alias(name)
        for name, source in HIT_FIELDS]))
    return responses.select(
        "ts", F.lit(2).alias("schema_version"), "request_id", "tool", "query",
        F.coalesce(F.size(kept), F.lit(0)).alias("n_hits"), kept.alias("hits"),
        F.round(F.col("ended_ms") - F.col("started_ms"), 3).alias("latency_ms"),
        fn.sha256(fn.canonical_json("hits_json", "exact")).alias("response_sha256"))


def content_audit_log(reads: DataFrame) -> DataFrame:
    """S11 for content reads: ts, request_id, doc_id, offset, limit, text."""
    text = F.coalesce("text", F.lit(""))
    return reads.select(
        "ts", F.lit(2).alias("schema_version"), "request_id", F.lit("content").alias("tool"),
        "doc_id", "offset", "limit", F.lit(0).alias("n_hits"),
        F.octet_length(text).alias("bytes"), fn.sha256(text).alias("content_sha256"))


def trace_records(requests: DataFrame) -> DataFrame:
    """Trace rows from (occurred_at, traceparent, request_id, method, route, status,
    duration_seconds); ids the client did not send are derived from the request id."""
    context = fn.parse_traceparent("traceparent", "request_id")
    shaped = requests.withColumn("__t", context).select(
        F.lit(1).alias("schema_version"), "occurred_at", "__t.trace_id", "__t.span_id",
        "__t.parent_span_id", fn.sha256("request_id").alias("request_id_sha256"), "method",
        "route", "status", F.round(F.col("duration_seconds") * 1000, 6).alias("duration_ms"))
    return fixed_vocabulary(shaped)


def append_traces(requests: DataFrame, path: str, checkpoint: str, **options):
    """S14 sink: append valid records of a request stream."""
    valid = trace_records(requests).where(F.size("violations") == 0).drop("violations")
    return (valid.writeStream.format("json").outputMode("append")
            .option("checkpointLocation", checkpoint).options(**options)
            .trigger(availableNow=True).start(path))


def _labels(**pairs: str | Column) -> Column:
    parts = []
    for name, value in pairs.items():
        column = F.col(value) if isinstance(value, str) else value
        parts += [F.lit(("," if parts else "") + f'{name}="'),
                  fn.label_escape(column.cast("string")), F.lit('"')]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def _family(rows: DataFrame, name: str, order: Column, text: Column) -> DataFrame:
    return rows.select(F.lit(name).alias("family"), order.cast("string").alias("order"),
                       text.alias("line"))


def metrics_exposition(counts: DataFrame, histogram: DataFrame, snapshot: DataFrame,
                       prefix: str = "control") -> DataFrame:
    """Exposition lines (family, order, line) from A06 and A05 rows.

    Sorting by (family, order) gives the text; label values come from fixed vocabularies, so the
    output is small however large the log was.
    """
    http, lat = f"{prefix}_http_requests_total", f"{prefix}_http_request_duration_seconds"
    whole = F.format_string("%d", F.col("value").cast("bigint"))
    requests = _family(
        counts, http, F.concat_ws("|", "method", "route", F.col("status").cast("string")),
        F.concat(F.lit(http), _labels(method="method", route="route", status="status"),
                 F.lit(" "), F.col("requests").cast("string")))
    position = F.coalesce(F.array_position(
        F.array(*[F.lit(repr(e)) for e in S.LATENCY_BUCKETS], F.lit("+Inf")), F.col("le")),
        F.lit(0))
    series = F.when(F.col("series") == "bucket", 0).when(F.col("series") == "count", 1) \
        .otherwise(2)
    order = F.concat_ws("|", "method", "route", series.cast("string"),
                        F.lpad(position.cast("string"), 2, "0"))
    text = F.when(F.col("series") == "bucket", F.concat(
        F.lit(lat + "_bucket"), _labels(method="method", route="route", le="le"), F.lit(" "),
        whole)).when(F.col("series") == "count", F.concat(
            F.lit(lat + "_count"), _labels(method="method", route="route"), F.lit(" "), whole)
    ).otherwise(F.concat(F.lit(lat + "_sum"), _labels(method="method", route="route"),
                         F.lit(" "), F.format_string("%.9f", "value")))
    latency = _family(histogram, lat, order, text)
    grouped = {"jobs_by_status": (f"{prefix}_jobs", "status"),
               "jobs_by_stage": (f"{prefix}_jobs_by_stage", "stage")}
    name = F.coalesce(*[F.when(F.col("field") == f, F.lit(n)) for f, (n, _) in grouped.items()],
                      F.concat(F.lit(prefix + "_"), "field"))
    labels = F.coalesce(*[F.when(F.col("field") == f, _labels(**{label: "key"}))
                          for f, (_, label) in grouped.items()], F.lit(""))
    value = F.when(F.col("field") == "oldest_runnable_age_seconds",
                   F.col("value").cast("string")).otherwise(whole)
    gauges = snapshot.where(F.col("field") != "violation").select(
        name.alias("family"), F.col("key").alias("order"),
        F.concat(name, labels, F.lit(" "), value).alias("line"))
    return requests.unionByName(latency).unionByName(gauges)


def write_metrics(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    one = lines.repartition(1).sortWithinPartitions("family", "order")
    one.select("line").write.mode(mode).text(path)
