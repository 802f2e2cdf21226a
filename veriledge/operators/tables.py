"""Table operations on schemaless JSON rows, and search-audit checks.

A JSON table is a DataFrame with a ``value`` text column and its parsed form ``v`` (variant).
"""
from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriledge.functions import scalars as fn
from veriledge.functions.contracts import Rule, duplicated, with_violations


def _path(dotted: str) -> str:
    return "$" + "".join(f"['{part}']" for part in dotted.split("."))


def variant_type(value: Column) -> Column:
    """JSON type name: object, array, string, boolean, integer, number or null."""
    kind = F.schema_of_variant(value)
    whole = kind.rlike(r"^(BIGINT|DECIMAL\(\d+,0\))$")
    return (F.when(value.isNull(), F.lit(None))
            .when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array")
            .when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean")
            .when(kind == "VOID", "null").when(whole, "integer").otherwise("number"))


def merge(*tables: DataFrame) -> DataFrame:
    """Concatenation; duplicates stay, absent columns become null."""
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table, allowMissingColumns=True)
    return out


def coverage_diff(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys found on one side only."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return (a.join(b, key, "left_anti").withColumn("side", F.lit("missing"))
            .unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("unknown"))))


def evidence_intersect(left: str | Column, right: str | Column) -> Column:
    """Set intersection of two arrays."""
    return F.array_intersect(left, right)


def dotted(field: str, variant: str = "v") -> Column:
    """Value at a dotted path as text, null where the path is absent."""
    return F.try_variant_get(F.col(variant), _path(field), "string")


def filter_eq(df: DataFrame, where: str, variant: str = "v") -> DataFrame:
    """``a.b=v`` over a JSON table. Both sides are compared as trimmed text; booleans are
    spelled True/False and an absent or null path is the text None."""
    field, _, wanted = where.partition("=")
    path = _path(field.strip())
    text = F.try_variant_get(F.col(variant), path, "string")
    flag = F.try_variant_get(F.col(variant), path, "variant")
    is_flag = F.schema_of_variant(flag) == "BOOLEAN"
    spelled = F.when(is_flag, F.initcap(text)).otherwise(F.coalesce(text, F.lit("None")))
    return df.where(F.coalesce(spelled, F.lit("None")) == wanted.strip())


def dedup_key(df: DataFrame, key: Column, order: str) -> DataFrame:
    """The first row per key by ``order``; rows without a key stay.

    The first row is a map-side combined minimum over (order, row digest, row), so a key shared by
    a large part of the table does not gather in one task, and equal order values leave one row.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    keyed = df.select(row.alias("__row"), key.alias("__key"), F.col(order).alias("__order"))
    first = (keyed.where(F.col("__key").isNotNull()).groupBy("__key").agg(F.min_by(
        "__row", F.struct("__order", F.xxhash64(F.to_json("__row")))).alias("__row")))
    return first.select("__row.*").unionByName(
        keyed.where(F.col("__key").isNull()).select("__row.*"))


def field_coverage(df: DataFrame, variant: str = "v") -> DataFrame:
    """A10: how many rows carry each top-level key."""
    entries = F.expr(f"map_keys(variant_get({variant}, '$', 'map<string,variant>'))")
    return (df.where(variant_type(F.col(variant)) == "object")
            .select(F.explode(entries).alias("field"))
            .groupBy("field").agg(F.count(F.lit(1)).alias("rows")))


# --- schema subset ---------------------------------------------------------------------------

def schema_errors(schema: dict, value: Column, path: str = "row") -> Column:
    """Compile a JSON-schema subset into one Column of error texts for a variant.

    Supported: type, enum, anyOf, required, properties, items, minItems. A wrong type ends the
    descent at that place. Nested arrays are walked with higher-order functions in the same row.
    """
    kind = variant_type(value)
    declared = schema.get("type")
    empty = F.array().cast("array<string>")
    parts: list[Column] = []

    if "enum" in schema:
        canonical = F.to_json(value)
        allowed = [json.dumps(item, ensure_ascii=False, separators=(",", ":"))
                   for item in schema["enum"]]
        parts.append(F.when(~canonical.isin(*allowed), F.array(F.lit(f"{path}: enum"))))
    if "anyOf" in schema:
        options = [F.size(schema_errors(option, value, path)) > 0
                   for option in schema["anyOf"]]
        failed_all = options[0]
        for option in options[1:]:
            failed_all = failed_all & option
        parts.append(F.when(failed_all, F.array(F.lit(f"{path}: anyOf"))))

    object_like = declared == "object" or (
        declared is None and ("required" in schema or "properties" in schema))
    if object_like:
        inner = []
        for name in schema.get("required", []):
            absent = F.try_variant_get(value, _path(name), "variant").isNull() & ~_has(value, name)
            inner.append(F.when(absent, F.array(F.lit(f"{path}.{name}: required"))))
        for name, sub in schema.get("properties", {}).items():
            member = F.try_variant_get(value, _path(name), "variant")
            inner.append(F.when(_has(value, name),
                                schema_errors(sub, member, f"{path}.{name}")))
        for item in inner:
            parts.append(F.when(kind == "object", item))
    elif declared == "array":
        members = F.try_variant_get(value, "$", "array<variant>")
        if schema.get("minItems"):
            parts.append(F.when(F.size(members) < schema["minItems"],
                                F.array(F.lit(f"{path}: minItems"))))
        if schema.get("items"):
            parts.append(F.flatten(F.transform(
                members, lambda item: schema_errors(schema["items"], item, f"{path}[]"))))

    found = F.flatten(F.array(empty, *[F.coalesce(part, empty) for part in parts]))
    if declared is None:
        return found
    accepted = {"number": ["integer", "number"]}.get(declared, [declared])
    wrong = ~F.coalesce(kind, F.lit("null")).isin(*accepted)
    return F.when(wrong, F.array(F.lit(f"{path}: type {declared}"))).otherwise(found)


def _has(value: Column, name: str) -> Column:
    keys = F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))
    return F.coalesce(F.array_contains(keys, name), F.lit(False))


def validate_schema(df: DataFrame, schema: dict, variant: str = "v") -> DataFrame:
    """P02 per row; an array schema is applied to the rows it would contain."""
    item = schema.get("items", schema)
    return df.withColumn("errors", schema_errors(item, F.col(variant)))


def schema_summary(validated: DataFrame) -> DataFrame:
    bad = F.count_if(F.size("errors") > 0)
    return validated.agg(F.count(F.lit(1)).alias("rows"), bad.alias("invalid"),
                         (bad == 0).alias("ok"))


# --- search audit ----------------------------------------------------------------------------

def audited_queries(audit: DataFrame) -> DataFrame:
    """Normalised queries found in the audit log of searches."""
    return (audit.where(F.col("tool").isin("agentic-search", "meta-search"))
            .where(F.coalesce("query", F.lit("")) != "")
            .select(fn.normalize_query("query").alias("norm")).distinct())


def undeclared_queries(audit: DataFrame, declared: DataFrame,
                       expected_files: DataFrame | None = None) -> DataFrame:
    """Declared counter-queries that were never searched.

    ``declared``: file, id, queries array. A file named in ``expected_files`` that declared
    nothing readable is a finding of its own.
    """
    exploded = (declared.select("file", "id", F.explode("queries").alias("query"))
                .where(F.trim("query") != "")
                .withColumn("norm", fn.normalize_query("query")))
    missing = exploded.join(audited_queries(audit), "norm", "left_anti").select(
        "file", "id", "query")
    if expected_files is not None:
        absent = (expected_files.select("file").distinct()
                  .join(declared.select("file").distinct(), "file", "left_anti")
                  .select("file", F.lit("?").alias("id"), F.lit("<FILE_MISSING>").alias("query")))
        missing = missing.unionByName(absent)
    return missing


def counter_subset(outputs: DataFrame) -> DataFrame:
    """Rows whose counter-evidence documents were not all among the checked ones."""
    stray = F.array_except(F.coalesce("counter_docs", F.array().cast("array<string>")),
                           F.coalesce("checked_docs", F.array().cast("array<string>")))
    return outputs.where(F.coalesce("candidate_id", F.lit("")) != "").where(
        F.size(stray) > 0).select("file", F.col("candidate_id").alias("id"))


def missing_replays(audit: DataFrame, declared: DataFrame) -> DataFrame:
    """C05, our rule: each hit of a searched counter-query is read later on.

    ``audit``: ts, tool, query, doc_id, hits array<string> (document ids).
    """
    counter = (declared.select("file", "id", F.explode("queries").alias("query"))
               .select("file", "id", fn.normalize_query("query").alias("norm")).distinct())
    hits = (audit.where(F.col("tool").isin("agentic-search", "meta-search"))
            .select(fn.normalize_query("query").alias("norm"), "ts",
                    F.explode("hits").alias("doc_id"))
            .groupBy("norm", "doc_id").agg(F.min("ts").alias("searched_at")))
    reads = (audit.where(F.col("tool") == "content").groupBy("doc_id")
             .agg(F.max("ts").alias("last_read")))
    unread = (hits.join(reads, "doc_id", "left")
              .where(F.col("last_read").isNull() | (F.col("last_read") < F.col("searched_at")))
              .select("norm").distinct())
    return counter.join(unread, "norm", "left_semi").select(
        "file", "id").distinct()


def stale_artifacts(audit: DataFrame, declared: DataFrame, files: DataFrame) -> DataFrame:
    """C05, our rule: an output file must not be older than the last read of a hit of one of its
    counter-queries. ``files``: file, modified_at."""
    counter = (declared.select("file", F.explode("queries").alias("query"))
               .select("file", fn.normalize_query("query").alias("norm")).distinct())
    hits = (audit.where(F.col("tool").isin("agentic-search", "meta-search"))
            .select(fn.normalize_query("query").alias("norm"), F.explode("hits").alias("doc_id"))
            .distinct())
    reads = (audit.where(F.col("tool") == "content").groupBy("doc_id")
             .agg(F.max("ts").alias("last_read")))
    last = (hits.join(reads, "doc_id").groupBy("norm").agg(F.max("last_read").alias("last_read")))
    newest = (counter.join(last, "norm").groupBy("file")
              .agg(F.max("last_read").alias("last_read")))
    return files.join(newest, "file").where(F.col("modified_at") < F.col("last_read")).select(
        "file")


def audit_queries(audit: DataFrame, declared: DataFrame, outputs: DataFrame,
                  files: DataFrame) -> DataFrame:
    """All findings of the search audit as (finding, file, id)."""
    def tagged(df, name):
        if "id" not in df.columns:
            df = df.withColumn("id", F.lit(""))
        return df.select(F.lit(name).alias("finding"), "file", "id")

    return merge(
        tagged(undeclared_queries(audit, declared, files), "MISSING"),
        tagged(missing_replays(audit, declared), "MISSING_REPLAY"),
        tagged(counter_subset(outputs), "INVALID_COUNTER_SUBSET"),
        tagged(stale_artifacts(audit, declared, files), "STALE_DECISION_ARTIFACT"),
    )


def check_unique(df: DataFrame, keys: list[str], code: str) -> DataFrame:
    marked = duplicated(df, keys, "__dup")
    return with_violations(marked, [Rule(code, F.col("__dup"), F.concat_ws(
        ",", *[F.col(k).cast("string") for k in keys]))]).drop("__dup")

