"""Treatment registry, summary reshaping and table catalogue checks."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriledge import schemas as S
from veriledge.functions.contracts import (
    ContractError, Rule, any_of, duplicated, with_violations,
)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.METHOD_REGISTRY).option("multiLine", "true").json(path)


def method_registry(registry: DataFrame) -> DataFrame:
    """One row per method with its budget and violations."""
    flat = registry.select("schema_version", "budget", F.explode("methods").alias("m")).select(
        "schema_version", F.col("budget.max_calls").alias("max_calls"),
        F.col("budget.max_tokens").alias("max_tokens"), "m.*")
    marked = duplicated(flat, ["method_id"], "__dup")
    flags = ("support_retrieval", "external_counter_retrieval", "cedg")
    mode, counter = F.col("decision_mode"), F.col("external_counter_retrieval")
    rules = [
        Rule("schema_version", F.coalesce(F.col("schema_version") != 1, F.lit(True))),
        Rule("duplicate_method", F.col("__dup")),
        Rule("fields", any_of([F.col(f).isNull() for f in (*flags, "method_id")])),
        Rule("memory", F.coalesce(~F.col("memory").isin(*S.MEMORY_MODES), F.lit(True))),
        Rule("decision_mode", F.coalesce(~mode.isin(*S.DECISION_MODES), F.lit(True))),
        Rule("self_critic_with_counter", (mode == "self_critic") & counter),
        Rule("verifier_without_counter", (mode == "verifier") & ~counter),
        Rule("budget", any_of([F.coalesce(F.col(f) < 0, F.lit(True))
                               for f in ("max_calls", "max_tokens")])),
    ]
    return with_violations(marked, rules).drop("__dup")


def load_method(registry: DataFrame, method_id: str) -> DataFrame:
    """Exactly one clean row for ``method_id``, or an error."""
    found = method_registry(registry).where(F.col("method_id") == method_id)
    rows = found.select("violations").limit(2).collect()
    if len(rows) != 1:
        raise ContractError(f"method {method_id!r} is missing or duplicated")
    if rows[0]["violations"]:
        raise ContractError(f"method {method_id!r}: {rows[0]['violations'][0]['code']}")
    return found.drop("violations")


def summary_long(summaries: DataFrame, metrics: list[str], id_column: str = "method_id",
                 strict: bool = True) -> DataFrame:
    """(method, metric, value). Summaries must be flagged as not scientific."""
    flag = ~F.coalesce(F.col("scientific_result") == F.lit(False), F.lit(False))
    if strict and not summaries.where(flag).isEmpty():
        raise ContractError("unexpected scientific status")
    numbers = summaries.select(id_column, *[F.col(m).cast("double").alias(m) for m in metrics])
    return numbers.unpivot([id_column], metrics, "metric", "value")


def table_violations(name: str, tables: dict[str, DataFrame]) -> DataFrame:
    """Broken keys, references and not-null columns of one runtime table.

    Returns (table, rule, key, rows). Keys are counted map-side; references are anti-joins.
    """
    spec, df = S.RUNTIME_TABLES[name], tables[name]

    def rows(found, rule, key, count):
        return found.select(F.lit(name).alias("table"), F.lit(rule).alias("rule"),
                            key.alias("key"), count.cast("bigint").alias("rows"))

    def joined(columns):
        return F.concat_ws("|", *[F.col(c).cast("string") for c in columns])

    required = [c for c in spec["schema"].fieldNames()
                if c not in spec["nullable"] and c in df.columns]
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required])
    out = rows(nulls.unpivot([], required, "c", "n").where("n > 0"), "not_null", F.col("c"),
               F.col("n"))
    for key in spec["keys"]:
        repeated = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        out = out.unionByName(rows(repeated, "unique:" + ",".join(key), joined(key),
                                   F.col("n")))
    for columns, other, target in spec["refs"]:
        known = tables[other].select(*[F.col(t).alias(c) for t, c in zip(target, columns)])
        lost = (df.join(known.distinct(), list(columns), "left_anti").groupBy(*columns)
                .agg(F.count(F.lit(1)).alias("n")))
        out = out.unionByName(rows(lost, f"reference:{other}", joined(columns), F.col("n")))
    return out


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    """An empty DataFrame with the schema of a runtime table."""
    return spark.createDataFrame([], S.RUNTIME_TABLES[name]["schema"])
