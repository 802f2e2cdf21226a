"""JSON-lines tables: scans that keep, reject or fail on bad lines, and sinks."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from veriledge.functions import scalars as fn
from veriledge.functions.contracts import ContractError
from veriledge.operators.score import dataset_digest
from veriledge.operators.tables import variant_type


# The bytes of one UTF-8 character, in hexadecimal.
_UTF8 = ("[0-7][0-9A-F]|(?:C[2-9A-F]|D[0-9A-F])[89AB][0-9A-F]|E0[AB][0-9A-F][89AB][0-9A-F]"
         "|(?:E[1-9A-CEF][89AB]|ED[89])[0-9A-F][89AB][0-9A-F]"
         "|(?:F0[9AB]|F[1-3][89AB]|F48)[0-9A-F](?:[89AB][0-9A-F]){2}")


def drop_undecodable(value: str | Column) -> Column:
    """A text as its bytes are read, without bytes that are no UTF-8."""
    text = F.col(value) if isinstance(value, str) else value
    kept = F.regexp_replace(F.hex(text.cast("binary")), rf"\G(?:({_UTF8})|[0-9A-F]{{2}})", "$1")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.unhex(kept).cast("string"))


def scan_lines(spark: SparkSession, path: str | list[str], lenient: bool = False) -> DataFrame:
    """Non-blank lines with their file and a position that follows the order in the file.

    ``lenient`` drops undecodable bytes; otherwise they become replacement characters.
    """
    raw = spark.read.text(path)
    if lenient:
        raw = raw.withColumn("value", drop_undecodable("value"))
    return raw.select(
        F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_path").alias("file"),
                 F.col("_metadata.file_block_start").alias("block"),
                 F.monotonically_increasing_id().alias("line")).alias("position"),
        F.regexp_replace("value", "^[﻿]", "").alias("value"),
    ).where(fn.collapse_spaces("value") != "")


def parse_rows(lines: DataFrame) -> DataFrame:
    """Add the parsed form ``v`` and ``problem`` (null, invalid_json or not_object)."""
    parsed = lines.withColumn("v", fn.parse_json_strict("value"))
    return parsed.withColumn(
        "problem", F.when(F.col("v").isNull(), "invalid_json")
        .when(variant_type(F.col("v")) != "object", "not_object"))


def _fail_on_problem(rows: DataFrame, label: str) -> None:
    bad = rows.where(F.col("problem").isNotNull()).select("problem", "value").limit(1).collect()
    if bad:
        raise ContractError(f"{label}: {bad[0]['problem']}: {bad[0]['value'][:120]}")


def read_jsonl_strict(spark: SparkSession, path, strict: bool = True
                      ) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects). ``strict`` raises when there is a reject."""
    rows = parse_rows(scan_lines(spark, path))
    if strict:
        _fail_on_problem(rows, str(path))
    return (rows.where(F.col("problem").isNull()).drop("problem"),
            rows.where(F.col("problem").isNotNull()).drop("v"))


def read_jsonl_nonempty(spark: SparkSession, path, label: str, strict: bool = True
                        ) -> tuple[DataFrame, DataFrame]:
    """As S01, and an empty input is an error."""
    rows, rejects = read_jsonl_strict(spark, path, strict)
    if rows.isEmpty():
        raise ContractError(f"{label}: input is empty")
    return rows, rejects


def read_jsonl_lenient(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """Invalid lines go to the side output; any JSON value is a row, bad bytes are dropped."""
    rows = parse_rows(scan_lines(spark, path, lenient=True))
    bad = F.col("problem") == "invalid_json"
    return (rows.where(~F.coalesce(bad, F.lit(False))).drop("problem"),
            rows.where(bad).drop("v"))


def read_jsonl_trusted(spark: SparkSession, path, schema: StructType | str) -> DataFrame:
    """Typed scan that fails on the first malformed line."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_audit_jsonl(spark: SparkSession, path) -> DataFrame:
    """Rows must be objects."""
    return read_jsonl_strict(spark, path)[0]


def typed(rows: DataFrame, schema: StructType) -> DataFrame:
    """Parsed rows as columns of a fixed schema; the JSON text stays as ``raw``."""
    value = F.from_json("value", schema)
    return rows.select(value.alias("r"), F.col("value").alias("raw")).select("r.*", "raw")


def json_lines(df: DataFrame) -> DataFrame:
    """One compact JSON text per row, null fields included as null."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
                     .alias("value"))


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """S06."""
    json_lines(df).write.mode(mode).text(path)


def canonical_lines(df: DataFrame) -> DataFrame:
    """Sorted-key JSON text per row, with numbers spelt as the exact canonical form spells them."""
    text = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    return df.select(fn.canonical_json(text, "exact").alias("value"))


def write_canonical_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> DataFrame:
    """Canonical lines plus the one-row digest of what was written."""
    lines = canonical_lines(df)
    lines.write.mode(mode).text(path)
    written = df.sparkSession.read.text(path)
    return dataset_digest(written, F.col("value")).crossJoin(
        written.agg(F.count(F.lit(1)).alias("rows")))  # one row each


def write_json_report(report: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A small report table as one JSON file with sorted fields.

    Only the finished rows go to one task; what computes them stays as parallel as it is.
    """
    report.select(*sorted(report.columns)).repartition(1).write.mode(mode).json(path)
