"""Row contracts: rules as Columns, reported in a ``violations`` array column.

A contract never stops at the first problem. It returns every row with the list of rules the row
breaks; ``strict`` restores fail-closed behaviour for callers that want an exception.
"""
from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """At least one row breaks a contract."""


@dataclass(frozen=True)
class Rule:
    code: str
    broken: Column
    detail: Column | None = None


def with_violations(df: DataFrame, rules: list[Rule], column: str = "violations") -> DataFrame:
    """Append the broken rules, in rule order; an existing array is extended."""
    none = F.array().cast("array<struct<code:string,detail:string>>")
    # Joined arrays are compiled as one; a filter over them would interpret every rule.
    kept = F.concat(*[
        F.when(F.coalesce(rule.broken, F.lit(False)), F.array(F.struct(
            F.lit(rule.code).alias("code"),
            (rule.detail if rule.detail is not None else F.lit(None)).cast("string")
            .alias("detail"),
        ))).otherwise(none)
        for rule in rules
    ])
    if column in df.columns:
        kept = F.concat(F.col(column), kept)
    return df.withColumn(column, kept)


def violation_codes(column: str = "violations") -> Column:
    """The codes as one comma separated string; empty for a clean row."""
    return F.array_join(F.transform(F.col(column), lambda item: item["code"]), ",")


def violations_table(df: DataFrame, keys: list[str], column: str = "violations") -> DataFrame:
    return (df.select(*keys, F.explode(column).alias("v"))
            .select(*keys, F.col("v.code").alias("code"), F.col("v.detail").alias("detail")))


def split_valid(df: DataFrame, column: str = "violations") -> tuple[DataFrame, DataFrame]:
    clean = df.where(F.size(column) == 0).drop(column)
    return clean, df.where(F.size(column) > 0)


def strict(df: DataFrame, column: str = "violations") -> DataFrame:
    """Raise when any row breaks a rule, otherwise return the rows without the column."""
    first = df.where(F.size(column) > 0).select(column).limit(1).collect()
    if first:
        item = first[0][column][0]
        raise ContractError(f"{item['code']}: {item['detail'] or ''}".rstrip(": "))
    return df.drop(column)


def is_missing(column: str | Column) -> Column:
    """Absent, null or the empty string; false, 0 and [] are present."""
    value = F.col(column) if isinstance(column, str) else column
    return value.isNull() | (value.cast("string") == "")


def is_blank(column: str | Column) -> Column:
    value = F.col(column) if isinstance(column, str) else column
    return value.isNull() | (F.trim(value.cast("string")) == "")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda left, right: left | right, conditions, F.lit(False))


def missing_fields(names) -> Rule:
    """One rule for all required fields; the detail lists the missing ones."""
    listed = F.array_join(F.filter(
        F.array(*[F.when(is_missing(name), F.lit(name)) for name in sorted(names)]),
        lambda item: item.isNotNull(),
    ), ", ")
    return Rule("missing_fields", listed != "", listed)


def duplicated(df: DataFrame, keys: list[str], flag: str = "is_duplicate",
               counted: DataFrame | None = None) -> DataFrame:
    """Mark rows whose key occurs more than once.

    The count is combined map-side and only repeated keys are joined back, so one very frequent
    key costs a counter, not a window over all its rows. ``counted`` are the same rows before other
    columns were joined to them: counting those does not repeat the joins.
    """
    repeated = ((df if counted is None else counted).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
                .where("__n > 1").select(*keys, F.lit(True).alias(flag)))
    return df.join(repeated, keys, "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))
