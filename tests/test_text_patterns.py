"""Patterns for white space and for texts that NFKC may change, over all code points."""
import re
import unicodedata

from pyspark.sql import functions as F

from veriledge.functions import scalars as fn


def test_patterns_over_all_code_points(spark):
    points = spark.range(0x110000).where("id < 55296 OR id >= 57344").selectExpr(
        "cast(id as int) AS id", "decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32') AS c")
    rows = points.select(
        "id", F.col("c").rlike(fn.nfkc_risky()).alias("risky"),
        fn.collapse_spaces(F.concat(F.lit("a"), "c", F.lit("b"))).alias("space")).where(
        "risky OR space = 'a b'").collect()
    risky = {r["id"] for r in rows if r["risky"]}
    changed = {i for i in range(0x110000) if not 0xD800 <= i < 0xE000 and (
        unicodedata.combining(chr(i)) or unicodedata.normalize("NFKC", chr(i)) != chr(i))}
    assert changed <= risky and not risky & set(range(0xA0)) and len(risky) < len(changed) + 400
    assert {r["id"] for r in rows if r["space"] == "a b"} == {
        i for i in range(0x110000) if chr(i).isspace()}


def test_runs_become_one_space(spark):
    texts = ["a b", " a  b ", "a\t b", "a \u3000b", "\u00a0a\u2003 \n b\x1c", "", " ", "a\u200bb"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(
        fn.collapse_spaces("t")).collect()]
    assert got == [" ".join(t.split()) for t in texts]


def test_an_engine_compares_a_few_bounds_only():
    """A flat class has hundreds of members, and each character of a text is tried against all."""
    flat = [re.findall(r"\\x\{[0-9A-F]+\}-", part) for part in re.split(r"[\[\]]", fn.nfkc_risky())]
    assert max(map(len, flat)) <= 4
