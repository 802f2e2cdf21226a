"""The strict JSON value: its result and how often a text is parsed for it."""
from veriledge.functions import scalars as fn


def test_a_text_is_parsed_once_for_its_value(spark):
    texts = ['{"k": 0}', "[1]", "1 2", "", None, "x", '{"v":2} ', "null", '"a"}']
    rows = spark.createDataFrame([(t,) for t in texts], "value string")
    parsed = rows.select(fn.parse_json_strict("value").alias("v"))
    plan = parsed._jdf.queryExecution().optimizedPlan().toString().lower().replace("_", "")
    assert plan.count("parsejson") == 1
    assert [r[0] for r in parsed.selectExpr("to_json(v)").collect()] == [
        '{"k":0}', "[1]", None, None, None, None, '{"v":2}', "null", None]


def test_exact_texts_of_a_long_batch_leave_arrow_a_few_at_a_time(spark, monkeypatch):
    import json

    import pyarrow as pa

    held, kept = [], pa.array
    texts = ['{"b": 1.50, "a": "x\\u00e9"}', "[1e400]", None, "{", '"' + "y" * 50 + '\\t"'] * 500
    monkeypatch.setattr(pa, "array", lambda values, *a: held.append(len(values)) or kept(values, *a))
    found = fn._exact_json.func(kept(texts, pa.string())).to_pylist()
    assert max(held) <= 64 and len(found) == len(texts)
    assert found[:5] == ['{"a":"xé","b":1.5}', None, None, None, json.dumps("y" * 50 + "\t")]
    assert fn._exact_json.func(kept([], pa.string())).to_pylist() == []
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = rows.select("i", fn.canonical_json("t", "exact").alias("c")).orderBy("i").collect()
    assert [r["c"] for r in got[:5]] == found[:5]
