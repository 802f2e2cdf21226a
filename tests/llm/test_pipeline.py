"""Stages on a small fixture: their decisions take effect and clean documents stay."""
import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(5)
    words = {"aa": "alo bero cima doru fen gam".split(), "bb": "xen yuk zor weft vim sul".split()}
    rows = []
    for i in range(120):
        lang = "ab"[i % 2] * 2
        rows.append((i, " ".join(rng.choice(words[lang]) + str(rng.choice("xyz")) for _ in range(60)),
                     lang, f"s{i % 4}"))
    item = " ".join(f"bench{rng.randrange(50)}" for _ in range(30))
    rows += [(200, rows[3][1], "bb", "s0"), (201, rows[3][1] + " tail", "bb", "s1"),
             (202, rows[5][1] + " " + item, "bb", "s2"), (203, None, "aa", "s0"), (204, "12 34", "aa", "s0")]
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows],
                          "doc_id long, text string, lang string, source string, n_chars int"
                          ).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(
        f"{folder}/benchmark.parquet")
    return str(folder)


def test_each_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    one = stages["language_id"](spark, docs, sf_dir)
    assert {r["doc_id"] for r in one.collect()} == set(range(120)) | {200, 201, 202}
    two = stages["ngram_jaccard_join"](spark, one, sf_dir)
    assert {r["doc_id"] for r in two.collect()} == set(range(120)) | {202}
    three = stages["benchmark_decontamination"](spark, two, sf_dir)
    assert {r["doc_id"] for r in three.collect()} == set(range(120))
    four = stages["mix_sources"](spark, three, sf_dir)
    assert one.columns == two.columns == three.columns == four.columns == docs.columns
    sizes = {r["source"]: r["n"] for r in three.groupBy("source").agg({"doc_id": "count"})
             .withColumnRenamed("count(doc_id)", "n").collect()}
    taken = {r["source"]: r["n"] for r in four.groupBy("source").agg({"doc_id": "count"})
             .withColumnRenamed("count(doc_id)", "n").collect()}
    level = 120 / 13
    for source, weight in zip(sorted(sizes), (5, 2, 1, 5)):
        assert abs(taken.get(source, 0) - level * weight) <= 1.01
    five = stages["token_ids"](spark, four, sf_dir)
    assert five.count() == four.count()


def test_run_and_empty_documents(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    done = corpus_pipeline.run(spark, sf_dir)
    assert done.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and done.count() > 100


def test_odd_rows_and_clashing_columns_pass_all_stages(spark, sf_dir):
    """Null ids, repeated rows, a very long text, and columns with the names that stages use."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rng = random.Random(9)
    long = " ".join(f"{rng.choice(['alo', 'bero', 'cima'])}{i % 977}" for i in range(60_000))
    more = spark.createDataFrame(
        [(None, "alo bero cimax alox fenz gamy " * 3, "aa", None, 1), (None, None, None, None, None),
         (400, long, "aa", None, None), (400, long, "aa", None, None), (401, "", None, "s1", 0)], docs.schema)
    wide = docs.unionByName(more).withColumns({
        name: F.lit(7) for name in ("k", "row", "n", "g", "copies", "copy", "place", "s", "score", "component_id",
                                    "item_id", "size", "start")})
    before = wide
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.stored(stage(spark, before, sf_dir), f"test-{name}")
        assert after.columns == wide.columns, name
        assert after.where("k = 7 AND place = 7").count() == after.count() > 100
        before = after
        if name == "ngram_jaccard_join":
            assert after.where("doc_id = 400").count() == 1
            assert after.where("doc_id IS NULL").count() == 1
    last = corpus_pipeline.STAGES[-1][1](spark, before, sf_dir)
    assert last.count() == before.count()
