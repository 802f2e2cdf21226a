"""Postings are dealt by document, so a task's share does not grow with the corpus."""
from collections import Counter

from pyspark.sql import functions as F

from veriledge.operators import retrieve

ROWS = [("a", "xx yy xx, XX zz", "2019-01-01"), ("b", "zz " * 40 + "yy", "2019-01-02"), ("c", "", "2019-01-03"),
        ("d", None, "2019-01-04"), ("e", "the of qq", "2019-01-05"), ("e", "qq yy", "2019-01-05")]


def _corpus(spark, rows):
    return spark.createDataFrame(rows, "snapshot_id string, content string, publication_date string").withColumn(
        "publication_date", F.to_date("publication_date"))


def test_words_are_counted_inside_their_row_and_rows_of_one_document_add_up(spark):
    vocabulary = spark.createDataFrame([("xx",), ("yy",), ("zz",), ("qq",)], "term string")
    wanted = Counter()
    for name, text, _ in ROWS:
        wanted.update((name, w) for w in (text or "").lower().replace(",", " ").split() if w not in ("the", "of"))
    for documents in (None, len(ROWS)):
        found = retrieve.term_postings(_corpus(spark, ROWS), vocabulary, documents).collect()
        assert {(r["snapshot_id"], r["term"]): r["tf"] for r in found} == wanted
        assert len(found) == len(wanted)


def test_more_documents_make_more_tasks_not_larger_ones(spark, monkeypatch):
    monkeypatch.setattr(retrieve, "TASK_DOCUMENTS", 4)
    rows = [(f"d{i}", "xx yy " * (1 + i % 3), "2019-01-01") for i in range(80)]
    vocabulary = spark.createDataFrame([("xx",), ("yy",)], "term string")
    ask = spark.createDataFrame([("q", "xx yy", "2020-01-01")], "query_id string, query string, cutoff_date string")
    ask = ask.withColumn("cutoff_date", F.to_date("cutoff_date"))
    for n in (40, 80):
        docs = _corpus(spark, rows[:n])
        postings = retrieve.block_postings(docs, vocabulary, n)
        weighted = retrieve.weighted_query_terms(ask, docs, postings, n)
        for df in (postings, retrieve.block_bounds(weighted, postings, n), retrieve.lexical_scores(ask, docs)):
            assert df.rdd.getNumPartitions() == n // 4
    assert retrieve.lexical_scores(ask, docs).count() == 80
