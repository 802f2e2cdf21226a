import hashlib

from pyspark.sql import functions as F

from veriledge.llm.stream_dedup import stream_dedup, stream_state


def written(df, path, files=3):
    df.repartition(files).write.parquet(str(path))
    return str(path)


def rows_of(df):
    return sorted((tuple(r) for r in df.select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            out.append((i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


ROWS = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "A"), (6, "a "), (7, "é"), (8, "é"),
        (9, "x" * 200_000), (10, "x" * 200_000), (None, "a"), (None, "only null"), (2, "a")]


def check(got, rows):
    assert sorted([r[:3] + r[4:] for r in got], key=repr) == brute(rows)
    kept = {}
    for r in got:
        kept.setdefault(r[4], []).append(r)
    for group in kept.values():
        stays = [r for r in group if r[3]]
        assert len(stays) == 1 and stays[0][0] == stays[0][1]


def test_groups_ties_nulls_and_long_texts(spark, documents, tmp_path):
    docs = documents([(i, t, None, None) for i, t in ROWS])
    docs = docs.withColumn("digest", F.lit(1)).withColumn("keep", F.lit("x")).withColumn("row", F.lit(0))
    check(rows_of(stream_dedup(spark, written(docs, tmp_path / "d.parquet"))), ROWS)


def test_texts_that_share_a_digest_are_told_apart(spark, documents, tmp_path):
    docs = documents([(i, t, None, None) for i, t in ROWS])
    short = stream_dedup(spark, written(docs, tmp_path / "d.parquet"),
                         digest=lambda t: F.substring(F.sha2(t.cast("binary"), 256), 1, 1))
    check(rows_of(short), ROWS)


def test_state_goes_on_over_later_files(spark, documents, tmp_path):
    path, state = str(tmp_path / "in"), str(tmp_path / "state")
    documents([(1, "a", None, None), (2, "b", None, None)]).write.parquet(path)
    stream_state(spark, path, state)
    documents([(9, "a", None, None), (3, "c", None, None)]).write.mode("append").parquet(path)
    held = {r["keep"]["doc_id"]: r["group_size"] for r in stream_state(spark, path, state).collect()}
    assert held == {9: 2, 2: 1, 3: 1}


def test_single_file_and_empty_tables(spark, documents, tmp_path, folder):
    assert stream_dedup(spark, f"{folder}/documents.parquet").count() == 200
    assert stream_dedup(spark, written(documents([]), tmp_path / "e.parquet", 1)).collect() == []
