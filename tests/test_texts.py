"""Unicode normal forms and undecodable bytes against Python's own."""
import random
import unicodedata

from pyspark.sql import functions as F

from veriledge.functions import scalars as fn
from veriledge.plans.catalog import ORACLES, QUERIES
from veriledge.sources import jsonl


def test_nfkc_of_any_text_equals_python(spark):
    rng = random.Random(1)
    pool = [chr(c) for c in [*range(32, 127), *range(0xA0, 0x250), *range(0x300, 0x370), 0x9BE, 0x9C7,
                             *range(0x1100, 0x1113), *range(0x1161, 0x1176), *range(0x11A8, 0x11C3),
                             0xAC00, 0xFB01, 0x2460, 0x212B, 0x1D400, 0x1F600, 0x4E2D, 0xF900, 0x3000]]
    texts = ["".join(rng.choices(pool, k=rng.randrange(1, 6))) for _ in range(4000)]
    texts += [chr(c) for c in range(1, 0x110000, 37) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    risky = fn.nfkc_risky()
    for t, leaves, got in df.select("t", F.col("t").rlike(risky), fn.normalize_passage("t")).collect():
        assert leaves or unicodedata.normalize("NFKC", t) == t, t
        assert got == " ".join(unicodedata.normalize("NFKC", t).split()), repr(t)


def test_all_documents_are_normalised(spark, folder):
    import hashlib

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = {r["doc_id"]: r["norm_sha256"] for r in QUERIES["F08_normalize_passage_all"](spark, folder).collect()}
    assert got.keys() == docs.keys() and any(not t.isascii() for t in docs.values())
    for key, text in docs.items():
        want = " ".join(unicodedata.normalize("NFKC", f"  {text} ①ﬁ x").split())
        assert got[key] == hashlib.sha256(want.encode()).hexdigest()


def test_every_script_is_normalised_and_checked(spark, tmp_path):
    """F08 reads documents of any script, and its SQL says the same of them."""
    import hashlib

    import duckdb

    rng = random.Random(3)
    pool = [chr(c) for c in range(1, 0x110000) if unicodedata.decomposition(chr(c)) or unicodedata.combining(chr(c))]
    texts = ["plain  text", "École\u00a0d'été", "e\u0301 \uff07 \ufb01", "中文 ①", "", None, None, "plain  text"]
    texts += ["".join(rng.choices([*pool, "a", " ", "é", "가"], k=rng.randrange(1, 9))) for _ in range(500)]
    spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "doc_id bigint, text string").write.parquet(
        str(tmp_path / "documents.parquet"))
    want = sorted((i // 2, "-" if t is None else hashlib.sha256(
        " ".join(unicodedata.normalize("NFKC", f"  {t} x").split()).encode()).hexdigest()) for i, t in enumerate(texts))
    got = QUERIES["F08_normalize_passage"](spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["norm_sha256"] or "-") for r in got) == want
    with duckdb.connect() as duck:
        duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        said = duck.execute(ORACLES["F08_normalize_passage"]).fetchall()
    assert sorted((i, t or "-") for i, t in said) == want


def test_undecodable_bytes_are_dropped(spark, tmp_path):
    rng = random.Random(2)
    good = ["é", "中", "😀", "�", "a", "߿", "\U0010ffff"]
    lines = []
    for i in range(300):
        raw = b"".join(rng.choice([rng.choice(good).encode(), bytes([rng.choice([0x80, 0xC0, 0xE2, 0xED, 0xF0,
                                                                                0xF5, 0xFF, 0xA0, 0x9F, 0x41])])])
                       for _ in range(rng.randrange(1, 8)))
        lines.append(b'{"i": %d, "s": "' % i + raw + b'"}')
    (tmp_path / "x.jsonl").write_bytes(b"\n".join(lines))
    kept, skipped = jsonl.read_jsonl_lenient(spark, str(tmp_path / "x.jsonl"))
    assert sorted(r["value"] for r in kept.collect()) == sorted(
        line.decode("utf-8", "ignore") for line in lines)
    assert skipped.count() == 0
