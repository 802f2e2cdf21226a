"""Where the rows of a key lie in the files of a stream."""
from types import SimpleNamespace

from pyspark.sql import functions as F

from veriledge.plans.catalog.q_streams import as_stream


def test_a_key_lies_in_one_file_of_a_stream(spark, tmp_path):
    """Files come in any order and in several batches; a ledger must not lie in two of them."""
    folders = iter([f"{tmp_path}/a"])
    tables = SimpleNamespace(spark=spark, scratch=lambda: next(folders))
    as_stream(tables, spark.range(3000).select((F.col("id") % 10).alias("k"), "id"), ["k"])
    files = spark.read.parquet(f"{tmp_path}/a").select("k", F.input_file_name().alias("file"))
    assert files.distinct().count() == 10
