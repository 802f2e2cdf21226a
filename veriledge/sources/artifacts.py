"""Content-addressed artifacts: load, conflicts, integrity."""
from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriledge.functions import scalars as fn
from veriledge.functions.contracts import Rule, is_blank, with_violations

KEY = ["tenant_id", "job_id", "logical_key"]


_SCHEME = "^[a-z0-9]+:(//[^/]*)?"
# Bytes of a file that are in memory at a time while it is hashed.
CHUNK = 8 << 20


def _opened(path: str):
    """(file system, path in it) of a qualified path, or None where Arrow knows no such scheme."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    host, _, inner = rest.removeprefix("//").partition("/")
    try:
        files, base = fs.FileSystem.from_uri(f"{scheme.replace('s3a', 's3')}://{host}/")
    except (ValueError, OSError):
        return None
    return files, f"{base.rstrip('/')}/{inner}"


def _stream_digests(batches):
    for batch in batches:
        digests = []
        for path in batch.column("path").to_pylist():
            files, inner = _opened(path)
            digest = hashlib.sha256()
            with files.open_input_stream(inner, compression=None) as stream:
                while chunk := stream.read(CHUNK):
                    digest.update(chunk)
            digests.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("path"), batch.column("length"), pa.array(digests, pa.string())],
            names=["path", "length", "sha256"])


def scan_files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """Files below ``root`` as (path, size_bytes, sha256).

    Spark lists the files and places them by size; each is hashed as a stream of 8 MB chunks, so
    a file may be larger than a task's memory. On a file system that Arrow cannot open contents
    are hashed as rows, where Spark's limit of 2 GB a file holds. Spark lists no empty files; an
    artifact is never empty.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(root)
    first = files.select("path").first()
    if first is not None and _opened(first["path"]) is not None:
        files = files.select("path", "length").mapInArrow(
            _stream_digests, "path string, length bigint, sha256 string")
    else:
        files = files.select("path", "length", F.sha2("content", 256).alias("sha256"))
    # file:/a/b -> a path relative to the root
    base = "/" + re.sub(_SCHEME, "", root).strip("/") + "/"
    local = F.regexp_replace("path", _SCHEME, "")
    return files.select(F.replace(local, F.lit(base), F.lit("")).alias("path"),
                        F.col("length").alias("size_bytes"), "sha256")


def artifact_put(incoming: DataFrame) -> DataFrame:
    """Index rows for (tenant_id, job_id, logical_key, content binary, media_type,
    created_at), one per logical key, with conflicts and contract violations.

    Content is replaced by its digest before anything is shuffled.
    """
    hashed = incoming.select(
        *KEY, F.sha2("content", 256).alias("content_sha256"),
        F.octet_length("content").cast("bigint").alias("size_bytes"), "media_type",
        "created_at")
    mark = F.concat_ws("|", "content_sha256", F.col("size_bytes").cast("string"), "media_type")
    row = F.struct(*hashed.columns)
    first = hashed.withColumn("__m", mark).groupBy(*[F.col(k).alias(f"__{k}") for k in KEY]).agg(
        F.min_by(row, F.struct("created_at", "__m")).alias("r"),
        (F.min("__m") != F.max("__m")).alias("__conflict")).select("r.*", "__conflict")
    rules = [
        *[Rule(f"unsafe_{k}", ~fn.safe_id(k)) for k in KEY],
        Rule("empty_content", F.col("size_bytes") < 1),
        Rule("media_type", is_blank("media_type") | (F.length("media_type") > 200)),
        Rule("logical_key_conflict", F.col("__conflict")),
    ]
    return with_violations(first, rules).drop("__conflict")


def stored_blobs(index: DataFrame) -> DataFrame:
    """Each blob is stored once per tenant, however many keys refer to it."""
    return (index.where(F.size("violations") == 0)
            .groupBy("tenant_id", "content_sha256").agg(
                F.max("size_bytes").alias("size_bytes"), F.count(F.lit(1)).alias("references")))


def blob_path(tenant: str = "tenant_id", digest: str = "content_sha256"):
    """Storage path of a blob: tenants are hashed, digests spread over 256 folders."""
    return F.concat_ws("/", F.lit("tenants"), fn.sha256(tenant), F.lit("blobs"),
                       F.substring(digest, 1, 2), digest)


def artifact_verify(index: DataFrame, blobs: DataFrame) -> DataFrame:
    """Index rows against blobs (tenant_id, blob_name, content binary).

    Blobs are reduced to size, digest and a JSON flag in the scan; contents are not shuffled.
    """
    facts = blobs.select(
        "tenant_id", F.col("blob_name").alias("content_sha256"),
        F.struct(F.octet_length("content").cast("bigint").alias("size"),
                 F.sha2("content", 256).alias("sha"),
                 F.coalesce(F.schema_of_variant(F.try_parse_json(
                     F.try_validate_utf8(F.col("content").cast("string"))))
                     .startswith("OBJECT"), F.lit(False)).alias("json_object")).alias("b"))
    joined = index.drop("violations").join(facts, ["tenant_id", "content_sha256"], "left")
    b = F.col("b")
    rules = [
        Rule("blob_missing", b.isNull()),
        Rule("blob_size", b["size"] != F.col("size_bytes")),
        Rule("blob_digest", b["sha"] != F.col("content_sha256")),
        Rule("json_root", (F.col("media_type") == "application/json") & ~b["json_object"]),
    ]
    return with_violations(joined, rules).drop("b")
