"""File digests and manifests on real files."""
import hashlib

from veriledge.functions.contracts import violation_codes
from veriledge.operators.jobs import manifest_verify
from veriledge.sources import artifacts


def test_files_are_hashed_in_chunks(spark, tmp_path, monkeypatch):
    contents = {"a b.bin": b"12", "x/ä%20.bin": b"1", "x/c.bin": bytes(range(256)) * 9,
                "x/packed.gz": b"not really packed"}
    (tmp_path / "x").mkdir()
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    monkeypatch.setattr(artifacts, "CHUNK", 100)
    found = {r["path"]: (r["size_bytes"], r["sha256"]) for r in artifacts.scan_files(
        spark, f"file://{tmp_path}").collect()}
    assert found == {name: (len(data), hashlib.sha256(data).hexdigest())
                     for name, data in contents.items()}


def test_a_file_over_two_gigabytes_is_hashed(spark, tmp_path):
    size = (2 << 30) + 12_345
    with open(tmp_path / "large.bin", "wb") as file:  # a hole: takes no disk
        file.truncate(size)
    digest, block = hashlib.sha256(), bytes(1 << 20)
    for _ in range(size >> 20):
        digest.update(block)
    digest.update(bytes(size & ((1 << 20) - 1)))
    row = artifacts.scan_files(spark, str(tmp_path)).first()
    assert (row["size_bytes"], row["sha256"]) == (size, digest.hexdigest())


def test_no_files(spark, tmp_path):
    (tmp_path / "empty").write_bytes(b"")
    assert artifacts.scan_files(spark, str(tmp_path)).count() == 0


def test_manifest_finds_changed_missing_and_new_files(spark, tmp_path):
    for name in ("same", "changed", "longer", "gone"):
        (tmp_path / name).write_bytes(b"abc")
    manifest = spark.createDataFrame(
        [(*r, "blob") for r in artifacts.scan_files(spark, str(tmp_path)).collect()],
        "path string, size_bytes bigint, sha256 string, kind string")
    copy = tmp_path / "copy"
    copy.mkdir()
    for name, data in (("same", b"abc"), ("changed", b"abd"), ("longer", b"abcd"), ("new", b"d")):
        (copy / name).write_bytes(data)
    found = manifest_verify(manifest, artifacts.scan_files(spark, str(copy)))
    assert {r["path"]: r["codes"] for r in found.select(
        "path", violation_codes().alias("codes")).collect()} == {
        "same": "", "changed": "sha256", "longer": "size,sha256", "gone": "missing_file",
        "new": "unmanifested_file"}
