"""The ledger format against plain reads of the same files."""
import io

import pytest

from veriledge.sources import ledger_source

FILES = {("a", "j1"): b"one\n\ntwo\r\nthr\xffee", ("a", "j2"): b"x" * 50 + b"\n" + b"y\n",
         ("tenant=b", "job=j1"): b"\n \nlast\n", ("c", "j3"): b""}


@pytest.fixture
def root(tmp_path):
    for (tenant, job), data in FILES.items():
        (tmp_path / tenant / job).mkdir(parents=True)
        (tmp_path / tenant / job / "events.jsonl").write_bytes(data)
        (tmp_path / tenant / job / "notes.md").write_bytes(b"no ledger\n")
    return tmp_path


def test_every_line_belongs_to_one_range(monkeypatch):
    data = b"a\nbb\n\nccc" + b"d" * 20 + b"\ne"
    lines = data.split(b"\n")
    expected = [(sum(len(x) + 1 for x in lines[:i]), line) for i, line in enumerate(lines)]
    for chunk in (1, 4, 100):
        monkeypatch.setattr(ledger_source, "_CHUNK", chunk)
        for size in range(1, len(data) + 2):
            found = [row for start in range(0, len(data), size) for row in ledger_source._lines(
                io.BytesIO(data), start, min(start + size, len(data)))]
            assert found == expected


@pytest.mark.parametrize("split", [3, 1_000])
def test_lines_by_format(spark, root, split):
    ledger_source.register(spark)
    lines = spark.read.format("ledger").option("split_bytes", split).load(str(root))
    rows = lines.orderBy("file", "offset").collect()
    assert [(r["tenant_id"], r["job_id"], r["offset"], r["value"]) for r in rows] == [
        ("a", "j1", 0, "one"), ("a", "j1", 5, "two"), ("a", "j1", 10, "three"),
        ("a", "j2", 0, "x" * 50), ("a", "j2", 51, "y"), ("b", "j1", 3, "last")]
    assert {r["value"] for r in lines.where("tenant_id = 'b'").collect()} == {"last"}
    assert {r["value"] for r in lines.where("job_id IN ('j1', 'j3') AND offset > 0")
            .collect()} == {"two", "three", "last"}
    assert lines.where("tenant_id = 'a' AND tenant_id = 'b'").count() == 0


def test_only_wanted_folders_are_listed(spark, root):
    ledger_source.register(spark)
    reader = ledger_source.LedgerReader({"path": str(root)})
    assert list(reader.pushFilters([ledger_source.EqualTo(("tenant_id",), "a"),
                                    ledger_source.In(("job_id",), ("j2", "j9"))])) == []
    parts = [p for task in reader.partitions() for p in task.parts]
    assert [p[:2] for p in parts] == [("a", "j2")]
