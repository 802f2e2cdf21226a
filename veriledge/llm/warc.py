"""WARC archives: a writer with revisit records, and a splittable reader of gzip members.

The reader cuts archives into byte ranges. A task looks for gzip magic in its range, takes the
first place whose decoded bytes begin a complete WARC header, and then follows member after
member; it owns every record that starts inside its range and reads such a record to its end.
"""
from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriledge.llm.common import open_store, shared_folder, stored

MAGIC = b"\x1f\x8b\x08"
BLOCK = 1 << 20
START, BLANK = b"WARC/1.", b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WRITTEN = "path string, bytes long, records long"


def _clean(value: str) -> str:
    """A header value on one line."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def _record(row: dict, payload: bytes) -> tuple[bytes, bytes]:
    """(header, block) of a record; a revisit's block is the HTTP header without the payload."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    revisit = row["revisits"]
    block = http if revisit else http + payload
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
             f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", "WARC-Date: 1970-01-01T00:00:00Z",
             f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if row["url"] is not None:
        lines.append("WARC-Target-URI: " + _clean(row["url"]))
    if row["page_id"] is not None:
        lines.append(f"X-Page-Id: {row['page_id']}")
    if revisit:
        lines.append("WARC-Profile: " + PROFILE)
        if row["refers_to"] is not None:
            lines.append(f"X-Refers-To-Page-Id: {row['refers_to']}")
    lines.append(f"Content-Length: {len(block)}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode(), block


def plan_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Pages with ``revisits`` and ``refers_to``: equal payloads are kept once.

    Of pages with equal payloads of at least ``least_bytes`` bytes, that with the largest page_id
    (then url) is the response. Digests are grouped without the payloads, and payloads are joined
    by page, not by digest, so a payload that a third of all pages share stays spread.
    """
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"),
                        F.col("url").cast("string").alias("url"), body.alias("html"))
    rows = rows.withColumn("sha", F.unhex(F.sha1(body.cast("binary")))).withColumn(
        "n", F.octet_length("html"))
    # Null-free names of a row, so that window and join share one placement of the payloads.
    names = {"p": F.coalesce("page_id", F.lit(0)), "no_p": F.col("page_id").isNull(),
             "u": F.coalesce("url", F.lit("")), "no_u": F.col("url").isNull()}
    rows = rows.withColumns(names)
    key = [*names, "sha"]
    light = stored(rows.select("page_id", "url", "n", *key), "warc-digests")
    keeper = light.groupBy("sha").agg(F.max(F.struct("page_id", "url")).alias("keep"))
    decided = (light.distinct().join(keeper, "sha")
               .select(*key, "keep",
                       (F.struct("page_id", "url").eqNullSafe(F.col("keep"))).alias("is_keep"),
                       (F.col("n") >= least_bytes).alias("counts")))
    same = Window.partitionBy(*key).orderBy("n")
    return (rows.withColumn("place", F.row_number().over(same)).join(decided, key)
            .withColumn("revisits", F.expr("counts and not (is_keep and place = 1)"))
            .select("page_id", "url", "html", "revisits", F.when(
                F.col("revisits"), F.col("keep.page_id")).alias("refers_to")))


def write_warc(planned: DataFrame, folder: str | None = None, level: int = 6,
               file_bytes: int = 1 << 30) -> DataFrame:
    """One gzip member per page into archives of about ``file_bytes``; returns (path, bytes, records).

    A task that is run again writes new files; only files of successful attempts are listed.
    """
    folder = folder or shared_folder(planned.sparkSession, "warc")

    def write(batches):
        store = sink = None
        done = []

        def close():
            sink.close()
            done.append({"path": path, "bytes": size, "records": records})

        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if store is None:
                    store, root = open_store(folder)
                    store.create_dir(root, recursive=True)
                if sink is None:
                    name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                    sink, path, size, records = store.open_output_stream(f"{root}/{name}", compression=None), \
                        f"{folder}/{name}", 0, 0
                header, block = _record(row, row["html"].encode("utf-8"))
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = packer.compress(header) + packer.compress(block) + \
                    packer.compress(b"\r\n\r\n") + packer.flush()
                sink.write(member)
                size, records = size + len(member), records + 1
                if size >= file_bytes:
                    close()
                    sink = None
        if sink is not None:
            close()
        if done:
            yield pa.RecordBatch.from_pylist(done)

    return stored(planned.mapInArrow(write, WRITTEN), "warc-files")


class _Window:
    """Bytes of a file by position, read in blocks."""

    def __init__(self, source):
        self.source, self.size, self.at, self.held = source, source.size(), 0, b""

    def get(self, position: int) -> bytes:
        """What is held from ``position`` on; at least one block unless the file ends."""
        if not self.at <= position < self.at + len(self.held):
            self.at, self.held = position, self.source.read_at(
                min(BLOCK, max(0, self.size - position)), position)
        return self.held[position - self.at:]


def _starts_record(window: _Window, position: int) -> bool:
    """Whether a gzip member at ``position`` decodes to a complete WARC header of any length."""
    unpack, seen, named = zlib.decompressobj(31), b"", False
    while not unpack.eof:
        raw = window.get(position)[:4096]
        if not raw:
            break
        try:
            seen += unpack.decompress(raw)
        except zlib.error:
            return False
        named = named or seen.startswith(START)
        if not named and not START.startswith(seen):
            return False
        if named and BLANK in seen:
            return True
        if named:
            # A header may be long: only what may begin the blank line is held.
            seen = seen[1 - len(BLANK):]
        position += len(raw)
    return False


def first_record(window: _Window, start: int, stop: int) -> int | None:
    """The first validated member that starts in [start, stop)."""
    position = start
    while position < stop:
        raw = window.get(position)
        if len(raw) < len(MAGIC) and position + len(raw) < window.size:
            raw = window.source.read_at(BLOCK, position)
        found = raw.find(MAGIC)
        if found < 0:
            if position + len(raw) >= window.size:
                return None
            position += max(1, len(raw) - len(MAGIC) + 1)
            continue
        if position + found >= stop:
            return None
        if _starts_record(window, position + found):
            return position + found
        position += found + 1
    return None


def read_member(window: _Window, position: int, keep: bool):
    """(headers, http headers, payload digest, length and bytes, next position) of one record."""
    unpack, head, http, body = zlib.decompressobj(31), None, None, []
    sha, length, left, held = hashlib.sha1(), 0, 0, b""
    while not unpack.eof:
        raw = window.get(position)
        if not raw:
            raise ValueError("archive ends inside a record")
        held += unpack.decompress(raw)
        position += len(raw) - len(unpack.unused_data)
        if head is None:
            cut = held.find(b"\r\n\r\n")
            if cut < 0:
                continue
            head, held = _fields(held[:cut]), held[cut + 4:]
            left = int(head.get("content-length", 0))
        if http is None:
            cut = held.find(b"\r\n\r\n")
            if cut < 0:
                continue
            http, held, left = _fields(held[:cut]), held[cut + 4:], left - cut - 4
        piece, held = held[:left], held[left:]
        sha.update(piece)
        length, left = length + len(piece), left - len(piece)
        if keep:
            body.append(piece)
    if head is None or http is None or left:
        raise ValueError("a record is shorter than its header says")
    return head, http, sha.digest(), length, b"".join(body), position


def _fields(raw: bytes) -> dict:
    lines = raw.decode("utf-8", "replace").split("\r\n")[1:]
    return {name.strip().lower(): value.strip() for name, _, value in
            (line.partition(":") for line in lines)}


def read_warc(files: DataFrame, split_bytes: int = 64 << 20, with_payload: bool = False) -> DataFrame:
    """Records of archives: page_id, url, record_type, refers_to, payload_bytes, payload_digest.

    ``files`` lists path and bytes. With ``with_payload`` the payload of responses is returned too.
    Length and digest of a response are computed from the payload, those of a revisit are taken
    from its headers, as it has no payload. Archives of several gigabytes are read by many tasks.
    """
    schema = ("page_id long, url string, record_type string, refers_to long, payload_bytes long, "
              "payload_digest string" + (", payload binary" if with_payload else ""))

    def number(value):
        return None if value is None else int(value)

    def read(batches):
        for listed in batches:
            for split in listed.to_pylist():
                store, path = open_store(split["path"])
                rows, weight = [], 0
                with store.open_input_file(path) as source:
                    window = _Window(source)
                    position = first_record(window, split["start"], split["stop"])
                    while position is not None and position < min(split["stop"], window.size):
                        head, http, sha, length, body, position = read_member(
                            window, position, with_payload)
                        kind = head.get("warc-type")
                        if kind == "revisit":
                            length = int(http.get("content-length", 0))
                            digest = head.get("warc-payload-digest", "sha1:")[5:]
                        else:
                            digest = base64.b32encode(sha).decode()
                        rows.append({
                            "page_id": number(head.get("x-page-id")),
                            "url": head.get("warc-target-uri"), "record_type": kind,
                            "refers_to": number(head.get("x-refers-to-page-id")),
                            "payload_bytes": length, "payload_digest": digest,
                            **({"payload": body} if with_payload else {})})
                        weight += len(body)
                        if len(rows) >= 5000 or weight > 32 << 20:
                            yield packed(rows)
                            rows, weight = [], 0
                if rows:
                    yield packed(rows)

    kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
                       ("refers_to", pa.int64()), ("payload_bytes", pa.int64()),
                       ("payload_digest", pa.string())]
                      + ([("payload", pa.binary())] if with_payload else []))

    def packed(rows):
        return pa.RecordBatch.from_pylist(rows, schema=kinds)

    splits = files.withColumn("start", F.explode(F.sequence(
        F.lit(0), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))))
    splits = splits.select("path", "start", (F.col("start") + split_bytes).alias("stop"))
    total = files.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 1
    return splits.repartition(max(1, int(total))).mapInArrow(read, schema)


def archive_pages(pages: DataFrame, least_bytes: int = 0, split_bytes: int = 64 << 20) -> DataFrame:
    """Write every page as a WARC record, read the archives back and return one row per record.

    Null html is an empty payload; null url or page_id leaves the header out and comes back as
    null. Of fully repeated rows one is the response. An empty table gives no archive and no rows.
    """
    return read_warc(write_warc(plan_revisits(pages, least_bytes)), split_bytes)
