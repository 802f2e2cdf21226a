"""Token ids as binary shards with Elias-Fano document boundaries.

A shard file holds, little-endian: 8 magic bytes; the concatenated ids (2 bytes each if every id
of the vocabulary fits, else 4); the Elias-Fano code of the boundaries (0 and the end of each
document); the Elias-Fano code of the ascending document ids; a JSON footer with the layout; the
footer's length (4 bytes); 8 magic bytes. ``EliasFano.select`` returns the i-th offset from about
two bits plus the low bits per document, with one 4-byte sample per 512 documents.
"""
from __future__ import annotations

import functools
import json
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriledge.llm.common import open_store, shared_folder

MAGIC = b"VLTOKEF1"
SAMPLE = 512
# Distinct words that a Python worker remembers before it starts afresh, and the words of a text that
# are looked up together. Longer words and pieces, as of scripts without spaces, are not remembered.
WORDS_KEPT = 1_000_000
WORDS_TOGETHER = 65_536
LONGEST_KEPT = 64
# Fixed value: how the public tokenizer file splits normalised text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Words with later letters are left to the whole library, whose character classes may be newer.
LATIN_END = "\u0250"


def byte_letters() -> dict:
    """The characters that byte-level models use for bytes: printable ones stay, others follow 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(others)}}


class EliasFano:
    """A non-decreasing sequence of non-negative integers, with select and bulk decoding."""

    def __init__(self, count, width, low, high, samples):
        self.count, self.width = count, width
        self.low, self.high, self.samples = low, high, samples

    @classmethod
    def encode(cls, values) -> EliasFano:
        v = np.asarray(values, dtype=np.uint64)
        count = len(v)
        top = int(v[-1]) if count else 0
        width = max(0, (top // count).bit_length() - 1) if count else 0
        shifts = np.arange(width, dtype=np.uint64)
        low = np.packbits(((v[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(),
                          bitorder="little")
        place = (v >> np.uint64(width)).astype(np.int64) + np.arange(count)
        bits = np.zeros(int(place[-1]) + 1 if count else 0, dtype=np.uint8)
        bits[place] = 1
        if len(bits) >= 1 << 32:
            raise ValueError("a shard has too many documents for 4-byte samples")
        return cls(count, width, low, np.packbits(bits, bitorder="little"),
                   place[::SAMPLE].astype("<u4"))

    def select(self, start: int, stop: int | None = None):
        """Values start..stop-1, or the single value at ``start``."""
        if stop is None:
            return int(self.select(start, start + 1)[0])
        stop = min(stop, self.count)
        if start >= stop:
            return np.zeros(0, dtype=np.uint64)
        first = start // SAMPLE
        begin = int(self.samples[first])
        last = -(-stop // SAMPLE)
        end = int(self.samples[last]) if last < len(self.samples) else len(self.high) * 8
        part = np.unpackbits(self.high[begin // 8: end // 8 + 1], bitorder="little")
        ones = np.flatnonzero(part) + begin // 8 * 8
        ones = ones[ones >= begin][start - first * SAMPLE: stop - first * SAMPLE]
        high = (ones - np.arange(start, stop)).astype(np.uint64) << np.uint64(self.width)
        if not self.width:
            return high
        bit = start * self.width
        piece = np.unpackbits(self.low[bit // 8: (stop * self.width + 7) // 8], bitorder="little")
        piece = piece[bit % 8: bit % 8 + (stop - start) * self.width].reshape(-1, self.width)
        weights = np.uint64(1) << np.arange(self.width, dtype=np.uint64)
        return high + (piece.astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64)

    def parts(self):
        return [self.low.tobytes(), self.high.tobytes(), self.samples.tobytes()]

    def layout(self) -> dict:
        return {"count": self.count, "width": self.width, "bytes": [len(p) for p in self.parts()]}

    @classmethod
    def load(cls, layout: dict, blob: bytes) -> EliasFano:
        a, b, c = layout["bytes"]
        return cls(layout["count"], layout["width"], np.frombuffer(blob, np.uint8, a),
                   np.frombuffer(blob, np.uint8, b, a), np.frombuffer(blob, "<u4", c // 4, a + b))


class WordEncoder:
    """Ids of whole texts through the tokenizers library, one distinct word at a time.

    For tokenizers that lower-case, normalise canonically and never join pieces across white
    space, the ids of a text are the ids of its words in order. Words are normalised by the
    tokenizer's own normaliser and split by its pattern, and each piece is encoded by its model;
    words beyond the Latin letters go through the whole library. Each distinct word is encoded
    once per worker and then looked up.
    """

    def __init__(self, spec: str, dtype: str):
        import tokenizers

        key = (zlib.crc32(spec.encode()), dtype)
        # The library's module outlives tasks, so a reused worker keeps what it has learnt.
        held = tokenizers.__dict__.setdefault("_veriledge_encoders", {})
        if key not in held:
            tokenizer = tokenizers.Tokenizer.from_str(spec)
            tokenizer.no_padding()
            tokenizer.no_truncation()
            held[key] = (tokenizer, {}, {})
        self.tokenizer, self.words, self.pieces = held[key]
        self.dtype, self.letters = dtype, byte_letters()
        self.pattern = regex.compile(PIECES)
        unit = "H" if dtype == "<u2" else "I"
        self.pack = functools.cache(lambda n: struct.Struct(f"<{n}{unit}"))

    def _bytes(self, ids) -> bytes:
        return self.pack(len(ids)).pack(*ids)

    def _learn(self, words) -> None:
        """Add distinct words to what is known."""
        # The normaliser makes one space of any run of white space, so only words without it can be
        # told apart again after joining; the library itself takes the others.
        odd = [word for word in words if word.split() != [word]]
        words = [word for word in words if word.split() == [word]]
        # To the normaliser, ASCII is only letters to lower.
        wide = [word for word in words if not word.isascii()]
        plain = self.tokenizer.normalizer.normalize_str(" ".join(wide)).split(" ")
        if len(plain) != len(wide):
            # Without words at all, or where the normaliser knows more white space.
            plain = [None] * len(wide)
        normals = dict(zip(wide, plain))
        model, pieces = self.tokenizer.model, self.pieces
        for word in words:
            quick = word.isascii()
            normal = word.lower() if quick else normals[word]
            if normal is None or "<|" in word or not quick and normal and max(normal) >= LATIN_END:
                odd.append(word)
                continue
            # The common shapes, letters and letters with one mark, need no pattern.
            if normal.isalpha():
                split = (normal,)
            elif normal[:-1].isalpha() and normal[-1] in ",.!?;:":
                split = (normal[:-1], normal[-1])
            else:
                split = self.pattern.findall(normal)
            code = []
            for piece in split:
                found = pieces.get(piece)
                if found is None:
                    spelt = piece if piece.isascii() and piece.isprintable() else \
                        piece.encode().decode("latin-1").translate(self.letters)
                    found = self._bytes([t.id for t in model.tokenize(spelt)])
                    if len(piece) <= LONGEST_KEPT:
                        pieces[piece] = found
                code.append(found)
            self.words[word] = b"".join(code)
        for word, found in zip(odd, self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)):
            self.words[word] = self._bytes(found.ids)

    def encode(self, text: str) -> bytes:
        for space in SPACES:
            if space in text:
                text = text.replace(space, " ")
        words = text.split(" ")
        if len(words) <= WORDS_TOGETHER:
            return self._joined(words)
        return b"".join(self._joined(words[at:at + WORDS_TOGETHER])
                        for at in range(0, len(words), WORDS_TOGETHER))

    def _joined(self, words) -> bytes:
        try:
            return b"".join(map(self.words.__getitem__, words))
        except KeyError:
            new = {w for w in words if w not in self.words}
        if max(len(self.words) + len(new), len(self.pieces)) > WORDS_KEPT:
            self.words.clear()
            self.pieces.clear()
            # Those that were known until now are forgotten as well.
            new = set(words)
        self._learn(new)
        found = b"".join(map(self.words.__getitem__, words))
        for word in new:
            if len(word) > LONGEST_KEPT:
                del self.words[word]
        return found


SPACES = "\t\n\v\f\r"


def is_word_wise(spec: str) -> bool:
    """Whether a tokenizer's file follows the rules that ``WordEncoder`` relies on."""
    held = json.loads(spec)
    steps = (held.get("normalizer") or {}).get("normalizers", [])
    splits = (held.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return ([s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"]
            and steps[1]["pattern"] == {"Regex": r"\s+"} and steps[1]["content"] == " "
            and [s["type"] for s in splits] == ["Split", "ByteLevel"]
            and splits[0]["pattern"] == {"Regex": PIECES} and splits[0]["behavior"] == "Removed"
            and not splits[1]["add_prefix_space"] and not splits[1]["use_regex"]
            and held.get("post_processor") is None
            and all("<|" in t["content"] and not t["lstrip"] and not t["rstrip"]
                    for t in held.get("added_tokens", [])))


class WholeEncoder:
    """Ids of whole texts by the library, for tokenizers without the word property."""

    def __init__(self, spec: str, dtype: str):
        import tokenizers

        self.tokenizer, self.dtype = tokenizers.Tokenizer.from_str(spec), dtype

    def encode(self, text: str) -> bytes:
        found = self.tokenizer.encode(text, add_special_tokens=False)
        return np.array(found.ids, dtype=self.dtype).tobytes()


def id_type(spec: str, end_id: int | None) -> str:
    """Two bytes per id where the whole vocabulary fits, else four."""
    held = json.loads(spec)
    top = max([*held["model"]["vocab"].values(), end_id or 0,
               *(t["id"] for t in held.get("added_tokens", []))])
    return "<u2" if top < 1 << 16 else "<u4"


class ShardWriter:
    """Streams one shard: ids go to the file as they come, only lengths and keys are held."""

    def __init__(self, sink, dtype: str):
        self.sink, self.dtype, self.ends, self.keys, self.nulls = sink, dtype, [0], [], 0
        self.unit = np.dtype(dtype).itemsize
        sink.write(MAGIC)

    def add(self, key: int | None, ids: bytes) -> None:
        if key is None:
            self.nulls += 1
        else:
            self.keys.append(key)
        self.ends.append(self.ends[-1] + len(ids) // self.unit)
        self.sink.write(ids)

    def close(self) -> None:
        base = self.keys[0] if self.keys else 0
        ends = EliasFano.encode(self.ends)
        keys = EliasFano.encode([k - base for k in self.keys])
        for part in (*ends.parts(), *keys.parts()):
            self.sink.write(part)
        footer = json.dumps({"dtype": self.dtype, "tokens": self.ends[-1], "nulls": self.nulls,
                             "base": base, "ends": ends.layout(), "keys": keys.layout()}).encode()
        self.sink.write(footer + len(footer).to_bytes(4, "little") + MAGIC)


class Shard:
    """Random access to the documents of a shard file."""

    def __init__(self, source):
        self.source, size = source, source.size()
        tail = source.read_at(12, size - 12)
        if tail[4:] != MAGIC or source.read_at(8, 0) != MAGIC:
            raise ValueError("not a token shard")
        length = int.from_bytes(tail[:4], "little")
        self.meta = json.loads(source.read_at(length, size - 12 - length))
        self.unit = np.dtype(self.meta["dtype"]).itemsize
        a, b = sum(self.meta["ends"]["bytes"]), sum(self.meta["keys"]["bytes"])
        at = 8 + self.meta["tokens"] * self.unit
        blob = source.read_at(a + b, at)
        self.ends = EliasFano.load(self.meta["ends"], blob[:a])
        self.keys = EliasFano.load(self.meta["keys"], blob[a:])
        self.count = self.ends.count - 1

    def key(self, i: int) -> int | None:
        return None if i < self.meta["nulls"] else \
            self.keys.select(i - self.meta["nulls"]) + self.meta["base"]

    def ids(self, start: int, stop: int) -> np.ndarray:
        raw = self.source.read_at((stop - start) * self.unit, 8 + start * self.unit)
        return np.frombuffer(raw, self.meta["dtype"])

    def documents(self, block: int = 4096):
        """(key, start, stop) of every document, decoded a block at a time."""
        nulls, base = self.meta["nulls"], self.meta["base"]
        for first in range(0, self.count, block):
            last = min(first + block, self.count)
            ends = self.ends.select(first, last + 1).tolist()
            keys = [None] * max(0, min(last, nulls) - first)
            low = max(first, nulls) - nulls
            if last > nulls:
                keys += [int(k) + base for k in self.keys.select(low, last - nulls)]
            yield from zip(keys, ends[:-1], ends[1:])


def write_shards(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int | None = 2,
                 key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every text and write shards in ascending key order; returns the list of shards.

    ``tokenizer`` is the text of a tokenizers JSON file, bounded by the vocabulary, and is sent to
    the executors once. Null text counts as empty, null keys come first, equal keys are ordered by
    text. Any other column is ignored, whatever its name. A task that is run again writes a file
    with a new name; only the files of the successful attempts are in the returned table
    (shard, path, n_docs, n_tokens, first_token). An empty table gives no shard.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "token-ids")
    dtype = id_type(tokenizer, end_id)
    sent = spark.sparkContext.broadcast((tokenizer, dtype, is_word_wise(tokenizer)))

    def write(batches):
        spec, kind, word_wise = sent.value
        writer, encoder = None, (WordEncoder if word_wise else WholeEncoder)(spec, kind)
        end = b"" if end_id is None else np.array([end_id], dtype=kind).tobytes()
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                store, root = open_store(folder)
                store.create_dir(root, recursive=True)
                part = TaskContext.get().partitionId()
                name = f"shard-{part:06d}-{uuid.uuid4().hex}.tok"
                sink = store.open_output_stream(f"{root}/{name}", compression=None)
                writer = ShardWriter(sink, kind)
            texts = batch.column(1)
            for i, k in enumerate(batch.column(0).to_pylist()):
                writer.add(k, encoder.encode(texts[i].as_py() or "") + end)
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pylist([{
                "shard": part, "path": f"{folder}/{name}", "n_docs": len(writer.ends) - 1,
                "n_tokens": writer.ends[-1]}])

    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"))
    shards = (rows.repartitionByRange(F.col("k").asc_nulls_first())
              .sortWithinPartitions(F.col("k").asc_nulls_first(), "t")
              .mapInArrow(write, "shard long, path string, n_docs long, n_tokens long"))
    listing = shared_folder(spark, "token-shards")
    shards.write.parquet(listing)
    # One row per shard, whose number is that of the write tasks.
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return spark.read.schema(shards.schema).parquet(listing).withColumn(
        "first_token", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).cast("long"))


def read_shards(shards: DataFrame, with_ids: bool = False) -> DataFrame:
    """Documents of written shards: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + \
        (", ids array<long>" if with_ids else "")
    types = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()),
             ("ids_crc32", pa.int64())] + ([("ids", pa.list_(pa.int64()))] if with_ids else [])

    def batch(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, (_, t) in zip(zip(*rows), types)], names=[n for n, _ in types])

    def read(batches):
        for listed in batches:
            for row in listed.to_pylist():
                store, path = open_store(row["path"])
                with store.open_input_file(path) as source:
                    shard, rows, held = Shard(source), [], 0
                    for k, start, stop in shard.documents():
                        ids = shard.ids(start, stop)
                        code = zlib.crc32(ids.astype("<u4").tobytes())
                        rows.append((k, row["first_token"] + start, stop - start, code,
                                     *([ids.tolist()] if with_ids else [])))
                        held += stop - start if with_ids else 1
                        if held >= 200_000 or len(rows) >= 10_000:
                            yield batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch(rows)

    # Adaptive execution would put the short listing into one task; every shard gets its own.
    return shards.select("path", "first_token").repartition(max(1, shards.count())).mapInArrow(
        read, schema)


def encode_documents(docs: DataFrame, tokenizer_path: str, end_id: int | None = 2) -> DataFrame:
    """Write ``docs`` as token shards and return the digest of each document read back."""
    with open(tokenizer_path, encoding="utf-8") as file:
        spec = file.read()
    return read_shards(write_shards(docs, spec, end_id=end_id))
