"""Phrase collocations: counting quotient filters per shard, merged across shards, then scored.

Texts are read once. Each task cuts them into chunks of a few megabytes per language, splits words
on the bytes and keeps a chunk as its distinct words and one short code per word. Words that occur
often enough to be part of a phrase get global numbers; only a chunk's distinct words are joined
with them. A chunk's phrases are counted in a quotient filter, which is cut into slices of the
permuted key; slices of all chunks are merged. Frequent words and phrases are one entry per chunk,
so no key is hot.
"""
from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriledge.llm import quotient as Q
from veriledge.llm.common import placed, sent_if_small, stored

# Fixed values of the contract.
MIN_COUNT, COVERED_PERCENT, TOP, NO_LANG = 10, 50, 2000, "und"
PIECE_ENDS, SPACES = b".,;:!?\n\x0b\x0c\r", b" \t"
# Text bytes of a chunk, text bytes a task holds over all languages, entries a slice may have.
CHUNK, HELD, SLICE = 4 << 20, 16 << 20, 1 << 18

_KIND = np.zeros(256, np.uint8)
_KIND[list(SPACES)] = 1
_KIND[list(PIECE_ENDS)] = 2
_PIECE_END = re.compile(b"[" + PIECE_ENDS + b"]")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

CHUNK_SCHEMA = ("chunk long, lang string, word string, code int, times long, codes binary, "
                "starts binary")
FILTER_SCHEMA = ("slice long, h int, s int, q int, n long, occupied binary, runends binary, "
                 "low binary, high binary, above_one binary, counters binary")


def split_words(texts: list[bytes]):
    """(words, starts): lower-cased words of all texts and whether each begins a piece."""
    raw = _LOWER[np.frombuffer(b"\n".join(texts), np.uint8)]
    kind = _KIND[raw]
    inside = kind == 0
    edge = np.flatnonzero(np.diff(np.r_[False, inside, False]))
    begin, end = edge[0::2], edge[1::2]
    piece = np.cumsum(kind == 2)[begin]
    offsets = np.zeros(len(begin) + 1, np.int64)
    np.cumsum(end - begin, out=offsets[1:])
    words = pa.Array.from_buffers(pa.large_binary(), len(begin), [
        None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw[inside]))])
    starts = np.r_[True, piece[1:] != piece[:-1]] if len(piece) else np.zeros(0, bool)
    return words, starts


def parts(text: bytes, size: int):
    """A long text in parts of about ``size`` bytes that end where a piece ends."""
    begin = 0
    while len(text) - begin > size:
        end = _PIECE_END.search(text, begin + size)
        if end is None:
            break
        yield text[begin:end.end()]
        begin = end.end()
    yield text[begin:]


def _chunk_rows(number: int, lang: str, texts: list[bytes]) -> pa.RecordBatch | None:
    """A row per distinct word with its code and count, then one row with all codes."""
    words, starts = split_words(texts)
    if not len(words):
        return None
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    distinct = coded.dictionary.cast(pa.large_string(), safe=False).cast(pa.string())
    k = len(distinct)
    small = codes.astype("<u2" if k <= 1 << 16 else "<u4").tobytes()
    none = pa.nulls(k, pa.binary())
    return pa.RecordBatch.from_arrays([
        pa.array([number] * (k + 1), pa.int64()), pa.array([lang] * (k + 1), pa.string()),
        pa.concat_arrays([distinct, pa.nulls(1, pa.string())]),
        pa.array([*range(k), None], pa.int32()),
        pa.array([*np.bincount(codes, minlength=k).tolist(), len(codes)], pa.int64()),
        pa.concat_arrays([none, pa.array([small], pa.binary())]),
        pa.concat_arrays([none, pa.array([np.packbits(starts).tobytes()], pa.binary())])],
        names=["chunk", "lang", "word", "code", "times", "codes", "starts"])


def chunked(docs: DataFrame, chunk_bytes: int = CHUNK) -> DataFrame:
    """The words of ``docs`` by chunk; a chunk has one language."""
    def cut(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: dict[str, list] = {}
        sizes: dict[str, int] = {}

        def close(lang):
            nonlocal number
            rows = _chunk_rows(number, lang, held.pop(lang))
            del sizes[lang]
            number += 1
            return [rows] if rows is not None else []

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                value = text.as_buffer().to_pybytes() if text.is_valid else b""
                if not value:
                    continue
                lang = lang.as_py()
                for part in parts(value, chunk_bytes):
                    held.setdefault(lang, []).append(part)
                    sizes[lang] = sizes.get(lang, 0) + len(part)
                    if sizes[lang] >= chunk_bytes:
                        yield from close(lang)
                    elif sum(sizes.values()) > HELD:
                        yield from close(max(sizes, key=sizes.get))
        for lang in list(held):
            yield from close(lang)

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"),
                       F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, CHUNK_SCHEMA)


def _count_chunk(rows: pa.Table, word_bits: int, s: int) -> pa.Table:
    """Filter slices of one chunk: its codes row, and the numbers of its frequent words."""
    h = Q.half_bits(word_bits)
    whole = rows.filter(rows.column("codes").is_valid())
    numbered = rows.filter(rows.column("codes").is_null())
    filters = []
    if len(whole):
        raw, count = whole.column("codes")[0].as_py(), whole.column("times")[0].as_py()
        codes = np.frombuffer(raw, "<u2" if len(raw) == 2 * count else "<u4").astype(np.int64)
        starts = np.unpackbits(np.frombuffer(whole.column("starts")[0].as_py(), np.uint8),
                               count=count).astype(bool)
        ids = np.zeros(int(codes.max()) + 1, np.uint64)
        ids[numbered.column("code").to_numpy()] = numbered.column("id").to_numpy().astype(np.uint64)
        seq = ids[codes]
        two = (seq[:-1] > 0) & (seq[1:] > 0) & ~starts[1:]
        three = two[:-1] & two[1:]
        i, j = np.flatnonzero(two), np.flatnonzero(three)
        zero = np.zeros(len(i), np.uint64)
        left, right = Q.permute(*Q.pack(
            np.r_[seq[i], seq[j]], np.r_[seq[i + 1], seq[j + 1]], np.r_[zero, seq[j + 2]],
            word_bits), h)
        filters = Q.sliced(*Q.summed(left, right, np.ones(len(left), np.uint64), h), h, s)
    names = [part.split()[0] for part in FILTER_SCHEMA.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    columns = [[getattr(f, n) for n in names] for f in filters]
    return pa.table([pa.array([c[k] for c in columns], kinds[part.split()[1]])
                     for k, part in enumerate(FILTER_SCHEMA.split(", "))], names=names)


def _frequent(rows: pa.Table, word_bits: int, least: int) -> pa.Table:
    """Merge the filters of one slice; word numbers and count of entries with ``least`` or more."""
    filters = [Q.QuotientFilter(**row) for row in rows.to_pylist()]
    left, right, counts = Q.merged(filters).entries()
    keep = counts >= np.uint64(least)
    words = Q.unpack(*Q.restore(left[keep], right[keep], Q.half_bits(word_bits)), word_bits)
    return pa.table([*[pa.array(w.astype(np.int64)) for w in words],
                     pa.array(counts[keep].astype(np.int64))], names=["w1", "w2", "w3", "a"])


def count_phrases(chunks: DataFrame, vocabulary: DataFrame, word_bits: int, occurrences: int,
                  least: int) -> DataFrame:
    """(w1, w2, w3, a) of all phrases of two (w3 = 0) or three words that occur ``least`` times."""
    s = min(max(0, (2 * occurrences // SLICE).bit_length()), Q.half_bits(word_bits))
    numbered = (chunks.where("word is not null").join(vocabulary, ["lang", "word"])
                .select("chunk", "code", "id", F.lit(None).cast("long").alias("times"),
                        F.lit(None).cast("binary").alias("codes"),
                        F.lit(None).cast("binary").alias("starts")))
    whole = chunks.where("codes is not null").select(
        "chunk", "code", F.lit(None).cast("long").alias("id"), "times", "codes", "starts")
    filters = whole.unionByName(numbered).groupBy("chunk").applyInArrow(
        lambda rows: _count_chunk(rows, word_bits, s), FILTER_SCHEMA)
    return filters.groupBy("slice").applyInArrow(
        lambda rows: _frequent(rows, word_bits, least), "w1 long, w2 long, w3 long, a long")


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)) in decimals of 38 digits."""
    wide = [c.cast("decimal(19,0)") for c in (a, left, right)]
    million = F.lit(1_000_000).cast("decimal(7,0)")
    top, bottom = million * (wide[0] * wide[0]), wide[1] * wide[2]
    return F.call_function("div", top, bottom)


def collocations(docs: DataFrame, least: int = MIN_COUNT, covered: int = COVERED_PERCENT,
                 top: int = TOP, chunk_bytes: int = CHUNK) -> DataFrame:
    """Each language's best phrases: lang, rank, phrase, a, l, r, n, score.

    Phrases have two or three words of one piece. A phrase scores by the cut of its words that
    explains it best; it goes if some longer phrase around it has at least ``covered`` percent of
    its occurrences. Null languages count as ``und``, null texts as empty; repeated rows count
    each; ties are settled by count, then by the phrase's bytes. Without candidates, or for an
    empty table, there are no rows. Other columns are ignored.
    """
    chunks = stored(chunked(docs, chunk_bytes), "phrase-chunks")
    words = chunks.where("word is not null")
    counted = words.groupBy("lang", "word").agg(F.sum("times").alias("f"))
    frequent = placed(counted.where(F.col("f") >= least).withColumn("all", F.lit(0)), ["all"],
                      ["lang", "word"], "phrase-words")
    vocabulary = stored(frequent.select("lang", "word", "f", (F.col("place") + 1).alias("id")),
                        "phrase-vocabulary")
    size, occurrences = vocabulary.agg(F.count("*"), F.coalesce(F.sum("f"), F.lit(0))).first()
    phrases = stored(count_phrases(chunks, sent_if_small(vocabulary, 128), size.bit_length() or 1,
                                   occurrences, least), "phrase-counts")
    return ranked(phrases, vocabulary, words.groupBy("lang").agg(F.sum("times").alias("n")),
                  covered, top)


def ranked(phrases: DataFrame, vocabulary: DataFrame, totals: DataFrame, covered: int, top: int
           ) -> DataFrame:
    """Scores, the phrases that a longer one covers left out, and ranks."""
    two = phrases.where("w3 = 0").select("w1", "w2", "a")
    three = phrases.where("w3 > 0")
    around = (three.select("w1", "w2", "a").union(three.select("w2", "w3", "a"))
              .groupBy("w1", "w2").agg(F.max("a").alias("longer")))
    kept = (two.join(around, ["w1", "w2"], "left")
            .where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * covered)))
    head = two.select("w1", "w2", F.col("a").alias("f12"))
    tail = two.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("f23"))
    both = (three.join(head, ["w1", "w2"]).join(tail, ["w2", "w3"])
            .select("w1", "w2", "w3", "a", "f12", "f23")
            .unionByName(kept.select("w1", "w2", F.lit(0).cast("long").alias("w3"), "a",
                                     F.lit(None).cast("long").alias("f12"),
                                     F.lit(None).cast("long").alias("f23"))))

    def named(k: int) -> DataFrame:
        wanted = [F.col("id").alias(f"w{k}"), F.col("word").alias(f"word{k}"),
                  F.col("f").alias(f"f{k}")]
        return sent_if_small(vocabulary.select(*wanted, *(["lang"] if k == 1 else [])), 128)

    full = both.join(named(1), "w1").join(named(2), "w2").join(named(3), "w3", "left")
    pair = F.col("w3") == 0
    # Cut after the first word; and, for three words, after the second.
    r1 = F.when(pair, F.col("f2")).otherwise(F.col("f23"))
    first = F.struct(_score(F.col("a"), F.col("f1"), r1).alias("score"), F.lit(1).alias("k"),
                     F.col("f1").alias("l"), r1.alias("r"))
    second = F.when(~pair, F.struct(
        _score(F.col("a"), F.col("f12"), F.col("f3")).alias("score"), F.lit(2).alias("k"),
        F.col("f12").alias("l"), F.col("f3").alias("r")))
    scored = full.withColumn("cut", F.least(first, second)).select(
        "lang", F.concat_ws(" ", "word1", "word2", "word3").alias("phrase"), "a", "cut.l", "cut.r",
        "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(sent_if_small(totals, 64), "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r",
        F.col("n").cast("long").alias("n"), "score")
