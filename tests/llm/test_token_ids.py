import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veriledge.llm import token_ids as ids

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")

NASTY = [
    None, "", " ", "\t\n\x0b\x0c\r", "Straße ÉCOLE d'été l'İstanbul ½ x²y", "é été ́a na b",
    "日本語 <|endoftext|>x a<|endoftext|> ΣΑΣ Ǆ don't I'LL 12a3 a_b\x1cc \x85   힣 가",
    "🙂a🙂 ﬁ Å Å", "word " * 30_000, "x" * 5_000,
]


@pytest.fixture(scope="module")
def spec():
    with open(public.path("word_bpe_49k.json"), encoding="utf-8") as file:
        return file.read()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 1 << 60), max_size=1500))
def test_elias_fano_round_trip(values):
    values = sorted(values)
    code = ids.EliasFano.encode(values)
    again = ids.EliasFano.load(code.layout(), b"".join(code.parts()))
    assert again.select(0, len(values)).tolist() == values
    for i in range(0, len(values), 97):
        assert again.select(i) == values[i]
        assert again.select(i, i + 5).tolist() == values[i:i + 5]


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 4000, 50_000))
    assert sum(map(len, ids.EliasFano.encode(ends).parts())) < 50_000 * 2


def test_words_encode_like_whole_texts(spec, folder):
    import pyarrow.parquet as pq

    whole = tokenizers.Tokenizer.from_str(spec)
    encoder = ids.WordEncoder(spec, "<u2")
    texts = pq.read_table(f"{folder}/documents.parquet")["text"].to_pylist()
    for text in [t or "" for t in NASTY + texts]:
        got = np.frombuffer(encoder.encode(text), "<u2").tolist()
        assert got == whole.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text_encodes_like_the_library(text):
    with open(public.path("word_bpe_49k.json"), encoding="utf-8") as file:
        spec = file.read()
    got = np.frombuffer(ids.WordEncoder(spec, "<u2").encode(text), "<u2").tolist()
    held = next(v for k, v in tokenizers._veriledge_encoders.items())[0]
    assert got == held.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", [
    "x  a\u00a0b y", "x \u00a0 a\u3000b y z", "\u2003 p q\u00a0r s\u2028t  u", "  ", "m\u00a0n", "a\x1cb  c\x85d e"])
def test_unicode_spaces_do_not_shift_words(spec, text):
    whole = tokenizers.Tokenizer.from_str(spec)
    for order in range(4):
        encoder = ids.WordEncoder(spec, "<u2")
        encoder.words, encoder.pieces = {}, {}
        words = text.split(" ")
        encoder._learn(dict.fromkeys(words[order:] + words[:order]))
        for part in [text, "two  spaces", *words]:
            got = np.frombuffer(encoder.encode(part), "<u2").tolist()
            assert got == whole.encode(part, add_special_tokens=False).ids


def test_the_normaliser_knows_no_other_space(spec):
    normal = tokenizers.Tokenizer.from_str(spec).normalizer.normalize_str
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    assert all(c.isspace() for c in points if " " in normal(c))


def expected(rows, spec):
    whole, at, out = tokenizers.Tokenizer.from_str(spec), 0, []
    for key, text in rows:
        code = whole.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((key, at, len(code), zlib.crc32(np.array(code, "<u4").tobytes())))
        at += len(code)
    return out


def test_documents_in_key_order_with_ties_and_nulls(spark, documents, spec):
    rows = [(5, "b"), (None, "z"), (5, "a"), (-3, None), (5, "a"), (1 << 62, "end"), (None, "y")]
    rows += [(100 + i, t) for i, t in enumerate(NASTY)]
    docs = documents([(k, t, None, None) for k, t in rows]).repartition(5)
    got = ids.encode_documents(docs, public.path("word_bpe_49k.json")).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected(order, spec)


def test_ids_come_back_and_other_tokenizers_work(spark, documents):
    path = public.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as file:
        spec = file.read()
    assert not ids.is_word_wise(spec)
    texts = ["Hello  world", "", "naïve\n\nline"]
    shards = ids.write_shards(documents([(i, t, None, None) for i, t in enumerate(texts)]), spec, end_id=None)
    got = {r["doc_id"]: r["ids"] for r in ids.read_shards(shards, with_ids=True).collect()}
    whole = tokenizers.Tokenizer.from_str(spec)
    assert got == {i: whole.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}


def test_empty_table_and_clashing_columns(spark, documents):
    path = public.path("word_bpe_49k.json")
    assert ids.encode_documents(documents([]), path).collect() == []
    docs = spark.sql("SELECT 1L AS doc_id, 'a b' AS text, 'q' AS k, 7 AS t, 9 AS shard, 'p' AS path")
    assert ids.encode_documents(docs, path).first()["n_tokens"] == 3


def test_ascii_words_need_no_normaliser(spec):
    encoder = ids.WordEncoder(spec, ids.id_type(spec, 2))
    whole = ids.WholeEncoder(spec, encoder.dtype)
    seen, real = [], encoder.tokenizer

    class Watched:
        model, encode_batch_fast = real.model, real.encode_batch_fast

        class normalizer:
            @staticmethod
            def normalize_str(text):
                seen.append(text)
                return real.normalizer.normalize_str(text)

    encoder.tokenizer, encoder.words, encoder.pieces = Watched, {}, {}
    text = "Plain WORDS, don't 12a3 \x00A\x7f ~Q_b École Straße İx " + "".join(map(chr, range(33, 127)))
    assert encoder.encode(text) == whole.encode(text)
    assert seen == [" ".join(seen[0].split(" "))] and all(not w.isascii() for w in seen[0].split(" "))


def test_a_full_store_of_words_forgets_and_goes_on(spec, monkeypatch):
    """Words that were known when the store is emptied are learnt again with the new ones."""
    whole = ids.WholeEncoder(spec, "<u2")
    monkeypatch.setattr(ids, "WORDS_KEPT", 40)
    encoder = ids.WordEncoder(spec, "<u2")
    encoder.words, encoder.pieces = {}, {}
    for i in range(60):
        text = f"the same words école 日本語 , x{i} then {'abcdefg'[i % 7] * (i + 1)} and  the same"
        assert encoder.encode(text) == whole.encode(text)
        assert len(encoder.words) <= 40 + len(set(text.split(" ")))


def test_long_texts_go_in_blocks_and_long_words_are_not_kept(spec, monkeypatch):
    whole = ids.WholeEncoder(spec, "<u2")
    monkeypatch.setattr(ids, "WORDS_TOGETHER", 7)
    encoder = ids.WordEncoder(spec, "<u2")
    encoder.words, encoder.pieces = {}, {}
    for text in (" ".join(f"w{i % 11}" for i in range(100)), "日本語の文" * 300 + " a " + "é" * 400 + " a",
                 "y" * 900, " " * 30, "a " * 21):
        assert encoder.encode(text) == whole.encode(text) == encoder.encode(text)
    assert max(map(len, [*encoder.words, *encoder.pieces])) <= 64
