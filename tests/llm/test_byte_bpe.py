"""Byte-level BPE next to an independent encoder, on given documents and awkward texts."""

import hashlib
import random
import string
import struct
import time

import public_tokenizers
import pytest
import tiktoken

from urlrisk.llm import byte_bpe, queries

RANKS = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
KNOWN = byte_bpe.tables(RANKS)
PLAIN = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.Codec(KNOWN, public_tokenizers.PATTERN)


def packed(text):
    ids = PLAIN.encode_ordinary(text or "")
    return struct.pack(f"<{len(ids)}I", *ids)


def same(codec, texts):
    got = list(codec.encode(texts))
    assert got == [packed(t) for t in texts]
    assert list(codec.decode(got)) == [(t or "").encode() for t in texts]


def test_awkward_texts(codec):
    same(codec, [None, "", " ", "  \n\t ", "a", "\x00", "\U0001f600 \u00e9\u0301", "<|endoftext|> it's", "aaaaaaaaaaaaaaaaa", "a " * 50, "\u3000\u00a0x", " a  b \n c\n d", "  ", " x", "\x1c \x1f y", "a\u2003 b"])


@pytest.mark.parametrize("letters", ["ab", "ab \n\t.'s", " \u3000\x1c\x85a1", "aeinst", "etaoin shrdlu", string.ascii_letters, string.digits, "\u00e9\u00e8\u00e4 n", "\u4e00\u4e8c\u4e09\u4eba\u5927\u5b66\u7684"])
def test_random_words(codec, letters):
    draw = random.Random(letters)
    same(codec, ["".join(draw.choices(letters, k=draw.randint(0, 60))) for _ in range(1500)])


@pytest.mark.parametrize("letters", ["a", string.ascii_lowercase, string.digits, "etaoinshrdlu", " ", "".join(map(chr, range(0x4e00, 0x6000)))])
def test_one_very_long_word(codec, letters):
    """A word of a whole text takes time in proportion to its length."""
    text, since = "".join(random.Random(3).choices(letters, k=300_000)), time.time()
    got = list(codec.encode([text]))
    assert time.time() - since < 30
    cut = "".join(random.Random(4).choices(letters, k=4_000))  # the other encoder takes the square of the length
    same(codec, [cut])
    assert list(codec.decode(got)) == [text.encode()]


def test_long_text_goes_in_slices(codec, monkeypatch):
    text = "".join(random.Random(1).choices("ab \n'sde.", k=20_000))
    monkeypatch.setattr(byte_bpe, "TEXT", 700)
    monkeypatch.setattr(byte_bpe, "DECODED", 500)
    monkeypatch.setattr(byte_bpe, "LETTERS", 300)
    monkeypatch.setattr(byte_bpe, "KEPT", 50)
    same(byte_bpe.Codec(KNOWN, public_tokenizers.PATTERN), [text, "short", None, text[:600]])


def test_unknown_ids(codec):
    with pytest.raises(ValueError):
        list(codec.decode([struct.pack("<I", 50256)]))


def test_small_vocabulary():
    """Merges whose token has a lower rank than its parts: only the leftmost place goes at a time."""
    ranks = {bytes([b]): b + 20 for b in range(256)} | {b"ab": 400, b"abc": 300, b"bc": 350, b"aab": 301, b"aa": 500, b"aaa": 299, b"ca": 302, b"bca": 9}
    plain = tiktoken.Encoding("small", pat_str=r"[^ ]+| +", mergeable_ranks=ranks, special_tokens={})
    codec, draw = byte_bpe.Codec(byte_bpe.tables(ranks), r"[^ ]+| +"), random.Random(2)
    texts = ["".join(draw.choices("abc", k=draw.randint(1, 80))) for _ in range(3000)]
    got = list(codec.encode(texts))
    assert got == [struct.pack(f"<{len(i)}I", *i) for i in map(plain.encode_ordinary, texts)]


def test_incomplete_vocabulary():
    with pytest.raises(ValueError):
        byte_bpe.tables({b"a": 0})


def test_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "two words", "x", b"old"), (1, "two words", "y", None), (None, None, "z", None)], "doc_id long, text string, decoded string, ids binary")
    both = byte_bpe.decode(byte_bpe.encode(df, KNOWN, public_tokenizers.PATTERN), KNOWN, decoded="bytes")
    assert sorted(((r.doc_id, r.decoded, r.ids, r.bytes) for r in both.collect()), key=str) == sorted(
        [(1, "x", packed("two words"), b"two words"), (1, "y", packed("two words"), b"two words"), (None, "z", b"", b"")], key=str)
    assert byte_bpe.encode(df.limit(0), KNOWN, public_tokenizers.PATTERN).count() == 0


def test_query_on_given_documents(spark):
    folder = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.QUERIES["op11_byte_bpe"].run(spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        row, want = got[d.doc_id], packed(d.text)
        assert (row.n_tokens, row.ids_sha256) == (len(want) // 4, hashlib.sha256(want).hexdigest())
        assert row.decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()
