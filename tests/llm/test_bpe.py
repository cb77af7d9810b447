from __future__ import annotations

import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken

from clftally.llm import bpe, registry

DATA = open(public_tokenizers.path(registry.RANKS), "rb").read()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(bpe.parse_ranks(DATA), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def standard():
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.parse_ranks(DATA), special_tokens={}
    )


def ids(packed):
    return list(memoryview(packed).cast("I"))


def test_random_texts(vocabulary, standard):
    rnd = random.Random(1)
    for alphabet in ("ab", "the 's're\n\tAing.,  é’中01-_=", "  \x1c\x85 x1", "😀é́क्ष 한"):
        for _ in range(1500):
            text = "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(50)))
            assert ids(vocabulary.encode(text)) == standard.encode_ordinary(text), text
            assert vocabulary.decode(vocabulary.encode(text)) == text.encode()


def test_every_prefix_has_its_last_token(vocabulary):
    piece = b"internationalisation"
    table = bpe.PrefixTable(vocabulary, piece)
    for n in range(1, len(piece) + 1):
        assert vocabulary.encode_piece(piece[:n])[-1] == table.last[n - 1]


def test_appends_cuts_and_replacements_of_a_piece(vocabulary):
    rnd, data = random.Random(2), b""
    table = bpe.PrefixTable(vocabulary)
    for _ in range(500):
        start = rnd.randrange(len(data) + 1)
        end = min(len(data), start + rnd.randrange(4))
        new = bytes(rnd.choice(b"thenig") for _ in range(rnd.randrange(5)))
        data = data[:start] + new + data[end:]
        table.replace(start, end, new)
        if len(data) > 80:
            data = data[:40]
            table.cut(40)
        assert table.data == data and table.tokens() == bpe.PrefixTable(vocabulary, data).tokens()


def test_edits_of_a_text(vocabulary, standard):
    rnd, text = random.Random(3), ""
    edited = bpe.EncodedText(vocabulary)
    for _ in range(1500):
        start = rnd.randrange(len(text) + 1)
        end = min(len(text), start + rnd.randrange(8)) if rnd.random() < 0.6 else start
        new = "".join(rnd.choice("the 's're\n\t  é0-") for _ in range(rnd.randrange(6)))
        text = text[:start] + new + text[end:]
        edited.replace(start, end, new)
        assert edited.text == text and edited.tokens() == standard.encode_ordinary(text)


def test_an_edit_encodes_few_pieces(vocabulary):
    edited = bpe.EncodedText(vocabulary, "one two three. " * 2000)
    assert edited.replace(15000, 15001, "x") < 10
    assert edited.append("more") < 5


def test_long_runs(vocabulary, standard):
    for text in ("a" * 30_000, " " * 30_000, "ab" * 15_000, "\n" * 999 + "x"):
        assert ids(vocabulary.encode(text)) == standard.encode_ordinary(text)


def test_incomplete_vocabularies_are_refused():
    with pytest.raises(ValueError, match="single bytes"):
        bpe.Vocabulary({b"a": 0}, "a")


def test_rows(spark):
    texts = [None, "", "the end.", "the end.", "x" * 5000, "naïve 中文"]
    rows = [(i if i else None, t, "ids", 1.5) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded double")
    encoded = bpe.encode(docs, DATA, public_tokenizers.PATTERN)
    assert encoded.columns == ["doc_id", "decoded", "ids"]
    decoded = bpe.decode(encoded, DATA, public_tokenizers.PATTERN)
    assert sorted(bytes(r.decoded) for r in decoded.collect()) == sorted((t or "").encode() for t in texts)
    both = bpe.round_trip(docs.select("doc_id", "text", "decoded"), DATA, public_tokenizers.PATTERN)
    assert both.columns == ["doc_id", "ids", "decoded"]
    pairs = lambda frame: sorted((bytes(r.ids), bytes(r.decoded)) for r in frame.collect())
    assert pairs(both) == pairs(decoded)
    assert registry.bpe_digests(docs.limit(0)).collect() == []


def test_query_equals_the_standard_library(spark, standard):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in registry.op1_bpe(spark, SF).collect()}
    assert got.keys() == docs.keys()
    for doc_id, text in docs.items():
        want = standard.encode_ordinary(text)
        packed = struct.pack(f"<{len(want)}I", *want)
        assert got[doc_id].n_tokens == len(want)
        assert got[doc_id].ids_sha256 == hashlib.sha256(packed).hexdigest()
        assert got[doc_id].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
