from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from clftally.llm import registry, repeats

SCHEMA = "doc_id long, text string"
SF = "/root/testdata/sf0.001"


def brute_force(texts, length):
    """Spans to remove from each text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    for d in data:
        gone = np.zeros(len(d) + 1, np.int64)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length : i + length + 1] -= 1
        mask = np.concatenate(([0], np.cumsum(gone)[:-1] > 0, [0])).astype(int) if len(d) else np.zeros(2, int)
        edges = np.flatnonzero(np.diff(mask)).reshape(-1, 2)
        yield d, [(int(a), int(b)) for a, b in edges]


def corpus(seed):
    rnd = random.Random(seed)
    piece = lambda n: "".join(rnd.choice("abcdé fgh") for _ in range(n))
    shared = [piece(n) for n in (190, 199, 200, 201, 230, 700, 1500)]
    texts = [None, "", "short", "x" * 199, "x" * 900, "xy" * 500, "é" * 300, piece(4000), piece(30_000)]
    for i in range(120):
        parts = [piece(rnd.randrange(300))]
        for _ in range(rnd.randrange(4)):
            s = rnd.choice(shared)
            a = rnd.randrange(len(s) // 2)
            parts += [s[a : a + rnd.randrange(400)] if rnd.random() < 0.5 else s, piece(rnd.randrange(200))]
        texts.append("".join(parts))
    return texts + texts[20:26] + [texts[30]] * 20


@pytest.mark.parametrize("shard, block", [(2048, 1 << 20), (3, 700)])
def test_against_brute_force(spark, monkeypatch, shard, block):
    monkeypatch.setattr(repeats, "SHARD_REGIONS", shard)
    monkeypatch.setattr(repeats, "SHARD_BYTES", 20 * block)
    monkeypatch.setattr(repeats, "BLOCK_BYTES", block)
    monkeypatch.setattr(repeats, "REGION_STARTS", 300)
    texts = corpus(shard)
    rows = [(i if i % 9 else None, t, i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA + ", spans int").withColumnRenamed("spans", "row").repartition(5)
    got = {r.row: r for r in repeats.remove_repeats(docs).collect()}
    assert got.keys() == set(range(len(texts)))
    for i, (data, spans) in enumerate(brute_force(texts, repeats.LENGTH)):
        found = [(s["first"], s["first"] + s["number"]) for s in got[i].spans]
        assert found == spans and got[i].n_bytes == len(data), i
        assert bytes(got[i].kept) == repeats.without(data, spans)


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(1)
    for alphabet in (1, 2, 5):
        codes = rng.integers(1, alphabet + 1, 400).astype(np.int16)
        codes[::57] = 0
        data = codes.tolist()
        order = repeats.suffix_array(codes).tolist()
        assert order == sorted(range(400), key=lambda i: data[i:])
        shared = repeats.common_prefixes(codes, np.array(order), np.array([0]), np.array([400]), 30)
        for a, b in zip(order, order[1:]):
            n = 0
            while n < 30 and max(a, b) + n < 400 and data[a + n] == data[b + n] != 0:
                n += 1
            assert shared[b] == n


def test_equal_strings_have_equal_keys():
    rnd = random.Random(3)
    text = bytes(rnd.choice(b"abc") for _ in range(300)) * 3
    keys, _ = repeats.start_keys(np.frombuffer(text, np.uint8), 200, 48)
    by_string = {}
    for i, key in enumerate(keys.tolist()):
        assert by_string.setdefault(text[i : i + 200], key) == key


def test_odd_tables(spark):
    docs = spark.createDataFrame([], SCHEMA + ", kept int, extra string")
    got = repeats.remove_repeats(docs)
    assert got.columns == ["doc_id", "extra", "n_bytes", "spans", "kept"] and got.collect() == []


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: r for r in registry.op8_repeats(spark, SF).collect()}
    assert len(got) == len(docs)
    for doc, (data, spans) in zip(docs, brute_force([d.text for d in docs], 200)):
        r = got[doc.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(data), sum(b - a for a, b in spans), len(spans))
        assert r.kept_sha256 == hashlib.sha256(repeats.without(data, spans)).hexdigest()
