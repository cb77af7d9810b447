from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from clftally.llm import registry, variants
from tests.llm.compare import duckdb_rows, spark_rows

SCHEMA = "doc_id long, text string"


def brute_counts(docs, one_in):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if one_in and h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_groups(counts):
    near = {w: [v for v in counts if v != w and one_edit(w, v)] for w in counts}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 10 * counts[w] else None
    rows = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, n, len(near[w]), counts.get(form[w])))
    return sorted(rows)


def grouped(spark, docs, one_in=None):
    counts = variants.word_counts(spark.createDataFrame(docs, SCHEMA).repartition(3), one_in=one_in)
    return sorted(tuple(row) for row in variants.grouped(counts).collect())


@pytest.mark.parametrize("seed", range(2))
def test_against_brute_force(spark, seed):
    """Words over two letters have many near ones, with letters next to their like."""
    pick, docs = random.Random(seed), [(None, None), (7, ""), (None, "aabbaab aabbaab")]
    for i in range(60):
        words = ["".join(pick.choices("ab" if i % 2 else "aéÀÿ÷", k=pick.randrange(6, 10))) for _ in range(30)]
        docs.append((i, " ".join(words)))
        if i % 6 == 0:
            docs.append((1000 + i, (words[0] + "-") * pick.choice([10, 100, 1000])))
    for one_in in (None, 3):
        assert grouped(spark, docs, one_in) == brute_groups(brute_counts(docs, one_in))


def test_chains_of_forms(spark):
    """Each word is a variant of the next, ten times as frequent; ways of four steps end at one root."""
    words = ["recieved", "received", "receivedx", "receivedxy", "receivedxyz"]
    docs = [(i, " ".join([word] * (2 * 10 ** (i % 4)))) for i, word in enumerate(words[1:4])] + [(9, "Received, " * 18)]
    got = {row[0]: row[1:3] for row in grouped(spark, docs)}
    assert got["received"] == ("receivedx", "receivedxy") or got["received"][1] == "received"
    counts = {"abcdefg": 2, "abcdefgh": 20, "abcdefghi": 200, "abcdefghij": 2000, "abcdefghijk": 20000}
    docs = [(i, " ".join([word] * n)) for i, (word, n) in enumerate(counts.items())]
    assert {row[2] for row in grouped(spark, docs)} == {"abcdefghijk"}


def test_ties_and_letters(spark):
    docs = [(1, "Straßen straßen STRAßEN " + "strassen " * 30 + "strafen " * 30 + "strajen " * 30)]
    assert grouped(spark, docs) == brute_groups(brute_counts(docs, None))


def test_long_words(spark):
    """Words around the length from which rests are hashed, and one of a quarter of a million letters."""
    pick, texts = random.Random(5), []
    base = "".join(pick.choices("abé", k=70))
    for length in (63, 64, 65, 66, 67):
        for k in range(6):
            at = pick.randrange(length)
            texts += [base[:length] + " "] * pick.choice([1, 2, 40])
            texts += [base[:at] + "xyb"[k % 3] + base[at + 1 : length] + " "] * 2
    docs = [(i, text * 2) for i, text in enumerate(texts)]
    assert grouped(spark, docs) == brute_groups(brute_counts(docs, None))
    huge = "ab" * 125_000
    got = grouped(spark, [(1, f"{huge} " * 30 + f"{huge[1:]} {huge[1:]} {huge}c {huge}c {huge}c")])
    assert [(len(word), form and len(form), n, near) for word, form, _, n, near, _ in got] == [
        (250_000, None, 30, 2), (250_001, 250_000, 3, 1), (249_999, 250_000, 2, 1)
    ]


def test_odd_tables(spark):
    assert grouped(spark, []) == []
    odd = spark.createDataFrame([(1, "wordwords wordwords", 2, "y")], SCHEMA + ", word long, run string")
    assert [tuple(r) for r in variants.word_counts(odd).collect()] == [("wordwords", 2)]


def test_query_equals_its_sql(spark):
    sf_dir = "/root/testdata/sf0.001"
    assert spark_rows(registry.op13_variants(spark, sf_dir)) == duckdb_rows(variants.SQL, sf_dir)
