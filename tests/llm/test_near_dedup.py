from __future__ import annotations

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from clftally.llm import near_dedup, registry, shingles

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingle_set(text):
    found = words(text)
    if len(found) < 5:
        return {tuple(found)} if found else set()
    return {tuple(found[i : i + 5]) for i in range(len(found) - 4)}


def brute_force(rows, threshold=0.8):
    texts = sorted({text or "" for _, text in rows})
    sets, root = [shingle_set(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    for a, b in {p for of in holders.values() for p in itertools.combinations(of, 2)}:
        if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    part = {t: find(i) for i, t in enumerate(texts)}
    least = defaultdict(set)
    for doc_id, text in rows:
        least[part[text or ""]].add(doc_id)
    name = {p: min((i for i in ids if i is not None), default=None) for p, ids in least.items()}
    return sorted(((d, name[part[t or ""]]) for d, t in rows), key=str), part


def edited(rnd, base, edits):
    copy = list(base)
    for _ in range(edits):
        copy[rnd.randrange(len(copy))] = f"e{rnd.randrange(10**6)}"
    return " ".join(copy)


@pytest.fixture(scope="module")
def families():
    rnd, rows = random.Random(1), []
    for family in range(30):
        base = [f"w{rnd.randrange(3000)}" for _ in range(rnd.choice([6, 40, 150, 400]))]
        rows += [edited(rnd, base, rnd.randrange(1 + len(base) // 20)) for _ in range(rnd.choice([1, 2, 5, 40]))]
    rows += ["", "  \n", None, "one two", "one  two ", "one two three", rows[0], rows[0] + " "]
    rows += ["again and again " * 3000, "again and again " * 3001]
    rows = list(enumerate(rows)) + [(None, "one two"), (3, "lonely text of id three"), (None, "no id at all")]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [1_000_000, 2_000])
def test_against_brute_force(spark, families, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", block)
    docs = spark.createDataFrame(families, SCHEMA).repartition(4)
    got = sorted(((r.doc_id, r.class_id) for r in near_dedup.classes(docs).collect()), key=str)
    assert got == brute_force(families)[0]


def test_unequal_repeats_against_brute_force(spark):
    """Pairs with nearly the same shingles, of which one text repeats a passage or a line many times."""
    rnd, rows = random.Random(2), []
    for pair, (length, passage, times) in enumerate([(500, 24, 50), (1000, 104, 20), (1000, 104, 10)] * 8):
        base = [f"p{pair}w{i}" for i in range(length)]
        at = rnd.randrange(length - passage)
        rows += [" ".join(base), " ".join(base[: at + passage] + base[at : at + passage] * times + base[at + passage :])]
    rows = list(enumerate(rows))
    want, part = brute_force(rows)
    assert len(set(part.values())) == len(rows) // 2
    got = near_dedup.classes(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert sorted(((r.doc_id, r.class_id) for r in got), key=str) == want


def test_one_row_of_each_class_stays(spark, families):
    twice = families + families[:50]
    left = near_dedup.drop_copies(spark.createDataFrame(twice, SCHEMA)).collect()
    labelled, part = brute_force(twice)
    assert sorted(part[r.text or ""] for r in left) == sorted(set(part.values()))
    assert {str(r.doc_id) for r in left} == {str(c) for _, c in labelled}


def test_odd_tables(spark):
    docs = spark.createDataFrame([], SCHEMA + ", class_id string, extra int")
    assert near_dedup.classes(docs).columns == ["doc_id", "text", "extra", "class_id"]
    assert near_dedup.classes(docs).collect() == [] and near_dedup.drop_copies(docs).collect() == []


def test_register_agreement_estimates_probability_jaccard():
    rng = np.random.default_rng(3)
    a = {int(x): float(w) for x, w in zip(rng.integers(1, 1 << 60, 60), rng.integers(1, 9, 60))}
    b = dict(list(a.items())[:45]) | {int(x): 2.0 for x in rng.integers(1, 1 << 60, 10)}
    b = {x: w * (3 if i % 7 == 0 else 1) for i, (x, w) in enumerate(b.items())}
    every = set(a) | set(b)
    exact = sum(
        1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in every) for i in set(a) & set(b)
    )
    sketch = lambda s: near_dedup.signature(
        np.array(list(s), np.uint64), np.array(list(s.values())), 20_000
    )
    assert (sketch(a) == sketch(b)).mean() == pytest.approx(exact, abs=0.015)


def test_early_end_changes_nothing():
    """Registers equal the least of all points, taken far beyond the end."""
    elements = np.array([5, 6, 7], np.uint64)
    weights = np.array([1.0, 2.0, 0.5])
    got = near_dedup.signature(elements, weights, 8)
    best = {}
    for element, weight in zip(elements, weights):
        time = 0.0
        for arrival in range(1, 400):
            one = np.array([element], np.uint64)
            r = near_dedup.draw(one, 2 * arrival)[0]
            time += -np.log(((int(r) >> 11) + 0.5) / 2**53) / weight
            k = int(near_dedup.draw(one, 2 * arrival + 1)[0]) % 8
            best[k] = min(best.get(k, (np.inf, 0)), (time, int(element)))
    assert got.tolist() == [best[k][1] for k in range(8)]


def test_shingles_equal_words():
    texts = ["a b c d e f a b c d e", None, "", " x ", "q\x0bw e r t", "é ü 中 ß ñ é ü 中 ß ñ", "z" * 3_000_000]
    flat, hashes = [], []
    for text in texts:
        found = words(text)
        flat += [tuple(found[i : i + 5]) for i in range(max(0, len(found) - 4))] or ([tuple(found)] if found else [])
    for _, data, offsets in shingles.blocks(pa.array(texts)):
        for found in shingles.shingles(data, offsets):
            hashes += found.tolist()
    assert len(hashes) == len(flat)
    assert len(set(zip(flat, hashes))) == len(set(flat)) == len(set(hashes))


def test_forest_connects_like_all_pairs():
    rnd = random.Random(4)
    for _ in range(50):
        sets = [sorted(rnd.sample(range(14), rnd.randrange(1, 12))) for _ in range(25)]
        arrays = [np.array(s, np.uint64) for s in sets]
        links = near_dedup.forest(arrays, 0.6)
        pairs = [
            (i, j)
            for i, j in itertools.combinations(range(25), 2)
            if len(set(sets[i]) & set(sets[j])) >= 0.6 * len(set(sets[i]) | set(sets[j]))
        ]
        assert set(links) <= set(pairs) and parts(25, links) == parts(25, pairs)
    assert near_dedup.forest([], 0.8) == []


def parts(n, links):
    root = list(range(n))
    for _ in range(n):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(((r.doc_id, r.class_id) for r in registry.op6_near_dedup(spark, SF).collect()), key=str)
    assert got == brute_force(rows)[0]
    assert max(Counter(c for _, c in got).values()) > 1
