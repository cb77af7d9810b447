from __future__ import annotations

import re
from collections import defaultdict
from fractions import Fraction

import pytest

from clftally.llm import mixing, registry
from tests.llm.compare import duckdb_rows, spark_rows

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, source string, text string"


def targets_of(sizes):
    """Shares in exact fractions, by resharing until no source is above its limit."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    capped = {}
    while True:
        rest = sum(sizes.values()) - sum(capped.values())
        weights = sum(w for s, w in weight.items() if s not in capped) or 1
        share = {s: Fraction(rest * weight[s], weights) for s in order if s not in capped}
        above = {s: 3 * sizes[s] for s, t in share.items() if t > 3 * sizes[s]}
        if not above:
            return share | {s: Fraction(c) for s, c in capped.items()}
        capped |= above


def check(rows, texts):
    sizes, taken = defaultdict(int), defaultdict(int)
    for source, text in texts:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    for r in rows:
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size and r.source_size == sizes[r.source]
    want = targets_of(sizes)
    for r in rows:
        assert r.target == pytest.approx(float(want[r.source]))
    for source, target in want.items():
        assert abs(taken[source] - target) <= 0.5


@pytest.mark.parametrize("hot", [2, 40])
def test_against_exact_shares(spark, hot):
    data = [(i, f"s{i % 7}" if i % hot else None, "w " * (i * 7919 % 50)) for i in range(500)]
    data += [(7, "s1", "a b c")] * 5 + [(None, "s1", None), (None, None, "x"), (1, "zz", ""), (2, "tiny", "a")]
    mixed = mixing.mix(spark.createDataFrame(data, SCHEMA))
    check(mixed.collect(), [d[1:] for d in data])
    assert sorted(map(str, mixed.collect())) == sorted(map(str, mixed.repartition(3).collect()))


def test_taken_rows_hold_the_taken_words(spark):
    data = [(i, f"s{i % 3}", f" a{i}\tb c\n" * (1 + i % 9 * (i % 3))) for i in range(90)]
    mixed = mixing.mix(spark.createDataFrame(data, SCHEMA))
    words = defaultdict(int)
    for r in mixing.take(mixed).collect():
        assert data[r.doc_id][2].startswith(r.text)
        words[r.doc_id] += len(r.text.split())
    assert words == {r.doc_id: r.taken for r in mixed.collect() if r.taken}


def test_odd_tables(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, "a", None, 5, "x"), (1, "a", "", 6, "y")]
    docs = spark.createDataFrame(rows, SCHEMA + ", size long, target string")
    mixed = mixing.mix(docs)
    assert mixed.columns == ["doc_id", "source", "text", "size", "source_size", "target", "taken"]
    assert [tuple(r)[3:] for r in mixed.collect()] == [(0, 0, 0.0, 0)] * 2
    assert mixing.take(mixed).count() == 0


def test_one_source(spark):
    docs = spark.createDataFrame([(1, None, "a b"), (2, None, "c")], SCHEMA)
    assert sorted((r.doc_id, r.target, r.taken) for r in mixing.mix(docs).collect()) == [(1, 3.0, 2), (2, 3.0, 1)]


def test_query_equals_its_sql(spark):
    assert spark_rows(registry.op3_mixing(spark, SF)) == duckdb_rows(mixing.SQL, SF)
