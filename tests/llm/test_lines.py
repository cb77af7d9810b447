from __future__ import annotations

from collections import defaultdict

import pytest

import corpus_pipeline
from clftally.llm import lines, registry
from tests.llm.compare import duckdb_rows, spark_rows

SCHEMA = "doc_id long, source string, text string"


def brute_force(rows, min_sites):
    sites, of_text = defaultdict(set), defaultdict(list)
    for _, source, text in rows:
        of_text[text].append((source is None, source or ""))
    for text, on in of_text.items():
        for line in (text or "").split("\n"):
            sites[line.strip(" \t\n\x0b\f\r")].add(min(on))
    shared = {line for line, on in sites.items() if line and len(on) >= min_sites}
    for doc_id, source, text in rows:
        if text is None:
            yield doc_id, source, None, 0, 0
            continue
        parts = text.split("\n")
        bare = [p.strip(" \t\n\x0b\f\r") for p in parts]
        left = "\n".join(p for p, b in zip(parts, bare) if b not in shared)
        gone = sum(b in shared for b in bare)
        yield doc_id, source, left if gone else text, sum(map(bool, bare)), gone


@pytest.mark.parametrize("min_sites", [2, 5, 12])
def test_against_brute_force(spark, min_sites):
    rows = []
    for i in range(400):
        own = [f"line {i} {j} of its own" for j in range(4)]
        common = [f"footer {k}" for k in range(15) if i % 20 <= k]
        rows.append((i, f"s{i % 20}" if i % 20 else None, "\n".join([*common[:1], *own, "", " \t", *common[1:3]])))
    rows += [(1, "s1", "x\n\nx\n"), (1, "s1", "x\n\nx\n"), (None, None, None), (7, None, ""), (8, "s3", "footer 19\n" * 3)]
    rows += [(900 + i, f"s{i}", "copied line one\ncopied line two") for i in range(20)]
    rows += [(950, "s1", "  footer 14\t\nmy words are here and there\r\n" + "z" * 50_000)]
    got = lines.drop_shared_lines(spark.createDataFrame(rows, SCHEMA), min_sites=min_sites).collect()
    key = lambda r: tuple(map(str, r))
    want = [(d, s, t, n, g) for d, s, t, n, g in brute_force(rows, min_sites)]
    assert sorted([tuple(r) for r in got], key=key) == sorted(want, key=key)


def test_copies_on_many_sites_stay(spark):
    rows = [(i, f"s{i}", "first line of it\nsecond line of it") for i in range(50)]
    got = lines.drop_shared_lines(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.text for r in got} == {rows[0][2]} and {r.n_removed for r in got} == {0}


def test_odd_tables(spark):
    assert lines.drop_shared_lines(spark.createDataFrame([], SCHEMA)).collect() == []
    docs = spark.createDataFrame([(1, "a", "x", 3, "y")], SCHEMA + ", n_lines long, extra string")
    got = lines.drop_shared_lines(docs)
    assert got.columns == ["doc_id", "source", "text", "extra", "n_lines", "n_removed"]
    assert tuple(got.first()) == (1, "a", "x", "y", 1, 0)


def test_query_equals_its_sql(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        assert spark_rows(registry.op7_lines(spark, sf)) == duckdb_rows(lines.SQL, sf)


def test_all_shared_lines_go_and_copies_stay(spark):
    """Pages that are mostly boilerplate lose it all; a text that many sites copy is no boilerplate."""
    menu = "home about contact imprint\nall rights reserved by us"
    rows = [(i, f"s{i}", f"{menu}\nown {i}") for i in range(20)] + [(20, "s0", menu)]
    rows += [(100 + i, f"s{i}", "first line of it\nsecond line of it") for i in range(50)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for left in (
        lines.drop_shared_lines(docs),
        corpus_pipeline.line_dedup(spark, docs, ""),
    ):
        got = {r.doc_id: r.text for r in left.collect()}
        assert got == {d: f"own {d}" if d < 20 else "" if d == 20 else t for d, _, t in rows}
