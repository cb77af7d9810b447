from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from clftally.llm import prefix_trie, registry
from tests.llm.compare import duckdb_rows, spark_rows

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def original(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {conv: [t[2:] for t in sorted(found)] for conv, found in turns.items()}


def brute_rebuilt(turns):
    done = {}
    for c, own in turns.items():
        h, base = zlib.crc32(str(c).encode()) % 6, c - (abs(c) % 100) * (1 if c >= 0 else -1)
        done[c] = turns.get(base, [])[:h] + own[h:]
    return done


def brute_nodes(turns):
    members, ends = defaultdict(list), defaultdict(list)
    for c, own in turns.items():
        for d in range(len(own) + 1):
            members[tuple(own[:d])].append(c)
        ends[tuple(own)].append(c)
    leaves, saved, children = defaultdict(int), defaultdict(int), defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    for path, convs in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += children[path] == 0
            saved[path[:d]] += (len(convs) - 1) * len(path[-1][1]) if path else 0
    return sorted(
        (
            min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs), children[path],
            leaves[path], saved[path],
            hashlib.sha256(",".join(map(str, sorted(ends[path]))).encode()).hexdigest(),
        )
        for path, convs in members.items()
    )


def nodes(turns):
    return sorted(tuple(row[c] for c in COLUMNS) for row in prefix_trie.trie(turns).collect())


def some_conversations(seed, convs, turns):
    pick = random.Random(seed)
    rows = []
    for c in range(convs):
        c = c * 7 - 40
        for t in range(pick.randrange(turns)):
            text = "same start" if t == 0 and c % 3 else pick.choice(["é😀", "", None, "a longer text", "x" * 400])
            rows.append((c, pick.choice([t, t, 3, None]), pick.choice(["user", "assistant", None]), text))
    rows += [(None, 1, "user", "no conversation"), *rows[:5]]
    pick.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_against_brute_force(spark, seed):
    rows = some_conversations(seed, 60, 9)
    turns = prefix_trie.turns_of(spark.createDataFrame(rows, SCHEMA))
    assert nodes(prefix_trie.rebuilt(turns)) == brute_nodes(brute_rebuilt(original(rows)))
    assert nodes(prefix_trie.plain(turns)) == brute_nodes(original(rows))


def test_one_conversation_with_most_turns_and_many_copies(spark):
    """A long conversation is spread over blocks; equal ones end at one node."""
    rows = [(0, t, "user", f"turn {t % 7}") for t in range(800)]
    rows += [(100 * c + 100, t, "user", "same") for c in range(300) for t in range(2)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns = prefix_trie.turns_of(spark.createDataFrame(rows, SCHEMA).repartition(8))
        assert turns.filter("conv_id = 0").select("block").distinct().count() > 1
        assert nodes(prefix_trie.plain(turns)) == brute_nodes(original(rows))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_turnless_conversations(spark):
    """A conversation whose turns all give way to those of one that does not exist."""
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 == 3)
    rows = [(c, 1, "user", "a"), (c, 2, "user", "b")]
    got = nodes(prefix_trie.rebuilt(prefix_trie.turns_of(spark.createDataFrame(rows, SCHEMA))))
    assert got == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_long_lists_are_ranked(spark):
    order = list(range(3000))
    random.Random(1).shuffle(order)
    arc = lambda i: (order[i], -order[i], bool(order[i] % 2))
    rows = [(arc(i), arc(i + 1) if i + 1 < len(order) else None) for i in range(len(order))]
    kind = "struct<a: long, b: long, out: boolean>"
    links = spark.createDataFrame(rows, f"arc {kind}, next {kind}")
    got = {tuple(row.arc): row.rank for row in prefix_trie.ranked(links, step=8, short=40).collect()}
    assert got == {arc(i): len(order) - 1 - i for i in range(len(order))}


def test_rounds_do_not_multiply_sizes(spark):
    """The size that Spark expects of a rank list has a few digits more after each round, not twice as many."""
    rows = [((i, 0, False), (i + 1, 0, False) if i < 2999 else None) for i in range(3000)]
    kind = "struct<a: long, b: long, out: boolean>"
    got = prefix_trie.ranked(spark.createDataFrame(rows, f"arc {kind}, next {kind}"), step=8, short=40)
    expected = got._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert expected.bit_length() < 2000
    assert {row.arc.a: row.rank for row in got.collect()} == {i: 2999 - i for i in range(3000)}


@pytest.mark.parametrize("depths", [1, 3])
def test_paths_in_pieces(spark, monkeypatch, depths):
    monkeypatch.setattr(prefix_trie, "PIECE_DEPTHS", depths)
    rows = some_conversations(7, 40, 9)
    # Long paths that part at several depths, and one that ends inside another.
    rows += [(1000 + c, t, "user", f"{t if t < 5 * c else (c, t)}") for c in range(6) for t in range(30)]
    rows += [(900, t, "user", f"{t}") for t in range(13)]
    turns = prefix_trie.turns_of(spark.createDataFrame(rows, SCHEMA))
    assert nodes(prefix_trie.rebuilt(turns)) == brute_nodes(brute_rebuilt(original(rows)))
    assert nodes(prefix_trie.plain(turns)) == brute_nodes(original(rows))


def test_tour_is_linked_by_stretches(spark):
    """The list to rank grows with the ends of conversations, not with their turns."""
    rows = [(c, t, "user", "same" if t < 40 + c else f"{c} {t}") for c in range(5) for t in range(60)]
    turns = prefix_trie.plain(prefix_trie.turns_of(spark.createDataFrame(rows, SCHEMA)))
    found = prefix_trie._nodes(prefix_trie._prefixes(turns))
    assert found.count() == 1 + 44 + 16 + 17 + 18 + 19 + 20
    assert prefix_trie._tour(prefix_trie._placed(prefix_trie._linked(found))).count() <= 2 * 5 + 1


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert nodes(prefix_trie.rebuilt(prefix_trie.turns_of(empty))) == []
    assert nodes(prefix_trie.plain(prefix_trie.turns_of(empty))) == []
    rows = [(1, None, None, None, 1, 2, 3, "x"), (1, None, None, None, 1, 2, 3, "x")]
    odd = spark.createDataFrame(rows, SCHEMA + ", block long, row long, pos long, start string")
    assert nodes(prefix_trie.plain(prefix_trie.turns_of(odd))) == brute_nodes({1: [("", "")] * 2})


def test_query_equals_its_sql(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = spark_rows(registry.op11_prefix_trie(spark, sf_dir))
    assert got == duckdb_rows(prefix_trie.SQL, sf_dir, "conversations")
