"""The prefix trie of conversations, with what sharing prefixes saves, by the Euler tour technique.

Every distinct sequence of first turns is a node. A turn is known by 128 bits of its role and text, and a sequence by
the exclusive or of those of its turns, each mixed with its place, so sequences can be put together in blocks and a
conversation with most of the turns is spread over tasks.

The tour enters and leaves each node once. Children follow each other by their least conversations, so it goes down the
path of a node's least conversation first, and up again until it comes to another child. The arcs that it takes on such
a path without leaving it are a stretch, known by the first of them. There are two stretches at most for each end of a
conversation, and more only where a path is cut into pieces of `PIECE_DEPTHS`.

Stretches are linked, each to the next, and the list is ranked: randomly chosen arcs are stops, all others jump along
their links, doubling their step each round, until they see a stop; the stops form a list that is shorter by `STEP`,
which is ranked the same way. Running sums over the ranked stretches then give the leaves and the savings of a node's
subtree as a difference between its two arcs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clftally.llm import common
from clftally.operators import numbering

# One arc in so many is a stop of its round.
STEP = 64
# A list of at most so many arcs is ranked in one task.
SHORT = 4096
# Depths of a path that are put together into stretches in one place.
PIECE_DEPTHS = 1 << 12
# The children of a node are linked within so many groups, and then the groups.
GROUPS = 1024
# Conversation ids whose list makes one piece of a digest's input.
PIECE = 4096


# Turns of one number are put in order by so many of their first characters, and then by digest.
ORDER_CHARS = 128


def turns_of(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``conv_id``, ``block``, ``pos`` (from 1), and of each turn ``a``, ``b`` (128 bits) and ``chars``.

    Turns are ordered by number, NULL first, those of one number by role, the first `ORDER_CHARS` characters of the
    text and a digest. NULL roles and texts are empty. Rows without a conversation are left out; repeated rows are
    turns of their own. Blocks follow each other within a conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    rows = conversations.filter(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("bigint").alias("conv_id"),
        F.col(turn).alias("turn"),
        role.alias("role"),
        F.left(text, F.lit(ORDER_CHARS)).alias("start"),
        F.xxhash64(role, text).alias("a"),
        F.xxhash64(F.lit("|"), text, role).alias("b"),
        F.monotonically_increasing_id().alias("row"),
        F.length(text).cast("bigint").alias("chars"),
    )
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "start", "a", "b", "row"]
    blocks = numbering.in_blocks(rows, order).sortWithinPartitions(*order)
    placed = common.checkpointed(
        blocks.select("conv_id", "block", "a", "b", "chars", F.monotonically_increasing_id().alias("place"))
    )
    return numbering.numbered(placed, ["conv_id"], ["place"], "pos").drop("place")


def rebuilt(turns: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Conversations whose first turns are those of the first conversation of their hundred.

    Each conversation c takes the first h turns of c - c % ``every`` (all if it has fewer, none if there is no such
    conversation), h being the CRC-32 of c in decimal modulo ``most``, and its own turns from behind its first h.
    Returns ``conv_id``, ``block``, ``depth``, ``a``, ``b``, ``chars`` and ``turns``, the depth of the last; a
    conversation without a turn has one row of depth 0.
    """
    own = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(most)).cast("bigint")
    lengths = turns.groupBy("conv_id").agg(F.count("*").alias("length"))
    bases = lengths.select(F.col("conv_id").alias("base"), F.col("length").alias("base_length"))
    plans = (
        lengths.withColumns({"h": own, "base": F.col("conv_id") - F.col("conv_id") % every})
        .join(bases, "base", "left")
        .withColumn("taken", F.least("h", F.coalesce("base_length", F.lit(0))))
        .withColumn("turns", F.col("taken") + F.greatest(F.col("length") - F.col("h"), F.lit(0)))
        .select("conv_id", "base", "h", "taken", "turns")
    )
    plans = common.checkpointed(plans)
    blocks = turns.select("conv_id", "block").distinct().join(plans, "conv_id")
    kept = (
        turns.join(blocks, ["conv_id", "block"])
        .filter(F.col("pos") > F.col("h"))
        .select("conv_id", "block", (F.col("taken") + F.col("pos") - F.col("h")).alias("depth"), "a", "b", "chars", "turns")
    )
    # No more than `every` conversations, twice as many around 0, ask for the same few turns.
    first = turns.filter(F.col("pos") < most).select(F.col("conv_id").alias("base"), "pos", "a", "b", "chars")
    borrowed = (
        plans.join(first, "base")
        .filter(F.col("pos") <= F.col("taken"))
        .select("conv_id", F.lit(-1).alias("block"), F.col("pos").alias("depth"), "a", "b", "chars", "turns")
    )
    nothing = _zero()
    empty = plans.filter("turns = 0").select(
        "conv_id", F.lit(-1).alias("block"), *[nothing.alias(c) for c in ("depth", "a", "b", "chars")], "turns"
    )
    return kept.unionByName(borrowed).unionByName(empty)


def plain(turns: DataFrame) -> DataFrame:
    """Conversations as they are, in the form `trie` takes."""
    lengths = turns.groupBy("conv_id").agg(F.count("*").alias("turns"))
    blocks = turns.select("conv_id", "block").distinct().join(lengths, "conv_id")
    return turns.join(blocks, ["conv_id", "block"]).select(
        "conv_id", "block", F.col("pos").alias("depth"), "a", "b", "chars", "turns"
    )


def trie(turns: DataFrame) -> DataFrame:
    """One row per node of the trie of conversations, the textless root included; none without conversations.

    ``turns`` is what `rebuilt` and `plain` return. Columns: ``a``, ``b`` (the node), ``conv_id`` (least member),
    ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256``.
    """
    prefixes = common.checkpointed(_prefixes(turns))
    placed = common.checkpointed(_placed(_linked(common.checkpointed(_nodes(prefixes)))))
    tour = common.checkpointed(_tour(placed))
    ranks = common.checkpointed(ranked(tour.select("arc", "next")))
    # Ranks count from the end, so sums are of what begins at a stretch.
    sums = numbering.running_sums(tour.join(ranks, "arc"), "rank", {"leaves": "leaf", "savings": "saved"})
    of_path = sums.groupBy("conv_id", "piece").agg(
        F.sort_array(F.collect_list(F.struct("stretch", "leaves", "savings"))).alias("sums")
    )
    # What begins at a node's entry, less what begins at its exit, is its subtree.
    entry, leaving = F.col("sums")[0], F.col("sums")[F.col("stretch").cast("int")]
    only = F.col("stretch") == 0
    return (
        placed.join(of_path, ["conv_id", "piece"])
        .withColumn("n_leaves", F.when(only, F.lit(1).cast("bigint")).otherwise(entry["leaves"] - leaving["leaves"]))
        .withColumn(
            "saved_tokens",
            F.when(only, F.col("saved_in_all")).otherwise(entry["savings"] - leaving["savings"]) - F.col("saved_above"),
        )
        .join(_ends(prefixes), ["a", "b"], "left")
        .select(
            "a", "b", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
        )
    )


def _zero() -> Column:
    return F.lit(0).cast("bigint")


def _prefixes(turns: DataFrame) -> DataFrame:
    """Each turn with the node it leads to (``a``, ``b``) and the one it comes from (``qa``, ``qb``)."""
    at_root = F.col("depth") == 0
    mixed = turns.select(
        "conv_id", "block", "depth", "chars", "turns",
        F.when(at_root, _zero()).otherwise(F.xxhash64("depth", "a", "b")).alias("ha"),
        F.when(at_root, _zero()).otherwise(F.xxhash64("b", "a", "depth")).alias("hb"),
    )
    totals = mixed.groupBy("conv_id", "block").agg(F.bit_xor("ha").alias("ta"), F.bit_xor("hb").alias("tb"))
    before = numbering.carried(
        totals, ["conv_id"], "block", {"ca": F.bit_xor("ta"), "cb": F.bit_xor("tb")}
    ).drop("ta", "tb")
    so_far = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    inside = mixed.select("*", F.bit_xor("ha").over(so_far).alias("xa"), F.bit_xor("hb").over(so_far).alias("xb"))
    both = inside.join(before, ["conv_id", "block"])
    a, b = F.col("xa").bitwiseXOR(F.col("ca")), F.col("xb").bitwiseXOR(F.col("cb"))
    return both.select(
        "conv_id", "depth", "chars", "turns", a.alias("a"), b.alias("b"),
        a.bitwiseXOR(F.col("ha")).alias("qa"), b.bitwiseXOR(F.col("hb")).alias("qb"),
    )


def _nodes(prefixes: DataFrame) -> DataFrame:
    """Nodes with their members counted; every conversation is a member of the root."""
    below = prefixes.filter("depth > 0").groupBy("a", "b", "qa", "qb", "depth").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars")
    )
    root = (
        prefixes.filter("depth = least(turns, 1)")
        .agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
        .filter("n_convs > 0")
        .select(
            _zero().alias("a"), _zero().alias("b"), F.lit(None).cast("bigint").alias("qa"),
            F.lit(None).cast("bigint").alias("qb"), _zero().alias("depth"), "conv_id", "n_convs",
            _zero().alias("chars"),
        )
    )
    return below.unionByName(root)


def _linked(nodes: DataFrame) -> DataFrame:
    """Nodes with their parent's conversation, ``n_children``, their first child and their next sibling.

    Siblings are linked in groups dealt by hash, and the groups of a parent through their first members, so that the
    children of one node spread over tasks. The first child is that of the least conversation; any order of the others
    will do.
    """
    this = F.struct("conv_id", "a", "b")
    group = F.pmod(F.xxhash64("a", "b"), F.lit(GROUPS)).cast("int")
    children = nodes.filter("qa IS NOT NULL").withColumn("group", group)
    keys = ["qa", "qb", "group"]
    heads = children.groupBy(*keys).agg(F.min(this).alias("head"), F.count("*").alias("number"))
    parents = nodes.select(F.col("a").alias("qa"), F.col("b").alias("qb"), F.col("conv_id").alias("parent_conv_id"))
    of_parent = Window.partitionBy("qa", "qb").orderBy("head")
    heads = heads.withColumn("next_head", F.lead("head").over(of_parent)).join(parents, ["qa", "qb"])
    families = heads.groupBy(F.col("qa").alias("a"), F.col("qb").alias("b")).agg(
        F.sum("number").alias("n_children"), F.min("head").alias("first_child")
    )
    in_group = Window.partitionBy(*keys).orderBy("conv_id")
    siblings = (
        children.select(*keys, "a", "b", F.lead(this).over(in_group).alias("beside"))
        .join(heads, keys)
        .select("a", "b", F.coalesce("beside", "next_head").alias("sibling"), "parent_conv_id")
    )
    return (
        nodes.join(siblings, ["a", "b"], "left")
        .join(families, ["a", "b"], "left")
        .withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("bigint")))
    )


def _arc(node: Column, out: bool) -> Column:
    return F.struct(node["a"].alias("a"), node["b"].alias("b"), F.lit(out).alias("out"))


def _placed(linked: DataFrame) -> DataFrame:
    """Nodes with the number of the stretch, within their piece of a path, that their exit is in.

    The nodes of one least conversation follow each other by depth, and all but the last one's first child is the next.
    So their entries are the beginning of stretch 0. It turns round at a leaf; below another node, or at the end of the
    piece, it goes on elsewhere (``down``, in the uppermost row). Exits follow each other up to one that has a sibling,
    or the uppermost; there the stretch ends (``onward`` is its next arc). ``saved_above`` counts the nodes above in the
    piece, and ``saved_in_all`` and ``top`` (the uppermost node, where stretch 0 ends) are of the piece.
    """
    here = F.struct("a", "b")
    path = Window.partitionBy("conv_id", "piece")
    above = path.orderBy("depth")
    deeper = path.orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, -1)
    following = (
        F.when(F.col("sibling").isNotNull(), _arc(F.col("sibling"), False))
        .when(F.col("qa").isNotNull(), _arc(F.struct(F.col("qa").alias("a"), F.col("qb").alias("b")), True))
    )
    return (
        linked.withColumns({
            "piece": F.floor(F.col("depth") / PIECE_DEPTHS),
            "saved": (F.col("n_convs") - 1) * F.col("chars"),
        })
        .select(
            "*",
            F.lag("depth").over(above).isNull().alias("uppermost"),
            F.max_by("first_child", "depth").over(path).alias("down"),
            F.min_by(here, "depth").over(path).alias("top"),
            F.sum("saved").over(path).alias("saved_in_all"),
            F.coalesce(F.sum("saved").over(above.rowsBetween(Window.unboundedPreceding, -1)), _zero()).alias("saved_above"),
        )
        .withColumn("ends", F.col("uppermost") | F.col("sibling").isNotNull())
        .withColumn("ended", F.coalesce(F.sum(F.col("ends").cast("bigint")).over(deeper), _zero()))
        .withColumn("stretch", F.col("down").isNotNull().cast("bigint") + F.col("ended"))
        .select(
            "a", "b", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "piece", "stretch", "saved_above",
            "saved_in_all", F.when(F.col("uppermost"), F.col("down")).alias("down"), "uppermost",
            F.when(F.col("ends") & (F.col("stretch") == 0), F.col("top")).alias("top"),
            F.when(F.col("ends"), following).alias("onward"),
        )
    )


def _tour(placed: DataFrame) -> DataFrame:
    """The stretches: ``arc`` (the first one), ``next`` (the first one of the next stretch), and what is on the way.

    A node's values stand on the arc that enters it, so all are in the first stretch of a piece.
    """
    here, first = F.struct("a", "b"), F.col("stretch") == 0
    last = lambda c: F.min_by(c, "depth")
    back = placed.groupBy("conv_id", "piece", "stretch").agg(
        F.max_by(here, "depth").alias("deepest"), last("onward").alias("next"), last("top").alias("top"),
        last("saved_in_all").alias("saved"),
    )
    back = back.select(
        "conv_id", "piece", "stretch",
        F.when(first, _arc(F.col("top"), False)).otherwise(_arc(F.col("deepest"), True)).alias("arc"),
        "next",
        first.cast("bigint").alias("leaf"),
        F.when(first, F.col("saved")).otherwise(_zero()).alias("saved"),
    )
    away = placed.filter(F.col("uppermost") & F.col("down").isNotNull()).select(
        "conv_id", "piece", _zero().alias("stretch"), _arc(here, False).alias("arc"),
        _arc(F.col("down"), False).alias("next"), _zero().alias("leaf"), F.col("saved_in_all").alias("saved"),
    )
    return back.unionByName(away)


def ranked(links: DataFrame, step: int = STEP, short: int = SHORT) -> DataFrame:
    """``arc`` and ``rank``, the number of arcs that follow it in the list; the last one's ``next`` is NULL.

    With a ``weight``, the rank is the sum of the weights on the way to the end.

    A round is no join: Spark takes the size of a join for the product of its sides' sizes and keeps that with a
    checkpoint, so the number would have twice as many digits after each round, until the driver cannot hold it.
    """
    if "weight" not in links.columns:
        links = links.withColumn("weight", F.col("next").isNotNull().cast("bigint"))
    links = common.checkpointed(links.select("arc", "next", "weight"))
    if links.count() <= short:
        return _ranked_here(links)
    stop = lambda arc: F.pmod(F.xxhash64(arc, F.lit(step)), F.lit(step)) == 0
    there = F.col("next").isNull() | stop(F.col("next"))
    seen = common.checkpointed(links.withColumn("there", there))
    while not seen.filter(~F.col("there")).isEmpty():
        seen = common.checkpointed(_jumped(seen))
    # The stops take another step size, so that those of the next round are others.
    stops = ranked(seen.filter(stop(F.col("arc"))).select("arc", "next", "weight"), step + 1, short)
    onward = stops.select(F.col("arc").alias("next"), F.col("rank").alias("onward"))
    return seen.join(onward, "next", "left").select(
        "arc", (F.col("weight") + F.coalesce("onward", F.lit(0))).alias("rank")
    )


def _jumped(seen: DataFrame) -> DataFrame:
    """Arcs that are not ``there`` yet with the next one's next, and all others as they are.

    Every arc tells what it has at its own place, and those that are not there ask at the place of their next.
    """
    kind = seen.schema["arc"].dataType
    row = lambda at, asks, arc, next: F.struct(
        at.alias("at"), F.lit(asks).alias("asks"), arc.alias("arc"), next.alias("next"), "weight", "there"
    )
    arc, next, nothing = F.col("arc"), F.col("next"), F.lit(None).cast(kind)
    tells, asks = row(arc, False, nothing, next), row(next, True, arc, nothing)
    rows = seen.select(F.inline(F.when(F.col("there"), F.array(tells)).otherwise(F.array(tells, asks))))
    told = F.first(F.when(~F.col("asks"), F.struct("next", "weight", "there")))
    rows = rows.withColumn("told", told.over(Window.partitionBy("at").orderBy("asks")))
    of = lambda own, name, onward: F.when(F.col("asks"), onward).otherwise(own).alias(name)
    return rows.filter(F.col("there") | F.col("asks") & F.col("told").isNotNull()).select(
        F.coalesce("arc", "at").alias("arc"),
        of(F.col("next"), "next", F.col("told.next")),
        of(F.col("weight"), "weight", F.col("weight") + F.col("told.weight")),
        of(F.col("there"), "there", F.col("told.there")),
    )


def _ranked_here(links: DataFrame) -> DataFrame:
    """Rank a list of at most `SHORT` arcs in one task."""
    schema = links.select("arc", F.col("weight").alias("rank")).schema
    names = ["a", "b", "out"]

    def run(rows: pa.Table) -> pa.Table:
        arcs = [tuple(v[n] for n in names) for v in rows["arc"].to_pylist()]
        following = {arc: None if v is None else tuple(v[n] for n in names) for arc, v in zip(arcs, rows["next"].to_pylist())}
        weights = dict(zip(arcs, rows["weight"].to_pylist()))
        way, arc = [], next(iter(set(arcs) - set(following.values())), None)
        while arc is not None:
            way.append(arc)
            arc = following[arc]
        total = np.cumsum([weights[arc] for arc in reversed(way)])[::-1]
        rank = dict(zip(way, total.tolist()))
        return pa.table([rows["arc"], pa.array([rank[arc] for arc in arcs], pa.int64())], names=["arc", "rank"])

    whole = common.for_python(links.withColumn("whole", F.lit(0)))
    return whole.groupBy("whole").applyInArrow(run, schema)


def _ends(prefixes: DataFrame) -> DataFrame:
    """SHA-256 of the ids of the conversations that end at each node, in order, comma-joined.

    Ids are put together in pieces of up to `PIECE` first; a digest then reads its pieces in order, one at a time.
    """
    ending = prefixes.filter("depth = turns")
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = ending.groupBy("a", "b", F.floor(F.col("conv_id") / PIECE).alias("piece")).agg(ids.alias("ids"))
    schema = "a bigint, b bigint, ends_sha256 string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, digest, done = None, None, []
        for batch in batches:
            for a, b, text in zip(batch["a"], batch["b"], batch["ids"]):
                if (a, b) == node:
                    digest.update(b",")
                else:
                    if node:
                        done.append((*node, digest.hexdigest()))
                    node, digest = (a, b), hashlib.sha256()
                digest.update(text.encode())
            if done:
                yield pd.DataFrame(done, columns=["a", "b", "ends_sha256"])
                done = []
        if node:
            yield pd.DataFrame([(*node, digest.hexdigest())], columns=["a", "b", "ends_sha256"])

    sorted_pieces = pieces.repartition("a", "b").sortWithinPartitions("a", "b", "piece")
    return common.for_python(sorted_pieces).select("a", "b", "ids").mapInPandas(run, schema)


# CRC-32 of a blob, bit by bit.
CRC_SQL = """(xor(list_reduce(list_concat([4294967295::UBIGINT],
    list_transform(range(0, octet_length({blob})), lambda i: CAST('0x' || hex({blob})[2 * i + 1 : 2 * i + 2] AS UBIGINT))),
    lambda c, byte: list_reduce(list_concat([xor(c, byte)], list_transform(range(0, 8), lambda i: i::UBIGINT)),
      lambda k, i: CASE WHEN k & 1 = 1 THEN xor(k >> 1, 3988292384::UBIGINT) ELSE k >> 1 END)), 4294967295::UBIGINT))"""

SQL = f"""
WITH own AS (
  SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS t,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
),
convs AS (
  SELECT conv_id, count(*) AS length, {CRC_SQL.format(blob="encode(CAST(conv_id AS VARCHAR))")} % 6 AS h
  FROM own GROUP BY conv_id
),
plans AS (
  SELECT c.conv_id, b.conv_id AS base, CAST(c.h AS BIGINT) AS h, least(CAST(c.h AS BIGINT), coalesce(b.length, 0)) AS taken
  FROM convs c LEFT JOIN convs b ON b.conv_id = c.conv_id - c.conv_id % 100
),
again AS (
  SELECT p.conv_id, o.pos AS depth, r, t FROM plans p JOIN own o ON o.conv_id = p.base AND o.pos <= p.taken
  UNION ALL
  SELECT p.conv_id, p.taken + o.pos - p.h, r, t FROM plans p JOIN own o ON o.conv_id = p.conv_id AND o.pos > p.h
),
members AS (
  SELECT conv_id, depth, length(t) AS chars,
    string_agg(md5(r) || md5(t), '') OVER (PARTITION BY conv_id ORDER BY depth) AS key
  FROM again
  UNION ALL
  SELECT conv_id, 0, 0, '' FROM convs
),
nodes AS (
  SELECT key, depth, key[1 : 64 * (depth - 1)] AS parent, min(conv_id) AS conv_id, count(*) AS n_convs,
    (count(*) - 1) * max(chars) AS saved
  FROM members GROUP BY key, depth
),
families AS (SELECT parent AS key, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY parent),
counted AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN families USING (key)),
subtrees AS (
  SELECT m.key, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved) AS saved_tokens
  FROM counted n JOIN members m ON m.conv_id = n.conv_id AND m.depth <= n.depth GROUP BY m.key
),
lasts AS (SELECT conv_id, max(depth) AS depth FROM members GROUP BY conv_id),
ends AS (
  SELECT key, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids
  FROM members JOIN lasts USING (conv_id, depth) GROUP BY key
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves,
  CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM counted n JOIN subtrees USING (key) LEFT JOIN ends USING (key)
LEFT JOIN nodes p ON n.depth > 0 AND p.key = n.parent
"""
