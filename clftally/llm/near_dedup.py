"""Near-duplicate documents by ProbMinHash, banding and exact verification.

Each text is the set of its five-word shingles. In ProbMinHash every shingle sends points into random registers as a
Poisson process whose rate is its weight; a register keeps the shingle of its first point, and a shingle stops as
soon as its next point comes later than all registers have. Two texts agree in a register with the probability
Jaccard similarity of their weights. All shingles weigh the same here, however often a text repeats them, so this is
the Jaccard similarity of the sets, the one that is verified.

Texts that agree in a band of registers are candidates. Candidates linked through bands form families, which are
usually small; within a family the sets of shingles are compared exactly, by an inverted index, and classes are the
connected parts of the pairs that reach the threshold. Pairs are never sent anywhere: a comparison hands on no
more links than it needs to connect what belongs together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clftally.llm import common, shingles

THRESHOLD = 0.8
# 25 bands of 5: a pair of similarity 0.8 is a candidate with probability 0.99995.
BANDS, ROWS = 25, 5
# Shingles of a family that are compared in one task with as many others; larger families are split into blocks,
# and all pairs of blocks are compared.
BLOCK_SHINGLES = 1_000_000

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def draw(elements: np.ndarray, number: int) -> np.ndarray:
    """A random 64-bit value of each element, another for each number."""
    return shingles.mixed(elements + np.uint64(int(_GOLDEN) * number % (1 << 64)))


def signature(elements: np.ndarray, weights: np.ndarray, registers: int = BANDS * ROWS) -> np.ndarray:
    """The element that comes first in each register. Needs at least one element."""
    first = np.full(registers, np.inf)
    winner = np.zeros(registers, np.uint64)
    times, active, arrival = np.zeros(len(elements)), np.arange(len(elements)), 0
    while len(active):
        arrival += 1
        random = draw(elements[active], 2 * arrival)
        gap = -np.log(((random >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53))
        times[active] += gap / weights[active]
        active = active[times[active] < first.max()]
        random = draw(elements[active], 2 * arrival + 1)
        place = (random % np.uint64(registers)).astype(np.int64)
        # Latest first, so that the earliest point of a register is written last.
        order = np.argsort(-times[active])
        place, point = place[order], active[order]
        better = times[point] < first[place]
        first[place[better]] = times[point[better]]
        winner[place[better]] = elements[point[better]]
    return winner


def band_keys(winners: np.ndarray) -> np.ndarray:
    """One key per band, unlike those of other bands."""
    table = winners.reshape(BANDS, ROWS)
    keys = np.arange(BANDS, dtype=np.uint64)
    for row in range(ROWS):
        keys = shingles.mixed(keys * _GOLDEN + table[:, row])
    return keys.view(np.int64)


def sketches(docs: DataFrame, node: str, text: str) -> DataFrame:
    """``node``, ``n`` (different shingles) and ``bands`` of each row that has a word, once per task and text."""
    schema = T.StructType(
        [docs.schema[node], T.StructField("n", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, keys, kept = [], [], []
            for first, data, offsets in shingles.blocks(batch.column(text)):
                for i, found in enumerate(shingles.shingles(data, offsets), first):
                    if len(found):
                        elements = np.unique(found)
                        kept.append(i)
                        number.append(len(elements))
                        keys.append(band_keys(signature(elements, np.ones(len(elements)))))
            flat = pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64))
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * BANDS, pa.int32()), flat)
            nodes = batch.column(node).take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([nodes, pa.array(number, pa.int64()), bands], schema.names)

    return docs.select(node, text).mapInArrow(run, schema)


def components(edges: DataFrame) -> DataFrame:
    """Connected parts of an undirected graph: ``(node, part)``, where ``part`` is its least node.

    Every round gives each node the least label among its neighbours and then the label of its label, so far
    ends come together fast. Rounds end when no label changes. Labels are checkpointed, never collected.
    """
    both = common.checkpointed(
        edges.select(F.col("u"), F.col("v")).unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    )
    labels = both.groupBy("u").agg(F.min("v").alias("v")).select(
        F.col("u").alias("node"), F.least("u", "v").alias("part")
    )
    while True:
        labels = common.checkpointed(labels)
        near = (
            both.join(labels.select(F.col("node").alias("v"), "part"), "v")
            .groupBy(F.col("u").alias("node"))
            .agg(F.min("part").alias("near"))
        )
        lower = common.checkpointed(
            labels.join(near, "node").select("node", "part", F.least("part", "near").alias("low"))
        )
        jump = lower.select(F.col("node").alias("low"), F.col("low").alias("lowest"))
        if lower.filter("low < part").isEmpty():
            return labels
        labels = lower.join(jump, "low").select("node", F.col("lowest").alias("part"))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Add ``class_id`` to all rows: the least id of the documents in the row's class.

    Documents are in one class if a chain of pairs connects them, each with at least ``threshold`` of all their
    different five-word shingles in common. A text with fewer than five words is one shingle of all its words. Equal
    texts always share a class, those without words too, which share it with no others; a NULL text counts as
    empty. NULL ids never name a class unless all of its are NULL. All columns stay, whatever their names; a
    ``class_id``, in any case, is replaced.
    """
    aside = common.Aside(docs)
    return aside.back(_labelled(aside.rows, aside.name(doc_id), aside.name(text), threshold), ["class_id"])


def _labelled(docs: DataFrame, doc_id: str, text: str, threshold: float) -> DataFrame:
    """Rows with the key of their text, their ``class_id``, and whether theirs is the text of the class that stays."""
    names = docs.columns
    keyed = common.for_python(docs).select(*names, F.unhex(F.md5(common.text_or_empty(text))).alias("_node"))
    ids = keyed.groupBy("_node").agg(F.min(doc_id).alias("_least"))
    part = verified_parts(keyed, text, threshold)
    labelled = ids.join(part.withColumnRenamed("node", "_node"), "_node", "left").withColumn(
        "part", F.coalesce("part", "_node")
    )
    first = F.min(F.struct(F.col("_least").isNull().alias("none"), F.col("_least"), F.col("_node")))
    heads = labelled.groupBy("part").agg(first.alias("_head"))
    by_node = labelled.join(heads, "part").select(
        "_node", F.col("_head._least").alias("class_id"), (F.col("_head._node") == F.col("_node")).alias("_stays")
    )
    return keyed.join(by_node, "_node").select(*names, "class_id", "_node", "_stays")


def verified_parts(keyed: DataFrame, text: str, threshold: float) -> DataFrame:
    """``(node, part)`` of the texts that are linked to others."""
    sketched = sketches(
        keyed.select("_node", common.text_or_empty(text).alias("_text")), "_node", "_text"
    ).dropDuplicates(["_node"])
    sketched = common.checkpointed(sketched)
    members = sketched.select(F.col("_node").alias("v"), F.explode("bands").alias("band"))
    heads = members.groupBy("band").agg(F.min("v").alias("u"), F.count("*").alias("size")).filter("size > 1")
    # A text hangs on the least of its bands' heads only, and its other heads on that one: what its bands connect
    # stays connected, by one link per text and one per pair of heads, of which many texts have the same.
    hung = members.join(heads, "band").groupBy("v").agg(F.min("u").alias("u"), F.collect_set("u").alias("heads"))
    links = F.explode(F.concat(F.array("v"), F.col("heads"))).alias("v")
    stars = hung.select("u", links).filter("u <> v").distinct()
    families = components(stars)
    links = _family_links(keyed, text, families, sketched, threshold)
    return components(links)


def _family_links(
    keyed: DataFrame, text: str, families: DataFrame, sketched: DataFrame, threshold: float
) -> DataFrame:
    """Links that connect what belongs together in each family."""
    sized = families.join(sketched.select(F.col("_node").alias("node"), "n"), "node")
    blocks = sized.groupBy("part").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    placed = common.checkpointed(
        families.join(blocks, "part").select(F.col("node").alias("_node"), "part", "blocks", own.alias("own"))
    )
    rows = keyed.select("_node", common.text_or_empty(text).alias("_text")).join(placed, "_node")
    sets = _shingle_sets(rows)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = sets.withColumn("other", other).select(
        F.struct("part", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).alias("pair"),
        F.col("_node").alias("node"),
        "set",
    )

    def compare(rows: pa.Table) -> pa.Table:
        sets = dict(zip(rows["node"].to_pylist(), rows["set"].to_pylist()))
        nodes = sorted(sets)
        found = forest([np.frombuffer(sets[n], np.uint64) for n in nodes], threshold)
        ends = [pa.array([nodes[pair[side]] for pair in found], pa.binary()) for side in (0, 1)]
        return pa.table(ends, names=["u", "v"])

    return dealt.groupBy("pair").applyInArrow(compare, "u binary, v binary")


def _shingle_sets(rows: DataFrame) -> DataFrame:
    """``_text`` as the sorted hashes of its shingles, packed in ``set``; equal texts once per task."""
    schema = common.schema_with(rows, ["_text"], [T.StructField("set", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            fresh = []
            for i, node in enumerate(batch.column("_node").to_pylist()):
                if node not in seen:
                    seen.add(node)
                    fresh.append(i)
            batch = batch.take(pa.array(fresh, pa.int64()))
            sets = []
            for _, data, offsets in shingles.blocks(batch.column("_text")):
                sets += [np.unique(found).tobytes() for found in shingles.shingles(data, offsets)]
            columns = [pa.array(sets, pa.binary()) if f == "set" else batch.column(f) for f in schema.names]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return rows.mapInArrow(run, schema)


def forest(sets: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """Pairs of sets with at least that Jaccard similarity, as many as connect what such pairs connect.

    Each set is met with all later ones at once: the lists of the sets that hold its elements are put together
    and counted.
    """
    if not sets:
        return []
    sizes = np.array([len(s) for s in sets])
    elements = np.concatenate(sets)
    owners = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(elements, kind="stable")
    holders, ordered = owners[order], elements[order]
    new = np.concatenate((np.ones(min(1, len(ordered)), bool), ordered[1:] != ordered[:-1]))
    start_of, run = np.flatnonzero(new), np.cumsum(new) - 1
    end_of = np.append(start_of[1:], len(ordered))
    # Where in the lists each element of each set stands; those behind it belong to later sets.
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    until = np.empty(len(order), np.int64)
    until[order] = end_of[run]
    roots, links = list(range(len(sets))), []
    at = np.concatenate(([0], np.cumsum(sizes)))

    def root(i: int) -> int:
        while roots[i] != i:
            roots[i] = roots[roots[i]]
            i = roots[i]
        return i

    for i in range(len(sets)):
        begin, end = place[at[i] : at[i + 1]] + 1, until[at[i] : at[i + 1]]
        lengths = end - begin
        if not lengths.any():
            continue
        offset = np.repeat(begin - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
        shared = np.bincount(holders[np.arange(lengths.sum()) + offset], minlength=len(sets))
        similar = np.flatnonzero((shared > 0) & (shared >= threshold * (sizes[i] + sizes - shared) - 1e-9))
        for j in similar.tolist():
            a, b = root(i), root(j)
            if a != b:
                roots[max(a, b)] = min(a, b)
                links.append((i, j))
    return links


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class: that of its least id, and of several such rows the first by its other columns.

    All columns are kept, whatever their names; maps and variants are put in order by their text as JSON.
    """
    aside = common.Aside(docs)
    doc_id, text = aside.name(doc_id), aside.name(text)
    rows = _labelled(aside.rows, doc_id, text, threshold)
    others = [_in_order(field) for field in aside.rows.schema.fields if field.name != text]
    place = F.row_number().over(Window.partitionBy("_node").orderBy(*others))
    first = (
        rows.filter(F.col("_stays") & F.col(doc_id).eqNullSafe(F.col("class_id")))
        .withColumn("_place", place)
        .filter("_place = 1")
    )
    return aside.back(first)


def _in_order(field: T.StructField) -> Column:
    """A column's values as something that can be sorted."""
    kind = field.dataType.simpleString()
    return F.to_json(F.struct(field.name)) if "map<" in kind or "variant" in kind else F.col(field.name)
