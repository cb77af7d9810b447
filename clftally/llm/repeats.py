"""Removal of byte strings that occur more than once, by suffix arrays.

A string counts if it is `LENGTH` bytes long and starts anywhere else too, in another text or the same one.

Sharding. Each start of such a string has a key: the least hash of the short strings inside it. Equal strings have
equal keys, so strings need comparing only within a key, and a key that occurs once needs nothing. Neighbouring
starts mostly share their key, and such a run travels as one region: its starts and the bytes behind them.

Within a shard, the regions are put together and their suffixes sorted by refinement of groups (Larsson and
Sadakane: sort by the first bytes, then by the group of the suffix a known number of bytes further on, doubling that
number). Common prefixes of neighbours come from Kasai's walk, one region per lane. A start is repeated if a neighbour
has `LENGTH` bytes in common with it.

A key with very many regions is split over shards. Each of these hands on one digest for every string that it has not
found to be repeated itself, and one for each group that it has; merging looks the digests of each shard up in those of
the others by binary search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clftally.llm import common, shingles

LENGTH = 200
# Bytes of the short strings whose least hash is a key.
GRAM = 48
# Bytes that are hashed, and region bytes that are sorted, at a time.
BLOCK_BYTES, SHARD_BYTES = 1 << 18, 1 << 20
# Starts in one region at most, and regions of a key in one shard.
REGION_STARTS, SHARD_REGIONS = 1 << 16, 2048


# Keys


def start_keys(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Key of each start in some bytes, and the hashes of all short strings."""
    grams = len(data) - gram + 1
    starts = np.arange(max(0, grams))
    hashes = shingles.stretch_hashes(data, starts, starts + gram)
    width = length - gram + 1
    least, reach = hashes, 1
    while 2 * reach <= width:
        least, reach = np.minimum(least[:-reach], least[reach:]), 2 * reach
    if reach < width:
        least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
    return least, hashes


def runs(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """First start, number of starts, key, and whether the key's string occurs twice, of each run of one text."""
    data, parts = np.frombuffer(text, np.uint8), []
    for begin in range(0, len(data) - length + 1, BLOCK_BYTES):
        block = data[begin : begin + BLOCK_BYTES + length - 1]
        keys, hashes = start_keys(block, length, gram)
        new = np.concatenate(([True], keys[1:] != keys[:-1]))
        new[::REGION_STARTS] = True
        first = np.flatnonzero(new)
        number = np.diff(np.append(first, len(keys)))
        found = keys[first]
        # Places of each run's key among the short strings that its starts reach.
        order = np.argsort(hashes, kind="stable")
        ordered = hashes[order]
        again = ordered[1:] == ordered[:-1]
        repeated = np.unique(ordered[1:][again])
        at = np.minimum(np.searchsorted(repeated, found), max(0, len(repeated) - 1))
        twice = repeated[at] == found if len(repeated) else np.zeros(len(found), bool)
        parts.append((first + begin, number, found, twice))
    if not parts:
        none = np.empty(0, np.int64)
        return none, none, none.view(np.uint64), none.astype(bool)
    return tuple(np.concatenate(part) for part in zip(*parts))


# Suffix arrays


def suffix_array(codes: np.ndarray) -> np.ndarray:
    """Suffixes in order, of codes below 512; what lies behind the end is less than any code but 0.

    Groups of suffixes that are equal so far are refined; those of one member are left alone.
    """
    size = len(codes)
    padded = np.concatenate((codes.astype(np.uint64), np.zeros(6, np.uint64)))
    # Seven codes fit one number.
    packed = np.zeros(size, np.uint64)
    for step in range(7):
        packed = (packed << np.uint64(9)) | padded[step : step + size]
    order = np.argsort(packed)
    ordered = packed[order]
    new = np.concatenate((np.ones(min(1, size), bool), ordered[1:] != ordered[:-1]))
    # A group is known by the place of its first member, counted from 1; 0 is the end.
    rank = np.zeros(size + 1, np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1] + 1
    at, known = np.flatnonzero(~(new & np.append(new[1:], True))), 7
    while len(at):
        members = order[at]
        key = rank[members] * (size + 1) + rank[np.minimum(members + known, size)]
        inner = np.argsort(key)
        members, key = members[inner], key[inner]
        first = np.concatenate(([True], key[1:] != key[:-1]))
        order[at] = members
        rank[members] = at[np.flatnonzero(first)[np.cumsum(first) - 1]] + 1
        at = at[~(first & np.append(first[1:], True))]
        known *= 2
    return order


def common_prefixes(codes: np.ndarray, order: np.ndarray, first: np.ndarray, number: np.ndarray, depth: int) -> np.ndarray:
    """For each suffix of some lanes, the codes it shares with the one before it in order, up to ``depth``.

    Kasai's walk: the next suffix of a text shares at least one code less with its neighbour than this one did. All
    lanes, given by first suffix and number, are walked side by side. A code of 0 equals nothing.
    """
    size = len(codes)
    place = np.empty(size, np.int64)
    place[order] = np.arange(size)
    padded = np.append(codes, 0).astype(np.int16)
    found = np.zeros(size, np.int64)
    longest_first = np.argsort(-number, kind="stable")
    first, number = first[longest_first], number[longest_first]
    shared = np.zeros(len(first), np.int64)
    for step in range(int(number[0]) if len(number) else 0):
        live = int(np.searchsorted(-number, -step))
        here = first[:live] + step
        before = np.where(place[here] > 0, order[place[here] - 1], size)
        shared = np.maximum(shared[:live] - 1, 0)
        shared[before == size] = 0
        growing = np.arange(live)
        while len(growing):
            a, b = here[growing] + shared[growing], before[growing] + shared[growing]
            left = padded[np.minimum(a, size)]
            same = (left == padded[np.minimum(b, size)]) & (left > 0) & (shared[growing] < depth)
            growing = growing[same]
            shared[growing] += 1
        found[here] = shared
    return found


def repeated_starts(regions: list[tuple[bytes, int]], length: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Which starts of each region are repeated, and a number of its string for each start of all regions in turn.

    A region is its bytes and its number of starts, ``length - 1`` less than its bytes. A mark after each region ends
    all comparisons, so a suffix that shares ``length`` bytes with a start is a start too.
    """
    sizes = np.array([len(data) + 1 for data, _ in regions], np.int64)
    number = np.array([starts for _, starts in regions], np.int64)
    first = np.cumsum(sizes) - sizes
    codes = np.frombuffer(b"".join(data + b"\0" for data, _ in regions), np.uint8).astype(np.int16) + 1
    codes[first + sizes - 1] = 0
    order = suffix_array(codes)
    shared = common_prefixes(codes, order, first, number, length)[order] >= length
    repeated, string = np.zeros(len(codes), bool), np.empty(len(codes), np.int64)
    repeated[order] = shared | np.append(shared[1:], False)
    string[order] = np.cumsum(~shared)
    at = np.repeat(first - (np.cumsum(number) - number), number) + np.arange(number.sum())
    return np.split(repeated[at], np.cumsum(number)[:-1]), string[at]


# Spark


def repeated_stretches(docs: DataFrame, text: str, length: int = LENGTH) -> DataFrame:
    """``(_node, first, number)``: stretches of starts of repeated strings in each text, by the text's key.

    ``docs`` has ``_node``, equal for equal texts only. Texts that occur more than once are not looked at for that.
    """
    found = docs.select("_node", F.col(text).alias("_text")).mapInArrow(
        _text_runs(length), "_key long, _node binary, _first long, _number int, _twice boolean"
    )
    # A window rather than a join with counted keys: the runs are made and shuffled once.
    of_key = Window.partitionBy("_key")
    one = F.struct("_node", "_first", "_number")
    counted = found.select(
        "*",
        (F.min(one).over(of_key) < F.max(one).over(of_key)).alias("_several"),
        F.max("_twice").over(of_key).alias("_again"),
        F.count("*").over(of_key).alias("_n"),
    )
    parts = F.ceil(F.col("_n") / SHARD_REGIONS)
    shard = F.pmod(F.xxhash64("_node", "_first"), parts).cast("int")
    hits = counted.filter("_several or _again").select(
        "_node", F.struct("_first", "_number", "_key", shard.alias("_shard"), (parts > 1).alias("_split")).alias("hit")
    )
    by_text = hits.groupBy("_node").agg(F.collect_set("hit").alias("_hits"))
    regions = (
        docs.select("_node", F.col(text).alias("_text"))
        .join(by_text, "_node")
        .mapInArrow(
            _cut_regions(length),
            "_key long, _shard int, _split boolean, _node binary, _first long, _number int, _bytes binary",
        )
        .repartition("_key", "_shard")
        .sortWithinPartitions("_key", "_shard")
    )
    sorted_ = common.checkpointed(
        regions.mapInArrow(
            _sort_shards(length), "_node binary, first long, number int, digest binary, shard int, alone boolean"
        )
    )
    inside = sorted_.filter("digest is null").select("_node", "first", "number")
    across = (
        sorted_.filter("digest is not null")
        .repartition("digest")
        .mapInArrow(_merge_shards, "_node binary, first long, number int")
    )
    return inside.unionByName(across)


def _text_runs(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            parts, nodes, counts = [], [], []
            for node, text in zip(batch.column("_node").to_pylist(), batch.column("_text")):
                if node not in seen:
                    seen.add(node)
                    part = runs(text.as_py().encode(), length)
                    if len(part[0]):
                        parts.append(part)
                        nodes.append(node)
                        counts.append(len(part[0]))
            if parts:
                first, number, key, twice = (np.concatenate(p) for p in zip(*parts))
                who = pa.array(np.repeat(np.arange(len(nodes)), counts))
                columns = [
                    pa.array(key.view(np.int64)),
                    pa.array(nodes, pa.binary()).take(who),
                    pa.array(first, pa.int64()),
                    pa.array(number, pa.int32()),
                    pa.array(twice),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["_key", "_node", "_first", "_number", "_twice"])

    return run


def _cut_regions(length: int):
    names = ["_key", "_shard", "_split", "_node", "_first", "_number", "_bytes"]
    kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.int64(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            rows = []
            for i, node in enumerate(batch.column("_node").to_pylist()):
                if node in seen:
                    continue
                seen.add(node)
                text = batch.column("_text")[i].as_py().encode()
                for h in batch.column("_hits")[i].as_py():
                    first, number = h["_first"], h["_number"]
                    cut = text[first : first + number + length - 1]
                    rows.append((h["_key"], h["_shard"], h["_split"], node, first, number, cut))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return run


def _sort_shards(length: int):
    """Sorts regions a shard at a time: whole keys, put together up to `SHARD_BYTES`."""
    names = ["_node", "first", "number", "digest", "shard", "alone"]
    kinds = [pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = {}, 0, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in batch.schema.names]
            for key, shard, split, node, first, number, data in zip(*columns):
                if size >= SHARD_BYTES and (key, shard) != last:
                    yield result(held)
                    held, size = {}, 0
                last = (key, shard)
                if (node, first) not in held:
                    held[(node, first)] = (shard, split, number, data)
                    size += len(data)
        if held:
            yield result(held)

    def result(held: dict) -> pa.RecordBatch:
        rows = list(shard_rows(held, length))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, kinds)], names)

    return run


def shard_rows(held: dict, length: int) -> Iterator[tuple]:
    """Stretches of repeated starts of a shard, and digests of the strings of split keys.

    Regions of equal bytes are sorted once; all their starts are repeated.
    """
    alike: dict[tuple[bytes, int], list] = {}
    for (node, first), (shard, split, number, data) in held.items():
        alike.setdefault((data, number), []).append((node, first, shard, split))
    regions = list(alike)
    repeated, strings = repeated_starts(regions, length)
    handed_on, at = set(), 0
    for (data, number), found in zip(regions, repeated):
        owners = alike[(data, number)]
        found = found | (len(owners) > 1)
        edges = np.flatnonzero(np.diff(np.concatenate(([0], found.astype(np.int8), [0]))))
        for begin, end in edges.reshape(-1, 2).tolist():
            for node, first, _, _ in owners:
                yield node, first + begin, end - begin, None, 0, False
        node, first, shard, split = owners[0]
        if split:
            for start in range(number):
                # Of the strings found here, one digest tells the other shards of each.
                string = int(strings[at + start])
                if not found[start] or string not in handed_on:
                    handed_on.add(string)
                    digest = hashlib.blake2b(data[start : start + length], digest_size=16).digest()
                    yield node, first + start, 1, digest, shard, not found[start]
        at += number


def _merge_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Starts not repeated in their own shard whose digests another shard has."""
    batches = list(batches)
    table = pa.Table.from_batches(batches) if batches else None
    if table is None or not len(table):
        return
    digests = np.array(table["digest"].to_pylist(), "S16")
    shards = table["shard"].to_numpy()
    order = {s: np.flatnonzero(shards == s) for s in np.unique(shards)}
    pieces = {s: np.sort(digests[rows]) for s, rows in order.items()}
    again = np.zeros(len(table), bool)
    for s, rows in order.items():
        for other, piece in pieces.items():
            if other != s:
                at = np.minimum(np.searchsorted(piece, digests[rows]), len(piece) - 1)
                again[rows] |= piece[at] == digests[rows]
    kept = table.filter(pa.array(again & table["alone"].to_numpy(zero_copy_only=False)))
    yield from kept.select(["_node", "first", "number"]).to_batches()


# Documents


def remove_repeats(
    docs: DataFrame, text: str = "text", keep: list[str] | None = None, length: int = LENGTH
) -> DataFrame:
    """Add ``n_bytes``, ``spans`` (removed runs: first byte and number) and ``kept`` (the bytes left) to each row.

    A byte goes if a string of ``length`` bytes that covers it starts anywhere else in the table too; all are judged
    on the input. A NULL text counts as empty. The text is dropped, and of the other columns ``keep`` stay (default:
    all); those named like new ones, in any case, are replaced, and other names are free. Rows of equal texts lose
    everything that is long enough.
    """
    aside = common.Aside(docs)
    names = docs.columns if keep is None else keep
    keep = [c for c in names if aside.name(c) != aside.name(text)]
    inside = list(dict.fromkeys(map(aside.name, keep)))
    return aside.back(_without_repeats(aside.rows, aside.name(text), inside, length), ["n_bytes", "spans", "kept"], keep)


def _without_repeats(docs: DataFrame, text: str, kept: list[str], length: int) -> DataFrame:
    whole = common.text_or_empty(text)
    keyed = common.for_python(docs).select(*kept, F.unhex(F.md5(whole)).alias("_node"), whole.alias("_text"))
    copied = keyed.groupBy("_node").agg(F.count("*").alias("n")).filter("n > 1").select("_node", F.lit(True).alias("_copied"))
    stretches = repeated_stretches(keyed.select("_node", "_text"), "_text", length)
    by_text = stretches.groupBy("_node").agg(F.collect_list(F.struct("first", "number")).alias("_stretches"))
    marked = by_text.join(copied, "_node", "full")
    rows = keyed.join(marked, "_node", "left").drop("_node")
    fields = [
        T.StructField("n_bytes", T.LongType()),
        T.StructField(
            "spans",
            T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("number", T.LongType())])),
        ),
        T.StructField("kept", T.BinaryType()),
    ]
    schema = common.schema_with(rows, ["_text", "_stretches", "_copied"], fields)
    span = pa.struct([("first", pa.int64()), ("number", pa.int64())])
    kinds = {"n_bytes": pa.int64(), "spans": pa.list_(span), "kept": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in common.slices(whole, "_text")):
            new = {name: [] for name in kinds}
            for text_, found, copied_ in zip(
                batch.column("_text"), batch.column("_stretches"), batch.column("_copied").to_pylist()
            ):
                data = text_.as_py().encode()
                stretches = [(s["first"], s["number"]) for s in found.as_py() or ()]
                if copied_ and len(data) >= length:
                    stretches = [(0, len(data) - length + 1)]
                spans = covered(stretches, length)
                new["n_bytes"].append(len(data))
                new["spans"].append([{"first": a, "number": b - a} for a, b in spans])
                new["kept"].append(without(data, spans))
            yield pa.RecordBatch.from_arrays(
                [pa.array(new[f], kinds[f]) if f in kinds else batch.column(f) for f in schema.names], schema.names
            )

    return rows.mapInArrow(run, schema)


def covered(stretches: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """First and last byte of each run that strings starting in the stretches cover; ends exclusive."""
    spans: list[tuple[int, int]] = []
    for first, number in sorted(stretches):
        end = first + number + length - 1
        if spans and first <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(spans[-1][1], end))
        else:
            spans.append((first, end))
    return spans


def without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *[edge for span in spans for edge in span], len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
