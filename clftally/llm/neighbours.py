"""Approximate nearest neighbours by low-dimensional stable projections in a kd-tree.

Vectors are scaled to length one, so that the largest cosine is the least distance, and projected by a few normal
random vectors. Over the choice of these, the squared projected distance of two vectors divided by their squared
distance follows a chi-square distribution. A kd-tree over the projections is searched outwards from a query, leaf
by leaf; each leaf's vectors are verified exactly. The search stops when the next leaf is so far off that a vector
nearer than the k-th best would, with the probability asked for, have been projected nearer than that leaf.

The tree's upper levels are fitted on a bounded sample and deal the vectors out to cells; each cell builds its own
lower levels. A query first searches the cell it lies in, and then only the cells that the test does not rule out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clftally.llm import common

# Projected dimensions; even, for the closed form of the chi-square distribution.
PROJECTED = 10
# Probability that a nearer vector would have been met before the search stops.
CONFIDENCE = 0.97
# Vectors per cell and per leaf, and queries that a cell answers in one task.
CELL_ROWS, LEAF_ROWS, QUERY_ROWS = 8192, 128, 4096
# The upper levels are fitted on about so many vectors, at least so many for each cell.
SAMPLE, SAMPLE_PER_CELL = 20_000, 4
SEED = 11
# Scores closer than this count as equal until they are computed once more in one way.
_NOISE = 1e-12


def chi_square(x: float, degrees: int) -> float:
    """Distribution function for an even number of degrees of freedom."""
    terms, term = 0.0, 1.0
    for i in range(degrees // 2):
        terms += term
        term *= x / 2 / (i + 1)
    return 1 - math.exp(-x / 2) * terms


def chi_square_limit(confidence: float, degrees: int) -> float:
    """Where the distribution function reaches ``confidence``."""
    low, high = 0.0, 1e4
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, degrees) < confidence else (low, middle)
    return high


def projection(dimensions: int) -> np.ndarray:
    return np.random.default_rng((SEED, dimensions)).normal(size=(dimensions, PROJECTED))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one; scaled by the largest part first, so that no square overflows or vanishes."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def cosines(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Cosine of vectors of any length with a query, row by row, so that equal vectors get equal values."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    query = query / np.abs(query).max()
    norms = np.sqrt((scaled * scaled).sum(axis=1)) * np.sqrt((query * query).sum())
    return (scaled * query).sum(axis=1) / norms


@dataclass
class Tree:
    """Splits of space by levels; node ``i`` has the children ``2i + 1`` and ``2i + 2``, the last level is cells."""

    depth: int
    axes: np.ndarray
    cuts: np.ndarray

    @property
    def cells(self) -> int:
        return 1 << self.depth

    def cell_of(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            right = points[np.arange(len(points)), self.axes[node]] >= self.cuts[node]
            node = 2 * node + 1 + right
        return node - (self.cells - 1)

    def squared_distances(self, points: np.ndarray) -> np.ndarray:
        """From each point to the box of each cell."""
        low = np.full((1, PROJECTED), -np.inf)
        high = np.full((1, PROJECTED), np.inf)
        for level in range(self.depth):
            nodes = np.arange((1 << level) - 1, (2 << level) - 1)
            low, high = np.repeat(low, 2, axis=0), np.repeat(high, 2, axis=0)
            left, right = np.arange(0, len(low), 2), np.arange(1, len(low), 2)
            high[left, self.axes[nodes]] = self.cuts[nodes]
            low[right, self.axes[nodes]] = self.cuts[nodes]
        return np.stack([box_distances(low, high, point) for point in points]) if len(points) else np.empty((0, len(low)))


def box_distances(low: np.ndarray, high: np.ndarray, point: np.ndarray) -> np.ndarray:
    away = np.maximum(np.maximum(low - point, point - high), 0)
    return (away * away).sum(axis=1)


def fit_tree(points: np.ndarray, depth: int) -> Tree:
    """Each node is cut at the median of its widest axis."""
    axes, cuts = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1)
    members = {0: points}
    for node in range((1 << depth) - 1):
        own = members.pop(node)
        if len(own):
            axes[node] = np.argmax(own.max(axis=0) - own.min(axis=0))
            cuts[node] = np.median(own[:, axes[node]])
        right = own[:, axes[node]] >= cuts[node]
        members[2 * node + 1], members[2 * node + 2] = own[~right], own[right]
    return Tree(depth, axes, cuts)


class Cell:
    """The vectors of one cell in a kd-tree of their own, kept as leaves with boxes."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.units = unit(vectors)
        points = self.units @ projection(vectors.shape[1])
        self.leaves = []
        stack = [np.arange(len(ids))]
        while stack:
            rows = stack.pop()
            if len(rows) <= LEAF_ROWS:
                self.leaves.append(rows)
                continue
            own = points[rows]
            axis = np.argmax(own.max(axis=0) - own.min(axis=0))
            half = np.argpartition(own[:, axis], len(rows) // 2)
            stack += [rows[half[: len(rows) // 2]], rows[half[len(rows) // 2 :]]]
        self.low = np.stack([points[rows].min(axis=0) for rows in self.leaves])
        self.high = np.stack([points[rows].max(axis=0) for rows in self.leaves])

    def nearest(self, query_id: int, query: np.ndarray, k: int, bound: float, limit: float) -> list[tuple[int, float]]:
        """The ``k`` best ids and cosines, given the squared distance ``bound`` of the k-th best elsewhere."""
        one = unit(query[None])[0]
        away = box_distances(self.low, self.high, one @ projection(len(query)))
        found = np.empty(0, np.int64)
        values = np.empty(0)
        for leaf in np.argsort(away):
            if away[leaf] >= limit * bound:
                break
            rows = self.leaves[leaf]
            rows = rows[self.ids[rows] != query_id]
            found = np.concatenate((found, rows))
            values = np.concatenate((values, self.units[rows] @ one))
            if len(values) > k:
                kth = np.partition(values, len(values) - k)[len(values) - k]
                keep = values >= kth - _NOISE
                found, values = found[keep], values[keep]
            if len(values) >= k:
                bound = min(bound, max(0.0, 2 - 2 * (values.min() if len(values) == k else kth)))
        exact = cosines(self.vectors[found], query)
        order = np.lexsort((self.ids[found], -exact))[:k]
        return [(int(self.ids[found[i]]), float(exact[i])) for i in order]


def nearest(
    rows: DataFrame,
    queries: DataFrame,
    k: int = 5,
    row_id: str = "vec_id",
    vector: str = "embedding",
    confidence: float = CONFIDENCE,
) -> DataFrame:
    """The ``k`` rows of largest cosine for each query: ``query_id``, ``rank`` from 1, ``vec_id``, ``score``.

    Rows and queries without an id, and vectors that are NULL, empty, zero or hold NULL or a value that is not
    finite, take no part; vectors meet only vectors of their length. Rows with a query's id are its own and not
    among its neighbours; queries that are equal in id and vector are one. Of equal vectors only the ``k + 1``
    least ids can be among anyone's neighbours, so no more are kept. Ties go to the smaller id.
    """
    base = common.checkpointed(_least_ids(_usable(common.for_python(rows), row_id, vector), k + 1))
    asked = common.checkpointed(_usable(queries, row_id, vector).distinct())
    spark = rows.sparkSession
    found = None
    # One round for each length of vectors; a table of embeddings has one, others are mistakes.
    for dimensions, n in sorted(tuple(r) for r in base.groupBy(F.size("v")).count().collect()):
        own = base.filter(F.size("v") == dimensions)
        tree = _upper_levels(own, n, dimensions)
        part = _search(own, asked.filter(F.size("v") == dimensions), tree, k, confidence)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    best = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _usable(rows: DataFrame, row_id: str, vector: str) -> DataFrame:
    """``id`` and ``v``, the vector in doubles."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = F.forall("v", finite) & F.exists("v", lambda x: x != 0)
    return (
        rows.select(F.col(row_id).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
        .filter(F.col("id").isNotNull() & F.col("v").isNotNull())
        .filter(usable)
    )


def _least_ids(rows: DataFrame, most: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    return rows.distinct().withColumn("place", place).filter(F.col("place") <= most).drop("place")


def _upper_levels(rows: DataFrame, n: int, dimensions: int) -> Tree:
    """Levels that cut the vectors into cells of about `CELL_ROWS`, fitted on a sample that the driver holds."""
    place = F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(1_000_000)) / F.lit(1_000_000.0)
    sample = rows.filter(place < SAMPLE / n).select("v").limit(2 * SAMPLE).toArrow()["v"].to_pylist()
    wanted = max(1, math.ceil(n / CELL_ROWS))
    depth = math.ceil(math.log2(max(1, min(wanted, len(sample) // SAMPLE_PER_CELL))))
    points = unit(np.array(sample, float)) @ projection(dimensions) if sample else np.empty((0, PROJECTED))
    return fit_tree(points, depth)


def _search(rows: DataFrame, queries: DataFrame, tree: Tree, k: int, confidence: float) -> DataFrame:
    """The best rows of every cell that a query has to search; the best of all cells are among them."""
    limit = chi_square_limit(confidence, PROJECTED)

    def place(batches):
        for batch in batches:
            points = unit(_matrix(batch.column("v"))) @ projection(_width(batch)) if len(batch) else None
            cells = tree.cell_of(points) if len(batch) else []
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("v"), pa.array(cells, pa.int64())], ["id", "v", "cell"]
            )

    def other_cells(batches):
        for batch in batches:
            sent = ([], [])
            if len(batch):
                home, bounds = batch.column("cell").to_numpy(), batch.column("bound").to_numpy()
                points = unit(_matrix(batch.column("v"))) @ projection(_width(batch))
                near = tree.squared_distances(points) < limit * bounds[:, None]
                near[np.arange(len(home)), home] = False
                sent = np.nonzero(near)
            who = pa.array(sent[0], pa.int64())
            columns = [batch.column(c).take(who) for c in ("query_id", "v", "bound")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sent[1], pa.int64())], ["query_id", "v", "bound", "cell"])

    def answer(data: pa.Table, asked: pa.Table) -> pa.Table:
        found = []
        if len(data) and len(asked):
            cell = Cell(data["id"].to_numpy(), _matrix(data["v"].combine_chunks()))
            vectors = _matrix(asked["v"].combine_chunks())
            for i, (query_id, bound) in enumerate(zip(asked["query_id"].to_pylist(), asked["bound"].to_pylist())):
                best = cell.nearest(query_id, vectors[i], k, bound, limit)
                found += [(query_id, vectors[i], other, score) for other, score in best]
        columns = list(zip(*found)) or [()] * 4
        kinds = (pa.int64(), pa.list_(pa.float64()), pa.int64(), pa.float64())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=["query_id", "q", "vec_id", "score"])

    def answers(asked: DataFrame) -> DataFrame:
        # Queries of one cell are split over as many tasks as they need, and the cell is sent to each.
        split = asked.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_ROWS).alias("parts"))
        of = lambda parts: F.pmod(F.xxhash64("query_id"), parts).cast("int").alias("part")
        dealt = asked.join(split, "cell").select("query_id", "v", "bound", "cell", of(F.col("parts")))
        copies = placed.join(split, "cell").select(
            "id", "v", "cell", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)).alias("part")
        )
        groups = copies.groupBy("cell", "part").cogroup(dealt.groupBy("cell", "part"))
        return groups.applyInArrow(answer, "query_id long, q array<double>, vec_id long, score double")

    cells = "id long, v array<double>, cell long"
    placed = common.checkpointed(rows.mapInArrow(place, cells))
    asked = queries.mapInArrow(place, cells).select(
        F.col("id").alias("query_id"), "v", F.lit(math.inf).alias("bound"), "cell"
    )
    asked = common.checkpointed(asked)
    home = common.checkpointed(answers(asked))
    # The squared distance of the k-th best at home; none rules out nothing.
    reached = home.groupBy("query_id", F.col("q").alias("v")).agg(F.count("*").alias("n"), F.min("score").alias("least"))
    known = F.when(F.col("n") >= k, F.greatest(F.lit(0.0), 2 - 2 * F.col("least"))).otherwise(F.lit(math.inf))
    bounded = asked.drop("bound").join(reached, ["query_id", "v"], "left").select(
        "query_id", "v", F.coalesce(known, F.lit(math.inf)).alias("bound"), "cell"
    )
    further = bounded.mapInArrow(other_cells, "query_id long, v array<double>, bound double, cell long")
    return home.unionByName(answers(further))


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _width(batch: pa.RecordBatch) -> int:
    return len(batch.column("v")[0])
