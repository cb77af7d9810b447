"""Starting, awaiting and reading streaming queries.

A query keeps its checkpoint and its result in one folder. There are two ways to keep a result:

- `start_running_result` writes the whole result of each micro-batch. That fits small results. Each goes to a place of
  its own, and a place is used again only after `KEPT` more batches, so a reader has that long.
- `start_running_counts` writes only the rows that a micro-batch changed. That fits results with many keys. Reading
  takes the latest row of each key; from time to time the changes are put together.

What is complete is told by a small note that each batch leaves behind its rows. Notes go to two places in turn, so one
of them can always be read. A batch that runs again after a failure writes the same rows to the same place.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

AVAILABLE_NOW = {"availableNow": True}

# Past results of a query that stay readable.
KEPT = 10
# Micro-batches after which changes are put together.
COMPACT_EVERY = 50
# Seconds between two looks at several queries.
_POLL = 0.2


def start_running_result(
    result: DataFrame, folder: str, name: str | None = None, trigger: Mapping = AVAILABLE_NOW, view: str | None = None
) -> StreamingQuery:
    """Start a complete-mode query whose current result `read_result` returns.

    A ``view`` of that name is bound anew after each micro-batch, so SQL text on it follows the query.
    """
    place = lambda number: f"{folder}/result/place={number}"
    # A batch comes with a session of its own, whose views nobody else sees.
    session = result.sparkSession

    def save(batch: DataFrame, batch_id: int) -> None:
        number = batch_id % (KEPT + 1)
        batch.write.mode("overwrite").parquet(place(number))
        note(batch.sparkSession, f"{folder}/done", batch_id, number)
        if view:
            bind_view(session, folder, view)

    if noted(result.sparkSession, f"{folder}/done") is None:
        # Before the first batch the result is empty.
        _empty(result).write.mode("overwrite").parquet(place("empty"))
        note(result.sparkSession, f"{folder}/done", -1, "empty")
    if view:
        bind_view(session, folder, view)
    return _writer(result, folder, name, trigger).outputMode("complete").foreachBatch(save).start()


def start_running_counts(
    result: DataFrame,
    folder: str,
    keys: Sequence[str],
    name: str | None = None,
    trigger: Mapping = AVAILABLE_NOW,
    compact_every: int = COMPACT_EVERY,
    view: str | None = None,
) -> StreamingQuery:
    """Start an update-mode query whose current result `read_counts` returns, and a ``view`` with that name if given.

    ``keys`` are the columns the result is grouped by. Each batch writes the keys it changed and no others.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        base = noted(spark, f"{folder}/base-done")
        batch.write.mode("overwrite").parquet(_changes(folder, base.number + 1 if base else 0, batch_id))
        note(spark, f"{folder}/done", batch_id, batch_id)
        if (batch_id + 1) % compact_every == 0:
            compact(spark, folder, keys)
        if view:
            bind_view(session, folder, view, keys)

    session = result.sparkSession
    if noted(result.sparkSession, f"{folder}/done") is None:
        _empty(result).write.mode("overwrite").parquet(_changes(folder, 0, -1))
        note(result.sparkSession, f"{folder}/done", -1, -1)
    if view:
        bind_view(session, folder, view, keys)
    return _writer(result, folder, name, trigger).outputMode("update").foreachBatch(save).start()


def start_appending(
    result: DataFrame, folder: str, name: str | None = None, trigger: Mapping = AVAILABLE_NOW
) -> StreamingQuery:
    """Start an append-mode query: rows are final once written, and state is dropped behind them."""
    return (
        _writer(result, folder, name, trigger)
        .outputMode("append")
        .format("parquet")
        .start(f"{folder}/result")
    )


def start_console(result: DataFrame, folder: str, trigger: Mapping = AVAILABLE_NOW) -> StreamingQuery:
    """Start a complete-mode query that prints its result, for a look at small data."""
    return _writer(result, folder, None, trigger).outputMode("complete").format("console").start()


def start_in_memory(
    result: DataFrame, folder: str, name: str, trigger: Mapping = AVAILABLE_NOW
) -> StreamingQuery:
    """Start a complete-mode query into an in-memory table, which the driver holds: small results only."""
    return _writer(result, folder, name, trigger).outputMode("complete").format("memory").start()


def read_result(spark: SparkSession, folder: str) -> DataFrame:
    """The result of the last micro-batch that finished; empty before the first.

    It can be read until `KEPT` more batches have run.
    """
    last = noted(spark, f"{folder}/done")
    if last is None:
        raise ValueError(f"no query has been started in {folder}")
    return spark.read.parquet(f"{folder}/result/place={last.number}")


def read_counts(spark: SparkSession, folder: str, keys: Sequence[str]) -> DataFrame:
    """The latest row of each key, as of the last micro-batch that finished; empty before the first.

    It can be read until changes have been put together twice more.
    """
    last, base = noted(spark, f"{folder}/done"), noted(spark, f"{folder}/base-done")
    if last is None:
        raise ValueError(f"no query has been started in {folder}")
    changes = spark.read.parquet(f"{folder}/changes").filter(
        (F.col("generation") > (base.number if base else -1)) & (F.col("batch") <= int(last.batch))
    )
    columns = [name for name in changes.columns if name not in ("generation", "batch")]
    rows = changes.select(*columns, F.col("batch").cast("bigint").alias("_batch"))
    if base:
        stored = spark.read.parquet(f"{folder}/base/number={base.number}")
        rows = rows.unionByName(stored.withColumn("_batch", F.lit(int(base.batch)).cast("bigint")))
    values = [name for name in columns if name not in keys]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "_batch").alias("_row"))
    return latest.select(*[F.col(f"_row.{name}") if name in values else name for name in columns])


def bind_view(spark: SparkSession, folder: str, view: str, keys: Sequence[str] | None = None) -> None:
    """Let a view name the result of the last micro-batch that finished; ``keys`` for results kept as changed keys."""
    current = read_result(spark, folder) if keys is None else read_counts(spark, folder, keys)
    current.createOrReplaceTempView(view)


def compact(spark: SparkSession, folder: str, keys: Sequence[str]) -> None:
    """Put the changes so far together, so that reading does not get slower with every batch.

    What has been put together twice is emptied; the rest stays for readers that have begun.
    """
    last, base = noted(spark, f"{folder}/done"), noted(spark, f"{folder}/base-done")
    number = base.number + 1 if base else 0
    merged = read_counts(spark, folder, keys)
    merged.write.mode("overwrite").parquet(f"{folder}/base/number={number}")
    note(spark, f"{folder}/base-done", int(last.batch), number)
    if number > 1:
        nothing = _empty(merged).withColumn("batch", F.lit(-1))
        cleared = nothing.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("batch")
        cleared.parquet(f"{folder}/changes/generation={number - 2}")
        _empty(merged).write.mode("overwrite").parquet(f"{folder}/base/number={number - 2}")


def await_and_stop(queries: Iterable[StreamingQuery], timeout: float | None = None) -> bool:
    """Wait until all queries end, ``timeout`` seconds at most, and stop those still running.

    The first failure of any of them is raised at once. Stops only the queries it is given, whatever happens.
    True if all ended by themselves.
    """
    queries = list(queries)
    deadline = None if timeout is None else time.monotonic() + timeout
    try:
        while True:
            active = [query for query in queries if query.isActive]
            for query in queries:
                if (failure := query.exception()) is not None:
                    raise failure
            left = _POLL if deadline is None else min(_POLL, deadline - time.monotonic())
            if not active or left <= 0:
                return not active
            # Waits are in whole milliseconds, and none is an error.
            active[0].awaitTermination(max(left, 0.001))
    finally:
        for query in queries:
            query.stop()


def progress(query: StreamingQuery) -> list[dict]:
    """Rows and speed of the recent micro-batches; also readable after the query has stopped."""
    return [
        {
            "batch": p["batchId"],
            "rows": p["numInputRows"],
            "rows_per_second": p["processedRowsPerSecond"],
        }
        for p in query.recentProgress
    ]


class ProgressTable(StreamingQueryListener):
    """Writes what every query of a session reports of each micro-batch, and how it ended, to a table.

    Add it with ``spark.streams.addListener``; `read_progress` reads the table. Each micro-batch has a place of its own,
    so one that is reported twice is one row.
    """

    SCHEMA = (
        "query string, name string, run string, batch long, at string, event string, rows long, "
        "rows_per_second double, milliseconds long, state_rows long, failure string"
    )

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self._write(str(event.id), event.name, str(event.runId), -1, event.timestamp, "started", None, None, None, None, None)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self._write(
            str(p.id), p.name, str(p.runId), p.batchId, p.timestamp, "progress", p.numInputRows, p.processedRowsPerSecond,
            p.durationMs.get("triggerExecution"), sum(s.numRowsTotal for s in p.stateOperators), None,
        )

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self._write(str(event.id), None, str(event.runId), -1, None, "ended", None, None, None, None, event.exception)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def _write(self, *row) -> None:
        query, run, batch, event = row[0], row[2], row[3], row[5]
        rows = self.spark.createDataFrame([row], self.SCHEMA)
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/of={query}/in={run}/event={event}-{batch}")


def read_progress(spark: SparkSession, folder: str) -> DataFrame:
    """The table that `ProgressTable` writes: one row per start, micro-batch and end of a query."""
    try:
        stored = spark.read.schema(ProgressTable.SCHEMA).option("recursiveFileLookup", True).parquet(folder)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ProgressTable.SCHEMA)
    return stored


def run(spark: SparkSession, result: DataFrame, folder: str, timeout: float | None = None) -> DataFrame:
    """Run one complete-mode query over all input there is, and return its result."""
    return _run_all(spark, {folder: result}, timeout)[folder]


def run_counts(
    spark: SparkSession, result: DataFrame, folder: str, keys: Sequence[str], timeout: float | None = None
) -> DataFrame:
    """Run one update-mode query over all input there is, and return its result."""
    _run_started([lambda: start_running_counts(result, folder, keys)], timeout)
    return read_counts(spark, folder, keys)


def run_appending(spark: SparkSession, result: DataFrame, folder: str, timeout: float | None = None) -> DataFrame:
    """Run one append-mode query over all input there is, and return the rows that are final."""
    _run_started([lambda: start_appending(result, folder)], timeout)
    return spark.read.schema(result.schema).parquet(f"{folder}/result")


def run_together(
    spark: SparkSession, results: Mapping[str, DataFrame], folder: str, timeout: float | None = None
) -> dict[str, DataFrame]:
    """Run several complete-mode queries at once, each in a folder of its name; returns their results."""
    places = {f"{folder}/{name}": result for name, result in results.items()}
    return dict(zip(results, _run_all(spark, places, timeout).values()))


def _run_all(
    spark: SparkSession, results: Mapping[str, DataFrame], timeout: float | None
) -> dict[str, DataFrame]:
    _run_started([lambda p=place, r=result: start_running_result(r, p) for place, result in results.items()], timeout)
    return {place: read_result(spark, place) for place in results}


def _run_started(starts: Sequence[Callable[[], StreamingQuery]], timeout: float | None) -> None:
    queries = []
    try:
        for start in starts:
            queries.append(start())
    except BaseException:
        for query in queries:
            query.stop()
        raise
    if not await_and_stop(queries, timeout):
        raise TimeoutError(f"streaming queries did not finish within {timeout} seconds")


def _writer(result: DataFrame, folder: str, name: str | None, trigger: Mapping):
    writer = result.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(**trigger)
    return writer.queryName(name) if name else writer


def _changes(folder: str, generation: int, batch_id: int) -> str:
    return f"{folder}/changes/generation={generation}/batch={batch_id}"


def _empty(rows: DataFrame) -> DataFrame:
    return rows.sparkSession.createDataFrame([], rows.schema)


def note(spark: SparkSession, folder: str, batch_id: int, number: int | str) -> None:
    """Say that a batch is complete, and where; notes of even and odd batches do not touch each other."""
    text = spark.createDataFrame([(f"{batch_id} {number}",)], "value string")
    text.coalesce(1).write.mode("overwrite").text(f"{folder}-{batch_id % 2}")


class _Note:
    def __init__(self, text: str):
        batch, number = text.split()
        self.batch = int(batch)
        self.number = int(number) if number.lstrip("-").isdigit() else number


def noted(spark: SparkSession, folder: str) -> _Note | None:
    """The last note; one that is just being written is passed over for the one before."""
    found = []
    for turn in (0, 1):
        try:
            found += [_Note(row.value) for row in spark.read.text(f"{folder}-{turn}").collect()]
        except AnalysisException as missing:
            # Not there yet. A note that cannot be read for another reason is a failure.
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
    return max(found, key=lambda note: note.batch, default=None)
