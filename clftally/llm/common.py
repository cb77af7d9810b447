"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clftally.sources.shared import shared_root

# Fixed value: white space that separates words, as the inside of a character class.
BLANKS = r"\x20\x09-\x0D"


# Bytes of a batch of texts.
BATCH_BYTES = 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def checkpointed(rows: DataFrame) -> DataFrame:
    """Rows written to the shared checkpoint folder; what built them is not run again.

    A lost executor loses nothing of them. Spark removes the files with the DataFrame when
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_root(rows.sparkSession))
    return rows.checkpoint()


def for_python(rows: DataFrame) -> DataFrame:
    """Rows that go to Python workers, a few megabytes at a time; the workers find this package.

    A batch is held by the JVM and by each Python worker that it passes through, several times over in some. This is
    a setting of the session, and applies to what runs in it from now on. The package's folder is named to the workers
    for runs from a checkout; a cluster has the package installed, and then the name does no harm.
    """
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    environment, root = rows.sparkSession.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    known = [path for path in environment.get("PYTHONPATH", "").split(os.pathsep) if path]
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join([*known, root])
    return rows


class Aside:
    """Input columns named by their place, so that none clashes with those an operator makes on its way.

    ``rows`` has them under these names, `name` tells that of a column, and `back` gives them their own ones again.
    """

    def __init__(self, rows: DataFrame):
        self.names = rows.columns
        self.rows = rows.toDF(*[f"_in{i}" for i in range(len(self.names))])

    def name(self, column: str) -> str:
        """The working name of a column; case counts only if several differ in nothing else."""
        alike = [n for n in self.names if n == column] or [n for n in self.names if n.lower() == column.lower()]
        if len(alike) != 1:
            raise ValueError(f"{len(alike)} columns are named {column!r}, of: {', '.join(self.names)}")
        return f"_in{self.names.index(alike[0])}"

    def back(self, rows: DataFrame, new: Iterable[str] = (), keep: Iterable[str] | None = None) -> DataFrame:
        """The input columns (or ``keep`` of them) and the new ones, which replace input columns named alike in any case."""
        new = list(new)
        taken = {name.lower() for name in new}
        places = range(len(self.names)) if keep is None else [int(self.name(name)[3:]) for name in keep]
        kept = [i for i in places if self.names[i].lower() not in taken]
        return rows.select(*[F.col(f"_in{i}").alias(self.names[i]) for i in kept], *new)


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def content_key(text: Column) -> Column:
    """128 bits that stand for a text, as a struct of two 64-bit hashes.

    The second hash covers the text behind a mark, so both collide for unlike texts by chance only.
    """
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit("|"), text).alias("b"))


def schema_with(rows: DataFrame, drop: Iterable[str], add: Iterable[T.StructField]) -> T.StructType:
    """The schema of ``rows`` without some columns, and new ones at the end; same names are replaced."""
    add = list(add)
    gone = {*drop, *(field.name for field in add)}
    return T.StructType([*(f for f in rows.schema.fields if f.name not in gone), *add])


def crc_of_id(doc_id: str = "doc_id") -> Column:
    """CRC-32 of an id as text; that of the empty text when it is NULL."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))


def slices(batch: pa.RecordBatch, column: str, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """A batch in parts with about ``size`` bytes in one column, so that what is made of a part stays small."""
    start = total = 0
    for i, length in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        if total >= size:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += length or 0
    if start < batch.num_rows:
        yield batch.slice(start)
