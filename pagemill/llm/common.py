"""Column helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import math
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters that separate words.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once per row.

    A plain reference inside a higher-order function may be inlined and then computed again for
    every element; a lambda variable is bound to its value.
    """
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text in order; an empty array for null or blank text."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def n_words(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACE_RUN))).cast("long")


def give_back() -> None:
    """Freed memory goes back to the machine; Python workers live on for other tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def released(each: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` that gives freed memory back when its task ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from each(batches)
        finally:
            give_back()

    return run


def slices(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of about ``limit`` bytes of a string or binary column; a value is never cut."""
    size = pc.binary_length(batch[column]).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.cumsum(size) // limit
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(batch)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names near ``names`` that ``df`` does not have yet (compared without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; our own where none is named (tests)."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return os.path.join(tempfile.gettempdir(), "pagemill-checkpoints")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for a written table in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder, and read it from there.

    Unlike ``checkpoint()`` this computes it once, and later reads are pruned by column.
    """
    spark = df.sparkSession
    path = scratch(spark, "table")
    if (written := _WRITTEN.get()) is not None:
        written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Paths of the scratch tables of the innermost open ``tidied``.
_WRITTEN: ContextVar[list[str] | None] = ContextVar("written", default=None)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def tidied(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Scratch tables written within are deleted at its end, but for those that the given function writes.

    Those go with the ``tidied`` around this one; the outermost one's stay as long as the shared
    folder, for the result is read from them.
    """
    written: list[str] = []
    around = _WRITTEN.get()
    token = _WRITTEN.set(written)

    def kept(df: DataFrame) -> DataFrame:
        inner = _WRITTEN.set(around)
        try:
            return cut_lineage(df)
        finally:
            _WRITTEN.reset(inner)

    try:
        yield kept
    finally:
        _WRITTEN.reset(token)
        for path in written:
            delete(spark, path)


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bits_for(n: float) -> int:
    return max(0, math.ceil(math.log2(n))) if n > 1 else 0
