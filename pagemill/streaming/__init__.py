"""Continuous indexing: an extension, the batch operators know no time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..operators import search


def index_stream(entries: DataFrame, path: str, upsert: Callable[[DataFrame, int], None] | None = None) -> DataStreamWriter:
    """A writer that adds an index of every micro-batch of entries under ``path``, as ``search.open_index`` reads it.

    A batch that is repeated after a failure overwrites its own folder, so each counts once.
    """

    def add(batch: DataFrame, number: int) -> None:
        search.build(batch, f"{path}/batch={number}")
        if upsert:
            upsert(batch, number)

    return entries.writeStream.foreachBatch(add)
