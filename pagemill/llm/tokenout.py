"""Training-order materialisation of token sequences.

Documents become sequences of a fixed number of token ids (the last one is padded). A keyed Feistel
permutation with cycle-walking gives every sequence its global slot: a bijection of the sequences'
dense numbers that needs no sort and no state. Ranges of slots are written as shards of a fixed
stride, in slot order, so a reader can start or resume at any slot by arithmetic alone.

Ids are the text's UTF-8 bytes (0 to 255), an end mark and padding, as unsigned 16-bit
little-endian integers, or those of ``bpe.encode`` in a binary column of 32-bit integers.

Dense numbers come from a first pass that counts sequences per input partition and a second one
that numbers them on from there; a row carries the number of its input partition, so it does not
matter which task reads it. The rows themselves are shuffled once: ranges of shards are dealt to
partitions by arithmetic, without a sample. Both passes read the same partitions if the input is a
scan; a difference raises. For other inputs give ``stable=False``: they are first written to the
checkpoint folder.

A task holds ``SLICE`` bytes of tokens, or one longer text, and ``BATCH`` packed sequences.

Defined results: null and empty text is one sequence of an end mark; repeated rows are sequences of
their own; an empty table writes no shard; null keys pass through; a key named like an added column
raises.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_lineage, slices

END, PAD = 256, 257
LENGTH = 2048
#: Sequences in a shard (16 MiB of 16-bit ids).
STRIDE = 4096
KEY = 0x5EED_0F_0DE2
ROUNDS = 6
#: Bytes of tokens in a slice of a batch; sequences in an output batch.
SLICE, BATCH = 4_000_000, 1024


def feistel(numbers: np.ndarray, total: int, key: int = KEY) -> np.ndarray:
    """A permutation of range(total), element by element."""
    half = max(1, (max(1, total - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xBF58476D1CE4E5B9) & (2**64 - 1)) for r in range(ROUNDS)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            f = right + k
            f = (f ^ (f >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            f = (f ^ (f >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((f ^ (f >> np.uint64(31))) & mask)
        return (left << np.uint64(half)) | right

    out = once(numbers.astype(np.uint64))
    while len(outside := np.flatnonzero(out >= np.uint64(total))):  # walk the cycle back into the range
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def _ids(column: pa.Array, kind: str) -> list[np.ndarray]:
    dtype = np.uint8 if kind == "bytes" else np.dtype("<u4")
    return [np.frombuffer(x, dtype) if x is not None else np.zeros(0, dtype) for x in column.to_pylist()]


ADDED = ("slot", "shard", "position", "chunk", "n_tokens", "packed", "ids")


def sequences(df: DataFrame, tokens: str = "text", key: str = "doc_id", length: int = LENGTH, seed: int = KEY, stride: int = STRIDE, stable: bool = True) -> tuple[DataFrame, int]:
    """slot, shard, position, doc key, chunk, n_tokens and the packed (compressed) ids of every sequence; their number.

    ``tokens``: a string column, taken as bytes, or a binary column of 32-bit ids.
    """
    if key.lower() in ADDED:
        raise ValueError(f"columns of these names are added: {list(ADDED)}")
    kind = "bytes" if isinstance(df.schema[tokens].dataType, T.StringType) else "ids"
    end, pad, dtype = (END, PAD, np.dtype("<u2")) if kind == "bytes" else (2**32 - 2, 2**32 - 1, np.dtype("<u4"))
    rows = df.select(F.col(key).alias("key"), F.col(tokens).cast("binary").alias("tokens"))
    if not stable:
        rows = cut_lineage(rows)
    rows = rows.withColumn("p", F.spark_partition_id())
    width = 1 if kind == "bytes" else 4
    chunks = F.ceil((F.coalesce(F.octet_length("tokens"), F.lit(0)) / width + 1) / length).cast("long")
    counted = rows.groupBy("p").agg(F.sum(chunks).alias("n")).collect()  # a row per input partition
    first, total = {}, 0
    for p, n in sorted((r["p"], r["n"]) for r in counted):
        first[p] = (total, n)
        total += n
    sent = df.sparkSession.sparkContext.broadcast(first)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        at, end_at = None, None
        docs, chunks, used, data = [], [], [], []

        def made(keys: pa.Array) -> pa.RecordBatch:
            nonlocal at
            slots = feistel(np.arange(at, at + len(data)), total, seed)
            at += len(data)
            out = [pa.array(slots), pa.array(slots // stride), pa.array((slots % stride).astype(np.int32)), keys.take(pa.array(docs, pa.int64())), pa.array(chunks, pa.int64()), pa.array(used, pa.int32()), pa.array(data, pa.binary())]
            for held in (docs, chunks, used, data):
                held.clear()
            return pa.RecordBatch.from_arrays(out, ["slot", "shard", "position", key, "chunk", "n_tokens", "packed"])

        for whole in batches:
            if at is None and len(whole):
                at, n = sent.value.get(whole["p"][0].as_py(), (0, 0))
                end_at = at + n
            for batch in slices(whole, "tokens", SLICE):
                for i, x in enumerate(_ids(batch["tokens"], kind)):
                    for chunk in range(-(-(len(x) + 1) // length)):
                        part = x[chunk * length : (chunk + 1) * length]
                        row = np.full(length, pad, dtype)
                        row[: len(part)] = part
                        if len(part) < length:
                            row[len(part)] = end
                        docs.append(i)
                        chunks.append(chunk)
                        used.append(min(length, len(x) + 1 - chunk * length))
                        data.append(squeeze.compress(row.tobytes()))
                        if len(data) == BATCH:
                            yield made(batch["key"])
                if data:
                    yield made(batch["key"])
        if at != end_at:
            raise RuntimeError("the input's rows changed between two passes; materialise it with stable=False")

    kept = df.schema[key].dataType.simpleString()
    return rows.mapInArrow(cut, f"slot long, shard long, position int, `{key}` {kept}, chunk long, n_tokens int, packed binary"), total


def write(spark: SparkSession, numbered: DataFrame, total: int, path: str, parts: int, stride: int = STRIDE) -> None:
    """One file a shard, its sequences in slot order. A failed run is simply repeated.

    ``parts`` partitions, or as many as there are shards if those are fewer, write ranges of shards.
    """
    shards = max(1, -(-total // stride))
    parts = max(1, min(parts, shards))
    home = F.floor(F.col("shard") * parts / F.lit(shards)).cast("int")
    dealt = numbered.repartitionById(parts, home).sortWithinPartitions("shard", "slot")
    schema = T.StructType([T.StructField("ids", T.BinaryType()) if f.name == "packed" else f for f in numbered.schema.fields])

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for whole in batches:
            for at in range(0, len(whole), 1024):
                batch = whole.slice(at, 1024)
                ids = pa.array([open_.decompress(x) for x in batch["packed"].to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([ids if n == "packed" else batch[n] for n in batch.schema.names], schema.names)

    dealt.mapInArrow(unpacked, schema).write.mode("overwrite").partitionBy("shard").option("compression", "zstd").parquet(path)


def resume(spark: SparkSession, path: str, slot: int = 0, stride: int = STRIDE) -> DataFrame:
    """The sequences from ``slot`` on; earlier shards are not opened."""
    return spark.read.parquet(path).where((F.col("shard") >= slot // stride) & (F.col("slot") >= slot))
