"""Byte-level BPE encoding and decoding by a global distinct-word shuffle.

Texts are cut into pre-tokens on the JVM. A task's documents make blocks; in a block the positions
of all pre-tokens are kept as numbers into the block's own list of distinct words. Only these lists
are shuffled by word: every distinct word of the corpus meets in one task and is merged there once.
The ids go back by block, are joined to the positions and put together in order. Positions cross
the network once, packed, as two bytes or so each; no row per pre-token is ever shuffled.

A block holds ``BLOCK_TOKENS`` pre-tokens or a few more, so a task's memory is bounded however large
its partition is; a word comes at most once from a block, so frequent words are no hot keys.

The positions are computed in the pass that makes the lists and again in the pass that is joined
with them; both read the same rows in the same order if the input is a scan. A block is named by its
input partition, its place there and a digest of its list, so a difference is seen and raised, never
hidden, and blocks with equal lists stay apart. For other inputs give
``stable=False``: they are first written to the checkpoint folder.

Defined results: null and empty text have no ids; repeated rows and null keys are rows of their
own; an empty table gives an empty table; columns named in ``keep`` pass through, and one named like an
added one raises. A single very long text makes a block of its own size.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, give_back, released, width

RANKS = "byte_bpe_50k.tiktoken"
BLOCK_TOKENS = 2_000_000
#: Words whose ids a task remembers; beyond them it starts anew.
REMEMBERED = 400_000
#: Documents whose positions travel in one row.
PACK = 512


@lru_cache(maxsize=2)
def token_bytes(path: str) -> list[bytes]:
    """Bytes of every id: the token-byte table. Ranks without a token are empty."""
    with open(path, "rb") as f:
        rows = [(base64.b64decode(a), int(b)) for a, b in (line.split() for line in f if line.strip())]
    out = [b""] * (1 + max(b for _, b in rows))
    for a, b in rows:
        out[b] = a
    return out


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    ranks = {a: i for i, a in enumerate(token_bytes(path)) if a}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _packed(numbers: np.ndarray) -> bytes:
    """Integers by byte planes, compressed."""
    planes = np.ascontiguousarray(numbers.astype("<u4")).view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def _flat(strings: pa.Array) -> tuple[np.ndarray, bytes]:
    """Byte lengths and joined bytes of a string or binary array without nulls."""
    offsets = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1]
    data = strings.buffers()[2]
    return np.diff(offsets), (data.to_pybytes()[offsets[0] : offsets[-1]] if data is not None and len(offsets) else b"")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, pa.Array, list[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]]]:
    """Digest and words of each block, and its batches with counts and word numbers of their documents."""
    import regex

    pattern = regex.compile(public_tokenizers.PATTERN)
    held: list[tuple[pa.RecordBatch, np.ndarray, pa.Array]] = []
    tokens, nth = 0, count()

    def block():
        coded = pa.concat_arrays([x for _, _, x in held]).dictionary_encode()
        words, numbers = coded.dictionary, coded.indices.to_numpy()
        lengths, data = _flat(words)
        name = xxhash.xxh3_128_digest(lengths.tobytes() + data) + b"%d.%d" % (held[0][0]["p_"][0].as_py(), next(nth))
        out, at = [], 0
        for batch, counts, x in held:
            out.append((batch, counts, numbers[at : at + len(x)]))
            at += len(x)
        return name, words, out

    for whole in batches:
        step = max(1, len(whole) // 4)
        for at in range(0, len(whole), step):
            batch = whole.slice(at, step)
            lists = batch["tokens_"]
            if batch["odd_"].null_count < len(batch):  # characters that the JVM's tables don't have yet
                odd = batch["odd_"].to_pylist()
                lists = pa.array([x if o is None else pattern.findall(o) for x, o in zip(lists.to_pylist(), odd, strict=True)], pa.list_(pa.string()))
            counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten()
            held.append((batch, counts, flat))
            tokens += len(flat)
            if tokens >= BLOCK_TOKENS:
                yield block()
                held, tokens = [], 0
    if held:
        yield block()


def encode(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str | None = None, stable: bool = True) -> DataFrame:
    """The columns ``keep`` with n_tokens and token_ids (little-endian unsigned 32-bit integers)."""
    if clash := {c.lower() for c in keep} & {"n_tokens", "token_ids"}:
        raise ValueError(f"columns of these names are added: {sorted(clash)}")
    spark = df.sparkSession
    path = path or public_tokenizers.path(RANKS)
    kept = [df.schema[c] for c in keep]
    names = [f"k{i}" for i in range(len(keep))]
    rows = df.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], F.col(text).alias("text_"))
    if not stable:
        rows = cut_lineage(rows)
    odd = F.coalesce(F.col("text_").rlike(r"\p{Cn}"), F.lit(False))
    cut = rows.select(
        *names,
        F.when(odd | F.col("text_").isNull(), F.array().cast("array<string>"))
        .otherwise(F.regexp_extract_all("text_", F.lit("(?U)" + public_tokenizers.PATTERN), F.lit(0))).alias("tokens_"),
        F.when(odd, F.col("text_")).alias("odd_"), F.spark_partition_id().alias("p_"),
    )
    parts = width(spark)

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for name, words, _ in _blocks(batches):
            if not len(words):
                continue
            home = (pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False) % parts).astype(np.int64)
            order = np.argsort(home, kind="stable")
            edges = np.flatnonzero(np.diff(home[order], prepend=-1, append=parts))
            out = {"block": [], "home": [], "numbers": [], "lengths": [], "words": []}
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                lengths, data = _flat(words.take(pa.array(order[a:b])))
                for k, v in (("block", name), ("home", int(home[order[a]])), ("numbers", _packed(order[a:b])), ("lengths", _packed(lengths)), ("words", squeeze.compress(data))):
                    out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("block", pa.binary()), ("home", pa.int32()), ("numbers", pa.binary()), ("lengths", pa.binary()), ("words", pa.binary())]))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = _encoding(path)._encode_single_piece
        seen: dict[bytes, bytes] = {}
        squeeze, open_ = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        for batch in batches:
            sizes, ids = [], []
            for lengths, words in zip(batch["lengths"].to_pylist(), batch["words"].to_pylist(), strict=True):
                ends = np.cumsum(_unpacked(lengths)).tolist()
                data, at, made = open_.decompress(words), 0, []
                for end in ends:
                    word, at = data[at:end], end
                    if (got := seen.get(word)) is None:
                        if len(seen) >= REMEMBERED:
                            seen.clear()
                        got = seen[word] = np.array(one(word), "<u4").tobytes()
                    made.append(got)
                sizes.append(_packed(np.fromiter(map(len, made), np.int64, len(made))))
                ids.append(squeeze.compress(b"".join(made)))
            yield pa.RecordBatch.from_arrays([batch["block"], batch["numbers"], pa.array(sizes, pa.binary()), pa.array(ids, pa.binary())], ["block", "numbers", "sizes", "ids"])

    key_types = ", ".join(f"{n} array<{f.dataType.simpleString()}>" for n, f in zip(names, kept, strict=True))

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nth = 0
        for name, words, held in _blocks(batches):
            for batch, counts, numbers in held:
                ends = np.concatenate([[0], np.cumsum(counts)])
                for at in range(0, len(batch), PACK):
                    to = min(at + PACK, len(batch))
                    keys = [pa.ListArray.from_arrays(pa.array([0, to - at], pa.int32()), pa.concat_arrays([batch[n].slice(at, to - at)])) for n in names]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name], pa.binary()), pa.array([len(words)], pa.int64()), pa.array([nth], pa.int64()), *keys, pa.array([_packed(counts[at:to])], pa.binary()), pa.array([_packed(numbers[ends[at] : ends[to]])], pa.binary())],
                        ["block", "n_words", "nth", *names, "counts", "positions"],
                    )
                    nth += 1

    def table_of(n: int, right: pa.Table) -> pa.Array:
        """The ids of a block's words, by their numbers; null where none came."""
        open_ = zstandard.ZstdDecompressor()
        at, lengths, data = [], [], []
        for numbers, sizes, ids in zip(right["numbers"], right["sizes"], right["ids"], strict=True):
            some = _unpacked(numbers.as_py())
            if len(some) and some.max() >= n:
                continue
            at.append(some)
            lengths.append(_unpacked(sizes.as_py()))
            data.append(open_.decompress(ids.as_py()))
        at = np.concatenate([np.zeros(0, np.uint32), *at])
        edges = np.cumsum(np.concatenate([np.zeros(1, np.int64), *lengths])).astype(np.int32)
        came = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(edges), pa.py_buffer(b"".join(data))])
        place = np.full(n, -1, np.int64)
        place[at] = np.arange(len(at))
        return came.take(pa.array(place, mask=place < 0))

    def assembled(left: pa.Table, right: pa.Table) -> pa.Table:
        give_back()  # what the group before this one held
        n = left["n_words"][0].as_py() if len(left) else 0
        table = table_of(n, right)
        if table.null_count:
            raise RuntimeError("the input's rows changed between two passes; encode it with stable=False")
        left = left.take(pc.sort_indices(left["nth"]))
        out = []
        for row in range(len(left)):
            counts = _unpacked(left["counts"][row].as_py()).astype(np.int64)
            got = table.take(pa.array(_unpacked(left["positions"][row].as_py())))
            edges = np.frombuffer(got.buffers()[1], np.int32)[: len(got) + 1] if len(got) else np.zeros(1, np.int32)
            edges = edges[np.concatenate([[0], np.cumsum(counts)])]
            ids = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(np.ascontiguousarray(edges)), got.buffers()[2] or pa.py_buffer(b"")])
            keys = [left[k][row].values for k in names]
            out.append(pa.Table.from_arrays([*keys, pa.array(np.diff(edges).astype(np.int64) // 4), ids], [*names, "n_tokens", "token_ids"]))
        return pa.concat_tables(out)

    words = cut.mapInArrow(released(lists), "block binary, home int, numbers binary, lengths binary, words binary")
    ids = words.repartitionById(parts, F.col("home")).mapInArrow(released(merged), "block binary, numbers binary, sizes binary, ids binary")
    places = cut.mapInArrow(released(positions), f"block binary, n_words long, nth long, {key_types}, counts binary, positions binary")
    types = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, kept, strict=True))
    out = places.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(assembled, f"{types}, n_tokens long, token_ids binary")
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], "n_tokens", "token_ids")


def decode(df: DataFrame, ids: str = "token_ids", path: str | None = None) -> DataFrame:
    """``df`` with ``decoded`` (binary): the ids joined with the token-byte table.

    The table has one row per id of the vocabulary, so it is sent to every task. An id that the
    vocabulary does not have raises.
    """
    path = path or public_tokenizers.path(RANKS)
    from pyspark.sql import types as T

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(token_bytes(path), pa.binary())
        for whole in batches:
            for at in range(0, len(whole), 1024):
                batch = whole.slice(at, 1024)
                lengths, data = _flat(batch[ids].fill_null(b""))
                got = table.take(pa.array(np.frombuffer(data, "<u4")))
                edges = np.frombuffer(got.buffers()[1], np.int32)[: len(got) + 1] if len(got) else np.zeros(1, np.int32)
                edges = np.ascontiguousarray(edges[np.concatenate([[0], np.cumsum(lengths // 4)])])
                out = pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer(edges), got.buffers()[2] or pa.py_buffer(b"")])
                yield pa.RecordBatch.from_arrays([*batch.columns, out], [*batch.schema.names, "decoded"])

    return df.mapInArrow(released(joined), T.StructType([*df.schema.fields, T.StructField("decoded", T.BinaryType())]))
