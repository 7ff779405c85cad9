"""Exact top-k by inner product with multi-resolution segment statistics.

Vectors are cut into 1, 4 and 16 segments; a segment is known by its mean and its standard
deviation. With segments of s components, the squared distance of two vectors is at least the sum
of s * ((mean - mean')^2 + (deviation - deviation')^2), so their inner product, which is half of
|q|^2 + |x|^2 minus that distance, is at most the sum of s * (mean * mean' + deviation * deviation').
Pairs whose bound is below the query's k-th score so far go, level by level; the exact product is
computed for what survives. Ties at the bound survive, so results are exact.

Queries are written once, dealt into chunks by hash, and a chunk is sent to all tasks that read
candidates; its size is bounded by ``CHUNK`` rows in the mean (8 MiB at 64 components), and candidates
are scanned once a chunk. A task computes the statistics of a block of candidates once for all blocks
of queries of its chunk, and returns k rows a query at most. The work still is queries times
candidates at the coarsest level, as an exact search without an index needs.

Defined results: vectors that are null or hold a null, infinite or not-a-number component take no
part; vectors of different lengths have no score; a query's own id is no candidate, even if it
occurs more than once; ties go to the smaller id; rows with null ids take no part; an empty table
gives an empty table; repeated candidates are candidates of their own; no other column is read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, released

SCALE = 1024
LEVELS = (1, 4, 16)
CHUNK = 16_384
#: Queries and candidates that are met at a time.
BLOCK = 2048


def quantised(ids: pa.Array, vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: ids and components floor(1024 * x), in doubles."""
    out = {}
    sizes = pc.list_value_length(vectors)
    for d in pc.unique(sizes).to_pylist():
        if d is None:
            continue
        mask = pc.and_(pc.equal(sizes, d), pc.is_valid(ids))
        mine = pc.fill_null(mask, False)
        flat = pc.list_flatten(vectors.filter(mine)).cast(pa.float64())
        x = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False).reshape(-1, d) if d else np.zeros((pc.sum(mine).as_py() or 0, 0))
        fine = np.isfinite(x).all(axis=1)
        out[d] = (ids.filter(mine).to_numpy(zero_copy_only=False).astype(np.int64)[fine], np.floor(SCALE * x[fine]))
    return out


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Rows of sqrt(s) * mean and sqrt(s) * deviation: the product of two rows bounds their vectors' product."""
    d = x.shape[1]
    edges = np.linspace(0, d, min(segments, d) + 1).astype(int)
    parts = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        seg, s = x[:, a:b], b - a
        mean = seg.mean(axis=1)
        parts += [math.sqrt(s) * mean, np.sqrt(((seg - mean[:, None]) ** 2).sum(axis=1))]
    return np.stack(parts, axis=1) if parts else np.zeros((len(x), 0))


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of rows, as integers."""
    if not q.size or np.abs(q).max() * np.abs(x).max() * q.shape[1] < 2**53:
        return np.einsum("ij,ij->i", q, x).astype(np.int64)
    return np.array([sum(int(a) * int(b) for a, b in zip(r, s, strict=True)) for r, s in zip(q, x, strict=True)], dtype=np.int64)


class Best:
    """The k best candidates of every query so far."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.at = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int64)
        self.scores = np.zeros(0, np.int64)
        self.least = np.full(len(queries), -np.inf)

    def add(self, at: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        at, ids, scores = np.concatenate([self.at, at]), np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
        order = np.lexsort((ids, -scores, at))
        at, ids, scores = at[order], ids[order], scores[order]
        first = np.searchsorted(at, at)
        rank = np.arange(len(at)) - first
        keep = rank < self.k
        self.at, self.ids, self.scores = at[keep], ids[keep], scores[keep]
        last = rank[keep] == self.k - 1
        self.least[self.at[last]] = self.scores[last]


def search(best: Best, q: np.ndarray, ids: np.ndarray, x: np.ndarray, q_stats: list[np.ndarray], x_stats: list[np.ndarray]) -> None:
    """Meets the queries ``q`` with a block of candidates; statistics are those of ``LEVELS``."""
    own = best.queries
    slack = 1e-6 * (1 + np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :].max(initial=0))
    floor = best.least[:, None] - slack
    alive = None
    for a, b in zip(q_stats, x_stats, strict=True):
        if alive is None or len(alive[0]) > 0.1 * len(q) * len(x):
            open_ = a @ b.T >= floor
            if alive is not None:
                was = np.zeros_like(open_)
                was[alive] = True
                open_ &= was
            alive = np.nonzero(open_)
        else:
            keep = np.einsum("ij,ij->i", a[alive[0]], b[alive[1]]) >= floor[alive[0], 0]
            alive = (alive[0][keep], alive[1][keep])
    qi, xi = alive
    other = own[qi] != ids[xi]
    qi, xi = qi[other], xi[other]
    for at in range(0, len(qi), 1 << 18):
        i, j = qi[at : at + (1 << 18)], xi[at : at + (1 << 18)]
        best.add(i, ids[j], products(q[i], x[j]))


def top_k(df: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", chunk: int = CHUNK) -> DataFrame:
    """query_id, rank, vec_id and score of every query's ``k`` best rows of ``df``."""
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    queries = df.where(is_query).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).where("id is not null").dropDuplicates(["id", "v"])
    chunks = max(1, math.ceil(queries.count() / chunk))
    part = F.pmod(F.xxhash64("id"), F.lit(chunks))
    queries = cut_lineage(queries.withColumn("part", part).repartition("part").sortWithinPartitions("part"))
    schema = "query_id long, vec_id long, score long"
    found = spark.createDataFrame([], schema)
    for c in range(chunks):
        own = queries.where(F.col("part") == c).select("id", "v").toArrow()
        if not own.num_rows:
            continue
        sent = spark.sparkContext.broadcast(quantised(own["id"].combine_chunks(), own["v"].combine_chunks()))

        def partial(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            levels = lambda x: [statistics(x, n) for n in LEVELS]
            mine: dict[int, list] = {}
            for d, (ids, q) in sent.value.items():
                for at in range(0, len(ids), BLOCK):
                    some = q[at : at + BLOCK]
                    mine.setdefault(d, []).append((Best(ids[at : at + BLOCK], k), some, levels(some)))
            for batch in batches:
                for d, (ids, x) in quantised(batch["id"], batch["v"]).items():
                    for at in range(0, len(ids) if d in mine else 0, BLOCK):
                        block = x[at : at + BLOCK]
                        of_block = levels(block)
                        for best, q, of_q in mine[d]:
                            search(best, q, ids[at : at + BLOCK], block, of_q, of_block)
            for blocks in mine.values():
                for best, _, _ in blocks:
                    yield pa.RecordBatch.from_arrays([pa.array(best.queries[best.at]), pa.array(best.ids), pa.array(best.scores)], ["query_id", "vec_id", "score"])

        found = found.unionAll(rows.mapInArrow(released(partial), schema))
    # a query id that occurs with several vectors is several queries with one answer list
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
