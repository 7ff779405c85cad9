"""Near duplicates by MinHash with tensored banding, every link confirmed on full sets.

A text's set is its distinct word shingles. Texts with equal sets are one node. Two collections of
14 small hashes (three minima each) are computed; a table's key is a pair of one hash of either
collection, so 84 minima serve 196 tables of six minima each. Texts of similarity 0.8 share no key
with a probability of 9e-5, those of 0.85 with 3e-6.

* Round one: in each bucket of up to ``SMALL`` nodes all pairs are candidates, in a larger one every
  node with the bucket's first ``REPS`` (one). Set sizes and a sketch (a byte of every minimum) drop
  pairs far below the threshold; the others are confirmed on full sets.
* The later rounds take the nodes of large buckets. A table's key is a hash of either collection, so
  nodes that share a table share a hash of the first one: its 14 hashes deal a node to 14 wider buckets
  that stand for all 196 tables.
* Round two, in wide buckets that still hold several components: each node outside the largest
  component meets its two likest nodes (by sketch) of other components, among ``NEIGHBOURS`` or so of
  the bucket's nodes that a hash deals together.
* Round three is the exact way for wide buckets that still hold nodes of several components. It
  makes rows (node, component): of every node outside the bucket's largest component (of more than
  ``SMALL`` nodes) and that component, and, where sketches are alike and a table is shared, of the nodes
  outside it among themselves, in pairs of blocks of about ``PART`` nodes, a task each. Each such node is then compared
  with the whole component on full sets, in blocks of about ``BLOCK``. No group emits its pairs, and
  no link between components is lost.
* Components come from alternating large and small stars over written tables.

Buckets are streamed in key order, in bounded memory. Keys that a sample finds in very many nodes are
dealt over all tasks, with a representative from the sample; texts that very many documents share get
their component by a broadcast of at most ``HOT`` digests. Links, components and sets stay on
executors. Scratch tables are deleted in the end, but for the one that the result is read from.

Very long texts are read whole; slices of texts are bounded by bytes, so only one long text counts.
Columns named like the added ones raise.

Defined results: null, empty and blank text has an empty set and is linked with nothing; a null id
is linked with nothing and keeps a null component; rows with one id count as one document; other
columns pass through in ``keep``; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_lineage, fresh, released, slices, tidied

SHINGLE = 5
PERCENT = 80
GROUPS = 14  # hashes in either collection
MINIMA = 3  # minima in a hash
SMALL = 16
#: First nodes of a large bucket that all its nodes meet in round one. Later rounds find what these miss, so more of them repeat work.
REPS = 1
#: In round three about so many nodes of a component meet twice as many nodes from outside it in a task.
BLOCK = 128
#: Nodes of a large bucket that are compared at once: in round two by sketch, in round three in either block of a pair.
NEIGHBOURS, PART = 1024, 512
#: A node in so many shows the keys that at least SEEN of them, and a part of 1 / HOT, have: at most HOT keys a table.
SAMPLE, SEEN = 64, 24
#: A text is dealt by broadcast if its copies are at least a part of 1 / HOT of the documents.
HOT = 256
#: Texts are shingled in slices of so many bytes.
SLICE = 2_000_000
#: Node ids of up to so many documents are broadcast to fetch their texts (16 MB); more are joined by shuffle.
BROADCAST_NODES = 1_000_000
#: At similarity 0.8 the sketch agrees in less than this part of its bytes with a probability under 1e-5.
SKETCH_PART = 0.6
_RNG = np.random.Generator(np.random.PCG64(20240229))
_A = _RNG.integers(1, 2**63, 2 * GROUPS * MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_C = _RNG.integers(0, 2**63, 2 * GROUPS * MINIMA, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the sets, and all sets' 64-bit shingle hashes, sorted within each set."""
    lists = pc.split_pattern_regex(pc.ascii_trim(pc.ascii_lower(texts.fill_null("")), " \t\n\x0b\x0c\r"), r"[\x09-\x0D\x20]+")
    counts = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    names = coded.dictionary.to_numpy(zero_copy_only=False)
    h = pd.util.hash_array(names, categorize=False)[coded.indices.to_numpy()] if len(names) else np.zeros(0, np.uint64)
    empty = pc.equal(texts.fill_null(""), "").to_numpy(zero_copy_only=False) if len(texts) else np.zeros(0, bool)
    starts = np.cumsum(counts) - counts
    blank = (counts == 1) & np.array([len(names) > 0 and names[c] == "" for c in coded.indices.to_numpy()[starts]], bool) if len(counts) else empty
    # running combination of k words; a shorter text is combined whole
    n = len(h)
    left = np.repeat(starts + counts, counts) - np.arange(n)  # words from here to the end of the text
    out = _mix(h + np.uint64(1))
    padded = np.concatenate([h, np.zeros(k, np.uint64)])
    for j in range(1, k):
        more = left > j
        out[more] = _mix(out[more] * np.uint64(0x9E3779B97F4A7C15) + padded[j : j + n][more] + np.uint64(j + 1))
    first = np.zeros(n, bool)
    first[starts] = True
    use = ((left >= k) | first) & ~np.repeat(blank, counts)
    doc = np.repeat(np.arange(len(counts)), counts)[use]
    out = out[use]
    order = np.lexsort((out, doc))
    doc, out = doc[order], out[order]
    new = np.ones(len(out), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (out[1:] != out[:-1])
    return np.bincount(doc[new], minlength=len(counts)), out[new]


def minima(sizes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """(sets, 84) minima; sizes are positive."""
    starts = np.cumsum(sizes) - sizes
    return np.stack([np.minimum.reduceat(_mix_light(hashes, a, c), starts) for a, c in zip(_A, _C, strict=True)], axis=1)


def _mix_light(h: np.ndarray, a: np.uint64, c: np.uint64) -> np.ndarray:
    x = (h ^ c) * a
    return x ^ (x >> np.uint64(32))


def collections(least: np.ndarray) -> np.ndarray:
    """(sets, 28) hashes: those of the first collection, then those of the second."""
    parts = least.reshape(len(least), 2 * GROUPS, MINIMA)
    out = np.broadcast_to(np.arange(2 * GROUPS, dtype=np.uint64), parts.shape[:2]).copy()
    for j in range(MINIMA):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, j])
    return out


def signed(docs: DataFrame, k: int) -> DataFrame:
    """doc, n, digest, a, b and sketch for the columns ``doc`` and ``text``."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                sizes, hashes = shingle_sets(batch["text"], k)
                some = sizes > 0
                least = minima(sizes[some], hashes) if some.any() else np.zeros((0, len(_A)), np.uint64)
                keys = collections(least).view(np.int64)
                ends = np.cumsum(sizes)
                digests = [xxhash.xxh3_128_digest(hashes[e - s : e].tobytes()) if s else None for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
                at = np.cumsum(some) - 1
                pick = pa.array(np.where(some, at, 0), mask=~some)
                fixed = lambda x: pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), GROUPS).cast(pa.list_(pa.int64())).take(pick)
                sketch = np.ascontiguousarray((least >> np.uint64(8)).astype(np.uint8))
                edges = (np.arange(len(sketch) + 1) * sketch.shape[1]).astype(np.int32)
                sketches = pa.Array.from_buffers(pa.binary(), len(sketch), [None, pa.py_buffer(edges), pa.py_buffer(sketch)]).take(pick)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc"], pa.array(sizes.astype(np.int64)), pa.array(digests, pa.binary()), fixed(keys[:, :GROUPS]), fixed(keys[:, GROUPS:]), sketches],
                    ["doc", "n", "digest", "a", "b", "sketch"],
                )

    return docs.mapInArrow(released(each), "doc long, n long, digest binary, a array<long>, b array<long>, sketch binary")


def _near(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes can be similar enough."""
    return 100 * np.minimum(n, m) >= percent * np.maximum(n, m)


def _bucketed(percent: int):
    """Rows (key, doc, n) sorted by key and doc, to candidate pairs and the members of large buckets (b is null).

    A row of a hot key brings the bucket's representative, ``rep`` and ``rep_n``, and needs no other row.
    """
    names = ["a", "b", "n"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(a, b, n):
            return pa.RecordBatch.from_arrays([pa.array(a), pa.nulls(len(a), pa.int64()) if b is None else pa.array(b), pa.array(n)], names)

        def large(_, doc, n, reps):
            for r, m in reps:
                ok = _near(n, np.full(len(n), m), percent) & (doc > r)
                yield out(np.full(int(ok.sum()), r), doc[ok], n[ok])
            yield out(doc, None, n)

        def closed(key, doc, n):
            """Whole buckets."""
            if not len(key):
                return
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sizes = np.diff(np.concatenate([starts, [len(key)]]))
            row_size = np.repeat(sizes, sizes)
            for s in range(1, SMALL):
                ok = (key[s:] == key[:-s]) & (row_size[s:] <= SMALL)
                if not ok.any():
                    break
                at = np.flatnonzero(ok & _near(n[s:], n[:-s], percent))
                yield out(doc[at], doc[at + s], n[at])
            for start, size in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
                rows = [x[start : start + size] for x in (key, doc, n)]
                yield from large(*rows, list(zip(rows[1][:REPS].tolist(), rows[2][:REPS].tolist(), strict=True)))

        rest = [np.zeros(0, np.int64)] * 3
        open_key, reps = None, []
        for batch in batches:
            if batch["rep"].null_count < len(batch):
                hot = batch.filter(batch["rep"].is_valid())
                doc, n, rep, rep_n = (hot[c].to_numpy() for c in ("doc", "n", "rep", "rep_n"))
                ok = _near(n, rep_n, percent) & (doc != rep)
                yield out(np.minimum(doc, rep)[ok], np.maximum(doc, rep)[ok], n[ok])
                yield out(doc, None, n)
                batch = batch.filter(batch["rep"].is_null())
            rows = [np.concatenate([r, batch[c].to_numpy()]) for r, c in zip(rest, ("key", "doc", "n"), strict=True)]
            if open_key is not None:  # a large bucket goes on
                other = np.flatnonzero(rows[0] != open_key)
                end = int(other[0]) if len(other) else len(rows[0])
                if end:
                    yield from large(*(r[:end] for r in rows), reps)
                rows = [r[end:] for r in rows]
                rest = rows
                if not len(rows[0]):
                    continue
                open_key = None
            if not len(rows[0]):
                continue
            other = np.flatnonzero(rows[0] != rows[0][-1])
            last = int(other[-1]) + 1 if len(other) else 0
            yield from closed(*(r[:last] for r in rows))
            rest = [r[last:] for r in rows]
            if len(rest[0]) > SMALL:
                open_key = rest[0][-1]
                reps = list(zip(rest[1][:REPS].tolist(), rest[2][:REPS].tolist(), strict=True))
                yield from large(*rest, reps)
                rest = [r[:0] for r in rest]
        yield from closed(*rest)

    return each


def _across(percent: int, best: int = 0):
    """Members of wide buckets, dealt by (key, lo, hi) and sorted by component, to what is to be compared across components.

    Members of block ``lo`` and of block ``hi`` are compared with one another; within a block where both are one.

    Without ``best``: rows (a, b) of a node and another component that holds a node like it by
    sketch; the node is the one whose component has fewer nodes in the bucket. A pair counts if it
    agrees in a hash of either collection (``keys``, whole), in the bucket of the first one of the
    first collection in which it does, so in one only, and that is a bucket which holds both.
    ``best``: pairs of nodes, so many for a node, the likest by sketch, from nodes that are not in
    the bucket's largest component.
    """

    def likest(doc, comp, n, sketch):
        starts = np.flatnonzero(np.concatenate([[True], comp[1:] != comp[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(comp)]]))
        largest = comp[starts[sizes.argmax()]]
        for i in np.flatnonzero(comp != largest).tolist():
            others = np.flatnonzero((comp != comp[i]) & _near(n, n[i], percent))
            if len(others):
                like = (sketch[others] == sketch[i]).mean(axis=1)
                order = np.argsort(-like, kind="stable")[:best]
                order = order[like[order] >= SKETCH_PART]
                o = others[order]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(doc[i], doc[o])), pa.array(np.maximum(doc[i], doc[o]))], ["a", "b"])

    def outside(doc, comp, n, sketch, keys, at, block, within):
        edge = np.searchsorted(comp, comp, side="right")
        share = edge - np.searchsorted(comp, comp, side="left")
        for first_row in np.flatnonzero(np.concatenate([[True], comp[1:] != comp[:-1]])).tolist():
            met = []  # nodes of later components with fewer nodes here
            for i in range(first_row, int(edge[first_row])):
                others = np.arange(edge[i], len(doc))
                if not within:
                    others = others[block[others] != block[i]]
                others = others[_near(n[others], n[i], percent)]
                others = others[(sketch[others] == sketch[i]).mean(axis=1) >= SKETCH_PART]
                if not len(others):
                    continue
                same = keys[others] == keys[i]
                others = others[(same[:, :GROUPS].argmax(axis=1) == at) & same[:, GROUPS:].any(axis=1)]
                fewer = share[others] < share[i]
                met = np.union1d(met, others[fewer]).astype(np.int64)
                comps = np.unique(comp[others[~fewer]])
                if len(comps):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(comps), doc[i])), pa.array(comps)], ["a", "b"])
            if len(met):
                yield pa.RecordBatch.from_arrays([pa.array(doc[met]), pa.array(np.full(len(met), comp[first_row]))], ["a", "b"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def run(table: pa.Table):
            doc, comp, n = (table[c].to_numpy() for c in ("doc", "comp", "n"))
            sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(len(doc), -1)
            if best:
                yield from likest(doc, comp, n, sketch)
            else:
                keys = pc.list_flatten(table["keys"]).to_numpy().reshape(len(doc), 2 * GROUPS)
                lo, hi = table["lo"][0].as_py(), table["hi"][0].as_py()
                yield from outside(doc, comp, n, sketch, keys, int(table["place"][0].as_py()), table["block"].to_numpy(), lo == hi)

        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            new = np.zeros(max(0, len(table) - 1), bool)
            for c in ("key", "lo", "hi"):
                x = table[c].to_numpy()
                new |= x[1:] != x[:-1]
            edges = [0, *(np.flatnonzero(new) + 1).tolist()]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                yield from run(table.slice(a, b - a))
            rest = table.slice(edges[-1])
        if rest is not None and len(rest):
            yield from run(rest)

    return each


def full_sets(nodes: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(doc, set) of the documents in ``nodes``, written."""
    nodes = cut_lineage(nodes.distinct())
    few = nodes.count() <= BROADCAST_NODES

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                sizes, hashes = shingle_sets(batch["text"], k)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch["doc"], pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes.view(np.int64)))], ["doc", "set"])

    texts = docs.join(F.broadcast(nodes) if few else nodes, "doc", "left_semi")
    return cut_lineage(texts.mapInArrow(released(sets), "doc long, set array<long>"))


def confirmed(pairs: DataFrame, docs: DataFrame, sketches: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough, from pairs without repetition."""

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(_A)
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint8).reshape(-1, width) for c in ("sa", "sb"))
            yield batch.filter(pa.array((x == y).mean(axis=1) >= SKETCH_PART)).select(["a", "b"])

    left, right = (sketches.select(F.col("doc").alias(c), F.col("sketch").alias(f"s{c}")) for c in "ab")
    close = cut_lineage(pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(released(alike), "a long, b long"))
    full = full_sets(close.select(F.explode(F.array("a", "b")).alias("doc")), docs, k)
    left, right = (full.select(F.col("doc").alias(c), F.col("set").alias(f"x{c}")) for c in "ab")
    both = F.size(F.array_intersect("xa", "xb"))
    joined = close.join(left, "a").join(right, "b")
    return joined.where(100 * both >= percent * (F.size("xa") + F.size("xb") - both)).select("a", "b")


def _compared(percent: int):
    """Rows sorted by (comp, chunk, block, role): a component's nodes (role 0), then those from outside, to links."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, inside, sets, index = None, [], [], None
        for batch in batches:
            keys = np.stack([batch[c].to_numpy() for c in ("comp", "chunk", "block")], axis=1)
            doc, role = batch["doc"].to_numpy(), batch["role"].to_numpy()
            edges, flat = batch["set"].offsets.to_numpy(), batch["set"].values.to_numpy()
            found = [np.zeros((0, 2), np.int64)]
            for i, key in enumerate(map(tuple, keys.tolist())):
                own = flat[edges[i] : edges[i + 1]]
                if key != at:
                    at, inside, sets, index = key, [], [], None
                if not role[i]:
                    inside.append(doc[i])
                    sets.append(own.copy())
                    continue
                if index is None:
                    nodes, sizes = np.array(inside, np.int64), np.array([len(x) for x in sets], np.int64)
                    hashes = np.concatenate([np.zeros(0, np.int64), *sets])
                    order = np.argsort(hashes, kind="stable")
                    index = hashes[order], np.repeat(np.arange(len(sizes)), sizes)[order]
                lo, hi = (np.searchsorted(index[0], own, side) for side in ("left", "right"))
                runs = hi - lo
                hits = index[1][np.repeat(hi - np.cumsum(runs), runs) + np.arange(runs.sum())]
                both = np.bincount(hits, minlength=len(nodes))
                ok = nodes[(100 * both >= percent * (sizes + len(own) - both)) & (nodes != doc[i])]
                found.append(np.stack([np.minimum(ok, doc[i]), np.maximum(ok, doc[i])], axis=1))
            links = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([pa.array(links[:, 0].copy()), pa.array(links[:, 1].copy())], ["a", "b"])

    return each


def against_components(wanted: DataFrame, comps: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between nodes and components: each ``doc`` of ``wanted`` with every node of its ``comp``, on full sets.

    A component without rows in ``comps`` is the node of that number. Both sides are dealt by hash, so
    neither a large component nor one that many nodes are compared with meets in one task.
    """
    wanted = cut_lineage(wanted.distinct())
    asked = cut_lineage(wanted.groupBy("comp").agg(F.ceil(F.count("*") / (2 * BLOCK)).cast("int").alias("chunks")))
    inside = cut_lineage(comps.join(asked.select("comp"), "comp").select("doc", "comp").unionAll(asked.select(F.col("comp").alias("doc"), "comp")).distinct())
    sizes = cut_lineage(inside.groupBy("comp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).join(asked, "comp"))

    def dealt(rows: DataFrame, role: int, one: str, every: str) -> DataFrame:
        return rows.join(sizes, "comp").select(
            "doc", "comp", F.lit(role).alias("role"), F.pmod(F.xxhash64("doc"), F.col(one)).cast("int").alias(one),
            F.explode(F.sequence(F.lit(0), F.col(every) - 1)).alias(every),
        ).withColumnsRenamed({"chunks": "chunk", "blocks": "block"})

    sets = full_sets(wanted.select("doc").unionAll(inside.select("doc")), docs, k)
    return (
        dealt(wanted, 1, "chunks", "blocks").unionByName(dealt(inside, 0, "blocks", "chunks")).join(sets, "doc")
        .repartition("comp", "chunk", "block").sortWithinPartitions("comp", "chunk", "block", "role", "doc")
        .mapInArrow(released(_compared(percent)), "a long, b long")
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of all nodes with an edge; comp is the component's smallest node."""
    now = cut_lineage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = None
    while True:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        now = cut_lineage(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct())
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == mark:
            break
        mark = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionAll(now.select("v", "v").distinct())


def group(df: DataFrame, text: str = "text", key: str = "doc_id", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``df`` with n_shingles, component_id and kept (whether the row's id is its component's)."""
    if clash := {c.lower() for c in df.columns} & {"n_shingles", "component_id", "kept"}:
        raise ValueError(f"columns of these names are added: {sorted(clash)}")
    docs = df.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")).where("doc is not null")
    with tidied(df.sparkSession) as kept:
        found = kept(_grouped(docs, k, percent))
    c, n, d = fresh(df, "comp_", "n_", "d_")
    found = found.select(F.col("doc").alias(d), F.col("n").alias(n), F.col("comp").alias(c))
    return (
        df.join(found, F.col(key).cast("long") == F.col(d), "left")
        .withColumns({"n_shingles": F.coalesce(F.col(n), F.lit(0)), "component_id": F.col(c), "kept": F.coalesce(F.col(c) == F.col(key).cast("long"), F.lit(True))})
        .select(*df.columns, "n_shingles", "component_id", "kept")
    )


def _keyed(reps: DataFrame) -> DataFrame:
    """key, doc, n of every node in every table; rep and rep_n where the key is hot."""
    table = F.explode(F.flatten(F.transform("a", lambda x, i: F.transform("b", lambda y, j: F.xxhash64(i, j, x, y)))))
    keyed = reps.select(table.alias("key"), "doc", "n")
    sample = F.pmod(F.xxhash64(F.lit("hot"), "doc"), F.lit(SAMPLE)) == 0
    least = max(SEEN, reps.where(sample).count() / HOT)
    hot = keyed.where(sample).groupBy("key").agg(F.count("*").alias("seen"), F.min(F.struct("doc", "n")).alias("r")).where(F.col("seen") >= least)
    hot = cut_lineage(hot.select("key", F.col("r.doc").alias("rep"), F.col("r.n").alias("rep_n")))
    dealt = F.when(F.col("rep").isNull(), F.col("key")).otherwise(F.xxhash64("key", "doc"))
    return keyed.join(F.broadcast(hot), "key", "left").repartition(dealt).sortWithinPartitions("key", "doc")


def _grouped(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc, n and comp of every document."""
    marks = cut_lineage(signed(docs, k))
    some = marks.where("n > 0")
    nodes = cut_lineage(some.groupBy("digest").agg(F.min("doc").alias("node"), F.count("*").alias("copies")))
    reps = cut_lineage(
        some.join(nodes.select("digest", F.col("node").alias("doc")), ["digest", "doc"]).dropDuplicates(["doc"]).select("doc", "n", "a", "b", "sketch")
    )
    found = cut_lineage(_keyed(reps).mapInArrow(released(_bucketed(percent)), "a long, b long, n long"))
    sketches = reps.select("doc", "sketch")
    first = cut_lineage(confirmed(found.where("b is not null").select("a", "b").distinct(), docs, sketches, k, percent))
    members = cut_lineage(reps.join(found.where("b is null").select(F.col("a").alias("doc")).distinct(), "doc", "left_semi"))

    def across(rows: DataFrame, best: int) -> DataFrame:
        signs = members.select("doc", "sketch") if best else members.select("doc", "sketch", F.concat("a", "b").alias("keys"))
        return (
            rows.join(signs, "doc").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "comp", "doc")
            .mapInArrow(released(_across(percent, best)), "a long, b long")
        )

    def more(links: DataFrame, best: int) -> DataFrame:
        comps = cut_lineage(components(links).withColumnRenamed("node", "doc"))
        known = members.select("doc", "n", "a").join(comps, "doc", "left")
        known = known.select("doc", "n", F.coalesce("comp", "doc").alias("comp"), F.posexplode("a").alias("place", "hash"))
        known = cut_lineage(known.select(F.xxhash64("place", "hash").alias("key"), "place", "doc", "n", "comp"))
        block = lambda total, most: F.pmod(F.xxhash64("doc"), F.ceil(F.col(total) / most)).cast("int")
        if best:
            mixed = known.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("c")).where("lo <> hi").select("key", "c")
            near = known.join(mixed, "key").withColumn("block", block("c", NEIGHBOURS)).withColumns({"lo": F.col("block"), "hi": F.col("block")}).drop("c")
            return cut_lineage(confirmed(across(near, best).distinct(), docs, sketches, k, percent))
        # the largest component of a bucket stays behind: all nodes outside it are compared with the whole component
        share = known.groupBy("key", "comp").agg(F.count("*").alias("c"), F.min("n").alias("lo"), F.max("n").alias("hi"))
        largest = share.groupBy("key").agg(F.count("*").alias("comps"), F.sum("c").alias("c"), F.max(F.struct("c", "comp", "lo", "hi")).alias("top")).where("comps > 1")
        has_top = F.col("top.c") > SMALL
        largest = largest.select(
            "key", F.when(has_top, F.col("top.comp")).alias("top"), F.col("top.lo").alias("least"), F.col("top.hi").alias("most"),
            (F.col("c") - F.when(has_top, F.col("top.c")).otherwise(0)).alias("rest"),
        )
        kept = known.alias("m").join(largest.alias("l"), (F.col("m.key") == F.col("l.key")) & ~F.col("comp").eqNullSafe(F.col("top")))
        outside = cut_lineage(kept.select("m.key", "place", "doc", "n", "comp", "top", "least", "most", "rest"))
        size_fits = (100 * F.col("most") >= percent * F.col("n")) & (100 * F.col("n") >= percent * F.col("least"))
        wanted = outside.where(F.col("top").isNotNull() & size_fits).select("doc", F.col("top").alias("comp"))
        # each member meets all blocks of its bucket, and so every pair of blocks has a task
        pairs = outside.withColumn("block", block("rest", PART)).withColumn("other", F.explode(F.sequence(F.lit(0), F.ceil(F.col("rest") / PART).cast("int") - 1)))
        pairs = pairs.select("key", "place", "doc", "n", "comp", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
        wanted = wanted.unionAll(across(pairs, best).select(F.col("a").alias("doc"), F.col("b").alias("comp")))
        return cut_lineage(against_components(wanted, comps, docs, k, percent))

    second = first.unionAll(more(first, best=2))
    all_ = components(second.unionAll(more(second, best=0)))
    homes = cut_lineage(nodes.join(all_, "node", "left").select("digest", "copies", F.coalesce("comp", "node").alias("comp")))
    total = nodes.agg(F.sum("copies")).first()[0] or 0
    hot = F.broadcast(homes.where(F.col("copies") * HOT >= total).select("digest", "comp"))  # HOT rows at most
    of = some.select("doc", "n", "digest")
    rows = of.join(hot, "digest").unionByName(of.join(hot, "digest", "left_anti").join(homes.drop("copies"), "digest")).drop("digest")
    rows = rows.unionByName(marks.where("n = 0").select("doc", "n", F.col("doc").alias("comp")))
    return rows.groupBy("doc").agg(F.max("n").alias("n"), F.min("comp").alias("comp"))
