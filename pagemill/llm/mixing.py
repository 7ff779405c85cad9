"""Mixing sources to target weights by subset-sum budget fitting.

Each source has a target: its weight's share of the budget, at most ``max_repeat`` times what it
holds; what is above goes to the others by weight. Whole passes over a source come first. For the
budget that remains, documents are counted by exact length; every length first gives its
proportional part (the rounding is carried from length to length), long lengths then close the gap to
a few thousand words, and a bounded-knapsack
dynamic program over the counts hits the rest as closely as any choice can. Where only documents too
long for that are left, the program runs over the whole rest, or, where that is too large, the nearest
sum of the spare documents is taken directly. Per length, documents are selected by seeded hash.

Scale: text never moves for the counts; one row per (source, length, 1/4096 of the hash range) is
summed map-side. The selection joins on the same three columns, so a length that a third of all
documents share is dealt over 4096 keys, and only the bucket at the cut is ranked. The dynamic
program sees one source's distinct lengths, never documents. The driver holds one row per source.

Defined results: null or blank text has size 0 and takes nothing; a null source is a source of its
own, last in order; repeated rows are taken one by one; a source without words has target 0; an
empty table gives an empty table; columns named like the added ones raise; very long texts count as
any other. Reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, n_words

WEIGHTS = (3.0, 1.0, 2.0)
BUDGET = 1.5
MAX_REPEAT = 2
SEED = 20240229
#: The dynamic program runs over so many words at most.
SPAN = 1 << 16
#: Where spare documents are too long for that, it runs over so many words, and words times parts, at most.
DEEP, DEEP_WORK = 1 << 22, 1 << 31
BUCKET_BITS = 12


def water_fill(sizes: Sequence[int], weights: Sequence[float], budget: float, max_repeat: float) -> list[float]:
    """Targets: shares of ``budget`` by weight, capped at ``max_repeat`` times each size."""
    caps = [max_repeat * s for s in sizes]
    out = [0.0] * len(caps)
    open_, left = set(range(len(caps))), min(float(budget), float(sum(caps)))
    while open_:
        total = sum(weights[i] for i in open_)
        full = {i for i in open_ if left * weights[i] / total > caps[i]}
        if not full:
            for i in open_:
                out[i] = left * weights[i] / total
            return out
        for i in full:
            out[i] = float(caps[i])
            left -= caps[i]
        open_ -= full
    return out


def knapsack(lengths: np.ndarray, spare: np.ndarray, want: int, span: int = SPAN) -> np.ndarray:
    """How many of each length to take, at most ``spare``, so that their sum is nearest ``want``.

    Ties go to the smaller sum. ``want`` beyond ``span`` leaves counts at 0.
    """
    out = np.zeros(len(lengths), dtype=np.int64)
    usable = (lengths > 0) & (spare > 0)
    if want <= 0 or want > span or not usable.any():
        return out
    top = 2 * want  # a sum beyond is farther off than none at all
    reach = np.zeros(top + 1, dtype=bool)
    reach[0] = True
    by = np.full(top + 1, -1, dtype=np.int32)  # the part that first reached a sum
    parts: list[tuple[int, int, int]] = []  # row, copies, words
    for i in np.argsort(lengths, kind="stable"):
        n, copies = int(lengths[i]), 1
        left = int(min(spare[i], top // n)) if usable[i] else 0
        while left > 0 and not reach[want]:
            k = min(copies, left)
            step = n * k
            if step <= top:
                new = reach[:-step] & ~reach[step:]
                by[step:][new] = len(parts)
                reach[step:] |= new
                parts.append((i, k, step))
            left -= k
            copies *= 2
        if reach[want]:
            break
    sums = np.flatnonzero(reach)
    at = int(sums[np.argmin(np.abs(sums - want))])
    while at:
        i, k, step = parts[by[at]]
        out[i] += k
        at -= step
    return out


def nearest_few(lengths: np.ndarray, spare: np.ndarray, want: int) -> np.ndarray:
    """The choice nearest ``want`` where every spare document is longer than half of it; ties go to the smaller sum.

    Two such documents are beyond ``want`` already, so only none, one, or the two shortest can be nearest.
    """
    out = np.zeros(len(lengths), dtype=np.int64)
    usable = np.flatnonzero((lengths > 0) & (spare > 0))
    usable = usable[np.argsort(lengths[usable], kind="stable")]
    shortest = np.repeat(usable[:2], np.minimum(spare[usable[:2]], 2))[:2].tolist()
    choices = [[], *([int(i)] for i in usable), *([shortest] if len(shortest) == 2 else [])]
    best = min(choices, key=lambda c: (abs(sum(int(lengths[i]) for i in c) - want), sum(int(lengths[i]) for i in c)))
    for i in best:
        out[i] += 1
    return out


def fit(lengths: np.ndarray, counts: np.ndarray, want: int, span: int = SPAN) -> np.ndarray:
    """Documents to take of each length (at most ``counts``) for ``want`` words in all."""
    total = sum(int(a) * int(b) for a, b in zip(lengths, counts, strict=True))
    if want <= 0 or not total:
        return np.zeros(len(lengths), dtype=np.int64)
    if want >= total:
        return counts.astype(np.int64)
    # every length gives its part of what is wanted less one document of the longest; rounding goes on from
    # length to length, so that lengths of few documents give theirs in turn, and is never more than that document off
    order = np.argsort(lengths, kind="stable")
    upto = [0]
    for c in counts[order].tolist():
        upto.append(upto[-1] + int(c))
    some = max(0, want - int(lengths.max()))
    part = np.zeros(len(lengths), dtype=np.int64)
    part[order] = np.diff(np.array([x * some // total for x in upto], dtype=np.int64))
    off = lambda x: abs(sum(int(a) * int(b) for a, b in zip(lengths, x, strict=True)) - want)
    found = _fill(lengths, counts, want, part, span)
    if off(found):  # with few documents those taken already may shut out a better choice
        found = min(found, _fill(lengths, counts, want, np.array([int(c) * want // total for c in counts], dtype=np.int64), span), key=off)
    return found


def _fill(lengths: np.ndarray, counts: np.ndarray, want: int, part: np.ndarray, span: int) -> np.ndarray:
    """``part`` and what is taken beside it for ``want`` words in all."""
    take = part.copy()
    left = want - sum(int(a) * int(b) for a, b in zip(lengths, take, strict=True))
    for i in np.argsort(-lengths, kind="stable"):
        if left <= span:
            break
        k = int(min(counts[i] - take[i], (left - span // 2) // lengths[i])) if lengths[i] else 0
        take[i] += k
        left -= k * int(lengths[i])
    if left <= span:
        return take + knapsack(lengths, counts - take, left, span)
    # what is spare is longer than left - span / 2 now, so than half of left
    found = take + nearest_few(lengths, counts - take, left)
    rest = want - sum(int(a) * int(b) for a, b in zip(lengths, part, strict=True))
    copies = sum(int(min(c, 2 * rest // n)).bit_length() for n, c in zip(lengths.tolist(), (counts - part).tolist(), strict=True) if n > 0)
    if rest <= DEEP and 2 * rest * copies <= DEEP_WORK:
        whole = part + knapsack(lengths, counts - part, rest, rest)
        off = lambda x: abs(sum(int(a) * int(b) for a, b in zip(lengths, x, strict=True)) - want)
        found = whole if off(whole) < off(found) else found
    return found


def mix(df: DataFrame, source: str = "source", text: str = "text", key: str = "doc_id", size: Column | None = None, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, max_repeat: int = MAX_REPEAT, seed: int = SEED) -> DataFrame:
    """``df`` with size, source_size, target (of its source) and copies (0 to ``max_repeat``).

    ``weights`` repeat over the sources by code point. ``budget`` is a multiple of all sizes.
    """
    added = ["size", "source_size", "target", "copies"]
    if clash := {c.lower() for c in df.columns} & set(added):
        raise ValueError(f"columns of these names are added: {sorted(clash)}")
    spark = df.sparkSession
    s, h, b, rank = fresh(df, "s_", "h_", "b_", "rank_")
    size = n_words(F.col(text)) if size is None else size
    hashed = F.xxhash64(F.lit(seed), F.col(key).cast("string"))
    docs = df.withColumns({
        "size": size.cast("long"), s: F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")), h: hashed,
    }).withColumn(b, F.shiftrightunsigned(h, 64 - BUCKET_BITS).cast("int"))
    counts = docs.groupBy(F.col(s).alias("s"), "size", F.col(b).alias("b")).agg(F.count("*").alias("n"))
    hist = counts.groupBy("s", "size").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("b", "n"))).alias("bins")).persist()
    totals = hist.groupBy("s").agg(F.sum(F.col("size") * F.col("n")).alias("w")).collect()
    totals = sorted(((r["s"], int(r["w"])) for r in totals), key=lambda r: (r[0] == "", r[0]))
    sizes = [w for _, w in totals]
    targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(sizes))], budget * sum(sizes), max_repeat)
    rows = []
    for (name, w), target in zip(totals, targets, strict=True):
        passes = min(max_repeat, int(target // w)) if w else 0
        rows.append((name, w, target, passes, round(target - passes * w) if passes < max_repeat else 0))
    plan = spark.createDataFrame(rows, "s string, source_size long, target double, passes int, want long")

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", ignore_index=True)
        take = fit(pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), int(pdf["want"].iloc[0]))
        return pd.DataFrame({"s": pdf["s"], "size": pdf["size"], "take": take})

    chosen = hist.select("s", "size", "n").join(plan, "s").groupBy("s").applyInPandas(fitted, "s string, size long, take long")
    # the bucket in which a length's quota ends, and how many of it are still taken
    cut = F.aggregate(
        "bins",
        F.struct(F.col("take").alias("left"), F.lit(1 << BUCKET_BITS).alias("b")),
        lambda acc, x: F.when(acc["b"] < (1 << BUCKET_BITS), acc)
        .when(acc["left"] >= x["n"], F.struct((acc["left"] - x["n"]).alias("left"), acc["b"].alias("b")))
        .otherwise(F.struct(acc["left"].alias("left"), x["b"].alias("b"))),
    )
    decided = (
        hist.join(chosen, ["s", "size"])
        .withColumn("cut", cut)
        .select("s", "size", F.explode("bins.b").alias("b"), F.col("cut.b").alias("cut"), F.col("cut.left").alias("left"))
        .join(plan.select("s", "source_size", "target", "passes"), "s")
        .select(F.col("s").alias(s), "size", F.col("b").alias(b), "source_size", "target", F.struct("cut", "left", "passes").alias(rank))
    )
    ranked = docs.join(decided, [s, "size", b]).withColumn(
        h, F.row_number().over(Window.partitionBy(s, "size", b).orderBy(h, key))
    )
    more = (F.col(b) < F.col(rank)["cut"]) | ((F.col(b) == F.col(rank)["cut"]) & (F.col(h) <= F.col(rank)["left"]))
    copies = F.col(rank)["passes"] + F.when((F.col(rank)["passes"] < max_repeat) & more, 1).otherwise(0)
    return ranked.withColumn("copies", copies).select(*df.columns, *added)


def expand(mixed: DataFrame) -> DataFrame:
    """A mix's documents, each as often as it is taken, without the added columns."""
    (n,) = fresh(mixed, "n_")
    return mixed.withColumn(n, F.explode(F.array_repeat(F.lit(0), F.col("copies")))).drop(n, "size", "source_size", "target", "copies")
