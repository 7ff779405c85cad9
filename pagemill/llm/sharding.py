"""Shards of bounded size by extendible hashing (DataFrame functions only).

Rows are hashed; a shard is a prefix of the hash's bits. The directory starts as one bucket, and
only a bucket over the byte limit is split on the next bit, until every one fits. Byte counts come
from one aggregation over slots of a fixed number of bits (a few times as many slots as shards), so
the splitting works on counts, not on rows; slots that are still too large get more bits in another
pass over their rows alone.

A bucket with a single key cannot be split by the key's hash. If it is over the limit (one huge row,
or a key that very many rows share), a hash of the whole row (``row``) deals its rows to about twice as
many groups as shards are needed; a group that is still too large is cut in the order of the row's hash.
The parts are numbered 0, 1, ... within the shard, each within the limit unless one row alone is above
it; bytes and rows are then a part's. Reruns agree, however the input is partitioned. Rows over half the
limit are parts of their own. Rows equal in all columns are of one group.

Defined results: null text has no bytes; null keys hash as one key of their own; repeated rows with
one key share a shard; an empty table gives no shard; other columns pass through, and one named like an
added one raises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bits_for, fresh

#: Bits of the hash that are used; 64 MiB a shard.
HASH_BITS = 60
LIMIT = 64 << 20
#: Directories of up to so many slots are broadcast (16 bytes a slot); larger ones are joined by shuffle.
BROADCAST_SLOTS = 1 << 16


def key_hash(key: Column) -> Column:
    """The first 60 bits of the key's MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("\x00null"))), 1, HASH_BITS // 4), 16, 10).cast("long")


def _prefix(h: Column, bits: int) -> Column:
    return F.shiftright(h, HASH_BITS - bits)


def _directory(rows: DataFrame, start: int, bits: int, limit: int) -> DataFrame:
    """Slots of ``bits`` bits with the depth of their shard; -1 where no prefix so far is small enough.

    ``start``: a depth at which every prefix is known to be too large (-1: none is).
    """
    slots = rows.groupBy(_prefix(F.col("h"), bits).alias("slot")).agg(
        F.sum("b").alias("bytes"), F.count("*").alias("rows"), F.min("h").alias("lo"), F.max("h").alias("hi")
    )
    up = slots.select("*", F.explode(F.sequence(F.lit(start + 1), F.lit(bits))).alias("depth"))
    # a slot of zero bits below its depth names the prefix
    at = F.expr(f"shiftright(slot, {bits} - depth)")
    prefixes = up.groupBy("depth", at.alias("prefix")).agg(
        F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
    )
    fits = (F.col("bytes") <= limit) | (F.col("lo") == F.col("hi"))
    small = prefixes.where(fits).select("depth", "prefix", "bytes", "rows", ((F.col("lo") == F.col("hi")) & (F.col("bytes") > limit)).alias("over"))
    best = (
        up.select("slot", "depth", at.alias("prefix"))
        .join(small, ["depth", "prefix"], "left")
        .groupBy("slot")
        .agg(F.min(F.when(F.col("bytes").isNotNull(), F.struct("depth", "bytes", "rows", "over"))).alias("s"))
    )
    return best.select("slot", F.coalesce("s.depth", F.lit(-1)).alias("depth"), F.col("s.bytes").alias("bytes"), F.col("s.rows").alias("rows"), F.col("s.over").alias("over"))


def shard(df: DataFrame, key: str = "doc_id", size: Column | None = None, limit: int = LIMIT, row: Column | None = None) -> DataFrame:
    """``df`` with n_bytes, shard (its bits as text, empty for the whole table), part, shard_bytes, shard_rows.

    ``row``: what tells the rows of one key apart; by default all columns.
    """
    if clash := {c.lower() for c in df.columns} & {"n_bytes", "shard", "part", "shard_bytes", "shard_rows"}:
        raise ValueError(f"columns of these names are added: {sorted(clash)}")
    size = F.octet_length("text") if size is None else size
    row = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}) if row is None else row
    h, found, group, tie, big = fresh(df, "h_", "found_", "group_", "tie_", "big_")
    narrow = df.select(key_hash(F.col(key)).alias("h"), F.coalesce(size, F.lit(0)).cast("long").alias("b"))
    total = narrow.agg(F.sum("b").alias("b")).first()["b"] or 0
    out = df.withColumns({"n_bytes": F.coalesce(size, F.lit(0)).cast("long"), h: key_hash(F.col(key))})
    start, bits, steps = -1, min(HASH_BITS, bits_for(total / limit) + 4), []
    open_slots = None
    any_over = False
    while True:
        rows = narrow if open_slots is None else narrow.join(open_slots, _prefix(F.col("h"), start) == F.col("open"), "left_semi")
        directory = _directory(rows, start, bits, limit).persist()
        seen = directory.agg(F.count_if(F.col("depth") < 0).alias("open"), F.count_if(F.col("over")).alias("over")).first()
        any_over |= seen["over"] > 0
        steps.append((bits, directory))
        if not seen["open"] or bits == HASH_BITS:
            break
        open_slots = directory.where("depth < 0").select(F.col("slot").alias("open"))
        start, bits = bits, min(HASH_BITS, bits + 12)
    s = None
    for i, (bits, directory) in enumerate(steps):
        mine = directory.select(F.col("slot").alias(f"slot_{i}"), F.struct("depth", "bytes", "rows", "over").alias(f"{found}{i}"))
        mine = F.broadcast(mine) if directory.count() <= BROADCAST_SLOTS else mine
        out = out.join(mine, _prefix(F.col(h), bits) == F.col(f"slot_{i}"), "left").drop(f"slot_{i}")
        here = F.when(F.col(f"{found}{i}.depth") >= 0, F.col(f"{found}{i}"))
        s = here if s is None else F.coalesce(s, here)
    bits_text = F.lpad(F.conv(F.col(h).cast("string"), 10, 2), HASH_BITS, "0")
    out = out.withColumns({
        "shard": F.substring(bits_text, F.lit(1), s["depth"]),
        "shard_bytes": s["bytes"], "shard_rows": s["rows"], found: s["over"],
    }).drop(*[f"{found}{i}" for i in range(len(steps))])
    if not any_over:
        return out.withColumn("part", F.lit(0).cast("long")).drop(h, found)
    # single keys over the limit: running bytes within small groups by the row's hash, never over the whole key
    fine = out.where(~F.col(found)).withColumn("part", F.lit(0).cast("long")).drop(h, found)
    groups = 2 * F.ceil(F.col("shard_bytes") / F.lit(limit)).cast("long")
    deep = out.where(F.col(found)).withColumn(tie, key_hash(row)).withColumns({group: F.pmod(F.col(tie), groups), big: F.col("n_bytes") > F.lit(limit // 2)})
    # (rows that are no parts of their own begin within the limit less their group's largest)
    one = Window.partitionBy("shard", h, group, big)
    w = one.orderBy(tie, "n_bytes").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begins = F.floor((F.sum("n_bytes").over(w) - F.col("n_bytes")) / (F.lit(limit) - F.max("n_bytes").over(one)))
    at = F.when(F.col(big), F.row_number().over(one.orderBy(tie, "n_bytes"))).otherwise(begins).cast("long")
    deep = deep.withColumn("part", at)
    (b_, r_), per = fresh(df, "bytes_", "rows_"), ["shard", group, big, "part"]
    parts = deep.groupBy(*per).agg(F.sum("n_bytes").alias(b_), F.count("*").alias(r_))
    parts = parts.withColumn(found, F.row_number().over(Window.partitionBy("shard").orderBy(group, big, "part")).cast("long") - 1)
    deep = deep.drop(found, "shard_bytes", "shard_rows").join(parts, per).drop("part").withColumnsRenamed({found: "part", b_: "shard_bytes", r_: "shard_rows"})
    return fine.unionByName(deep.select(*fine.columns))
