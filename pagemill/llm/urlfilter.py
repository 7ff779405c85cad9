"""URL rules looked up in Bloom filter cascades (DataFrame functions only).

A rule names a host (with all its subdomains) and the start of a path. The keys of a url are its
host suffixes joined with its path starts; a rule fits if its key is among them. The first filter
holds the listed keys, the next one the keys of the corpus that pass it wrongly, the next the
listed keys that pass that one, and so on until nothing passes wrongly. Over the keys of the corpus
that the cascade was built from, membership is exact, and looking it up needs no join: the filters
are literals in the expression.

The first filter is sized so that about as many corpus keys pass it wrongly as there are listed
keys, so all filters together grow with the list and only with the logarithm of the corpus.
``max_bytes`` checks that before they are sent to executors; a longer list is to be dealt into
several cascades by a hash of the key, as ``judge`` does beyond that size.

Defined results: a null url or one without ``://`` has an empty host and path and no rule; a rule
listed as both allow and block blocks; repeated urls get equal rows; an empty table or list works.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, let

MAX_BYTES = 16 << 20
HOST_PATH = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), HOST_PATH, 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), HOST_PATH, 2)


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str
    verdict: str  # allow or block

    @property
    def key(self) -> str:
        return self.host + self.path


@dataclass
class Bloom:
    """``bits`` as 64-bit words; ``hashes`` positions a key, by double hashing under ``seed``."""

    bits: list[int]
    hashes: int
    seed: int

    @property
    def size(self) -> int:
        return 64 * len(self.bits)

    @staticmethod
    def positions(key: Column, size: int, hashes: int, seed: int) -> Column:
        a, b = F.xxhash64(key, F.lit(2 * seed)), F.xxhash64(key, F.lit(2 * seed + 1))
        one = lambda j: F.pmod(F.pmod(a, F.lit(size)) + F.lit(j) * F.pmod(b, F.lit(size)), F.lit(size))
        return F.array(*[one(j) for j in range(hashes)])

    @classmethod
    def of(cls, keys: DataFrame, n: int, bits_per_key: float, seed: int) -> Bloom:
        """Over the column ``key`` of ``n`` rows. Bits are or-ed on the executors."""
        size = 64 * max(1, math.ceil(n * bits_per_key / 64))
        hashes = max(1, min(20, round(bits_per_key * math.log(2))))
        at = keys.select(F.explode(cls.positions(F.col("key"), size, hashes, seed)).alias("p"))
        word = at.groupBy((F.col("p") / 64).cast("long").alias("w")).agg(
            F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("b")
        )
        bits = [0] * (size // 64)
        for row in word.collect():  # at most size / 64 rows, checked before
            bits[row["w"]] = row["b"]
        return cls(bits, hashes, seed)

    def holds(self, key: Column) -> Column:
        words = F.array(*[F.lit(b).cast("long") for b in self.bits]) if len(self.bits) <= 32 else F.from_json(
            F.lit("[" + ",".join(map(str, self.bits)) + "]"), "array<bigint>"
        )
        return F.forall(
            self.positions(key, self.size, self.hashes, self.seed),
            lambda p: F.getbit(F.get(words, (p / 64).cast("int")), (p % 64).cast("int")) == 1,
        )


@dataclass
class Cascade:
    levels: list[Bloom] = field(default_factory=list)

    def holds(self, key: Column) -> Column:
        """Listed or not, for keys of the universe: level by level, as long as filters say yes."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i, level in reversed(list(enumerate(self.levels))):
            # a key that level i rejects is not in the set that level i encodes
            out = F.when(~level.holds(key), F.lit(i % 2 == 1)).otherwise(out)
        return out

    @classmethod
    def build(cls, listed: DataFrame, universe: DataFrame, seed: int = 0, max_bytes: int = MAX_BYTES) -> Cascade:
        """From two one-column frames ``key``; the universe may repeat keys and hold listed ones."""
        listed = listed.distinct().persist()
        n = listed.count()
        cascade = cls()
        if not n:
            return cascade
        rows = universe.count()
        bits = max(8.0, 1.44 * math.log2(max(2.0, rows / n)))
        if n * bits / 8 > max_bytes:
            raise ValueError(f"{n} keys need {n * bits / 8:.0f} bytes; deal the list into several cascades")
        cascade.levels.append(Bloom.of(listed, n, bits, seed))
        wrong = universe.where(cascade.levels[0].holds(F.col("key"))).distinct().join(listed, "key", "left_anti").persist()
        inside, outside = listed, wrong  # what the last level holds, and what passes it wrongly
        n = outside.count()
        while n:
            if n > max_bytes:
                raise ValueError(f"{n} keys pass a filter wrongly; deal the list into several cascades")
            level = Bloom.of(outside, n, 8.0, seed + len(cascade.levels))
            cascade.levels.append(level)
            inside, outside = outside, inside.where(level.holds(F.col("key")))
            n = outside.count()
        wrong.unpersist()
        listed.unpersist()
        return cascade


def keys(host: Column, path: Column, max_labels: int, lengths: list[int]) -> Column:
    """All keys of a url that a list with such hosts and path lengths could name, longest first."""

    def suffixes(labels: Column) -> Column:
        last = F.least(F.size(labels), F.lit(max_labels))
        return F.transform(F.sequence(F.lit(1), last), lambda k: F.array_join(F.slice(labels, -k, k), "."))

    starts = F.filter(
        F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]), lambda x: x.isNotNull()
    )
    both = let(
        starts,
        lambda p: F.flatten(F.transform(let(F.split(host, r"\."), suffixes), lambda h: F.transform(p, lambda x: F.concat(h, x)))),
    )
    ordered = F.sort_array(F.transform(both, lambda k: F.struct(F.length(k).alias("n"), k.alias("k"))), asc=False)
    return F.transform(ordered, lambda x: x["k"])


def judge(df: DataFrame, rules: list[UrlRule], url: str = "url", default: str = "allow", seed: int = 0, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``df`` with ``host``, ``path``, ``rule`` (the longest that fits, else null) and ``verdict``."""
    spark = df.sparkSession
    if clash := {c.lower() for c in df.columns} & {"host", "path", "rule", "verdict"}:
        raise ValueError(f"columns of these names are added: {sorted(clash)}")
    out = df.withColumns({"host": host(F.col(url)), "path": path(F.col(url))})
    if not rules:
        return out.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    labels = max(r.host.count(".") + 1 for r in rules)
    lengths = sorted({len(r.path) for r in rules})
    own = keys(F.col("host"), F.col("path"), labels, lengths)
    universe = out.select(F.explode(F.when(F.col("host") != "", own)).alias("key"))
    blocked = {r.key for r in rules if r.verdict == "block"}
    cascades = {}
    for verdict, listed in (("block", blocked), ("allow", {r.key for r in rules} - blocked)):
        # beyond one cascade's size the list is dealt into several by a hash of the key
        parts = max(1, math.ceil(len(listed) * 8 / max_bytes))
        frame = spark.createDataFrame([(k,) for k in sorted(listed)], "key string")
        part = F.pmod(F.xxhash64("key"), F.lit(parts))
        cascades[verdict] = [
            Cascade.build(frame.where(part == i), universe.where(part == i), seed, max_bytes) for i in range(parts)
        ]

    def listed_as(key: Column, verdict: str) -> Column:
        parts = cascades[verdict]
        out = F.lit(False)
        for i, cascade in enumerate(parts):
            mine = cascade.holds(key)
            out = out | (mine if len(parts) == 1 else (F.pmod(F.xxhash64(key), F.lit(len(parts))) == i) & mine)
        return out

    (found,) = fresh(out, "found")
    said = lambda k: F.when(listed_as(k, "block"), F.lit("block")).when(listed_as(k, "allow"), F.lit("allow"))
    hits = F.filter(F.transform(own, lambda k: F.struct(k.alias("rule"), said(k).alias("verdict"))), lambda x: x["verdict"].isNotNull())
    return (
        out.withColumn(found, F.when(F.col("host") != "", F.get(hits, F.lit(0))))
        .withColumns({"rule": F.col(found)["rule"], "verdict": F.coalesce(F.col(found)["verdict"], F.lit(default))})
        .drop(found)
    )
