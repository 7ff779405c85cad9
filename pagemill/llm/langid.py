"""Language of whole texts, with spans of mixed language.

The script of a word narrows its candidate languages; hashed byte trigrams of the word score the
rest; Viterbi over the words, with a penalty for switching language, labels spans. The text's
language is the one that labels most of its words.

Training counts trigrams on the executors over a bounded sample of labelled rows, about
``SAMPLE`` a language; the model is 65,536 buckets a language whatever the corpus. Prediction is one
pass without a shuffle. Distinct words of a batch are scored once, all at a time. Where no stretch
of words gains more by another language than one switch costs, one label for all words is the best
path, and that is decided by running sums; the others go through the dynamic program, word by word
for all of a batch's texts together.

Defined results: null text or text without letters is ``und`` with score 0 and no spans; words
without letters take the label of the words around them and count for none; ties go to the
language that sorts first; with nothing to learn from every text is ``und``; repeated rows get
equal results; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import released

#: About so many labelled rows of each language are learned from.
SAMPLE = 1500
BUCKETS = 1 << 16
SWITCH = 12.0
#: Words of a batch that are worked on at a time; longer texts are still taken whole.
STEP = 1_000_000
#: First code points of script ranges (Unicode blocks) and the script that begins there.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0780, "other"), (0x0900, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "ethiopic"), (0x1400, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"),
    (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"),
    (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "other"), (0xFB50, "arabic"), (0xFE00, "other"),
    (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"), (0x32000, "other"),
)
NAMES = sorted({name for _, name in SCRIPTS})
_STARTS = np.array([a for a, _ in SCRIPTS])
_KIND = np.array([NAMES.index(b) for _, b in SCRIPTS])
#: A language's candidates must have its script in at least this part of its words.
SCRIPT_SHARE = 0.01


@dataclass
class Model:
    langs: list[str]
    scores: np.ndarray  # (BUCKETS, languages), centred log probabilities
    scripts: np.ndarray  # (languages, scripts), whether it is written so


def _bare(words: pa.Array) -> pa.Array:
    """Words in lower case with nothing but letters and the marks on them."""
    only = pc.replace_substring_regex(pc.utf8_lower(words), r"[^\p{L}\p{M}]+", "")
    return pc.replace_substring_regex(only, r"^\p{M}+", "")


def _grams(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all byte trigrams of ``^word$``, and where each word's begin (an empty word has one)."""
    framed = pc.binary_join_element_wise(pa.scalar("^"), words, pa.scalar("$"), "")
    offsets = np.frombuffer(framed.buffers()[1], np.int32)[framed.offset : framed.offset + len(framed) + 1].astype(np.int64)
    data = np.frombuffer(framed.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].astype(np.uint32)
    offsets = offsets - offsets[0]
    data = np.concatenate([data, np.zeros(2, np.uint32)])
    mixed = (data[:-2] * np.uint32(0x9E3779B1)) ^ (data[1:-1] * np.uint32(0x85EBCA77)) ^ (data[2:] * np.uint32(0xC2B2AE3D))
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    codes = ((mixed >> np.uint32(12)) % np.uint32(BUCKETS)).astype(np.int64)
    # the last two positions of a word reach into the next one
    inside = np.ones(len(codes), bool)
    inside[offsets[1:] - 1] = False
    inside[offsets[1:] - 2] = np.diff(offsets) == 2
    ends = np.concatenate([[0], np.cumsum(inside)])
    return codes[inside], ends[offsets[:-1]]


def _script(words: pa.Array) -> np.ndarray:
    """Script of each word's first letter; -1 where it has none."""
    first = pc.utf8_slice_codeunits(words, 0, 1)
    some = pc.not_equal(first, "").to_numpy(zero_copy_only=False)
    points = np.frombuffer("".join(first.to_pylist()).encode("utf-32-le"), np.uint32)
    out = np.full(len(words), -1)
    out[some] = _KIND[np.searchsorted(_STARTS, points, side="right") - 1]
    return out


def _split(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Words of every text: their counts, and all of them (white space at an end makes empty ones)."""
    lists = pc.split_pattern_regex(texts.fill_null(""), r"[\x09-\x0D\x20]+")
    return lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten()


def train(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE) -> Model:
    """From the labelled rows of ``df``; ``key`` and a hash choose about ``sample`` rows a language."""
    rows = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    have = {r["l"]: r["n"] for r in rows.groupBy(F.col(lang).alias("l")).agg(F.count("*").alias("n")).collect()}
    if not have:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((0, len(NAMES)), bool))
    langs = sorted(have)
    million = 1_000_000
    part = F.create_map(*[x for l in langs for x in (F.lit(l), F.lit(min(million, sample * million // have[l])))])
    chosen = rows.where(F.pmod(F.xxhash64(F.lit("train"), F.col(key)), F.lit(million)) < part[F.col(lang)])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for l in batch["lang"].unique().to_pylist():
                _, flat = _split(batch["text"].filter(pc.equal(batch["lang"], l)))
                words = _bare(flat)
                words = words.filter(pc.not_equal(words, ""))
                if not len(words):
                    continue
                codes, _ = _grams(words)
                mine = sums.setdefault(l, np.zeros(BUCKETS + len(NAMES), np.int64))
                mine[:BUCKETS] += np.bincount(codes, minlength=BUCKETS)
                mine[BUCKETS:] += np.bincount(_script(words), minlength=len(NAMES))
        for l, mine in sums.items():
            at = np.flatnonzero(mine)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([l] * len(at), pa.string()), "bucket": at.astype(np.int32), "n": mine[at]})

    counts = chosen.select(F.col(lang).alias("lang"), F.col(text).alias("text")).mapInArrow(released(counted), "lang string, bucket int, n long")
    found = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # languages x buckets at most
    langs = [l for l in langs if l in set(found["lang"].to_pylist())]
    table = np.zeros((len(langs), BUCKETS + len(NAMES)))
    table[[langs.index(l) for l in found["lang"].to_pylist()], found["bucket"].to_numpy()] = found["n"].to_numpy()
    grams = table[:, :BUCKETS] + 0.2
    logs = np.log(grams / grams.sum(axis=1, keepdims=True))
    scripts = table[:, BUCKETS:] / np.maximum(1, table[:, BUCKETS:].sum(axis=1, keepdims=True)) >= SCRIPT_SHARE
    return Model(langs, np.ascontiguousarray((logs - logs.mean(axis=0)).T.astype(np.float32)), scripts)


def word_scores(words: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """A score for every word and language, and whether the word has letters (without: all 0)."""
    bare = _bare(words)
    script = _script(bare)
    codes, starts = _grams(bare)
    scores = np.add.reduceat(model.scores[codes], starts, axis=0) if len(words) else np.zeros((0, len(model.langs)))
    has = script >= 0
    can = model.scripts[:, script].T | ~model.scripts[:, script].T.any(axis=1, keepdims=True)
    scores = np.where(can, scores, scores.min(axis=1, keepdims=True, initial=0) - 20)
    scores[~has] = 0
    return scores, has


def viterbi(scores: np.ndarray, counts: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Labels of all words: for every text the path of the highest sum, less ``switch`` for each change."""
    n, l = scores.shape
    ends = np.cumsum(counts)
    starts = ends - counts
    doc = np.repeat(np.arange(len(counts)), counts)
    sums = np.concatenate([np.zeros((1, l)), np.cumsum(scores, axis=0, dtype=np.float64)])
    best = np.argmax(sums[ends] - sums[starts], axis=1) if len(counts) else np.zeros(0, np.int64)
    labels = best[doc].astype(np.int32)
    if not n or l < 2:
        return labels
    # the most that any stretch of words gains by other languages
    gain = scores.copy()
    own = gain[np.arange(n), labels].copy()
    gain[np.arange(n), labels] = -np.inf
    run = np.concatenate([[0.0], np.cumsum((gain.max(axis=1) - own).astype(np.float64))])
    run = run[1:] - run[starts][doc]
    step = 2 * np.abs(run).max() + 1
    low = np.minimum.accumulate(np.concatenate([[0.0], run[:-1]]) * (np.arange(n) != starts[doc]) - doc * step) + doc * step
    most = np.full(len(counts), -np.inf)
    np.maximum.at(most, doc, run - low)
    hard = np.flatnonzero(most > switch)
    if not len(hard):
        return labels
    hard = hard[np.argsort(-counts[hard], kind="stable")]
    begin, length = starts[hard], counts[hard]
    kind = np.int8 if l < 128 else np.int32
    back = np.zeros((n, l), kind)
    value = scores[begin].astype(np.float64)
    active = len(hard)
    for t in range(1, int(length[0])):
        active = int(np.searchsorted(-length, -t, side="left"))
        v = value[:active]
        top = np.argmax(v, axis=1)
        jump = v[np.arange(active), top] - switch
        stay = v >= jump[:, None]
        at = begin[:active] + t
        back[at] = np.where(stay, np.arange(l, dtype=kind), top[:, None])
        value[:active] = np.where(stay, v, jump[:, None]) + scores[at]
    state = np.argmax(value, axis=1)
    for t in range(int(length[0]) - 1, -1, -1):
        active = int(np.searchsorted(-length, -t, side="left"))
        at = begin[:active] + t
        labels[at] = state[:active]
        if t:
            state[:active] = back[at, state[:active]]
    return labels


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())]))


def predict(df: DataFrame, model: Model, text: str = "text", switch: float = SWITCH, spans: bool = False) -> DataFrame:
    """``df`` with lang_pred and score, the part of the words with letters that it labels.

    With ``spans`` also the spans: word numbers from ``start`` to ``end`` (excluded) and language.
    """
    added = ["lang_pred", "score"] + ["spans"] * spans
    if clash := {c.lower() for c in df.columns} & set(added):
        raise ValueError(f"columns of these names are added: {sorted(clash)}")
    schema = T.StructType([*df.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())] + [T.StructField("spans", SPANS)] * spans)
    sent = df.sparkSession.sparkContext.broadcast(model)

    def labelled(texts: pa.Array, model: Model) -> list[pa.Array]:
        counts, flat = _split(texts)
        coded = flat.dictionary_encode()
        at = coded.indices.to_numpy()
        scores, has = word_scores(coded.dictionary, model)
        labels = viterbi(scores[at], counts, switch)
        has = has[at]
        l, n = len(model.langs), len(counts)
        doc = np.repeat(np.arange(n), counts)
        votes = np.bincount(doc[has] * l + labels[has], minlength=n * l).reshape(n, l)
        total = votes.sum(axis=1)
        top = votes.argmax(axis=1)
        score = np.where(total > 0, votes[np.arange(n), top] / np.maximum(1, total), 0.0)
        names = pa.array(model.langs, pa.string())
        out = [pc.if_else(pa.array(total > 0), names.take(pa.array(top)), "und"), pa.array(score)]
        if spans:
            starts = np.cumsum(counts) - counts
            nth = np.arange(len(at)) - starts[doc]
            empty = pc.equal(coded.dictionary, "").to_numpy(zero_copy_only=False)[at]
            nth = nth - np.repeat(empty[np.minimum(starts, max(0, len(at) - 1))] & (counts > 0), counts) if len(at) else nth
            keep = ~empty & (total > 0)[doc]
            d, w, x = doc[keep], nth[keep], labels[keep]
            new = np.ones(len(d), bool)
            new[1:] = (d[1:] != d[:-1]) | (x[1:] != x[:-1])
            last = np.concatenate([new[1:], np.ones(min(1, len(d)), bool)])
            offsets = np.concatenate([[0], np.cumsum(np.bincount(d[new], minlength=n))]).astype(np.int32)
            fields = [pa.array(w[new].astype(np.int32)), pa.array((w[last] + 1).astype(np.int32)), names.take(pa.array(x[new]))]
            out.append(pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, ["start", "end", "lang"])))
        return out

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for whole in batches:
            size = pc.binary_length(whole[text]).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            group = np.cumsum(size) // (6 * STEP)
            edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(whole)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                batch = whole.slice(a, b - a)
                if model.langs:
                    new = labelled(batch[text], model)
                else:
                    new = [pa.array(["und"] * (b - a), pa.string()), pa.array(np.zeros(b - a))] + [pa.nulls(b - a, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])))] * spans
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *added])

    return df.mapInArrow(released(each), schema)


def learnable(key: Column, lang: Column) -> Column:
    """Rows to learn from: labelled ones whose key's CRC-32, modulo 3, is not 1."""
    return lang.isNotNull() & ~held_out(key)


def held_out(key: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
