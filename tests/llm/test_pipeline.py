"""The pipeline stage by stage, each on all that its predecessor kept."""

import hashlib
import random

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from pagemill.llm import bpe  # noqa: E402

SYLLABLES = {"en": "the and house with there over under land ing tion", "fr": "les nous \u00e9tions apr\u00e8s cela eau eux \u00e7on", "de": "der die und nicht ung schaft lich \u00fcber"}


def text(rng, lang, n=60):
    parts = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_stages_and_run(spark, tmp_path):
    rng = random.Random(10)
    rows = [(i, text(rng, lang, rng.randint(40, 80)), lang, f"s{i % 3}", 0) for i, lang in enumerate(["en", "fr", "de"] * 40)]
    clean = dict((r[0], r[1]) for r in rows)
    copies = [(200 + i, rows[i][1], rows[i][2], "s0", 0) for i in range(10)]
    near = [(300 + i, rows[i][1] + " end", rows[i][2], "s1", 0) for i in range(10, 20)]
    junk = [(400, None, "en", "s0", 0), (401, "", None, "s1", 0), (402, "too short", "en", "s2", 0), (403, "spam spam spam " * 40, "en", "s2", 0), (404, "12 34 56 " * 3 + " ".join(str(i) for i in range(900, 980)), None, "s2", 0)]
    frame = spark.createDataFrame(rows + copies + near + junk, "doc_id long, text string, lang string, source string, n_chars long")
    frame.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    docs, kept = frame, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = [r["doc_id"] for r in docs.select("doc_id").collect()]
        if name != "byte_bpe":
            assert docs.columns == frame.columns
    all_ids = set(clean) | {r[0] for r in copies + near}
    assert set(kept["quality_rules"]) == all_ids | {404}  # 404 has no letters
    assert set(kept["language_id"]) == all_ids
    assert sorted(kept["near_duplicates"]) == sorted(clean)
    taken = {i: kept["source_mixing"].count(i) for i in clean}
    assert set(kept["source_mixing"]) <= set(clean) and max(taken.values()) <= 2
    size = {i: len(t.split()) for i, t in clean.items()}
    total, of = sum(size.values()), lambda s: sum(taken[i] * size[i] for i in clean if i % 3 == s)
    caps = [2 * sum(size[i] for i in clean if i % 3 == s) for s in range(3)]
    assert of(0) == pytest.approx(min(caps[0], 1.5 * total * 3 / 6), abs=5)
    assert sum(of(s) for s in range(3)) == pytest.approx(1.5 * total, abs=15)
    enc = bpe._encoding(bpe.public_tokenizers.path(bpe.RANKS))
    last = docs.collect()
    assert sorted(r["doc_id"] for r in last) == sorted(kept["source_mixing"])
    for r in last:
        assert np.frombuffer(r["token_ids"], "<u4").tolist() == enc.encode_ordinary(clean[r["doc_id"]])
        assert r["decoded_sha256"] == hashlib.sha256(clean[r["doc_id"]].encode()).hexdigest()
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    key = lambda rows: sorted((r["doc_id"], r["n_tokens"], bytes(r["token_ids"])) for r in rows)
    assert key(again) == key(last)
