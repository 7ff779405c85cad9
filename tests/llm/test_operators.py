"""Operators against brute force on small inputs with awkward rows."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagemill.llm import bpe, chat, common, langid, mixing, neardup, quality, sharding, tokenout, topk, urlfilter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", "  \n ", "one", "a b", "x " * 40, "same line here\nsame line here\nother", "é ß 漢字 \u00a0 y", "Long " + "word " * 3000]


def docs(spark, texts, sources=None):
    sources = sources or ["s"] * len(texts)
    return spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(zip(texts, sources, strict=True))], "doc_id long, text string, source string")


def test_quality_measures_match_brute_force(spark):
    rng = random.Random(1)
    texts = ODD + [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(40)]
    got = {r["doc_id"]: r for r in quality.report(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = WORD.findall(t or "")
        windows = [tuple(w[j : j + 8]) for j in range(len(w) - 7)]
        covered = {k for j, x in enumerate(windows) if windows.count(x) > 1 for k in range(j, j + 8)} if len(w) < 200 else set(range(len(w) - 0)) - {0}
        assert got[i]["n_words"] == len(w)
        assert got[i]["word_chars"] == sum(map(len, w))
        assert got[i]["n_repeat_words"] == len(covered), i
        assert got[i]["base_failed"] == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
    assert quality.report(docs(spark, ["x"]).limit(0)).count() == 0
    with pytest.raises(ValueError):
        quality.report(docs(spark, ["x"]).withColumn("KEPT", F.lit(1)))


def test_cascade_filters_by_its_rules(spark):
    good = "These are thirty words of clean prose " + " ".join(f"word{i}" for i in range(30))
    kept = quality.keep(docs(spark, [good, "too short", good.upper(), "a### b$$$ " * 20, None])).collect()
    assert [r["doc_id"] for r in kept] == [0]
    a, b, c = (quality.Rule(n, None) for n in "abc")
    order = quality.by_rejections_per_cost([(a, 2.0, 0.5), (b, 0.5, 0.2), (c, 4.0, 0.0)])
    assert [r.name for r, _, _ in order] == ["b", "a", "c"]
    got = quality.report(docs(spark, ["a#b $ c\n x\na#b $ c\n x\n\n x"])).first()
    assert got["n_symbols"] == 4 and got["n_dup_lines"] == 3 and got["n_lines"] == 5


def test_url_cascade_is_exact(spark):
    rng = random.Random(2)
    hosts = ["example.com", "www.example.com", "a.b.net", "net", "com", "x.org", "EXAMPLE.com", "notexample.com"]
    urls = [None, "no scheme", "http://", "http://example.com", "http://a://b"] + [f"http://{rng.choice(hosts)}/{rng.choice(['en', 'es', 'fr', 'enx', ''])}/{i}?q#f" for i in range(300)]
    rules = [urlfilter.UrlRule(*r) for r in (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"))]
    got = urlfilter.judge(spark.createDataFrame(list(enumerate(urls)), "id long, url string"), rules).collect()
    for r in got:
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", r["url"] or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [x for x in rules if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        best = max(fits, key=lambda x: len(x.key), default=None)
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, best.key if best else None, best.verdict if best else "allow")
    universe = spark.createDataFrame([(f"k{i}",) for i in range(3000)], "key string")
    cascade = urlfilter.Cascade.build(universe.limit(700), universe)
    assert universe.where(cascade.holds(F.col("key"))).count() == 700


def test_shards_fit_their_limit(spark):
    texts = ["x" * (i % 50) for i in range(500)] + ["y" * 900, None, ""]
    got = sharding.shard(docs(spark, texts), limit=600).collect()
    assert len(got) == len(texts)
    by = {}
    for r in got:
        by.setdefault((r["shard"], r["part"]), []).append(r)
    for rows in by.values():
        total = sum(r["n_bytes"] for r in rows)
        assert total == rows[0]["shard_bytes"] and (total <= 600 or len(rows) == 1)
    names = sorted({s for s, _ in by})
    assert not any(b.startswith(a) and a != b for a in names for b in names)
    same = spark.createDataFrame([(7, "z" * 100)] * 50, "doc_id long, text string")
    parts = sharding.shard(same, limit=600).groupBy("shard", "part").agg(F.sum("n_bytes").alias("b")).collect()
    assert sum(p["b"] for p in parts) == 5000 and max(p["b"] for p in parts) <= 700
    assert sharding.shard(same.limit(0)).count() == 0
    with pytest.raises(ValueError):
        sharding.shard(same.withColumn("Part", F.lit(0)))


def test_parts_do_not_depend_on_partitions(spark):
    rng = random.Random(9)
    rows = [(7 if i % 3 else i, i, "z" * rng.randint(0, 250)) for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, n long, text string")
    runs = [sorted((r["n"], r["shard"], r["part"], r["shard_bytes"], r["shard_rows"]) for r in sharding.shard(frame.repartition(p), limit=600).collect()) for p in (1, 6)]
    assert runs[0] == runs[1] and len(runs[0]) == 400
    hot = {r[1] for r in runs[0] if rows[r[0]][0] == 7}
    assert len(hot) == 1
    parts = {r[2] for r in runs[0] if r[1] in hot}
    assert parts == set(range(len(parts))) and len(parts) > 20


def test_parts_of_one_key_fit_their_limit(spark):
    sizes = [400, 400, 250, 250, 250, 900, 300, 1, 600, 250, 0, 550] * 3
    same = spark.createDataFrame([(7, "z" * n) for n in sizes], "doc_id long, text string").coalesce(1)
    by = {}
    for r in sharding.shard(same, limit=600).collect():
        by.setdefault((r["shard"], r["part"]), []).append(r)
    assert sum(map(len, by.values())) == len(sizes)
    for rows in by.values():
        total = sum(r["n_bytes"] for r in rows)
        assert total <= 600 or len(rows) == 1
        assert {(r["shard_bytes"], r["shard_rows"]) for r in rows} == {(total, len(rows))}


def test_preference_pairs(spark):
    rows = [(0, 0, "user", "hi"), (0, 1, "assistant", "a"), (1, 0, "user", "hi"), (1, 1, "assistant", "b"), (2, 0, "user", None), (4, 0, None, "x"), (5, 0, None, "x"), (None, 0, "user", "lost")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["pair_id"]: r for r in chat.preference_pairs(turns, F.floor(F.col("conv_id") / 2), F.col("conv_id") % 2 == 0).collect()}
    assert got[0]["prompt"] == "<|im_start|>user\nhi<|im_end|>\n" and got[0]["chosen"] == "<|im_start|>assistant\na<|im_end|>\n" and got[0]["chosen_mask"] == "22:0,12:1"
    assert got[1]["status"] == "unpaired" and got[1]["rejected"] is None
    assert got[2]["status"] == "identical" and got[2]["chosen"] == "" and len(got) == 3
    rows = [(0, 0, "user", "hi"), (0, 0, "user", "hi"), (0, 1, "assistant", "a"), (1, 0, "user", "hi"), (3, 0, "user", "other"), (3, 1, "assistant", "c")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    (one,) = chat.preference_pairs(turns, F.lit(0), F.col("conv_id") == 0).collect()  # 1 and 3 are on one side
    assert (one["rejected_id"], one["n_prompt_turns"], one["rejected"]) == (1, 1, "") and one["chosen"].count("<|im_start|>") == 2
    assert chat.preference_pairs(turns.limit(0), F.col("conv_id"), F.lit(True)).count() == 0


def test_knapsack_against_all_subsets():
    rng = random.Random(3)
    for _ in range(50):
        lengths = np.array(sorted(rng.sample(range(1, 30), 4)))
        spare = np.array([rng.randint(0, 3) for _ in range(4)])
        want = rng.randint(1, 60)
        sums = {sum(int(a) * k for a, k in zip(lengths, ks, strict=True)) for ks in np.ndindex(*(spare + 1))}
        got = mixing.knapsack(lengths, spare, want)
        assert (got <= spare).all()
        assert abs(int((got * lengths).sum()) - want) == min(abs(s - want) for s in sums)


def test_fit_of_few_very_long_documents():
    assert mixing.fit(np.array([300_000]), np.array([1]), 210_000).tolist() == [1]
    assert mixing.fit(np.array([300_000]), np.array([1]), 140_000).tolist() == [0]
    assert mixing.fit(np.array([90_000, 150_000, 260_000]), np.array([1, 1, 1]), 255_000).tolist() == [0, 0, 1]
    rng = random.Random(8)
    for _ in range(30):
        lengths = np.array(sorted(rng.sample(range(40_000, 900_000), 5)))
        counts = np.array([rng.randint(1, 2) for _ in range(5)])
        want = rng.randint(150_000, int((lengths * counts).sum()) - 1)
        part = np.array([int(c) * want // int((lengths * counts).sum()) for c in counts])
        sums = [int(((np.array(ks) + part) * lengths).sum()) for ks in np.ndindex(*(counts - part + 1))]
        got = mixing.fit(lengths, counts, want)
        assert (got <= counts).all()
        if want - int((part * lengths).sum()) > 66_000:
            greedy = abs(int((got * lengths).sum()) - want)
            assert greedy <= 66_000 or greedy == min(abs(x - want) for x in sums)
    # beyond the program's words: none, one or the two shortest
    assert mixing.nearest_few(np.array([60, 70]), np.array([2, 1]), 100).tolist() == [2, 0]
    assert mixing.fit(np.array([30_000_000]), np.array([1]), 21_000_000).tolist() == [1]


def test_mix_meets_targets_and_repeats(spark):
    texts = [None, ""] + ["w " * (i % 17 + 1) for i in range(400)]
    sources = [None, "b"] + ["abc"[i % 3] if i % 5 else None for i in range(400)]
    first = mixing.mix(docs(spark, texts, sources)).collect()
    assert len(first) == len(texts) and max(r["copies"] for r in first) <= 2
    taken, target = {}, {}
    for r in first:
        taken[r["source"]] = taken.get(r["source"], 0) + r["copies"] * r["size"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 2 for s in taken)
    again = mixing.mix(docs(spark, texts, sources).repartition(5)).collect()
    assert sorted((r["doc_id"], r["copies"]) for r in first) == sorted((r["doc_id"], r["copies"]) for r in again)
    same = mixing.mix(spark.createDataFrame([(1, "a b", "s")] * 9 + [(2, "a b", "t")], "doc_id long, text string, source string"))
    assert same.agg(F.sum(F.col("copies") * 2)).first()[0] <= 40
    assert mixing.mix(docs(spark, ["x"]).limit(0)).count() == 0
    assert mixing.water_fill([10, 100], [3, 1], 165, 2) == [20, 145]
    with pytest.raises(ValueError):
        mixing.mix(docs(spark, ["x"]).withColumn("Size", F.lit(1)))
    # distinct lengths: short and long ones are taken alike
    lengths = np.arange(1, 1001)
    take = mixing.fit(lengths, np.ones(1000, np.int64), 250_000)
    assert int((take * lengths).sum()) == 250_000 and 0.4 < take[:500].mean() < 0.6 and 0.4 < take[500:].mean() < 0.6


def test_mix_expands_copies(spark):
    frame = docs(spark, ["w " * (i % 5) for i in range(30)], ["ab"[i % 2] for i in range(30)])
    mixed = mixing.mix(frame)
    out = mixing.expand(mixed)
    assert out.columns == frame.columns
    want = {r["doc_id"]: r["copies"] for r in mixed.collect() if r["copies"]}
    assert {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()} == want


def test_top_k_is_exact(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 5)  # several blocks of queries and candidates
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=12)]) for i in range(400)] + [(400, None), (401, [1.0, None] + [0.0] * 10), (402, [float("nan")] * 12), (403, [1.0, 2.0]), (500, [0.0] * 12), (501, [0.0] * 12)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, k=5, chunk=8).collect()
    fine = {i: np.floor(1024 * np.float32(v).astype(float)).astype(int) for i, v in rows if v and len(v) == 12 and all(x is not None and np.isfinite(x) for x in v)}
    want = set()
    for q in (i for i in fine if i % 20 == 0):
        best = sorted(((-int(fine[q] @ fine[i]), i) for i in fine if i != q))[:5]
        want |= {(q, n, i, -s) for n, (s, i) in enumerate(best, 1)}
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got} == want
    few = spark.createDataFrame([(0, [1.0]), (1, [1.0]), (1, [1.0]), (None, [9.0]), (2, [0.5])], "vec_id long, embedding array<float>")
    got = topk.top_k(few, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(1, 1024 * 1024), (1, 1024 * 1024), (2, 1024 * 512)]
    assert topk.top_k(few.limit(0), F.col("vec_id") == 0).count() == 0


def test_bpe_equals_the_library_and_round_trips(spark, monkeypatch):
    texts = ODD + ["x's ''s 12½\u0085z\n\n\nq  ", "\U0001fae8 \U00011f02 b", "tail  ", "\0 \x1c"]
    frame = docs(spark, texts).repartition(3)
    both = bpe.decode(bpe.encode(frame, stable=False)).collect()
    enc = bpe._encoding(bpe.public_tokenizers.path(bpe.RANKS))
    assert len(both) == len(texts)
    for r in both:
        t = texts[r["doc_id"]] or ""
        assert np.frombuffer(r["token_ids"], "<u4").tolist() == enc.encode_ordinary(t) and r["n_tokens"] == len(enc.encode_ordinary(t))
        assert bytes(r["decoded"]).decode() == t
    assert bpe.encode(docs(spark, ["x"]).limit(0), stable=False).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(frame.withColumn("n_tokens", F.lit(1)), keep=("doc_id", "n_tokens"))


def test_bpe_of_files_and_its_ids_as_token_output(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_TOKENS", 40)
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    texts = [*ODD, "some words that come again and again", *["some words that come again and again"] * 4]
    docs(spark, texts).coalesce(1).write.parquet(f"{tmp_path}/one")
    docs(spark, texts).coalesce(1).write.mode("append").parquet(f"{tmp_path}/one")  # two equal files
    encoded = bpe.encode(spark.read.parquet(f"{tmp_path}/one"))
    enc = bpe._encoding(bpe.public_tokenizers.path(bpe.RANKS))
    rows = encoded.collect()
    assert len(rows) == 2 * len(texts)
    assert all(np.frombuffer(r["token_ids"], "<u4").tolist() == enc.encode_ordinary(texts[r["doc_id"]] or "") for r in rows)
    encoded.dropDuplicates(["doc_id"]).write.parquet(f"{tmp_path}/ids")
    made, total = tokenout.sequences(spark.read.parquet(f"{tmp_path}/ids"), "token_ids", length=8, stride=16)
    tokenout.write(spark, made, total, f"{tmp_path}/out", parts=3, stride=16)
    whole = {}
    for r in sorted(tokenout.resume(spark, f"{tmp_path}/out", 0, 16).collect(), key=lambda r: (r["doc_id"], r["chunk"])):
        whole.setdefault(r["doc_id"], []).extend(np.frombuffer(r["ids"], "<u4")[: r["n_tokens"]].tolist())
    assert whole == {i: [*enc.encode_ordinary(t or ""), 2**32 - 2] for i, t in enumerate(texts)}


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(5)
    counts = np.array([1, 0, 4, 6, 3])
    scores = rng.normal(scale=3, size=(counts.sum(), 3))
    got, at = langid.viterbi(scores, counts, 2.0), 0
    for n in counts:
        s, mine = scores[at : at + n], got[at : at + n]
        value = lambda p: sum(s[i, x] for i, x in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:], strict=False))  # noqa: E731, B023
        assert value(tuple(mine)) == pytest.approx(max((value(p) for p in np.ndindex(*(3,) * n)), default=0))
        at += n


def test_language_and_spans(spark):
    en, fr = "the house and the garden with them there ", "les maisons où nous étions après cela été "
    rows = [(i, (en if i % 2 else fr) * 5, "en" if i % 2 else "fr") for i in range(60)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = [(0, en * 3), (1, fr * 3), (2, None), (3, "12 !"), (4, " " + en * 2 + fr * 3)]
    got = {r["id"]: r for r in langid.predict(spark.createDataFrame(asked, "id long, text string"), model, spans=True).collect()}
    assert [got[i]["lang_pred"] for i in range(5)] == ["en", "fr", "und", "und", "fr"]
    assert [(s["start"], s["end"], s["lang"]) for s in got[4]["spans"]] == [(0, 16, "en"), (16, 40, "fr")]
    marks = langid.predict(spark.createDataFrame([(0, "\u0301\u0308 \u0301"), (1, "\u0301 " + en)], "id long, text string"), model).orderBy("id").collect()
    assert [(r["lang_pred"], r["score"]) for r in marks] == [("und", 0.0), ("en", 1.0)]
    assert langid.predict(spark.createDataFrame([], "id long, text string"), model).count() == 0
    with pytest.raises(ValueError):
        langid.predict(spark.createDataFrame([], "id long, text string, Score int"), model)
    many = langid.viterbi(np.eye(200)[[150] * 4 + [190] * 4] * 9.0, np.array([8]), 1.0)
    assert many.tolist() == [150] * 4 + [190] * 4
    none = langid.train(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert langid.predict(spark.createDataFrame(asked, "id long, text string"), none).first()["lang_pred"] == "und"


def test_feistel_is_a_permutation_and_shards_resume(spark, tmp_path):
    for n in (1, 2, 3, 1000, 4097):
        assert sorted(tokenout.feistel(np.arange(n), n).tolist()) == list(range(n))
    texts = ["abc" * i for i in range(40)] + [None, ""]
    made, total = tokenout.sequences(docs(spark, texts), length=16, stride=10, stable=False)
    tokenout.write(spark, made, total, str(tmp_path / "t"), parts=4, stride=10)
    rows = tokenout.resume(spark, str(tmp_path / "t"), 0, 10).orderBy("slot").collect()
    assert [r["slot"] for r in rows] == list(range(len(rows)))
    whole = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["chunk"])):
        whole.setdefault(r["doc_id"], []).extend(np.frombuffer(r["ids"], "<u2")[: r["n_tokens"]].tolist())
    assert all(whole[i] == [*(t or "").encode(), tokenout.END] for i, t in enumerate(texts))
    assert tokenout.resume(spark, str(tmp_path / "t"), 25, 10).count() == len(rows) - 25
    none, n = tokenout.sequences(docs(spark, ["x"]).limit(0), stable=False)
    assert n == 0 and none.count() == 0
    with pytest.raises(ValueError):
        tokenout.sequences(docs(spark, ["x"]).withColumnRenamed("doc_id", "slot"), key="slot")


def test_slots_of_a_file_whose_rows_are_all_in_one_partition(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenout, "BATCH", 7)
    monkeypatch.setattr(tokenout, "SLICE", 100)
    texts = ["abc" * (i % 40) for i in range(3000)] + [None, "long " * 3000]
    docs(spark, texts).coalesce(1).write.option("compression", "none").parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")  # one row group is read by one of many tasks
    try:
        for stable in (True, False):
            made, total = tokenout.sequences(spark.read.parquet(f"{tmp_path}/in"), length=32, stride=50, stable=stable)
            out = f"{tmp_path}/out{stable}"
            tokenout.write(spark, made, total, out, parts=5, stride=50)
            rows = spark.read.parquet(out).select("slot", "doc_id", "n_tokens").collect()
            assert sorted(r["slot"] for r in rows) == list(range(total))
            assert sum(r["n_tokens"] for r in rows) == sum(len(t or "") + 1 for t in texts)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_near_duplicates_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL", 3)  # so that small groups take the way of large ones
    monkeypatch.setattr(neardup, "REPS", 1)
    monkeypatch.setattr(neardup, "BLOCK", 2)
    monkeypatch.setattr(neardup, "PART", 2)
    monkeypatch.setattr(neardup, "NEIGHBOURS", 4)
    monkeypatch.setattr(neardup, "SAMPLE", 2)  # so that some keys are hot
    monkeypatch.setattr(neardup, "SEEN", 3)
    rng = random.Random(6)
    base = [f"w{i}" for i in range(60)]
    texts = list(ODD) + ["One", "w1  W2", "w1 w2"]
    for _ in range(60):
        x = list(base)
        for j in rng.sample(range(60), rng.randint(0, 5)):
            x[j] = f"n{rng.random()}"
        texts.append(" ".join(x))
    got = {r["doc_id"]: r for r in neardup.group(docs(spark, texts), k=2).collect()}
    sets = []
    for t in texts:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(set(zip(w, w[1:], strict=False)) if len(w) > 1 else {tuple(w)} if w else set())
    comp = list(range(len(texts)))
    for _ in texts:
        for a in range(len(texts)):
            for b in range(a):
                i = len(sets[a] & sets[b])
                if i and 100 * i >= 80 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    assert [got[i]["component_id"] for i in range(len(texts))] == comp
    assert [got[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]
    assert all(got[i]["kept"] == (comp[i] == i) for i in got)
    assert neardup.group(docs(spark, ["x"]).limit(0), k=2).count() == 0
    with pytest.raises(ValueError):
        neardup.group(docs(spark, ["x"]).withColumn("Kept", F.lit(1)))
    twice = neardup.group(spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "a b c"), (None, "a b c")], "doc_id long, text string"), k=2).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in twice) == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False)]


def test_scratch_tables_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}")
    with common.tidied(spark) as outer:
        with common.tidied(spark) as kept:
            b = kept(common.cut_lineage(spark.range(3)))
            assert len(list(tmp_path.iterdir())) == 2
        assert b.count() == 3 and len(list(tmp_path.iterdir())) == 1
        c = outer(b)
    assert c.count() == 3 and len(list(tmp_path.iterdir())) == 1


def test_pairs_whose_sketches_agree_but_not_their_hashes_are_met():
    width, groups, place = 2 * neardup.GROUPS * neardup.MINIMA, neardup.GROUPS, 1
    same = list(range(2 * groups))
    other = [-1 if g in (0, groups) else g for g in same]  # the first groups agree in bytes only
    row = {"key": 1, "place": place, "n": 10, "sketch": bytes(width), "lo": 0, "hi": 0, "block": 0}
    batch = pa.RecordBatch.from_pylist([row | {"doc": 1, "comp": 1, "keys": same}, row | {"doc": 2, "comp": 2, "keys": other}])
    got = [(r["a"], r["b"]) for out in neardup._across(80)(iter([batch])) for r in out.to_pylist()]
    assert got == [(1, 2)]
    batch = pa.RecordBatch.from_pylist([row | {"doc": d, "comp": d, "keys": same} for d in (1, 2)])
    assert not [r for out in neardup._across(80)(iter([batch])) for r in out.to_pylist()]  # met at place 0
    two = [row | {"doc": d, "comp": d, "keys": other if d > 1 else same, "hi": 1, "block": d // 3} for d in (1, 2, 3)]
    got = [(r["a"], r["b"]) for out in neardup._across(80)(iter([pa.RecordBatch.from_pylist(two)])) for r in out.to_pylist()]
    assert got == [(1, 3)]  # 1 and 2 are of one block, 2 and 3 agree at place 0


def test_nodes_against_components_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 2)  # several blocks and chunks a component
    rng = random.Random(7)
    texts = [" ".join(rng.choice("abcde") for _ in range(rng.randint(2, 9))) for _ in range(60)]
    frame = docs(spark, texts).select(F.col("doc_id").alias("doc"), "text")
    comps = spark.createDataFrame([(i, i % 3) for i in range(30)], "doc long, comp long")
    asked = [(d, c) for d in range(30, 60) for c in (0, 1, 2, 59) if (d + c) % 4] + [(30, 1)]
    got = neardup.against_components(spark.createDataFrame(asked, "doc long, comp long"), comps, frame, 2, 50).collect()
    sets = [set(zip(w, w[1:], strict=False)) for w in map(str.split, texts)]
    alike = lambda a, b: 100 * len(sets[a] & sets[b]) >= 50 * len(sets[a] | sets[b])
    want = {(min(d, m), max(d, m)) for d, c in asked for m in ([59] if c == 59 else range(c, 30, 3)) if d != m and alike(d, m)}
    assert want and {(r["a"], r["b"]) for r in got} == want
