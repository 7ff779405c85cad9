import pytest
from pyspark.sql import functions as F

from pagemill.functions import text as X
from pagemill.operators import results as RS
from pagemill.operators import search as SE

PRICING = [(0, "Pricing", "acme pricing for every team size", 0.8), (1, "About", "acme pricing is mentioned here in passing only", 0.8), (2, "Contact", "write to acme support", 0.8)]


def entries(spark, rows):
    return spark.createDataFrame(rows, "doc long, title string, content string, weight double")


def ranked(spark, rows, text, **options):
    queries = spark.createDataFrame([(1, text)], "qid long, text string")
    return [r["doc"] for r in SE.rank(SE.build(entries(spark, rows)), queries, **options).orderBy("rank").collect()]


def test_fold_and_terms(spark):
    rows = [("Café",), ("東京都",), ("京",), ("iPhone用",), ("ＡＣＭＥ",), ("ﬁle",), ("한국어 검색",), ("a 7",), (None,)]
    got = [r["t"] for r in spark.createDataFrame(rows, "x string").select(X.fold("x").alias("f")).select(X.terms(F.col("f")).alias("t")).collect()]
    assert got == [["cafe"], ["東京", "京都"], ["京"], ["iphone", "用"], ["acme"], ["file"], ["한국어", "검색"], ["7"], []]


def test_ranks_title_over_body_and_rare_over_common(spark):
    assert ranked(spark, PRICING, "pricing", prefix=False) == [0, 1]
    assert len(ranked(spark, PRICING, "acme", prefix=False)) == 3
    assert ranked(spark, PRICING, "nothing") == []
    assert ranked(spark, PRICING, "") == []


def test_scores_match_formula(spark):
    queries = spark.createDataFrame([(1, "solo")], "qid long, text string")
    rows = [(0, "solo", "one two three four", 1.0), (1, "x1", "solo five six seven", 1.0)]
    got = SE.rank(SE.build(entries(spark, rows)), queries, prefix=False).orderBy("rank").collect()
    import math

    idf = math.log(1 + 0.5 / 2.5)
    assert got[0]["score"] == pytest.approx(idf * 3 * 2.2 / 4.2, abs=1e-6)
    assert got[1]["score"] == pytest.approx(idf * 1 * 2.2 / 2.2, abs=1e-6)


def test_prefix_fuzzy_and_phrase(spark):
    rows = [(0, "t", "zebra crossing", 0.6), (1, "t", "inset captions", 0.6), (2, "t", "beta something gamma", 0.6), (3, "t", "some beta gamma thing", 0.6)]
    assert ranked(spark, rows, "zeb") == [0]
    assert ranked(spark, rows, "zeb ") == []
    assert ranked(spark, rows, "z") == []
    assert ranked(spark, rows, "insef") == [1]
    assert ranked(spark, rows, "insef", fuzzy=False) == []
    assert ranked(spark, rows, "beta gamma")[0] == 3


def test_top_k_is_a_prefix_of_longer_lists_and_ties_go_by_document(spark):
    rows = [(i, "t", "word " * (i % 7 + 1) + "filler", 0.6) for i in range(60)]
    assert ranked(spark, rows, "word", limit=5) == ranked(spark, rows, "word", limit=20)[:5]
    assert ranked(spark, [(i, "t", "same text", 0.6) for i in range(30)], "same", limit=5) == [0, 1, 2, 3, 4]


def test_one_edit(spark):
    rows = [("form", "fomr", True), ("form", "for", True), ("form", "forms", True), ("form", "fxrm", True), ("form", "mrof", False), ("form", "formss", False), ("ab", "ba", True)]
    got = spark.createDataFrame(rows, "a string, b string, want boolean").select(X.within_one_edit(F.col("a"), F.col("b")).alias("g"), "want").collect()
    assert all(r["g"] == r["want"] for r in got)


def test_highlights():
    assert RS.match_ranges("Un Café ici", ["cafe"]) == [[3, 6]]
    assert RS.match_ranges("Café!", ["cafe"]) == [[0, 4]]
    assert RS.match_ranges("abab", ["ab"]) == [[0, 3]]
    assert RS.highlight("a <b> c", [[2, 4]]) == "a <mark>&lt;b&gt;</mark> c"
    text, ranges = RS.snippet("x" * 100 + " needle " + "y" * 100, [[101, 106]])
    assert text.startswith("…") and text.endswith("…") and text[ranges[0][0] : ranges[0][1] + 1] == "needle"
    assert RS.snippet("short", []) == ("short", [])


def test_result_has_all_fields(spark):
    rows = entries(spark, PRICING)
    queries = spark.createDataFrame([(1, "pricing")], "qid long, text string")
    out = RS.results(SE.rank(SE.build(rows), queries), rows, SE.query_terms(queries))
    assert set(RS.FIELDS) <= set(out.columns)
    assert out.where("rank = 1").first()["snippetHtml"].count("<mark>") == 1


def test_results_are_marked_by_the_terms_that_scored(spark):
    rows = entries(spark, [(0, "t", "zebra crossing zeb", 0.6), (1, "t", "x " * 100 + "inset captions", 0.6)])
    queries = spark.createDataFrame([(1, "zeb"), (2, "insef"), (3, "qqqq")], "qid long, text string")
    index = SE.build(rows)
    scored = SE.scored_terms(index, queries)
    got = {r["qid"]: (r["terms"], r["corrections"] and [tuple(c) for c in r["corrections"]]) for r in scored.collect()}
    assert got == {1: (["zeb", "zebra"], None), 2: (["inset"], [("insef", "inset")])}
    out = {r["qid"]: r for r in RS.results(SE.rank(index, queries), rows, scored.withColumnRenamed("terms", "tokens")).collect()}
    assert [(m["key"], m["indices"]) for m in out[1]["matches"]] == [("content", [[0, 4], [15, 17]])]
    assert out[2]["matches"][0]["indices"] == [[200, 204]] and "<mark>inset</mark>" in out[2]["snippetHtml"] and "<mark>" not in out[2]["snippetText"]


def test_returned_terms_keep_the_order_of_the_query(spark):
    rows = entries(spark, [(0, "t", "zulu alpha beta betas betty", 0.6), (1, "t", "alpha betty inset inlet", 0.6), (2, "t", "inlet sinks", 0.6)])
    queries = spark.createDataFrame([(1, "zulu alpha zulu bet"), (2, "sinkz insef zzzz"), (3, "")], "qid long, text string")
    got = {r["qid"]: (r["terms"], r["corrections"] and [tuple(c) for c in r["corrections"]]) for r in SE.scored_terms(SE.build(rows), queries).collect()}
    assert got == {1: (["zulu", "alpha", "betty", "beta", "betas"], None), 2: (["sinks", "inset"], [("sinkz", "sinks"), ("insef", "inset")])}


def test_search_results_query_marks_corrections(spark, tmp_path):
    from pagemill.plans import catalogue

    spark.createDataFrame([(0, "t\n" + "x " * 100 + "inset captions")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "insef")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    (row,) = catalogue.QUERIES["search_results"](spark, str(tmp_path)).collect()
    assert row["qid"] == 7 and "<mark>inset</mark>" in row["snippetHtml"] and len(row["matches"]) == 1


def test_whole_texts_are_ranked_against_brute_force(spark, tmp_path):
    import math

    from pagemill.plans import catalogue

    texts = ["t\nred fox sits by old stone wall", "t\nold stone mill", "t\nwallpaper only", "t\nred red fox", "t\nwall stone old by sits fox red"]
    asked = "red fox sits by old stone wall"
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, asked)], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    words = [[w for w in t.split() if len(w) > 1] for t in texts]
    mean = sum(map(len, words)) / len(words)
    df = {w: sum(w in d for d in words) for d in words for w in d}

    def brute(mult, boost):
        out = []
        for i, d in enumerate(words):
            s = 0.0
            for term, m in mult.items():
                tf = d.count(term) / (0.25 + 0.75 * len(d) / mean)
                s += m * math.log(1 + (len(words) - df[term] + 0.5) / (df[term] + 0.5)) * tf * 2.2 / (tf + 1.2) * 0.6
            if s:
                out.append((i, s * (1.35 if boost and asked in " ".join(texts[i].split()) else 1)))
        return sorted(out, key=lambda x: (-round(x[1], 6), x[0]))

    exact = dict.fromkeys(asked.split(), 1.0)
    run = lambda name: catalogue.QUERIES[name](spark, str(tmp_path)).collect()
    assert sorted((r["term"], r["df"]) for r in run("prefix_completions")) == [("wall", 2), ("wallpaper", 1)]
    for name, want in [("bm25f_batch", brute(exact, False)), ("bm25f_prefix", brute(exact | {"wallpaper": 0.5}, False)), ("phrase_boost_rank", brute(exact, True))]:
        got = sorted(run(name), key=lambda r: r["rank"])
        assert [r["doc"] for r in got] == [i for i, _ in want], name
        assert [r["score"] for r in got] == pytest.approx([s for _, s in want], abs=2e-6)
    # document 1 holds none of the first three words
    assert {r["doc"] for r in run("search_results")} == {0, 1, 2, 3, 4}


def test_stream_of_entries_is_indexed(spark, tmp_path):
    from pagemill.streaming import index_stream

    entries(spark, PRICING).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("doc long, title string, content string, weight double").parquet(f"{tmp_path}/in")
    index_stream(stream, f"{tmp_path}/index").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start().awaitTermination(60)
    index = SE.open_index(spark, f"{tmp_path}/index/batch=0")
    assert index.n == 3 and index.postings.where("term = 'pricing'").count() == 2
