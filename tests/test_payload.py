import json

from pyspark.sql import functions as F

from pagemill.operators import entries as EN
from pagemill.sources import payload as P


def doc(text):
    return {"type": "doc", "content": [{"type": "paragraph", "content": [{"type": "text", "text": text}]}]}


def test_sites_of_json_files_make_entries(spark, tmp_path):
    inner = {"id": "b", "component": "Box", "content": doc("inner words")}
    first = {"id": "a", "stableId": "top", "params": {"title": "First"}, "subsections": [inner, 7]}
    site = {"config": {"url": "https://a.org", "z": 1, "b": 2}, "more": 1, "pages": [
        {"route": "/", "title": "Home", "sections": [first]}, {"route": "/x", "title": "X", "hidden": True, "seo": {"noindex": True}, "hasContent": False}]}
    for name, value in (("one/en", json.dumps(site)), ("one/fr", json.dumps({"pages": []})), ("two/en", "no json")):
        file = tmp_path / f"{name}.json"
        file.parent.mkdir(exist_ok=True)
        file.write_text(value)
    sites, pages, sections = P.read_sites(spark, str(tmp_path))
    assert {(r["site_id"], r["locale"]): r["config"] and list(json.loads(r["config"])) for r in sites.where("config is not null").collect()} == {("one", "en"): ["url", "z", "b"]}
    got = pages.orderBy("ord").collect()
    assert [(r["locale"], r["route"], r["hidden"], r["noindex"], r["has_content"]) for r in got] == [("en", "/", None, None, None), ("en", "/x", True, True, False)]
    rows = sections.orderBy(F.size("path")).collect()
    assert [(r["path"], r["section_id"], r["anchor"], r["component"], r["param_title"]) for r in rows] == [([1], "a", "section-top", None, "First"), ([1, 1], "b", "section-b", "Box", None)]
    found = EN.extract(pages.drop("locale"), sections.drop("locale")).orderBy("type", F.size("path")).collect()
    assert [(r["id"], r["title"], r["content"]) for r in found] == [("page:/", "Home", "Home"), ("section:/:a", "First", ""), ("section:/:b", "", "inner words")]


def test_texts_come_back_as_they_were(spark, tmp_path):
    texts = [("s", "llms.txt", "# T\n\nline\n"), ("s", "robots.txt", ""), ("t", "a b.xml", "<x/>"), ("t", "none.txt", None)]
    P.write_texts(spark.createDataFrame(texts, "site_id string, file string, text string"), f"{tmp_path}/out")
    got = {(r["site_id"], r["file"]): r["text"] for r in P.read_texts(spark, f"{tmp_path}/out").collect()}
    assert got == {(s, f): t or "" for s, f, t in texts}
