"""Page reports, and the crawl documents they may come from."""

import json

import pytest
from pyspark.sql import functions as F

from crawlsight.operators import citability, linked_data, pages, retrieval, signals
from crawlsight.sources.tables import read_crawl_json


def test_question_match(spark):
    index = retrieval.postings(spark.createDataFrame(
        [(1, "a.test", "Pricing plans", "", "", "the team plan costs little"), (2, "a.test", "", "", "", "")], "page_id int, host string, title string, description string, headings string, text string"
    ))
    asked = spark.createDataFrame([(7, "team pricing plan"), (8, "pricing refund window days"), (9, "the")], "query_id int, query string")
    pairs = spark.createDataFrame([(1, 7), (1, 8), (2, 7), (1, 9), (3, 7)], "page_id int, query_id int")
    got = {(r.page_id, r.query_id): r for r in pages.page_question_match(pairs, asked, index).collect()}
    assert got[1, 7].status == "answered" and got[1, 7].coverage == 1.0 and got[1, 7].missing_terms == []
    assert got[1, 8].status == "missing" and got[1, 8].missing_terms == ["refund", "window", "days"]
    assert (got[2, 7].status, got[2, 7].score, got[2, 7].missing_terms) == ("missing", 0.0, ["team", "pricing", "plan"])
    assert got[3, 7].status == got[1, 9].status == "missing" and len(got) == 5
    alone = retrieval.postings(spark.createDataFrame([(1, "a.test", "Pricing plans", "", "", "the team plan costs little")], "page_id int, host string, title string, description string, headings string, text string"))
    assert got[1, 7].score == retrieval.rank_pages(asked.where("query_id = 7"), alone).first().score


def test_findings(spark):
    words = " ".join(["word"] * 300)
    data = json.dumps({"@type": "Organization", "name": "Acme", "url": "/"})
    rows = [
        (1, "https://a.test/", f'<title>T</title><meta name=description content="d"><link rel=canonical href="https://b.test/"><meta name=robots content="max-snippet:20">'
            f'<script type="application/ld+json">{data}</script><script type="application/ld+json">{{</script><p data-nosnippet>{words}</p>', 200),
        (2, "https://a.test/x", '<meta name="robots" content="noindex, nosnippet"><div id="root"></div>', 404), (3, "https://a.test/n", None, None),
    ]
    source = spark.createDataFrame(rows, "page_id int, url string, html string, status int")
    sig = signals.page_signals(source).join(source.select("page_id", "status"), "page_id")
    crawlers = spark.createDataFrame([(1, "OAI-SearchBot", False), (1, "GPTBot", False), (2, "OAI-SearchBot", True)], "page_id int, token string, reaches boolean")
    match = spark.createDataFrame([(1, "weak", 0.5, ["refund"]), (2, "missing", 0.0, ["x"])], "page_id int, status string, coverage double, missing_terms array<string>")
    report = pages.page_report(sig, linked_data.node_checks(linked_data.nodes(source)), citability.page_citability(sig), crawlers, match)
    got = {}
    for r in pages.page_findings(report).orderBy("page_id", "rank").collect():
        got.setdefault(r.page_id, []).append((r.severity, r.code, r.detail))
    assert got[1][:2] == [("high", "crawlers-kept-out", "OAI-SearchBot"), ("high", "max-snippet", "20")]
    assert got[1][2:] == [
        ("medium", "canonical-elsewhere", ""), ("medium", "faulty-node", 'Organization Acme: url is not absolute: "/".'), ("medium", "jsonld-errors", "1"),
        ("medium", "question", "refund"), ("medium", "citability", got[1][6][2]), ("low", "data-nosnippet", "1"),
    ]
    assert [c for _, c, _ in got[2]] == ["status", "noindex", "app-shell", "nosnippet", "question", "no-title", "no-description", "no-structured-data"]
    assert [c for _, c, _ in got[3]] == ["no-title", "citability", "no-description", "no-structured-data"]
    bare = pages.page_report(sig.drop("status"), linked_data.node_checks(linked_data.nodes(source)), citability.page_citability(sig))
    assert "question" not in {r.code for r in pages.page_findings(bare).collect()} and bare.count() == 3


def test_crawl_documents(spark, tmp_path):
    page = {"id": "p", "url": "https://a.test/", "status": 200, "title": "T", "headings": [{"level": 1, "text": "H"}], "links": ["https://a.test/b"], "jsonLd": [{"@type": "Person"}], "extra": 1}
    one = {"target": "https://a.test/", "startedAt": "s", "completedAt": "c", "pages": [page, {"url": "https://a.test/b"}], "crawlEdges": [{"from": "https://a.test/", "to": "https://a.test/b"}], "warnings": []}
    two = {"target": "https://b.test/", "failures": [{"url": "https://b.test/", "error": "timeout"}]}
    for name, text in (("one", json.dumps(one, indent=1)), ("two", json.dumps(two)), ("bad", "{broken"), ("other", "{}")):
        (tmp_path / f"{name}.json").write_text(text)
    t = read_crawl_json(spark, str(tmp_path))
    rows = {r.url: r for r in t["pages"].collect()}
    assert rows["https://a.test/"].headings[0].text == "H" and json.loads(rows["https://a.test/"].jsonld) == [{"@type": "Person"}]
    assert (rows["https://a.test/b"].status, rows["https://a.test/b"].title, rows["https://a.test/b"].links) == (0, "", None)
    assert {k: v.count() for k, v in t.items()} == {"runs": 2, "pages": 2, "edges": 1, "failures": 1, "rejected": 2}
