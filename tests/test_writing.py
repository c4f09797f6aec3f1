"""Texts of briefs and tasks; links, types and identities of pages; robots rules within a row."""

import json

from pyspark.sql import functions as F

from crawlsight.operators import compare, identity, linked_data, robots, signals, writing


def test_brief_texts(spark):
    rows = [
        ("a.com", 1, "what is a  pump?", "lost", "extend", "https://a.com/p", ["pump"], "comparison", 0.5, ["what"], "https://r.com/x", 0.755), ("a.com", 2, "how " + "very " * 20 + "long!", "missing", "write", "https://a.com/h", [], None, None, None, None, None),
        ("b.com", 1, 'say "hi"', "weak", "extend", "https://b.com/s", ["say"], "other", 0.4, [], None, None),
    ]
    briefs = spark.createDataFrame(rows, "host string, rank int, query string, reason string, action string, target string, missing_terms array<string>, type string, coverage double, matched array<string>, rival_url string, rival_coverage double")
    known = spark.createDataFrame([("a.com", "Acme", "Pumps.")], "host string, brand string, description string")
    a, b, c = writing.brief_texts(briefs, known).orderBy("host", "rank").collect()
    assert (a.title, len(a.outline), a.outline[1]) == ("What is a pump", 6, "Whom Acme suits better, and whom the other")
    assert len(b.title) <= 60 and b.title.endswith("very…") and b.outline[0] == f"Heading: {b.title}" and len(b.outline) == 5
    data = json.loads(c.schema)
    assert data["mainEntity"][0]["name"] == 'Say "hi"?' and "b.com" in data["mainEntity"][0]["acceptedAnswer"]["text"] and json.loads(a.schema)["@type"] == "FAQPage"
    assert a.markdown.startswith("## Extend: What is a pump\n\nQuestion: what is a  pump?\nPage: https://a.com/p\nFound: another site comes first: https://r.com/x has 76 % of the words, this one 50 %\nMust cover: pump\nHas: what\n\n### Outline\n- Heading: What is a pump")
    assert "Found: no page has enough of the words\nMust cover: the question as it is asked\n\n### Outline" in b.markdown
    bare = writing.brief_texts(briefs.drop("type", "coverage", "matched", "rival_url", "rival_coverage"), known)
    assert bare.columns == ["host", "rank", "query", "reason", "action", "target", "missing_terms", "title", "outline", "schema", "markdown"]
    board = spark.createDataFrame([("a.com", None, 20.0, 40.0, 50, "F"), ("a.com", "content", 7.5, 10.0, 75, None), ("a.com", "access", None, None, None, None)], "host string, layer string, earned double, possible double, score int, grade string")
    tasks = spark.createDataFrame([("a.com", 2, "h1", 0.0, None), ("a.com", 1, "titles", 12.5, "Give titles.")], "host string, rank int, action string, points double, fix string")
    lines = writing.fix_lines(known, board, tasks, writing.brief_texts(briefs, known).where("host = 'a.com'"))
    text, tokens = writing.fix_briefs(lines).where("host = 'a.com'").select("text", "tokens").first()
    assert text.startswith("# Make a.com visible in AI answers\nReaders of all kinds should be able to reach, read and rightly describe Acme.\nWhat it is: Pumps.\nReadiness: 50 of 100, grade F\n- content: 7.5 of 10\n## 1. titles (+12.5 points)\nGive titles.\n## 2. h1\n### Extend: What is a pump")
    assert "\n#### Outline\n" in text and text.endswith("Measure again afterwards.") and tokens == -(-len(text) // 4)


def test_links_types_and_identity(spark):
    html = (
        '<meta property="og:site_name" content="Site"><meta property="og:image" content="/logo.png"><meta property="og:description" content="About it"><a href="/x#a">x</a><a href="/x">x</a><a href="https://www.linkedin.com/acme/">l</a>'
        '<a href="https://linkedin.com/acme">l</a><a href="mailto:a@b.c">m</a><a href="https://other.org/">o</a><a href="https://www.a.com/y">y</a>'
        '<script type="application/ld+json">{"@context": {"@type": "Hidden"}, "@graph": [{"@type": ["Organization", "Brand"], "name": "Acme Ltd"}, {"a": {"b": {"c": {"d": {"e": {"@type": "Deep"}}}}}}], "author": {"@type": "Person", "name": "\\"@type\\":\\"Fake\\""}}</script>'
    )
    pages = spark.createDataFrame([(1, "https://a.com/", html), (2, "https://b.com/", "<title>Bee | Home of bees</title>"), (3, "https://c.com/", None)], "page_id long, url string, html string")
    sig = signals.page_signals(pages)
    got = {r.page_id: r for r in signals.page_links(sig).collect()}
    assert got[1].internal == ["https://a.com/x", "https://www.a.com/y"] and got[1].social == ["https://www.linkedin.com/acme", "https://linkedin.com/acme"] and got[3].internal == []
    assert {r.page_id: set(r.jsonld_types) for r in sig.collect()} == {1: {"Organization", "Brand", "Person"}, 2: set(), 3: set()}
    names = linked_data.organisation_names(linked_data.nodes(pages))
    who = {r.host: r for r in identity.host_identity(sig, names=names).collect()}
    assert (who["a.com"].brand, who["a.com"].description, who["a.com"].logo, who["a.com"].facts) == ("Acme Ltd", "About it", "https://a.com/logo.png", []) and who["b.com"].brand == "Bee" and who["c.com"].brand == "c.com"
    assert {r.host: r.brand for r in identity.host_identity(sig).collect()}["a.com"] == "Site"
    profile = spark.createDataFrame([("a.com", "Own", ["fact"])], "host string, brand string, facts array<string>")
    own = identity.host_identity(sig, profile, names).where("host = 'a.com'").first()
    assert (own.brand, own.description, own.facts, own.category) == ("Own", "About it", ["fact"], "")
    ready = spark.createDataFrame([("a.com", 60, "D")], "host string, score int, grade string")
    cited = spark.createDataFrame([("a.com", 50, 2)], "host string, score int, liftable int")
    reach, files = spark.createDataFrame([("a.com", 7)], "host string, search_reach int"), spark.createDataFrame([("a.com", "llms", 200), ("a.com", "robots", 200), ("b.com", "llms", None)], "host string, kind string, status int")
    hosts = spark.createDataFrame([("a.com",), ("b.com",), ("gone.com",)], "host string")
    columns = {r.host: (r.measured, r.reach, r.llms_txt, r.schema_types) for r in compare.site_columns(hosts, sig, ready, cited, reach, files).collect()}
    assert columns == {"a.com": (True, 7, True, ["Brand", "Organization", "Person"]), "b.com": (True, None, False, []), "gone.com": (False, None, False, None)}


def test_robots_rules_meet_pages_in_their_row(spark):
    files = spark.createDataFrame([("a", "User-agent: *\nDisallow: /\nAllow: /open\n\nUser-agent: GPTBot\nUser-agent: bingbot\nDisallow: /x*.pdf$\nAllow: /x/\n"), ("b", "User-agent: gptbot\nDisallow:\n"), ("c", None)], "host string, body string")
    bots = spark.createDataFrame([("GPTBot",), ("Bingbot",), ("Other",), ("Other",), (None,)], "token string")
    pages = spark.createDataFrame([(1, "a", "/x/a.pdf"), (2, "a", "/xy.pdf"), (3, "a", "/xy.pdf?"), (4, "a", "/open/1"), (5, "b", "/"), (6, "none", "/"), (7, "c", "/")], "page_id int, host string, path string")
    rules = robots.robots_rules(files)
    got = {(r.page_id, r.token): r.allowed for r in robots.robots_verdict(pages, rules, bots).collect()}
    refused = {k for k, allowed in got.items() if not allowed}
    assert len(got) == 21 and refused == {(1, "GPTBot"), (1, "Bingbot"), (2, "GPTBot"), (2, "Bingbot"), (1, "Other"), (2, "Other"), (3, "Other")}
    assert robots.robots_verdict(pages, rules, bots.where(F.lit(False))).count() == 0
    assert "CartesianProduct" not in robots.robots_verdict(pages, rules, bots)._jdf.queryExecution().toString()
