"""Responses as readers get them: files, challenges, sitemaps, Markdown, structure; scores over all checks."""

import random

import pytest
from pyspark.sql import functions as F

from crawlsight.functions import urls
from crawlsight.operators import readiness, responses, signals, structure


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_html_pages_and_file_probes(spark):
    rows = frame(spark, [
        (1, 200, "text/html; charset=utf-8", ""), (2, 404, "text/html", "<html>"), (3, 200, None, "a <HTML lang=en>"), (4, 200, "text/plain", "<html>"), (5, 200, "", "text"), (6, None, "text/html", None),
    ], "id int, status int, content_type string, body string")
    assert {r.id: r.yes for r in rows.select("id", responses.is_html_page(rows).alias("yes")).collect()} == {1: True, 2: False, 3: True, 4: False, 5: False, 6: False}
    files = frame(spark, [
        (1, 200, "text/plain", "User-agent: *"), (2, 200, "text/HTML", "hello"), (3, 200, None, " \n<!DOCTYPE html>"), (4, 500, "text/html", "x"), (5, 200, "text/plain", "say <html>"), (6, None, None, None),
    ], "id int, status int, content_type string, body string")
    got = {r.id: (r.status, r.body) for r in responses.file_probes(files).collect()}
    assert got == {1: (200, "User-agent: *"), 2: (404, ""), 3: (404, ""), 4: (500, ""), 5: (200, "say <html>"), 6: (None, "")}


def test_agent_view(spark):
    words = lambda n: " ".join(f"w{i}" for i in range(n))
    pages = [
        ("page", "text/html", f"<html><head><title> A  b </title></head><body><nav>menu</nav><main><h1>In person</h1><p>{words(500)}</p></main><script>var x</script></body></html>"),
        ("shell", "text/html", '<html><body><div id="root"></div></body></html>'),
        ("scripts", "", "<html><body>few<script src=a></script><script src=b></script><script src=c></script></body></html>"),
        ("challenge", "text/html", "<html><title>Just a moment...</title><body>checking</body></html>"),
        ("long challenge", "text/html", f"<html><body>captcha {words(400)}</body></html>"),
        ("wall", "text/html", f"<html><title>Sign in</title><body>{words(200)}<input class=x type='password'></body></html>"),
        ("shop", "text/html", f"<html><title>Shop</title><body>{words(600)} password<input type=password></body></html>"),
        ("markdown", "text/markdown", "# Title\n\n captcha text"), ("image", "image/png", "xx yy"), ("none", None, None),
    ]
    got = {r.url: r for r in responses.agent_view(frame(spark, pages, "url string, content_type string, body string")).collect()}
    assert (got["page"].title, got["page"].words, got["page"].text[:20]) == ("A b", 503, "In person w0 w1 w2 w")
    assert {u for u, r in got.items() if r.app_shell} == {"shell", "scripts"} and {u for u, r in got.items() if r.challenge} == {"challenge"}
    assert {u for u, r in got.items() if r.login_wall} == {"wall"} and {u for u, r in got.items() if not r.readable} == {"image"}
    assert got["markdown"].text == "# Title captcha text" and (got["none"].text, got["none"].words) == ("", 0)


def test_sitemaps(spark):
    index = lambda *to: "<?xml?><sitemapindex>" + "".join(f"<sitemap><loc> {t} </loc></sitemap>" for t in to) + "</sitemapindex>"
    pages = lambda *to: "<urlset>" + "".join(f"<url><LOC>{t}</LOC></url>" for t in to) + "</urlset>"
    probes = frame(spark, [
        ("a", 1, "a/robots-map", 404, "x"), ("a", 2, "a/sitemap.xml", 200, pages("a/1?x=1&amp;y=2", "<![CDATA[a/2]]>")), ("b", 1, "b/m", 200, "<html>no map"), ("b", 2, "b/n", 404, None),
        ("c", 1, "c/m", None, None), *[("d", i, f"d/{i}", 404, "") for i in range(1, 5)], ("d", 5, "d/5", 200, pages("d/x")), ("e", 1, "e/m", 200, index("e/1")),
    ], "host string, seq int, url string, status int, body string")
    got = {r.host: (r.url, r.status, r.kind) for r in responses.host_sitemaps(probes).collect()}
    assert got == {"a": ("a/sitemap.xml", 200, "pages"), "b": ("b/m", 422, None), "c": ("c/m", None, None), "d": ("d/1", 404, None), "e": ("e/m", 200, "index")}
    assert responses.sitemap_states(probes).where("url = 'a/sitemap.xml'").first().locations == ["a/1?x=1&y=2", "a/2"]
    files = [("r", 200, index("i1", "i2", "gone")), ("i1", 200, index("r", "p1")), ("i2", 200, pages("x2", "x1")), ("p1", 200, pages("x1", "x3")), ("gone", 404, pages("never")),
             ("lone", 200, index("l1", "l2")), ("deep", 200, index("deep1")), ("deep1", 200, index("deep2")), ("deep2", 200, index("p1")), ("loop", 200, index("loop"))]
    roots = [("h", "r"), ("h", "r"), ("k", "lone"), ("m", "deep"), ("n", "loop"), ("o", "nowhere"), ("q", None)]
    read = lambda **x: {(r.host, r.url, r.sitemap, r.level) for r in responses.sitemap_pages(frame(spark, roots, "host string, url string"), frame(spark, files, "url string, status int, body string"), **x).collect()}
    whole = {("h", "x1", "i2", 1), ("h", "x2", "i2", 1), ("h", "x3", "p1", 2), ("k", "l1", "lone", 0), ("k", "l2", "lone", 0), ("n", "loop", "loop", 0)}
    assert read() == whole | {("m", "x1", "p1", 3), ("m", "x3", "p1", 3)}
    assert read(depth=1) == {x for x in whole if x[1] != "x3"} | {("m", "deep1", "deep", 0)}


def test_target_lists(spark):
    lists = frame(spark, [(1, [" https://www.A.com/x ", "a.com", None, "", "b.org/path", "localhost", "http://c.net:8080", "d.io", "e.io"]), (2, []), (3, None), (4, ["two words.com", "HTTP://www.z.dev"])], "list_id int, entries array<string>")
    got = sorted(map(tuple, urls.hosts_of(lists).collect()))
    assert got == [(1, 1, "a.com"), (1, 2, "b.org"), (1, 3, "c.net"), (1, 4, "d.io"), (4, 1, "z.dev")]


def test_links_of_other_schemes_and_queries(spark):
    rows = frame(spark, [("ftp://x.com/f",), ("?q=1",), ("mailto:a@b.c",), ("x?y#z",)], "h string")
    got = [r[0] for r in rows.select(urls.resolve_link(F.lit("https://a.com/d/p?old=1"), F.col("h"))).collect()]
    assert got == ["ftp://x.com/f", "https://a.com/d/p?q=1", None, "https://a.com/d/x?y"]


def test_markdown(spark):
    body = "# Ada Lovelace\n\nAI *engineer* and `creator`.\r\n\n## Not\n###### Six ######\n####### seven\n```python\n# a comment\ncode [x](/code)\n```\n[Atlas](/atlas \"t\") and ![img](i.png) [mail](mailto:a@b.c)\n## \n - item [a](b) [c](https://other.org/#h)"
    rows = frame(spark, [(1, "https://example.com/dir/", body), (2, "https://e.com", None)], "id int, url string, body string")
    one, none = responses.markdown_pages(rows).orderBy("id").collect()
    assert [(h.level, h.text) for h in one.headings] == [(1, "Ada Lovelace"), (6, "Six ######"), (1, "a comment")]
    assert one.paragraphs == ["AI engineer and creator.", "## Not".replace(" ", " "), "####### seven", "code x(/code)", "Atlas(/atlas \"t\") and img(i.png) mail(mailto:a@b.c)", "##", "- item a(b) c(https://other.org/#h)"]
    assert one.links == ["https://example.com/code", "https://example.com/atlas", "https://example.com/dir/i.png", "https://example.com/dir/b", "https://other.org/"]
    assert (one.title, one.description) == ("Ada Lovelace", "AI engineer and creator.") and one.text.startswith("Ada Lovelace Six ###### a comment AI engineer")
    assert (none.title, none.headings, none.links, none.text) == ("", [], [], "") and len(none.fingerprint) == 64


def test_structure_of_nested_elements(spark):
    pages = [
        (1, "<meta name=twitter:card content=' a  b '><meta content='2' name='twitter:card'><meta name='twitter:site'><main><article><p>one</p><article>two</article><p>three &amp; <b>four</b></p></article><time>May</time></main><header></header>"),
        (2, None), (3, "<section>never <p>closed <br> at </div> all"), (4, "<address>" + "x" * 3000 + "</address>" + "<time>t</time>" * 200), (5, "<main>" * 3 + "deep" + "</main>" * 9),
    ]
    got = {r.page_id: r for r in structure.page_structure(frame(spark, pages, "page_id int, html string")).collect()}
    assert [tuple(e) for e in got[1].semantic_elements] == [("main", "one two three & four May"), ("article", "one two three & four"), ("article", "two"), ("time", "May")]
    assert got[1].twitter == {"twitter:card": "2"} and (got[2].semantic_elements, got[2].twitter) == ([], {})
    assert [tuple(e) for e in got[3].semantic_elements] == [("section", "never closed at all")] and [e.text for e in got[5].semantic_elements] == ["deep"] * 3
    assert len(got[4].semantic_elements) == 100 and len(got[4].semantic_elements[0].text) == 2000


def test_signals_read_nested_scopes_and_many_repeated_keys(spark):
    tags = "".join(f'<meta property="og:x{i}" content="{i}">' for i in range(1100))
    pages = [
        (1, "https://a.com/", "<article><p>one</p><article>two</article><p>three</p></article>"), (2, "https://a.com/2", f'<meta property="og:image" content="first">{tags}<meta property="og:image" content="last">'),
        (3, "https://a.com/3", "<main>kept <main>inner</main> too</main> out"), (4, "https://a.com/4", "before <article>never closed"),
    ]
    got = {r.page_id: r for r in signals.page_signals(frame(spark, pages, "page_id int, url string, html string")).collect()}
    assert [got[i].text for i in (1, 3, 4)] == ["one two three", "kept inner too", "never closed"]
    assert got[2].open_graph["og:image"] == "last" and len(got[2].open_graph) == 1101
    r = random.Random(1)
    for _ in range(5):  # the balanced end against a stack
        parts = [r.choice(["<article>", "</article>", "<article id=x>", "a ", "b "]) for _ in range(30)]
        want, depth = "", 0
        for p in parts:
            step = 1 if p.startswith("<a") else -1 if p.startswith("</") else 0
            if depth == 0 and step == 1 and not want:
                depth, want = 1, " "
                continue
            if want and depth > 0:
                depth += step
                want += p if depth > 0 else ""
        got = frame(spark, [("".join(parts),)], "s string").select(signals.first_element(F.col("s"), "article")).first()[0]
        assert got == want[1:]


@pytest.fixture(scope="module")
def site(spark):
    long = " ".join(f"word{i}" for i in range(200))
    page = '<html lang="en"><head><title>{0}</title><meta name="description" content="d"><link rel="canonical" href="https://a.com/"></head><body><h1>{0}</h1><p>' + long + "</p></body></html>"
    rows = [(1, "https://a.com/", page.format("Home")), (2, "https://a.com/b", page.format("B")), (3, "http://b.com/", "")]
    return signals.page_signals(frame(spark, rows, "page_id long, url string, html string"))


def test_all_checks_and_the_board(spark, site):
    orgs = frame(spark, [("a.com", ["name", "url", "logo"], 2)], "host string, core array<string>, same_as int")
    weights = readiness.all_checks(site, orgs, readiness.unknown_access(site.select("host").limit(0)))
    assert weights.where("host = 'a.com'").count() == readiness.ALL_CHECKS == weights.select("check_id").distinct().count()
    assert {r.layer: r.w for r in weights.where("host = 'b.com'").groupBy("layer").agg(F.sum("weight").alias("w")).collect()} == readiness.ALL_WEIGHTS
    known = readiness.unknown_access(frame(spark, [("a.com",), ("zzz.com",)], "host string")).withColumn("status", F.lit("pass")).withColumn("earned", F.col("weight") * 1.0)
    timed = frame(spark, [(1, 1800.0), (1, 1600.0), (3, 9000.0)], "page_id long, ms double")
    rows = readiness.all_checks(site, orgs, known, timed)
    status = {(r.host, r.check_id): r.status for r in rows.collect()}
    assert (status["a.com", "speed"], status["b.com", "speed"], status["a.com", "firewall"], status["b.com", "firewall"], status["a.com", "organization-schema"]) == ("warn", "fail", "pass", "na", "pass")
    assert len(status) == 54  # none of a host that has no pages
    board = {(r.host, r.layer): r for r in readiness.score_board(rows).collect()}
    for host in ("a.com", "b.com"):
        mine = [r for r in rows.collect() if r.host == host and r.status != "na"]
        total, most = sum(r.earned for r in mine), sum(r.weight for r in mine)
        assert (board[host, None].earned, board[host, None].possible, board[host, None].score) == (total, most, int(100 * total / most + 0.5))
        assert sum(board[host, x].earned for x in readiness.ALL_WEIGHTS) == total
    assert board["b.com", None].grade == "F" and board["a.com", "access"].grade is None
    only_na = frame(spark, [("x", "speed", "content", 2, "na", 0.0)], "host string, check_id string, layer string, weight int, status string, earned double")
    assert sorted((r.layer or "", r.score) for r in readiness.score_board(only_na).collect()) == [("", 0), ("content", None)]
