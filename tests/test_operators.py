from pyspark.sql import functions as F

from crawlsight.operators import answers, graph, journeys, retrieval, robots
from crawlsight.sources.tables import history_diff, merged_history

PAGES = [
    (1, "acme.test", "Acme Data | B2B contact data", "Verified contact data for revenue teams.", "Trusted by 400 sales teams", "Acme Data sells verified business contact records to sales teams."),
    (2, "acme.test", "Pricing | Acme Data", "Plans and prices.", "Plans Team Enterprise", "Team is $29 per seat per month. Enterprise pricing is bespoke."),
    (3, "acme.test", "We are hiring | Acme Data", "Open roles.", "Engineering Sales", "We are hiring engineers and account executives in Austin."),
    (4, "rival.test", "Rival vs Acme Data | Rival", "How Rival compares to Acme Data on contact data.", "Rival vs Acme Data", "Rival and Acme Data both sell verified b2b contact data to sales teams."),
]
SCHEMA = "page_id long, host string, title string, description string, headings string, text string"


def ask(spark, question, pages=PAGES):
    q = spark.createDataFrame([(1, question)], "query_id int, query string")
    return retrieval.best_page(q, retrieval.postings(spark.createDataFrame(pages, SCHEMA))).first()


def test_verdicts(spark):
    r = ask(spark, "acme data pricing per seat", PAGES[:3])
    assert (r.page_id, r.status, r.coverage, r.missing_terms) == (2, "answered", 1.0, [])
    r = ask(spark, "b2b contact data gdpr compliance", PAGES[:3])
    assert (r.page_id, r.status, r.missing_terms) == (1, "weak", ["gdpr", "compliance"])
    r = ask(spark, "soc2 penetration testing audit report", PAGES[:3])
    assert (r.page_id, r.status) == (None, "missing")
    assert ask(spark, "what is the best").status == "missing"
    assert ask(spark, "rival vs acme data comparison").page_id == 4


def test_lost_to_rival(spark):
    q = spark.createDataFrame([(1, "rival vs acme data comparison")], "query_id int, query string")
    r = retrieval.compare_to_rivals(q, retrieval.postings(spark.createDataFrame(PAGES, SCHEMA)), "acme.test").first()
    assert r.lost and r.rival.page_id == 4


def allowed(spark, body, path, token="GPTBot"):
    files = spark.createDataFrame([("a.test", body)], "host string, body string")
    bots = spark.createDataFrame([(token,)], "token string")
    pages = spark.createDataFrame([(1, "a.test", path)], "page_id int, host string, path string")
    return robots.robots_verdict(pages, robots.robots_rules(files), bots).first()["allowed"]


def test_robots(spark):
    body = "User-agent: *\nDisallow: /private\nAllow: /private/open\n\nUser-agent: GPTBot\nUser-agent: Other\nCrawl-delay: 2\nDisallow: /x*.pdf$ # no files\nDisallow:\nSitemap: https://a.test/s.xml"
    assert allowed(spark, body, "/private") and not allowed(spark, body, "/private", "Bingbot")
    assert allowed(spark, body, "/private/open/1", "Bingbot")
    assert not allowed(spark, body, "/xa/b.pdf") and allowed(spark, body, "/xa/b.pdf?q")
    assert allowed(spark, "", "/any")
    files = spark.createDataFrame([("a.test", body)], "host string, body string")
    assert [r.url for r in robots.robots_sitemaps(files).collect()] == ["https://a.test/s.xml"]


def test_graph(spark):
    links = spark.createDataFrame([("a.test", f"https://a.test/{p}") for p in ("blog/1", "blog/2", "pricing", "about", "cart", "x.pdf", "deep/a/b/c")], "host string, url string")
    picked = [r.url.rsplit("test/", 1)[1] for r in graph.pick_pages(links).orderBy("pick_no").collect()]
    assert picked[:3] == ["about", "pricing", "blog/1"] and len(picked) == 5
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "from_url string, to_url string")
    got = {r.url: r.depth for r in graph.reachable(edges, spark.createDataFrame([("a",)], "url string")).collect()}
    assert got == {"a": 0, "b": 1, "c": 2}
    docs = spark.createDataFrame([(3, "x"), (1, "x"), (2, None), (4, "")], "doc_id int, text string")
    assert {r.doc_id: r.duplicate_of for r in graph.fingerprints(docs).collect()} == {1: None, 3: 1, 2: None, 4: 2}


def test_answers(spark):
    brands = spark.createDataFrame([("Acme Data", ["acmedata", "acme"])], "brand string, needles array<string>")
    text = "Top tools:\n1. Rival: beats Acme Data\n2. Acme Data: good\n- Other"
    r = answers.brand_hits(spark.createDataFrame([(1, text), (2, "none")], "answer_id int, text string"), brands).collect()
    assert [(x.answer_id, x.position) for x in r] == [(1, 2)]
    rows = [("a", "category", "ok", False, False, True), ("a", "category", "ok", True, True, True), ("a", "branded", "ok", True, False, True), ("a", "category", "error", None, None, None)]
    s = answers.visibility_score(spark.createDataFrame(rows, "host string, kind string, status string, mentioned boolean, cited boolean, grounded boolean")).first()
    assert (s.measured, s.score) == (3, 57)


def test_journeys(spark):
    schema = "url string, final_url string, status int, content_type string, ms double, words int, app_shell boolean, robots_blocked boolean, challenge boolean, login_wall boolean, error string"
    rows = [
        ("https://a.test/", "https://a.test", 200, "text/html", 10.0, 500, False, False, False, False, ""),
        ("https://a.test/", None, 403, "text/html", 10.0, 5, False, True, False, False, ""),
        ("https://a.test/", "https://a.test/b", 200, "text/html", 3000.0, 5, False, False, False, False, None),
        ("https://a.test/", None, None, None, None, None, None, None, None, None, "timeout"),
    ]
    got = [r.issues for r in journeys.fetch_issues(spark.createDataFrame(rows, schema)).collect()]
    assert got == [[], ["robots_blocked", "firewall_blocked"], ["thin_content", "slow_response", "redirected"], ["unreachable"]]
    page = spark.createDataFrame([(1, "Team costs $29 per seat. Mail sales@a.test")], "page_id int, text string")
    assert {r.intent for r in journeys.intent_proofs(page).collect()} == {"pricing", "contact"}


def test_many_brands_meet_by_their_first_letters(spark, monkeypatch):
    brands = spark.createDataFrame([("Acme Data", ["acmedata", "acme"]), ("Other", ["other"]), ("Zed", ["zedco"])], "brand string, needles array<string>")
    told = spark.createDataFrame([(1, "1. Rival\n2. Ac-me Data: good"), (2, "none"), (3, "abc"), (4, None), (5, "- OTHER and acme")], "answer_id int, text string")
    want = {(r.answer_id, r.brand, r.position) for r in answers.brand_hits(told, brands).collect()}
    assert want == {(1, "Acme Data", 2), (5, "Other", 1), (5, "Acme Data", 1)}


def test_journey_outcomes(spark):
    fine = ("fetch", 200, 500, [])
    trails = {
        "blocked": [("fetch", 403, 0, [])], "stalled": [fine], "partial": [fine, ("answer", None, None, None)], "shell": [("fetch", 200, 500, ["javascript_only"])],
        "verified": [fine, ("answer", None, None, None)], "custom": [fine, ("answer", None, None, None)],
    }
    rows = [(j, a, s, 10, 100, w, i, j == "verified" and a == "answer", j == "custom") for j, steps in trails.items() for a, s, w, i in steps]
    steps = spark.createDataFrame(rows, "journey_id string, action string, status int, ms int, bytes int, words int, issues array<string>, verified boolean, custom boolean")
    got = {r.journey_id: r.outcome for r in journeys.journey_metrics(steps).collect()}
    assert got == {"blocked": "blocked", "stalled": "stalled", "partial": "partial", "shell": "blocked", "verified": "completed", "custom": "completed"}
    assert {r.outcome for r in journeys.journey_metrics(steps.drop("verified", "custom")).collect()} == {"blocked", "stalled", "partial"}


def test_journey_issues(spark):
    rows = [
        ("a", 1, "fetch", "https://a.test/", None, 200, 500, ["slow_response"], 9), ("a", 2, "fetch", "https://a.test/", None, 200, 500, ["slow_response", "redirected"], 5),
        ("a", 3, "fetch", "https://a.test/x", "https://a.test/y", 404, 5, ["not_found"], 7), ("a", 4, "giveup", None, None, None, None, None, None),
        ("b", 1, "fetch", "https://b.test/", None, 403, 0, ["firewall_blocked"], 3), ("b", 2, "giveup", None, None, None, None, [], None),
        ("c", 1, "fetch", "https://c.test/", None, 200, 500, [], 3), ("c", 2, "answer", None, None, None, None, None, None),
        ("d", 1, "fetch", "https://d.test/", None, 200, 500, [], 3),
    ]
    steps = spark.createDataFrame(
        [(*r, r[0] == "d") for r in rows],
        "journey_id string, n int, action string, url string, final_url string, status int, words int, issues array<string>, ms int, exhausted boolean",
    )
    issues = journeys.journey_issues(steps)
    got = {}
    for r in issues.orderBy("journey_id", "rank").collect():
        got.setdefault(r.journey_id, []).append((r.code, r.step, r.url))
    assert got == {
        "a": [("no_route", 4, ""), ("slow_response", 1, "https://a.test/"), ("not_found", 3, "https://a.test/y"), ("redirected", 2, "https://a.test/")],
        "b": [("firewall_blocked", 1, "https://b.test/")], "c": [("unverified_answer", 2, "")], "d": [("budget_exhausted", None, "")],
    }
    assert {r.journey_id: (r.blockers, r.friction) for r in journeys.issue_counts(issues).collect()} == {"a": (1, 2), "b": (1, 0), "c": (0, 0), "d": (0, 1)}
    m = {r.journey_id: r for r in journeys.journey_metrics(steps.withColumn("bytes", F.lit(1))).collect()}
    assert (m["a"].steps, m["a"].fetches, m["a"].broken, m["a"].blocked, m["a"].slowest_ms, m["b"].blocked) == (4, 3, 1, 0, 9, 1)


def test_routes_and_moves(spark):
    links = spark.createDataFrame([
        (1, "a.test", 0, "https://a.test/pricing", "x"), (1, "a.test", 1, "https://www.a.test/pricing/", "again"), (1, "a.test", 2, "https://a.test/x/y", "Our plans"),
        (1, "a.test", 3, "https://b.test/pricing", "away"), (1, "a.test", 4, "https://docs.a.test/api", None), (1, "a.test", 5, "mailto:x", "contact"), (2, "a.test", 0, "https://a.test/z", "none"),
    ], "page_id int, host string, pos int, href string, text string")
    got = {(r.page_id, r.intent, r.href): r.score for r in journeys.rank_routes(links).collect()}
    assert got == {
        (1, "pricing", "https://a.test/pricing"): 29, (1, "pricing", "https://a.test/x/y"): 18, (1, "docs", "https://docs.a.test/api"): 29, (1, "signup", "https://a.test/pricing"): 9,
    }
    seen = spark.createDataFrame([(1, "a.test/pricing")], "page_id int, key string")
    assert {(r.intent, r.href) for r in journeys.rank_routes(links, seen).collect()} == {("pricing", "https://a.test/x/y"), ("docs", "https://docs.a.test/api")}
    pages = spark.createDataFrame([(1, "T", "Team costs $29 per seat"), (2, None, None)], "page_id int, title string, text string")
    moves = {(r.page_id, r.intent): (r.action, r.url) for r in journeys.next_moves(pages, journeys.rank_routes(links)).collect()}
    assert len(moves) == 12 and moves[1, "pricing"] == ("answer", None) and moves[1, "docs"] == ("fetch", "https://docs.a.test/api") and moves[2, "pricing"] == ("giveup", None)
    asked = spark.createDataFrame(
        [("j", 1, "a.test", "fetch", "https://a.test/seen"), ("j", 2, "a.test", "fetch", "https://a.test/n"), ("j", 3, "a.test", "fetch", "https://www.a.test/n/"), ("j", 4, "a.test", "fetch", "ftp://a.test/n2"),
         ("j", 5, "a.test", "fetch", None), ("j", 6, "a.test", "fetch", "https://a.test/m"), ("j", 7, "a.test", "search", None), ("j", 8, "a.test", "answer", None), ("j", 9, "a.test", "fetch", "https://a.test/o")],
        "journey_id string, n int, host string, action string, url string",
    )
    done = spark.createDataFrame([("j", "a.test/seen")], "journey_id string, key string")
    # one of the two fetches is spent on what was seen, and a search without words is none
    assert sorted(r.n for r in journeys.admit_moves(asked, done, fetches=2).collect()) == [2, 8]
    assert sorted(r.n for r in journeys.admit_moves(asked.withColumn("query", F.lit("cost")), done, fetches=3).collect()) == [2, 6, 7, 8]


def test_history(spark):
    schema = "id string, host string, completed_at string, status string, score int"
    old = spark.createDataFrame([("1", "a", "2024-01-01", "complete", 60)], schema)
    new = spark.createDataFrame([("2", "a", "2024-02-01", "complete", 72), ("1", "a", "2024-01-01", "complete", 61), ("3", "a", "2024-03-01", "failed", 0)], schema)
    kept = merged_history(old, new)
    assert {(r.id, r.score) for r in kept.collect()} == {("1", 61), ("2", 72)}
    assert [r.delta for r in history_diff(kept).orderBy("completed_at").collect()] == [None, 11]


def test_streams(spark, tmp_path):
    from crawlsight.streaming import jobs

    events = spark.range(50).select(F.timestamp_seconds(F.col("id") * 600).alias("ts"), (F.col("id") % 2).alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = jobs.windowed_counts(stream).writeStream.format("memory").queryName("w").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    got = {(r.start, r.n) for r in spark.table("w").collect()}
    every = {(r.start, r.n) for r in jobs.windowed_counts(events).collect()}
    assert got <= every and len(got) >= len(every) - 2  # the windows that the watermark has not passed stay open


def test_provenance_and_schema_are_scored(spark):
    from crawlsight.operators import citability, signals

    data = '<script type="application/ld+json">{"@graph": [{"@type" : ["Article", "NewsArticle"], "author": {"@type": "Person"}, "datePublished": "2024"}]}</script>'
    bodies = [
        data, "<time datetime='2024-01-01'>then</time>", "<meta content='Ann' name='author'>", "<a href=/a rel=\"author\">Ann</a>",
        "<script type='application/ld+json'>{\"@type\": \"Thing\", oops}</script>", "<!-- <time datetime=x> --><meta name=\"author\" content=\"\">plain",
    ]
    pages = spark.createDataFrame([(i, f"https://a.test/{i}", f"<html><body>{b}<p>Text</p></body></html>") for i, b in enumerate(bodies)], "page_id long, url string, html string")
    s = signals.page_signals(pages)
    got = {r.page_id: (r.has_date, r.has_author, sorted(r.jsonld_types)) for r in s.collect()}
    assert got == {
        0: (True, True, ["Article", "NewsArticle", "Person"]), 1: (True, False, []), 2: (False, True, []), 3: (False, True, []), 4: (False, False, []), 5: (False, False, []),
    }
    points = {r.page_id: (r.provenance, r.schema) for r in citability.page_citability(s).collect()}
    assert points == {0: (10, 10), 1: (5, 0), 2: (5, 0), 3: (5, 0), 4: (0, 0), 5: (0, 0)}


def read_pages(spark, bodies):
    from crawlsight.operators import signals

    return signals.page_signals(spark.createDataFrame([(i, f"https://a.test/{i}", b) for i, b in enumerate(bodies)], "page_id long, url string, html string"))


def test_signals_of_odd_markup(spark):
    words = "one two three four five six seven eight"
    page = (
        "<html lang='en'><head><meta content='About us' name='description'><meta name=robots content=noindex><meta property='og:title' content='A'>"
        "<meta property=\"og:title\" content=\"B\"><link href='/c' rel=canonical></head><body><div id=root></div><h1></h1><h1>Real</h1><h2>Why us?</h2>"
        "<svg><title>x</title></svg><template><p>gone</p></template><iframe>gone</iframe>"
        f"<main><div>{words} container<p>{words} leaf</p></div><ul><li>a<ul><li>b</ul><li>c</ul><ol><li>only</ol><table><tr><td>1<tr><td>2</table><table><tr><td><table><tr><td>x</table></table>"
        f"<li>{words} item<li>{words} last</li></main><img alt='x'><img alt=' '><img><a href='/about'>a</a></body></html>"
    )
    r = read_pages(spark, [page, None]).collect()
    s = r[0]
    assert (s.lang, s.description, s.meta_robots, s.canonical, s.open_graph) == ("en", "About us", "noindex", "/c", {"og:title": "B"})
    assert s.h1 == ["Real"] and s.question_headings == 1 and s.app_shell and "gone" not in s.text
    assert s.passages == [f"{words} leaf", f"{words} item", f"{words} last"]
    assert (s.lists, s.tables, s.images, s.images_with_alt, s.hrefs) == (1, 2, 3, 1, ["/about"])
    assert (r[1].title, r[1].words, r[1].passages, r[1].lists) == ("", 0, [], 0)


def test_two_questions_earn_all_points(spark):
    from crawlsight.operators import citability

    pages = read_pages(spark, ["<h2>What is it?</h2>" * n for n in range(4)])
    assert {r.page_id: r.questions for r in citability.page_citability(pages).collect()} == {0: 0, 1: 6, 2: 10, 3: 10}


def test_wordless_pages_count(spark):
    from crawlsight.operators import retrieval

    pages = spark.createDataFrame([(1, "a", "Blue whale", "", "", "whales"), (2, "a", "", None, "", "")], "page_id long, host string, title string, description string, headings string, text string")
    index = retrieval.postings(pages)
    assert tuple(retrieval.corpus_stats(index).first()) == (2, 3.5)
    assert {(r.page_id, r.term, r.tf, r.dl) for r in index.collect()} == {(1, "blu", 3, 7), (1, "whal", 4, 7), (2, None, 0, 0)}
    asked = spark.createDataFrame([(1, "blue whales")], "query_id int, query string")
    assert [(r.page_id, r.status) for r in retrieval.rank_pages(asked, index).collect()] == [(1, "answered")]


def test_llms_lines_part_titles_by_their_own_marks(spark):
    from crawlsight.operators import identity

    pages = read_pages(spark, ["<title>Plans · Prices | A</title>"])
    who = spark.createDataFrame([("a.test", "A", "")], "host string, brand string, description string")
    assert identity.llms_entries(pages, who).first().line == "- [Plans · Prices](https://a.test/0)"


def test_markup_checks(spark):
    from crawlsight.operators import readiness

    data = '<script type="application/ld+json">{"@type": "Product", "datePublished": "2024", "author": "x"}</script>'
    html = {
        "https://a.test/": f"<meta property='og:title' content=x><img alt=a><img>{data}<a href='/about-us'>a</a><a href='https://other.test/contact'>b</a>",
        "https://a.test/blog/1": f"{data}<meta name=robots content='noindex, follow'>", "https://b.test/": "<script type='application/ld+json'>{oops</script><a href='//b.test/contact'>c</a><h2>Why?</h2>",
    }
    from crawlsight.operators import signals

    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(html.items())], "page_id long, url string, html string")
    got = {}
    for r in readiness.markup_checks(signals.page_signals(pages)).collect():
        got.setdefault(r.host, {})[r.check_id] = r.status
    assert got["a.test"] == {
        "indexable": "warn", "alt-text": "warn", "offering-schema": "pass", "faq-schema": "fail", "open-graph": "warn", "about-contact": "warn", "jsonld-valid": "pass", "freshness": "pass",
    }
    assert got["b.test"] == {
        "indexable": "pass", "alt-text": "na", "offering-schema": "fail", "faq-schema": "warn", "open-graph": "fail", "about-contact": "warn", "jsonld-valid": "fail", "freshness": "na",
    }


def test_asked_postings_rank_as_all_do(spark):
    rows = [(i, f"h{i % 3}.test", "Pricing plans" if i % 2 else "", "cost of tools", "", " ".join(["tool price gdpr word"[k % 4 * 5:] for k in range(i)])) for i in range(12)]
    pages = spark.createDataFrame([*rows, (99, "h9.test", "", "", "", "")], SCHEMA)
    asked = spark.createDataFrame([(1, "tools and prices for gdpr"), (2, "pricing plan"), (3, "nothing here says xylophone")], "query_id int, query string")
    every, few = retrieval.postings(pages), retrieval.asked_postings(pages, asked)
    assert sorted(retrieval.corpus_stats(few).first()) == sorted(retrieval.corpus_stats(every).first())
    assert {r.term for r in few.collect()} == {None, *(r.term for r in retrieval.query_terms(asked).collect())} & {None, *(r.term for r in every.collect())}
    for per_host in (False, True):
        both = [sorted(map(str, retrieval.rank_pages(asked, index, 2, per_host).collect())) for index in (every, few)]
        assert both[0] == both[1] and both[0]
    # a page's sums are made where its postings lie: no list of words and no pair of query and page is dealt out again
    plan = retrieval.scores(asked, few)._jdf.queryExecution().executedPlan().toString()
    assert "collect_set" not in plan and "hashpartitioning(query_id" not in plan
