from pyspark.sql import functions as F

from crawlsight.operators import access, briefs, compare, identity


def test_access(spark):
    probes = spark.createDataFrame(
        [("GPT", 200, "fine", None), ("Claude", 200, "Just a moment...", None), ("Bing", 503, "", None), ("Slow", None, None, "timed out"), ("Gone", None, None, "refused")],
        "agent string, status int, body string, error string",
    )
    got = {r.agent: (r.blocked, r.inconclusive) for r in access.probe_class(probes).collect()}
    assert got == {"GPT": (False, False), "Claude": (True, False), "Bing": (True, False), "Slow": (False, True), "Gone": (True, False)}
    pages = spark.createDataFrame(
        [(1, "https://www.a.test/x/", "NOINDEX, max-snippet: 40", None, "https://a.test/x"), (2, "https://a.test/x", None, "none, noai", "/y"), (3, "https://a.test/", None, None, None)],
        "page_id int, url string, meta_robots string, x_robots_tag string, canonical string",
    )
    one, two, three = access.snippet_controls(pages).orderBy("page_id").collect()
    assert (one.noindex, one.nosnippet, one.max_snippet, one.source, one.canonical_elsewhere) == (True, False, 40, "meta robots", False)
    assert (two.noindex, two.nosnippet, two.noai, two.source, two.canonical_elsewhere) == (True, True, True, "X-Robots-Tag header", True)
    assert (three.noindex, three.max_snippet, three.source, three.canonical_elsewhere) == (False, None, "", False)
    files = spark.createDataFrame([("a", 200, 5, True), ("b", 200, 5, False), ("c", 200, 0, True), ("d", 404, None, None), ("e", None, None, None)], "host string, status int, urls int, referenced boolean")
    assert {r.host: r.state for r in access.sitemap_state(files).collect()} == {"a": "ok", "b": "unreferenced", "c": "invalid", "d": "missing", "e": "missing"}


def test_crawlers_and_checks(spark):
    verdicts = access.bots(spark).select(F.lit(1).alias("page_id"), "token", (F.col("token") != "Bingbot").alias("allowed"))
    pages = spark.createDataFrame([(1, "a.test")], "page_id int, host string")
    files = spark.createDataFrame([("a.test", "User-agent: Bingbot\nDisallow: /")], "host string, body string")
    probes = spark.createDataFrame([("a.test", "Googlebot", 403, True)], "host string, token string, status int, blocked boolean")
    rows = access.crawler_rows(verdicts, files, probes, pages)
    assert rows.count() == 14 and {r.token for r in rows.where("not reaches").collect()} == {"Bingbot", "Googlebot"}
    assert access.search_reach(rows).first().search_reach == 6
    home = verdicts.select(F.lit("a.test").alias("host"), "token", "allowed")
    seen = spark.createDataFrame([("a.test", False, True)], "host string, blocked boolean, inconclusive boolean")
    host_files = spark.createDataFrame(
        [("a.test", "robots", 404, None, None, None), ("a.test", "sitemap", 200, None, 3, False), ("a.test", "llms", 200, "# A\n\n- [x](https://a.test/)", None, None)],
        "host string, kind string, status int, body string, urls int, referenced boolean",
    )
    got = {r.check_id: (r.status, r.earned) for r in access.access_checks(home, seen, host_files).collect()}
    assert got == {
        "search-crawlers": ("fail", 0.0), "training-crawlers": ("pass", 3.0), "firewall": ("warn", 5.0), "robots-file": ("warn", 1.0),
        "sitemap": ("warn", 2.0), "llms-txt": ("pass", 6.0), "llms-full": ("warn", 0.5),
    }


def test_compare(spark):
    best = spark.createDataFrame(
        [(1, "a", 2.0, 0.8, "answered"), (1, "b", 3.0, 0.8, "answered"), (2, "a", 1.0, 0.5, "weak"), (2, "b", 1.0, 0.5, "weak"), (3, "a", 0.0, 0.0, "missing")],
        "query_id int, host string, score double, coverage double, status string",
    )
    winners = compare.question_winners(best)
    assert {r.query_id: r.winner for r in winners.collect()} == {1: "b", 2: "a", 3: None}
    tallies = compare.site_tallies(best, winners)
    assert {r.host: (r.answers, r.wins) for r in tallies.collect()} == {"a": (1, 1), "b": (1, 1)}
    found = {r.dimension: (r.host, r.ties) for r in compare.leaders(tallies, {"wins": "wins", "answers": "answers"}).collect()}
    assert found == {"wins": (None, 2), "answers": (None, 2)}
    history = spark.createDataFrame([("a", "1", 1, 60, 4), ("a", "2", 2, 72, 6), ("a", "3", 3, None, 5)], "host string, id string, completed_at int, score int, lost int")
    got = {(r.id, r.metric): (r.change, r.better) for r in compare.metric_changes(history, ("score", "lost")).collect()}
    assert got[("2", "score")] == (12.0, True) and got[("2", "lost")] == (2.0, False) and got[("3", "lost")] == (-1.0, True)
    assert got[("3", "score")] == (None, None) and got[("1", "score")] == (None, None)
    checks = spark.createDataFrame([("a", 1, "h1", "fail"), ("a", 1, "lang", "pass"), ("a", 2, "h1", "pass"), ("a", 2, "lang", "fail")], "host string, run int, check_id string, status string")
    r = compare.fixed_and_broke(checks).first()
    assert (r.fixed, r.broke) == (["h1"], ["lang"])


def test_identity(spark):
    rows = [("Pricing | Acme Data", "acme-data.test"), ("A very long tagline about many useful things", "x.test"), ("Blog - Short", "y.test"), (None, "z.test")]
    got = spark.createDataFrame(rows, "t string, h string").select(identity.brand_from_title(F.col("t"), F.col("h")).alias("b")).collect()
    assert [r.b for r in got] == ["Acme Data", "", "Blog", ""]
    pages = spark.createDataFrame(
        [(1, "a.test", "https://a.test/", "Acme | Home", ["Hi"], "We sell."), (2, "a.test", "https://a.test/blog/x", "Post | Acme", ["P"], ""), (3, "a.test", "https://a.test/privacy", "Privacy", [], ""), (4, "a.test", "https://a.test", "Again", [], "")],
        "page_id int, host string, url string, title string, h1 array<string>, description string",
    )
    known = spark.createDataFrame([("a.test", "Acme", None)], "host string, brand string, description string")
    body = identity.llms_txt(pages, identity.host_identity(pages, known)).first().body
    assert body == "# Acme\n\n> We sell.\n\n## Key pages\n\n- [Home](https://a.test/): We sell.\n\n## Resources\n\n- [Post](https://a.test/blog/x)\n"


def test_briefs(spark):
    rows = [
        ("a.test", 1, "acme pricing plans", "missing", 0.0, None, ["acme", "pricing", "plans"], False), ("a.test", 2, "plans pricing acme", "weak", 0.5, "https://a.test/p", ["acme"], False),
        ("a.test", 3, "data export format", "weak", 0.5, "https://a.test/p", ["format"], False), ("a.test", 4, "rival compare", "answered", 1.0, "https://a.test/q", [], True),
        ("a.test", 5, "known answer", "answered", 1.0, "https://a.test/q", [], None), ("a.test", 6, "the", "missing", 0.0, None, [], False),
    ]
    hits = spark.createDataFrame(rows, "host string, query_id int, query string, status string, coverage double, url string, missing_terms array<string>, lost boolean")
    got = [(r.query_id, r.reason, r.action, r.target) for r in briefs.briefs(hits).orderBy("rank").collect()]
    assert got == [(4, "lost", "extend", "https://a.test/q"), (1, "missing", "write", "https://a.test/acme-pricing-plans"), (3, "weak", "extend", "https://a.test/p")]
    checks = spark.createDataFrame([("a", "h1", "content", 3, "fail", 0.0), ("a", "lang", "content", 1, "warn", 0.5), ("a", "https", "access", 6, "pass", 6.0), ("a", "alt", "entity", 9, "na", 0.0)], "host string, check_id string, layer string, weight int, status string, earned double")
    assert [(r.check_id, r.points, r.priority) for r in briefs.readiness_actions(checks).orderBy("rank").collect()] == [("h1", 30.0, "high"), ("lang", 5.0, "high")]
    blocked = spark.createDataFrame([("a", "access")], "host string, layer string")
    assert {r.layer: (r.state, r.gaps) for r in briefs.stage_states(checks, blocked).collect()} == {"content": ("fail", 2), "access": ("fail", 0), "entity": ("na", 0)}
    assert [r.check_id for r in briefs.gaps(checks).orderBy("rank").collect()] == ["h1", "lang"]


def test_lost_questions(spark):
    best = spark.createDataFrame(
        [(1, "a", 2.0, 0.8, "answered"), (1, "b", 3.0, 0.8, "answered"), (2, "a", 1.0, 0.5, "weak"), (2, "b", 1.0, 0.5, "weak"), (3, "a", 9.0, 0.1, "missing"), (3, "b", 1.0, 0.9, "answered")],
        "query_id int, host string, score double, coverage double, status string",
    )
    lost = compare.lost_questions(best)
    assert {(r.query_id, r.host) for r in lost.where("lost").collect()} == {(1, "a"), (3, "a")}
    hits = lost.withColumns({"query": F.concat(F.lit("word"), "query_id"), "url": F.lit(""), "missing_terms": F.array(F.lit("x"))})
    assert [(r.query_id, r.reason) for r in briefs.briefs(hits).where("host = 'a'").orderBy("rank").collect()] == [(1, "lost"), (3, "lost"), (2, "weak")]


def test_score_board_stores_only_what_checks_read(spark):
    from crawlsight.operators import readiness, signals
    from crawlsight.plans.sites import _UNASKED

    pages = spark.createDataFrame([(1, "https://a.test/", "<title>A</title><p>x</p>")], "page_id long, url string, html string")
    kept = signals.page_signals(pages).drop(*_UNASKED)
    assert {"text", "readable", "passages"} <= set(_UNASKED) <= set(signals.page_signals(pages).columns)
    assert readiness.checks(kept).columns and readiness.markup_checks(kept).columns  # no check asks for what is left out
