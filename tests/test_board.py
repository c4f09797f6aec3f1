"""Stages and their gaps, what rivals teach, evidence and fixes, next steps, history entries, trails."""

import json

from pyspark.sql import functions as F

from crawlsight.operators import board, briefs, citability, compare, readiness, signals
from crawlsight.sources import tables

CHECK = "host string, check_id string, layer string, weight int, status string, earned double"


def tables_of(spark, **rows):
    kinds = {
        "hosts": "host string, live boolean, pages long", "checks": CHECK, "probes": "host string, agent string, blocked boolean",
        "citability": "host string, page_id long, url string, score int, lead int, facts int",
        "hits": "host string, query_id string, query string, status string, lost boolean, rival string, missing_terms array<string>",
        "fanout": "host string, type string, status string, mentioned boolean, cited boolean, searched boolean",
        "counts": "host string, measured int, mentions int, category_measured int, category_mentions int, citations int, grounded_measured int, wrong int, skipped int, searched boolean",
        "actions": "host string, priority string",
    }
    return {k: spark.createDataFrame(rows.get(k, []), schema) for k, schema in kinds.items()}


def test_stage_board(spark):
    t = tables_of(
        spark, hosts=[("a", False, 3), ("live", True, None), ("gone", False, None), ("bad", False, 1)],
        checks=[("a", "https", "access", 2, "pass", 2.0), ("a", "sitemap", "access", 4, "warn", 2.0), ("a", "titles", "content", 4, "fail", 0.0), ("a", "h1", "content", 3, "fail", 0.0), ("a", "speed", "content", 2, "na", 0.0),
                ("a", "canonical", "entity", 2, "pass", 2.0), ("bad", "https", "access", 2, "pass", 2.0)],
        probes=[("bad", "GPTBot", True), ("bad", "Browser", False), ("bad", "PerplexityBot", True), ("bad", "PerplexityBot", True), ("a", "GPTBot", False)],
        citability=[("a", 1, "a/1", 20, 20, 5), ("a", 2, "a/2", 45, 8, 0), ("a", 3, "a/3", 90, 20, 5), ("a", 4, "a/4", None, 0, 0), ("bad", 9, "bad/", 80, 20, 5), ("gone", 5, "g/", None, 0, 0)],
        hits=[("a", "q1", "alpha", "answered", True, "r.com", []), ("a", "q2", "beta", "missing", False, None, ["beta", "vs"]), ("a", "q3", "gamma", "weak", None, None, ["beta", "delta"]), ("bad", "q1", "x", "answered", False, None, [])],
        fanout=[("a", "comparison", "ok", False, False, True), ("a", "follow_up", "ok", True, False, True), ("a", "entailment", "ok", None, None, True), ("a", "entailment", "error", True, True, True)],
        counts=[("a", 4, 2, 3, 1, 0, 2, 2, 1, True), ("bad", 2, 0, 2, 0, 0, 0, 0, 0, False)], actions=[("a", "high"), ("a", "low")],
    )
    stages, gaps = board.stage_board(*(t[k] for k in ("hosts", "checks", "probes", "citability", "hits", "fanout", "counts", "actions")))
    got = {(r.host, r.stage): (r.state, r.n, r.of, r.coverage, r.gaps) for r in stages.collect()}
    assert len(got) == 36 and [r.stage for r in stages.where("host = 'a'").orderBy("no").collect()] == list(board.STAGES)
    assert got["a", "crawl"] == ("partial", 3, None, 67, 1) and got["a", "content"] == ("fail", 0, 2, 0, 2) and got["a", "entity"] == ("pass", 1, 1, 100, 0)
    assert got["a", "agent"] == ("skipped", None, None, None, 0) and got["a", "citability"] == ("partial", 2, 3, 52, 4)
    assert got["a", "retrieval"] == ("fail", 1, 3, 33, 3) and got["a", "fanout"] == ("partial", 1, 3, 33, 3) and got["a", "answers"] == ("partial", 1, 3, 33, 3) and got["a", "fixes"] == ("partial", 1, 2, None, 0)
    assert got["bad", "crawl"] == ("fail", 1, None, 100, 2) and got["bad", "citability"] == ("pass", 0, 1, 80, 0) and got["bad", "answers"][0] == "fail" and got["bad", "fixes"] == ("pass", None, None, None, 0)
    assert {got["live", s][0] for s in board.STAGES} == {"running"} and got["gone", "crawl"] == ("skipped", None, None, None, 1) and got["gone", "fixes"][0] == "pass"
    told = [(r.stage, r.severity, r.code, r.subject, r.n) for r in gaps.where("host = 'a'").orderBy("rank").collect()]
    assert told[:6] == [("content", "high", "titles", "", None), ("citability", "high", "hard-to-quote", "a/1", 20), ("retrieval", "high", "no-page", "beta", None), ("retrieval", "high", "rival-first", "r.com alpha", None),
                        ("fanout", "high", "absent-kind", "comparison", 1), ("fanout", "high", "never-a-source", "", None)]
    assert ("retrieval", "medium", "wanted-words", "beta 2, delta 1", None) in told and ("citability", "medium", "no-facts", "", 1) in told and ("citability", "low", "unscored", "", 1) in told
    assert [s for _, s, *_ in told] == sorted((s for _, s, *_ in told), key=board.SEVERITIES.index)
    assert {(r.code, r.subject) for r in gaps.where("host = 'bad' AND stage = 'crawl'").collect()} == {("refused-unlike-browsers", "GPTBot"), ("refused-unlike-browsers", "PerplexityBot")}
    assert {r.code for r in gaps.where("host = 'gone'").collect()} == {"not-fetched", "unscored", "not-measured"} and gaps.where("host = 'live'").count() == 0
    assert {r.host: (r.ran, r.total) for r in board.board_totals(stages).collect()} == {"a": (8, 9), "live": (0, 9), "gone": (1, 9), "bad": (5, 9)}
    empty = tables_of(spark)
    assert board.stage_board(*(empty[k] for k in ("hosts", "checks", "probes", "citability", "hits", "fanout", "counts", "actions")))[0].count() == 0


def test_takeaways(spark):
    market = spark.createDataFrame([("m", 1, "me"), ("m", 2, "b"), ("m", 3, "c"), ("n", 1, "c"), ("n", 2, "me"), ("o", 1, "none"), ("o", 2, "me"), ("p", 1, "me"), ("p", 2, "none")], "market string, pos int, host string")
    columns = spark.createDataFrame([("me", True, 50, 6, None, False), ("b", True, 60, 6, 10, True), ("c", True, 70, 8, 5, True), ("none", False, None, None, None, None)], "host string, measured boolean, readiness int, reach int, citability int, llms_txt boolean")
    layers = spark.createDataFrame([("me", "access", 50), ("me", "content", 50), ("b", "access", 55), ("b", "content", 70), ("b", "agent", None), ("c", "access", 90)], "host string, layer string, score int")
    winners = spark.createDataFrame([("m", f"q{i}", f"ask {i}", w) for i, w in enumerate(["b", "me", None, "c", "b", "b"])], "market string, query_id string, query string, winner string")
    got = [tuple(r) for r in board.takeaways(market, columns, layers, winners).orderBy("market", "no").collect()]
    assert got == [
        ("m", 1, "readiness", ["b", "c"], 60, 50, "content", 20, None), ("m", 2, "reach", ["c"], 8, 6, None, None, None), ("m", 3, "citability", ["b", "c"], 10, None, None, None, None),
        ("m", 4, "questions", ["ask 0 — b", "ask 3 — c", "ask 4 — b"], 6, None, None, None, 4), ("m", 5, "llms-txt", ["b", "c"], None, None, None, None, None), ("n", 1, "leads", [], None, None, None, None, None),
    ]


def test_evidence_and_fixes(spark):
    page = '<html><head><title>{}</title><meta name="robots" content="{}"></head><body><h1>x</h1>{}</body></html>'
    rows = [(i, f"https://a.com/blog/{i}", page.format("Same" if i < 9 else "", "noindex" if i == 2 else "", "<img src=a>" if i == 3 else "")) for i in range(1, 10)]
    rows.append((20, "https://b.com/", page.format("B", "", "<h2>s</h2><h2>t</h2>")))
    evidence = readiness.check_evidence(signals.page_signals(spark.createDataFrame(rows, "page_id long, url string, html string")))
    got = {(r.host, r.check_id): (r.n, r.of, r.urls) for r in evidence.collect()}
    assert got["a.com", "titles"] == (9, 9, [f"https://a.com/blog/{i}" for i in range(1, 7)]) and got["a.com", "indexable"] == (1, 9, ["https://a.com/blog/2"])
    assert got["a.com", "alt-text"][2] == ["https://a.com/blog/3"] and got["a.com", "freshness"][0] == 9 and ("a.com", "h1") not in got and ("b.com", "structure") not in got
    checks = spark.createDataFrame([("a.com", "titles", "content", 4, "fail", 0.0), ("a.com", "sitemap", "access", 4, "warn", 2.0), ("a.com", "h1", "content", 3, "pass", 3.0), ("a.com", "other", "content", 3, "fail", 0.0)], CHECK)
    fixes = {r.check_id: r.fix for r in readiness.fix_texts(checks, evidence).collect()}
    assert fixes == {"titles": "Give 9 of 9 pages a title of their own; begin with https://a.com/blog/1.", "sitemap": readiness.FIXES["sitemap"], "other": None}
    parts = (readiness.CHECKS, readiness.MARKUP_CHECKS, readiness.ENTITY_CHECKS, readiness.SPEED_CHECKS, readiness._UNKNOWN)
    assert set(readiness.FIXES) == {x[0] for part in parts for x in part}


def test_next_steps(spark):
    names = ["lead", "passages", "facts", "structure", "questions", "provenance", "schema"]
    full = [20, 20, 15, 15, 10, 10, 10]
    cases = {1: (full, False, 3, (0, 0, 0), "none", 0), 2: ([8, 20, 0, 15, 10, 10, 10], False, 3, (0, 0, 0), "facts", 15), 3: ([0, 0, 15, 15, 10, 10, 10], False, 3, (1, 0, 0), "lead", 20),
             4: ([20, 0, 0, 0, 10, 10, 10], False, 3, (1, 1, 2), "passages-dangling", 20), 5: ([20, 5, 15, 15, 10, 10, 10], False, 3, (1, 1, 1), "passages-short", 15), 6: ([20, 0, 15, 15, 10, 10, 10], False, 0, (0, 0, 0), "passages-none", 20),
             7: ([0] * 7, True, 0, (0, 0, 0), "render", 100), 8: ([20, 0, 15, 15, 10, 10, 10], False, 2, (0, 2, 1), "passages-long", 20)}
    points = spark.createDataFrame([(i, *x[0], sum(x[0])) for i, x in cases.items()] + [(9, *full, None)], f"page_id long, {', '.join(f'{n} int' for n in names)}, score int")
    flaws = spark.createDataFrame([(i, 0, *x[3]) for i, x in cases.items()], "page_id long, liftable int, short int, long int, dangling int")
    pages = spark.createDataFrame([(i, x[1], ["p"] * x[2]) for i, x in cases.items()], "page_id long, app_shell boolean, passages array<string>")
    got = {r.page_id: (r.code, r.lost) for r in citability.next_step(points, flaws, pages).collect()}
    assert got == {i: x[4:] for i, x in cases.items()}
    assert citability.next_step(points, flaws, pages).where(F.col("advice").isNull()).count() == 0
    worst = citability.host_pages_by_need(points.withColumn("host", F.lit("h")))
    assert [r.page_id for r in worst.orderBy("rank").collect()][0] == 7 and worst.count() == 8


def test_best_passage(spark):
    one = "Acme builds 40 pumps " + "and more words to fill the line " * 4 + "at $20 in 2024."
    rows = [(1, ["short", one.replace("$20 in 2024", "cost"), one]), (2, ["short only"]), (3, [])]
    got = {r.page_id: r.passage for r in citability.best_passage(spark.createDataFrame(rows, "page_id long, passages array<string>")).collect()}
    assert got == {1: one, 2: "short only", 3: None}


def test_one_ranking_of_actions(spark):
    ready = spark.createDataFrame([("a", 1, "titles", 9.0, "high"), ("a", 2, "h1", 2.5, "medium"), ("a", 3, "lang", 2.5, "medium")], "host string, rank int, check_id string, points double, priority string")
    seen = spark.createDataFrame([("a", 1, "sources", "high", 2, 2), ("a", 2, "absent", "medium", 1, 4), ("b", 1, "entity", "high", 1, 1)], "host string, rank int, action string, priority string, n int, of int")
    got = [(r.host, r.action) for r in briefs.rank_actions(ready, seen).orderBy("host", "rank").collect()]
    assert got == [("a", "sources"), ("a", "titles"), ("a", "absent"), ("a", "h1"), ("a", "lang"), ("b", "entity")]


def test_history_entries(spark):
    f = lambda rows, schema: spark.createDataFrame(rows, schema)
    runs = f([("r1", "a.com", "2026-01-02", "2026-01-01", "complete", "m"), ("r2", "a.com", None, "2026-01-03", "failed", "m")], "id string, host string, completed_at string, created_at string, status string, model string")
    got = {r.id: r for r in compare.history_entries(
        runs, f([("r1",), ("r1",)], "id string"), f([("r1", "access", 50, None), ("r1", "content", None, None), ("r1", None, 60, "D")], "id string, layer string, score int, grade string"),
        f([("r1", "titles", "fail"), ("r1", "h1", "pass")], "id string, check_id string, status string"), f([("r1", 40, 0, 0)], "id string, score int, category_mentions int, category_measured int"),
        f([("r1", 50), ("r1", 61), ("r1", None)], "id string, score int"), f([("r1", 75, 2)], "id string, answerable_coverage int, lost int"),
    ).collect()}
    a, b = got["r1"], got["r2"]
    assert (a.completed_at, a.pages, a.readiness, a.grade, a.layers, a.visibility, a.named, a.asked, a.citability, a.answerable, a.lost, a.failing) == ("2026-01-02", 2, 60, "D", {"access": 50, "content": None}, 40, None, None, 56, 75, 2, ["titles"])
    assert (b.completed_at, b.pages, b.readiness, b.grade, b.layers, b.failing) == ("2026-01-03", 0, None, "", {}, [])


def test_trails_batch_and_stream(spark, tmp_path):
    line = lambda kind, **x: json.dumps({"type": kind, **x})
    trip = lambda n, outcome: {"id": "j", "host": "a.com", "outcome": outcome, "steps": [{"n": i, "action": "fetch", "issues": []} for i in range(n)]}
    rows = [("done", 2, line("result", journey=trip(2, "completed"))), ("done", 1, line("progress", journey=trip(1, "stalled"))), ("done", 3, line("error", message="late")), ("walks", 1, line("progress", journey=trip(1, "stalled"))),
            ("walks", 2, line("progress", journey=trip(2, "partial"))), ("failed", 1, line("progress", journey=trip(1, "stalled"))), ("failed", 2, line("error", message="timed out")), ("odd", 1, "{not json"), ("odd", 2, line("progress")), ("odd", 3, None)]
    schema = "run string, at long, value string"
    read = lambda df: {r.run: (r.state, r.journey.outcome if r.journey else None, len(r.journey.steps) if r.journey else None, r.message, r.lines) for r in df.collect()}
    batch = tables.read_trails(spark.createDataFrame(rows, schema))
    want = {"done": ("done", "completed", 2, None, 3), "walks": ("walking", "partial", 2, None, 2), "failed": ("failed", "stalled", 1, "timed out", 2), "odd": ("walking", None, None, None, 3)}
    assert read(tables.last_states(batch)) == want
    assert [r.message for r in batch.where("run = 'odd'").orderBy("at").collect()] == ["{not json", '{"type": "progress"}', None]
    for part in (rows[:4], rows[4:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = tables.last_states(tables.read_trails(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))))
    stream.writeStream.format("memory").queryName("trail_states").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert read(spark.table("trail_states")) == want


def test_pages_snapshots_and_catalogue(spark, tmp_path):
    spark.createDataFrame([(1, "https://a.com/", "<p>é"), (2, "https://b.com/", None)], "page_id int, url string, html string").write.parquet(str(tmp_path / "thin"))
    got = tables.read_pages(spark, str(tmp_path / "thin")).orderBy("page_id").collect()
    assert (got[0].final_url, got[0].status, got[0].bytes, got[0].content_type, got[1].bytes) == ("https://a.com/", None, 5, None, None)
    spark.createDataFrame([(1, "u", "v", 200, {"Content-Type": "text/html", "X-ROBOTS-TAG": "noindex"}, "x")], "page_id long, url string, final_url string, status int, headers map<string,string>, html string").write.parquet(str(tmp_path / "full"))
    full = tables.read_pages(spark, str(tmp_path / "full")).first()
    assert (full.final_url, full.status, full.content_type, full.x_robots_tag) == ("v", 200, "text/html", "noindex")
    path = str(tmp_path / "snapshots")
    run = lambda name, *n: spark.createDataFrame([(name, i) for i in n], "snapshot_id string, n int")
    for part in (run("r1", 1, 2), run("r2", 3), run("r1", 1, 2)):
        tables.write_snapshot(part, path)
    assert sorted((r.snapshot_id, r.n) for r in spark.read.parquet(path).collect()) == [("r1", 1), ("r1", 2), ("r2", 3)]
    catalogue = readiness.check_catalogue(spark)
    assert catalogue.count() == readiness.ALL_CHECKS and {r.layer: r.w for r in catalogue.groupBy("layer").agg(F.sum("weight").alias("w")).collect()} == readiness.ALL_WEIGHTS
