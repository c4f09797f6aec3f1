"""Live verdicts, paced states and the history sink: restarts, replays and second writers; conformance of documents."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from crawlsight.operators import journeys
from crawlsight.sources import conform as schemas
from crawlsight.streaming import history, jobs, verdicts

STEP = "journey_id string, ts timestamp, n int, action string, url string, final_url string, status int, ms long, bytes long, words int, issues array<string>, verified boolean, custom boolean, exhausted boolean"
START = datetime.datetime(2026, 1, 1)


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


@pytest.fixture
def folders(spark, tmp_path):
    made = iter(range(100))
    return lambda: str(tmp_path / f"f{next(made)}")


def add(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def run(stream, spark, out, checkpoint):
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def trails(seed, count):
    r, out = random.Random(seed), []
    for j in range(count):
        ends, walk = r.choice(["answer", "giveup", "exhausted", "answer"]), []
        for n in range(1, r.randint(1, 8)):
            action = r.choice(["fetch", "fetch", "fetch", "search"])
            codes = r.sample(["slow_response", "thin_content", "javascript_only", "not_found", "robots_blocked", "redirected", "unreachable"], r.randint(0, 2)) if action == "fetch" else r.choice([[], ["left_the_site"]])
            walk.append((f"j{j}", at(j + 5 * n), n, action, f"https://a.com/{r.randint(1, 3)}", r.choice(["", None, "https://a.com/x"]), r.choice([200, 200, 404, None]), r.choice([10, 3000, None]), r.choice([5, None]), r.choice([500, 119, None]), r.choice([codes, codes or None]), r.random() < 0.2, None, False))
        n = len(walk) + 1
        walk.append((f"j{j}", at(j + 5 * n), n, "search" if ends == "exhausted" else ends, "", "", None, None, None, None, [], False, r.random() < 0.2, ends == "exhausted"))
        out.append(walk)
    return out


def test_live_verdicts_equal_the_batch_over_restarts(spark, folders):
    walks = trails(4, 40)
    source, out, checkpoint = folders(), folders(), folders()
    # three runs; the second repeats a step of the first, the third comes after some journeys ended
    first = [s for w in walks for s in w if s[2] <= 3]
    rest = [s for w in walks for s in w if s[2] > 3]
    late = [(w[0][0], at(300), 99, "fetch", "https://a.com/late", "", 200, 1, 1, 500, ["slow_response"], True, None, False) for w in walks[:5]]
    for part in (first, rest + first[:10], late):
        add(spark, part, STEP, source)
        stream = spark.readStream.schema(STEP).parquet(source)
        run(verdicts.live_verdicts(stream, timeout="10 minutes", late="10 minutes"), spark, out, checkpoint)
    told = spark.read.parquet(out)
    every = spark.createDataFrame([s for w in walks for s in w], STEP)
    assert told.count() == every.count()  # a row a step, none for repeats or what comes after the end
    assert {r.n for r in told.where("journey_id = 'j0'").collect()} == {s[2] for s in walks[0]}
    last = told.where("state = 'sealed'")
    assert last.count() == len(walks)
    issues = journeys.issue_counts(journeys.journey_issues(every))
    batch = journeys.journey_metrics(every).join(issues, "journey_id", "left").na.fill(0, ["blockers", "friction"])
    columns = ["journey_id", "outcome", *verdicts.COUNTERS]
    assert sorted(map(tuple, last.select(*columns).collect())) == sorted(map(tuple, batch.select(*columns).collect()))


def test_a_journey_without_steps_expires(spark, folders):
    source, out, checkpoint = folders(), folders(), folders()
    step = lambda j, n, s, action="fetch", **x: (j, at(s), n, action, "https://a.com/", "", 200, 5, 5, 300, x.get("issues", []), False, None, False)
    for part in ([step("open", 1, 0), step("ended", 1, 0), step("ended", 2, 5, "answer"), step("slow", 1, 0)], [step("slow", 2, 500)], [step("other", 1, 2000)], [step("another", 1, 4000)]):
        add(spark, part, STEP, source)
        run(verdicts.live_verdicts(spark.readStream.schema(STEP).parquet(source), timeout="10 minutes", late="1 minute"), spark, out, checkpoint)
    got = {(r.journey_id, r.n, r.state, r.outcome, r.fetches) for r in spark.read.parquet(out).collect()}
    assert {x for x in got if x[2] == "expired"} >= {("open", 1, "expired", "stalled", 1), ("slow", 2, "expired", "stalled", 2)}
    assert ("ended", 2, "sealed", "partial", 1) in got and not any(x[0] == "ended" and x[2] == "expired" for x in got)


def test_paced_states(spark, folders):
    schema = "id string, ts timestamp, status string, note int"
    source, out, checkpoint = folders(), folders(), folders()
    rows = [("a", at(s), status, s) for s, status in ((0, "asking"), (5, "asking"), (14, "asking"), (15, "scanning"), (16, "complete"), (17, "asking"), (18, "asking"), (33, "asking"))]
    rows += [("b", at(1), "failed", 1), ("b", at(2), "failed", 2), (None, at(1), "asking", 9), ("c", at(1), None, 7)]
    for part in (rows[:3], rows[3:]):
        add(spark, part, schema, source)
        run(verdicts.paced(spark.readStream.schema(schema).parquet(source)), spark, out, checkpoint)
    got = sorted((r.id, r.note) for r in spark.read.parquet(out).collect())
    assert got == [("a", 0), ("a", 15), ("a", 16), ("a", 17), ("a", 33), ("b", 1), ("b", 2), ("c", 7)]


RUN = "id string, host string, completed_at string, status string, score int"


def test_history_survives_replays_and_second_writers(spark, folders):
    path, source, checkpoint = folders(), folders(), folders()
    first = [("r1", "a.com", "2026-01-01", "complete", 10), ("r2", "a.com", "2026-01-02", "failed", 0), ("r3", "b.com", "2026-01-01", "partial", 5)]
    add(spark, first, RUN, source)
    history.history_sink(spark.readStream.schema(RUN).parquet(source), path, "one", checkpoint, every=None).awaitTermination()
    read = lambda **x: sorted(map(tuple, history.read_history(spark, path, RUN, **x).collect()))
    assert read() == [first[0], first[2]]
    write = history.history_writer(path, "one")
    write(spark.createDataFrame(first, RUN), 0)  # the batch is replayed
    assert read() == [first[0], first[2]]
    other = history.history_writer(path, "two")  # of the same instant and batch number
    other(spark.createDataFrame([("r4", "a.com", "2026-01-01", "complete", 7)], RUN), 0)
    write(spark.createDataFrame([("r1", "a.com", "2026-01-03", "complete", 12)], RUN), 1)
    want = [("r1", "a.com", "2026-01-03", "complete", 12), first[2], ("r4", "a.com", "2026-01-01", "complete", 7)]
    assert read() == want and read(keep=1) == want[:2]
    history.compact_history(spark, path, RUN)
    assert read() == want
    write(spark.createDataFrame([("r1", "a.com", "2026-01-03", "complete", 12)], RUN), 1)  # a replay of a merged batch
    other(spark.createDataFrame([("r5", "c.com", "2026-01-09", "complete", 1)], RUN), 1)
    assert read() == [*want, ("r5", "c.com", "2026-01-09", "complete", 1)]
    spark.createDataFrame([("r9", "z.com", "2026", "complete", 1)], RUN).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{path}/log/two/batch=2")
    assert len(read()) == 4  # its write has not ended
    history.compact_history(spark, path, RUN)
    assert len(read()) == 4
    # the stream goes on from its checkpoint
    add(spark, [("r6", "d.com", "2026-02-01", "complete", 3)], RUN, source)
    history.history_sink(spark.readStream.schema(RUN).parquet(source), path, "one", checkpoint, every=None).awaitTermination()
    with pytest.raises(ValueError):
        history.history_writer(path, "../x")
    assert history.read_history(spark, folders(), RUN).count() == 0


def test_fetch_streams(spark, folders):
    schema = "ts timestamp, url string, final_url string, status int, ms long, bytes long, words int, content_type string, error string, challenge boolean, login_wall boolean, app_shell boolean, robots_blocked boolean"
    row = lambda s, url, status, ms=5: (at(s), url, url, status, ms, 1, 300, "text/html", None, None, None, None, None)
    rows = [row(0, "https://a.com/x", 404), row(1, "https://a.com/x", 404, 9000), row(2, "https://a.com/", 200), row(3, "https://b.com/", 503)]
    source, out, checkpoint = folders(), folders(), folders()
    add(spark, rows, schema, source)
    stream = spark.readStream.schema(schema).parquet(source)
    run(jobs.classified(stream), spark, out, checkpoint)
    batch = journeys.fetch_issues(spark.createDataFrame(rows, schema))
    assert sorted(map(str, spark.read.parquet(out).collect())) == sorted(map(str, batch.collect()))
    once, marks = folders(), folders()
    run(jobs.first_issues(stream), spark, once, marks)
    add(spark, [row(4, "https://a.com/x", 404), row(5, "https://a.com/y", 404)], schema, source)
    run(jobs.first_issues(spark.readStream.schema(schema).parquet(source)), spark, once, marks)  # restarted
    got = sorted((r.code, r.url) for r in spark.read.parquet(once).collect())
    assert got == [("not_found", "https://a.com/x"), ("not_found", "https://a.com/y"), ("server_error", "https://b.com/"), ("slow_response", "https://a.com/x")]


def test_moves_within_what_is_left(spark):
    moves = spark.createDataFrame([
        ("a", 1, "x.com", "fetch", "/pricing#plans", None), ("a", 2, "x.com", "fetch", "https://www.x.com/pricing/", None), ("a", 3, "x.com", "fetch", "docs", None),
        ("a", 4, "x.com", "fetch", "https://evil.com/", None), ("a", 5, "x.com", "fetch", "javascript:alert(1)", None), ("a", 6, "x.com", "search", None, "  ab "),
        ("a", 7, "x.com", "search", None, " abc "), ("a", 8, "x.com", "answer", None, None), ("a", 9, "x.com", "fetch", "ftp://x.com/f", None),
        ("b", 1, "www.x.com", "fetch", "https://x.com/9", None), ("b", 2, "x.com", "search", None, "one more"), ("c", 1, "x.com", "fetch", "/8", None), ("c", 2, "x.com", "fetch", "/9", None),
    ], "journey_id string, n int, host string, action string, url string, query string")
    visited = spark.createDataFrame([("a", "x.com/docs")] + [("b", f"x.com/{i}") for i in range(8)] + [("c", f"x.com/{i}") for i in range(7)], "journey_id string, key string")
    got = {(r.journey_id, r.n): r.url or r.query for r in journeys.admit_moves(moves, visited).collect()}
    assert got == {("a", 1): "https://x.com/pricing", ("a", 7): "abc", ("a", 8): None, ("b", 2): "one more", ("c", 1): "https://x.com/8"}
    spent = spark.createDataFrame([("a", 8, 1), ("b", 0, 2)], "journey_id string, fetches int, searches int")
    got = {(r.journey_id, r.n) for r in journeys.admit_moves(moves, visited, spent).collect()}
    assert got == {("a", 7), ("a", 8), ("b", 1), ("c", 1), ("c", 2)}


def documents(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "no int, document string")


def test_conform_fills_defaults_and_gives_reasons(spark):
    page = {"url": "https://a.com/", "status": 200, "ms": 12.5, "bytes": 10}
    full = {**page, "h1": ["A"], "headings": [{"level": 2, "text": "T", "more": 1}], "openGraph": {"og:title": "x"}, "jsonLd": [{"@type": "Thing"}, None, 3], "appShell": True, "words": 7.0, "unknown": 1}
    bad = {"url": "nowhere", "status": "200", "ms": None, "headings": [{"level": 1.5, "text": "a"}, {"text": 3}, None], "openGraph": {"k": 1}, "h1": "A", "title": None, "passages": ["x", 2]}
    valid, rejected = schemas.conform(documents(spark, json.dumps(page), json.dumps(full), json.dumps(bad), "{broken", None, "[1]", "{}"), schemas.PAGE_SIGNALS)
    a, b = valid.orderBy("no").collect()
    assert (a.url, a.status, a.ms, a.title, a.h1, a.headings, a.openGraph, a.words, a.appShell, a.jsonLd) == ("https://a.com/", 200, 12.5, "", [], [], {}, 0, False, [])
    assert (b.h1, [(h.level, h.text) for h in b.headings], b.openGraph, b.appShell, b.words) == (["A"], [(2, "T")], {"og:title": "x"}, True, 7)
    assert [json.loads(x.toJson()) for x in b.jsonLd] == [{"@type": "Thing"}, None, 3]
    why = {r.no: set(r.reasons) for r in rejected.collect()}
    assert why[2] == {
        "url: malformed", "status: not a int", "ms: not a number", "bytes: missing", "headings[0].level: not a int", "headings[1].level: missing", "headings[1].text: not a string",
        "headings[2]: not a object", "openGraph.k: not a string", "h1: not a list", "title: not a string", "passages[1]: not a string",
    }
    assert why[3] == why[4] == why[5] == {"document: not a JSON object"} and why[6] == {f"{k}: missing" for k in ("url", "status", "ms", "bytes")}


def test_conform_bounds_lists_and_choices(spark):
    plan = lambda *q: json.dumps({"queries": list(q)})
    ok = {"type": "comparison", "query": "a or b"}
    valid, rejected = schemas.conform(documents(spark, plan(ok), plan(), plan(*[ok] * 13), plan({"type": "other", "query": "ab"}), plan({**ok, "query": "x" * 241})), schemas.FANOUT_PLAN)
    assert [(r.no, [tuple(q) for q in r.queries]) for r in valid.collect()] == [(0, [("comparison", "a or b", "")])]
    why = {r.no: r.reasons for r in rejected.collect()}
    assert why[1] == ["queries: fewer than 1"] and why[2] == ["queries: more than 12"] and why[4] == ["queries[0].query: malformed"]
    assert why[3][1] == "queries[0].query: malformed" and why[3][0].startswith("queries[0].type: not one of equivalent")
    nullable = (schemas.Field("status", "int", nullable=True), schemas.Field("n", "int", 3, least=1, most=5))
    valid, rejected = schemas.conform(documents(spark, '{"status": null}', "{}", '{"status": 1, "n": 9}'), nullable)
    assert [tuple(r) for r in valid.collect()] == [(0, None, 3)] and {r.no: r.reasons for r in rejected.collect()} == {1: ["status: missing"], 2: ["n: above 5"]}
    assert valid.where(F.lit(False)).count() == 0
