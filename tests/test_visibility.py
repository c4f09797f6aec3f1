"""Visibility and fan-out on small fixtures."""

from pyspark.sql import functions as F

from crawlsight.operators import visibility as vis

SOURCES = "array<struct<uri:string,title:string>>"


def test_recognition(spark):
    told = [
        ("Acme Data is a tool.", True), ("I could not find any information about Acme Data.", False), ("I have no details on Acme Data's pricing, but Acme Data is known.", True),
        ("I am not familiar with the company Acme Data.", False), ("Nothing here.", False), (None, False),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(told)], "i int, text string")
    got = df.select("i", vis.recognises(F.col("text"), F.lit("Acme Data"), F.array(F.lit("acmedata"))).alias("ok")).orderBy("i").collect()
    assert [r.ok for r in got] == [ok for _, ok in told]
    dotted = spark.createDataFrame([("No information about A.me (x)",), ("No information about Axme (x)",)], "text string")
    assert [r.ok for r in dotted.select(vis.recognises(F.col("text"), F.lit("A.me"), F.array(F.lit("ame"), F.lit("axme"))).alias("ok")).collect()] == [False, True]


def test_sources_and_rivals(spark):
    rows = [([("https://www.b.test/x", "Title"), ("https://c.test", "docs.a.test"), ("nonsense", None)], ["Acme", "G 2", "Rival", "software-advice", "Third"])]
    df = spark.createDataFrame(rows, f"s {SOURCES}, names array<string>")
    r = df.select(vis.normalised_sources(F.col("s")).alias("s"), vis.rival_names(F.col("names"), F.array(F.lit("acme")), 1).alias("one"), vis.rival_names(F.col("names"), F.array(F.lit("acme"))).alias("all"))
    one = r.withColumn("own", vis.cites(F.col("s"), F.lit("a.test"))).first()
    assert [x.domain for x in one.s] == ["b.test", "docs.a.test", ""] and one.own and one.one == ["Rival"] and one["all"] == ["Rival", "Third"]


def test_prompt_queue(spark):
    rows = [("a", "branded", 1, "What is A?"), ("a", "category", 2, " Best tools "), ("a", "category", 1, "Other"), ("a", "custom", 9, "best TOOLS"), ("a", "custom", 8, ""), ("b", "branded", 1, "x")]
    got = vis.prompt_queue(spark.createDataFrame(rows, "host string, kind string, ordinal int, text string"), 2).orderBy("host", "no").collect()
    assert [(r.host, r.no, r.kind, r.text) for r in got] == [("a", 1, "custom", "best TOOLS"), ("a", 2, "category", "Other"), ("b", 1, "branded", "x")]


def test_share_of_voice(spark):
    answers = spark.createDataFrame([
        ("a.test", 1, "category", "ok", True, ["Rival", "Rival", "Acme", "Reddit", " "]), ("a.test", 2, "category", "ok", False, ["RIVAL", "Second"]),
        ("a.test", 3, "branded", "ok", True, ["Hidden"]), ("a.test", 4, "category", "error", None, ["Hidden"]), ("b.test", 5, "category", "ok", False, None),
    ], "host string, answer_id int, kind string, status string, mentioned boolean, competitors array<string>")
    brands = spark.createDataFrame([("a.test", "Acme", ["acme"]), ("b.test", "B Co", ["bcompany"])], "host string, brand string, needles array<string>")
    got = [(r.host, r.name, r.mentions, r.brand, r["rank"]) for r in vis.share_of_voice(answers, brands).orderBy("host", "rank").collect()]
    assert got == [("a.test", "Rival", 2, False, 1), ("a.test", "Acme", 1, True, 2), ("a.test", "Second", 1, False, 3), ("b.test", "B Co", 0, True, 1)]
    assert [r.name for r in vis.share_of_voice(answers, brands, 1).where("host = 'a.test'").orderBy("rank").collect()] == ["Rival", "Acme"]


def test_domains_and_counts(spark):
    s = lambda *d: [(f"https://{x}", "", x) for x in d]
    rows = [("a.test", 1, "category", "ok", True, True, True, 1, s("z.test", "b.test", "z.test")), ("a.test", 2, "branded", "ok", False, False, True, None, s("b.test", "x.a.test", "")), ("a.test", 3, "category", "ok", True, None, False, 4, [])]
    df = spark.createDataFrame(rows, "host string, answer_id int, kind string, status string, mentioned boolean, cited boolean, grounded boolean, position int, sources array<struct<uri:string,title:string,domain:string>>")
    by = lambda **k: [(r.domain, r["count"], r.own) for r in vis.cited_domains(df, **k).collect()]
    assert sorted(by()) == [("b.test", 2, False), ("x.a.test", 1, True), ("z.test", 1, False)] and [d for d, _, _ in by(keep=2, by_name=True)] == ["b.test", "x.a.test"]
    r = vis.answer_counts(df).first()
    assert (r.measured, r.mentions, r.category_measured, r.category_mentions, r.citations, r.grounded_measured, r.average_position) == (3, 2, 2, 2, 1, 2, 2.5)


def test_fanout(spark):
    rows = [
        ("s", "comparison", "ok", True, False, "answered", False), ("s", "comparison", "ok", False, None, "weak", True), ("s", "equivalent", "error", None, None, "answered", None),
        ("s", "follow_up", "ok", False, True, None, True), ("t", "other", "error", None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "seed string, type string, status string, mentioned boolean, cited boolean, retrieval string, lost boolean")
    got = {r.seed: tuple(r)[1:] for r in vis.fanout_summary(df).collect()}
    assert got == {"s": (3, 1, 1, 67, 2, 1, 1, 67), "t": (0, 0, 0, None, 0, 0, 0, None)}
    live = [(r.type, r.measured, r.hits) for r in vis.fanout_by_type(df).orderBy("type_no").collect()]
    index = [(r.type, r.measured, r.hits) for r in vis.fanout_by_type(df, True).orderBy("type_no").collect()]
    assert live == [("comparison", 2, 1), ("follow_up", 1, 1)] and index == [("equivalent", 1, 1), ("comparison", 2, 1)]


def test_plans(spark):
    rows = [(1, "comparison", "a vs b"), (1, "follow_up", "and then"), (2, "comparison", "ok query"), (2, "odd", "ok query"), (3, "comparison", "ab"), (4, "comparison", None)] + [(5, "comparison", f"query {i}") for i in range(13)]
    valid, rejected = vis.valid_plan(spark.createDataFrame(rows, "plan_id int, type string, query string"))
    assert {r.plan_id for r in valid.collect()} == {1} and {r.plan_id for r in rejected.collect()} == {2, 3, 4, 5} and rejected.count() == 17


def test_visibility_actions(spark):
    rows = [
        ("a.test", "category", "ok", False, False, True, ["wrong price"]), ("a.test", "category", "ok", True, False, True, None), ("a.test", "category", "ok", True, None, True, []),
        ("a.test", "branded", "ok", None, None, False, None), ("b.test", "category", "failed", None, None, None, None), ("c.test", "branded", "ok", True, True, True, None),
    ]
    df = spark.createDataFrame([(*r[:6], None, r[6]) for r in rows], "host string, kind string, status string, mentioned boolean, cited boolean, grounded boolean, position int, inaccuracies array<string>")
    domains = spark.createDataFrame([("a.test", "g2.com", 2, False), ("a.test", "a.test", 1, True), ("c.test", "c.test", 1, True)], "host string, domain string, count int, own boolean")
    got = [(r.host, r.action, r.priority, r.n, r.of) for r in vis.visibility_actions(df, domains).orderBy("host", "rank").collect()]
    assert got == [
        ("a.test", "sources", "high", 1, 1), ("a.test", "entity", "high", 1, 1), ("a.test", "accuracy", "high", 1, 1), ("a.test", "absent", "medium", 1, 3),
        ("a.test", "never-cited", "medium", 2, 3),
    ]
    names = spark.createDataFrame([("www.g2.com",), ("old.reddit.com",), ("en.wikipedia.org",), ("x.test",), (None,)], "d string")
    assert [r[0] for r in names.select(vis.cited_site_class(names.d)).collect()] == ["review", "community", "reference", "other", None]
