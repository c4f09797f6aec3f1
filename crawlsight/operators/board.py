"""How far a site's measurement got: nine stages under one schema, what each lacks, and what the site should learn from rivals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import js_round

# The stages in their order, how bad a gap is, the kinds of sub-query whose loss is worst.
STAGES = ("crawl", "content", "entity", "agent", "citability", "retrieval", "fanout", "answers", "fixes")
SEVERITIES = ("high", "medium", "low")
KEY_KINDS = ("comparison", "canonicalization")
#: Gaps that a stage lists of one sort; their counts have all.
LOW_PAGES, LISTED = 4, 5

_ROW = "host string, stage string, state string, n long, of long, coverage int"
_GAP = "host string, stage string, code string, severity string, subject string, n long, sort long"


def _count(cond: Column) -> Column:
    return F.sum(F.coalesce(cond, F.lit(False)).cast("long"))


def _share(n: Column, of: Column) -> Column:
    return js_round(100 * n / F.nullif(of, F.lit(0))).cast("int")


def _shaped(df: DataFrame, schema: str) -> DataFrame:
    fields = [f.split() for f in schema.split(", ")]
    return df.select(*(F.col(n).cast(t).alias(n) for n, t in fields))


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _first(df: DataFrame, order: list, keep: int) -> DataFrame:
    """The ``keep`` first rows of each host, numbered in sort."""
    place = F.row_number().over(Window.partitionBy("host").orderBy(*order))
    return df.withColumn("sort", place).where(F.col("sort") <= keep)


def check_stages(hosts: DataFrame, checks: DataFrame, probes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, gaps) of the four stages that checks decide; a crawler that was refused fails the crawl."""
    refused = probes.where("blocked AND agent <> 'Browser'").select("host", "agent").distinct()
    browser = probes.where("blocked AND agent = 'Browser'").select("host").distinct().withColumn("browser", F.lit(True))
    stage = F.when(F.col("layer") == "access", "crawl").otherwise(F.col("layer"))
    measured = F.col("status") != "na"
    sums = checks.withColumn("stage", stage).groupBy("host", "stage").agg(
        _count(F.col("status") == "pass").alias("passed"), _count(measured).alias("counted"), F.max(F.when(F.col("status") == "fail", 2).when(F.col("status") == "warn", 1).otherwise(0)).alias("worst"),
        F.sum(F.when(measured, F.col("earned"))).alias("earned"), F.sum(F.when(measured, F.col("weight"))).alias("possible"),
    )
    every = hosts.select("host", "live", "pages", F.explode(F.array(*map(F.lit, STAGES[:4]))).alias("stage"))
    blocked = refused.select("host").distinct().withColumn("blocked", F.lit(True))
    x = every.join(sums, ["host", "stage"], "left").join(blocked, "host", "left")
    c = F.col
    crawl = c("stage") == "crawl"
    waiting = F.when(c("live"), "running").otherwise("skipped")
    scored = F.when(c("counted").isNull(), "skipped").when(c("worst") == 2, "fail").when(c("worst") == 1, "partial").otherwise("pass")
    state = F.when(crawl & c("pages").isNull(), waiting).when(crawl & c("blocked"), "fail").when(~crawl & c("counted").isNull(), waiting).otherwise(scored)
    ran = F.when(crawl, c("pages").isNotNull()).otherwise(c("counted").isNotNull())
    rows = x.select(
        "host", "stage", state.alias("state"), F.when(crawl, c("pages")).otherwise(c("passed")).alias("n"), F.when(~crawl, c("counted")).alias("of"),
        F.when(ran, _share(c("earned"), c("possible"))).alias("coverage"),
    )
    named = checks.join(hosts.where("pages IS NOT NULL").select("host"), "host").withColumn("stage", stage).where("status IN ('fail', 'warn')")
    severity = F.when(c("status") == "warn", "low").when(c("weight") >= 4, "high").otherwise("medium")
    gaps = [
        named.select("host", "stage", c("check_id").alias("code"), severity.alias("severity"), F.lit("").alias("subject"), F.lit(None).alias("n"), (1000 - c("weight")).alias("sort")),
        refused.join(browser, "host", "left").select("host", F.lit("crawl").alias("stage"), F.when(c("browser"), "refused").otherwise("refused-unlike-browsers").alias("code"), F.lit("high").alias("severity"),
                                                     c("agent").alias("subject"), F.lit(None).alias("n"), F.lit(0).alias("sort")),
        hosts.where("NOT live AND pages IS NULL").select("host", F.lit("crawl").alias("stage"), F.lit("not-fetched").alias("code"), F.lit("high").alias("severity"), F.lit("").alias("subject"), F.lit(None).alias("n"), F.lit(0).alias("sort")),
    ]
    return _shaped(rows, _ROW), _union([_shaped(g, _GAP) for g in gaps])


def citability_stage(hosts: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``pages``: host, page_id, url, score, lead, facts (of ``page_citability``); n and of are pages below 50 and pages scored."""
    c = F.col
    scored = c("score").isNotNull()
    sums = pages.groupBy("host").agg(
        js_round(F.avg("score")).cast("int").alias("mean"), _count(scored).alias("scored"), _count(~scored).alias("unscored"), _count(c("score") < 50).alias("low"), _count(scored & (c("facts") == 0)).alias("no_facts")
    )
    x = hosts.join(sums, "host", "left")
    none = c("mean").isNull()
    state = F.when(none, F.when(c("live"), "running").otherwise("skipped")).when(c("mean") >= 70, "pass").when(c("mean") >= 40, "partial").otherwise("fail")
    rows = x.select("host", F.lit("citability").alias("stage"), state.alias("state"), F.when(~none, c("low")).alias("n"), F.when(~none, c("scored")).alias("of"), c("mean").alias("coverage"))
    low = _first(pages.where("score < 50"), ["score", "page_id"], LOW_PAGES)
    gap = lambda df, code, severity, n, sort: df.select("host", F.lit("citability").alias("stage"), F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit("").alias("subject"), n.alias("n"), F.lit(sort).alias("sort"))
    gaps = [
        low.select("host", F.lit("citability").alias("stage"), F.lit("hard-to-quote").alias("code"), F.when(c("score") < 25, "high").otherwise("medium").alias("severity"), c("url").alias("subject"), c("score").alias("n"), "sort"),
        gap(x.where(~none & (c("no_facts") > 0)), "no-facts", "medium", c("no_facts"), 100), gap(x.where(~none & (c("unscored") > 0)), "unscored", "low", c("unscored"), 101),
        gap(x.where(none & (c("unscored") > 0) & ~c("live")), "unscored", "low", c("unscored"), 101),
    ]
    return _shaped(rows, _ROW), _union([_shaped(g, _GAP) for g in gaps])


def retrieval_stage(hosts: DataFrame, hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``hits``: host, query_id, query, status (answered, weak, missing), lost, rival, missing_terms; n of its questions are answered."""
    c = F.col
    sums = hits.groupBy("host").agg(F.count(F.lit(1)).alias("all"), *(_count(c("status") == s).alias(s) for s in ("answered", "weak", "missing")))
    x = hosts.join(sums, "host", "left")
    none = c("all").isNull()
    state = F.when(none, F.when(c("live"), "running").otherwise("skipped")).when(c("missing") > 0, "fail").when(c("weak") > 0, "partial").otherwise("pass")
    rows = x.select("host", F.lit("retrieval").alias("stage"), state.alias("state"), c("answered").alias("n"), c("all").alias("of"), _share(c("answered"), c("all")).alias("coverage"))
    words = hits.where("status <> 'answered'").select("host", F.explode("missing_terms").alias("term")).where(F.length("term") > 2).groupBy("host", "term").agg(F.count(F.lit(1)).alias("times"))
    wanted = _first(words, [F.desc("times"), "term"], 8).groupBy("host").agg(F.array_sort(F.collect_list(F.struct("sort", "term", "times"))).alias("w"))
    listed = F.array_join(F.transform("w", lambda w: F.concat(w.term, F.lit(" "), w.times.cast("string"))), ", ")
    none_asked = x.where(none & ~c("live"))
    of = lambda df, code, subject, base: df.select("host", F.lit("retrieval").alias("stage"), F.lit(code).alias("code"), F.lit("high").alias("severity"), subject.alias("subject"), F.lit(None).alias("n"), (c("sort") + base).alias("sort"))
    gaps = [
        of(_first(hits.where("status = 'missing'"), ["query_id"], LISTED), "no-page", c("query"), 0),
        of(_first(hits.where("lost"), ["query_id"], LISTED), "rival-first", F.concat_ws(" ", "rival", "query"), 10),
        wanted.select("host", F.lit("retrieval").alias("stage"), F.lit("wanted-words").alias("code"), F.lit("medium").alias("severity"), listed.alias("subject"), F.lit(None).alias("n"), F.lit(100).alias("sort")),
        none_asked.select("host", F.lit("retrieval").alias("stage"), F.lit("not-measured").alias("code"), F.lit("medium").alias("severity"), F.lit("").alias("subject"), F.lit(None).alias("n"), F.lit(0).alias("sort")),
    ]
    return _shaped(rows, _ROW), _union([_shaped(g, _GAP) for g in gaps])


def fanout_stage(hosts: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``queries``: host, type, status, mentioned, cited, searched (whether the engine searched live); n of those asked reached the site."""
    c, ok = F.col, F.col("status") == "ok"
    reached = F.coalesce("mentioned", F.lit(False)) | F.coalesce("cited", F.lit(False))
    asked = queries.where(ok)
    sums = asked.groupBy("host").agg(F.count(F.lit(1)).alias("asked"), _count(reached).alias("reached"), _count(c("cited")).alias("cited"), F.bool_or(F.coalesce("searched", F.lit(False))).alias("searched"))
    x = hosts.join(sums, "host", "left")
    none = c("asked").isNull()
    share = _share(c("reached"), c("asked"))
    state = F.when(none, F.when(c("live"), "running").otherwise("skipped")).when(share >= 60, "pass").when(share > 0, "partial").otherwise("fail")
    rows = x.select("host", F.lit("fanout").alias("stage"), state.alias("state"), c("reached").alias("n"), c("asked").alias("of"), share.alias("coverage"))
    kinds = asked.groupBy("host", "type").agg(F.count(F.lit(1)).alias("n"), _count(reached).alias("hits")).where("hits = 0")
    gap = lambda df, code, severity: df.select("host", F.lit("fanout").alias("stage"), F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit("").alias("subject"), F.lit(None).alias("n"), F.lit(100).alias("sort"))
    gaps = [
        kinds.select("host", F.lit("fanout").alias("stage"), F.lit("absent-kind").alias("code"), F.when(c("type").isin(*KEY_KINDS), "high").otherwise("medium").alias("severity"), c("type").alias("subject"), "n", F.lit(0).alias("sort")),
        gap(x.where(~none & (c("cited") == 0) & c("searched")), "never-a-source", "high"), gap(x.where(none & ~c("live")), "not-measured", "medium"),
    ]
    return _shaped(rows, _ROW), _union([_shaped(g, _GAP) for g in gaps])


def answers_stage(hosts: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``counts``: ``answer_counts`` with wrong, skipped (statements against the site's pages, questions not asked) and searched."""
    c = F.col
    x = hosts.join(counts, "host", "left")
    none = F.coalesce("measured", F.lit(0)) == 0
    n, of = c("category_mentions"), c("category_measured")
    state = F.when(none, F.when(c("live"), "running").otherwise("skipped")).when(of == 0, "skipped").when(n == 0, "fail").when(n < of, "partial").otherwise("pass")
    rows = x.select("host", F.lit("answers").alias("stage"), state.alias("state"), F.when(~none, n).alias("n"), F.when(~none, of).alias("of"), F.when(~none, _share(n, of)).alias("coverage"))
    rules = (
        (none & ~c("live"), "not-measured", "high", F.lit(None)), (~none & (n == 0), "never-named", "high", of), (~none & (c("citations") == 0) & (c("grounded_measured") > 0), "never-cited", "high", c("grounded_measured")),
        (~none & (c("wrong") > 0), "wrong-statements", "high", c("wrong")), (~none & (c("skipped") > 0), "not-asked", "low", c("skipped")), (~none & ~F.coalesce("searched", F.lit(True)), "no-live-search", "medium", F.lit(None)),
    )
    found = F.array_compact(F.array(*(F.when(cond, F.struct(F.lit(code).alias("code"), F.lit(s).alias("severity"), k.cast("long").alias("n"), F.lit(i).alias("sort"))) for i, (cond, code, s, k) in enumerate(rules))))
    return _shaped(rows, _ROW), _shaped(x.select("host", F.lit("answers").alias("stage"), F.lit("").alias("subject"), F.inline(found)), _GAP)


def fixes_stage(hosts: DataFrame, actions: DataFrame) -> DataFrame:
    """``actions``: host, priority; n of its tasks are pressing."""
    c = F.col
    x = hosts.join(actions.groupBy("host").agg(_count(c("priority") == "high").alias("high"), F.count(F.lit(1)).alias("all")), "host", "left")
    state = F.when(c("all").isNull(), F.when(c("live"), "running").otherwise("pass")).when(c("high") > 0, "partial").otherwise("pass")
    return _shaped(x.select("host", F.lit("fixes").alias("stage"), state.alias("state"), c("high").alias("n"), c("all").alias("of"), F.lit(None).alias("coverage")), _ROW)


def stage_board(hosts: DataFrame, checks: DataFrame, probes: DataFrame, citability: DataFrame, hits: DataFrame, fanout: DataFrame, counts: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stages, gaps): nine rows for each of ``hosts`` (host, live, pages; null pages: not fetched), and all that is missing, worst first.

    stages: host, no, stage, state (pass, partial, fail, running, skipped), n, of, coverage, gaps. A stage that passed but has
    a gap is partial. gaps: host, rank, stage, severity, code, subject, n; ties in the order of the stages. The other tables
    are those of the stage functions here; one without rows of a host leaves that stage running while the host is live, else
    skipped.
    """
    hosts = hosts.select("host", F.coalesce("live", F.lit(False)).alias("live"), "pages")
    both = [check_stages(hosts, checks, probes), citability_stage(hosts, citability), retrieval_stage(hosts, hits), fanout_stage(hosts, fanout), answers_stage(hosts, counts)]
    # a gap counts for the hosts asked about only
    gaps = _union([g for _, g in both]).join(hosts.select("host"), "host", "left_semi")
    number = lambda name, of: F.array_position(F.array(*map(F.lit, of)), F.col(name)).cast("int")
    counted = gaps.groupBy("host", "stage").agg(F.count(F.lit(1)).cast("int").alias("gaps"))
    rows = _union([r for r, _ in both] + [fixes_stage(hosts, actions)]).join(counted, ["host", "stage"], "left").withColumn("gaps", F.coalesce("gaps", F.lit(0)))
    state = F.when((F.col("state") == "pass") & (F.col("gaps") > 0), "partial").otherwise(F.col("state"))
    stages = rows.select("host", number("stage", STAGES).alias("no"), "stage", state.alias("state"), "n", "of", "coverage", "gaps")
    order = Window.partitionBy("host").orderBy(number("severity", SEVERITIES), number("stage", STAGES), "sort", "code", "subject")
    return stages, gaps.select("host", F.row_number().over(order).alias("rank"), "stage", "severity", "code", "subject", "n")


def board_totals(stages: DataFrame) -> DataFrame:
    """(host, ran, total): how many stages gave a measurement."""
    ran = ~F.col("state").isin("running", "skipped")
    return stages.groupBy("host").agg(F.sum(ran.cast("int")).cast("int").alias("ran"), F.count(F.lit(1)).cast("int").alias("total"))


# ---------------------------------------------------------------- rivals


def takeaways(market: DataFrame, columns: DataFrame, layers: DataFrame, winners: DataFrame) -> DataFrame:
    """(market, no, code, rivals, theirs, mine, layer, gap, n): what the first site of each market should learn from the others.

    ``market``: market, pos, host, the site in question first. ``columns``: host, measured, readiness, reach, citability,
    llms_txt. ``layers``: host, layer, score. ``winners``: market, query_id, query, winner. readiness, reach and citability
    name the rivals ahead, in their order, the first one's value beside one's own and, for readiness, the layer in which the
    first one's lead is widest (none where it leads in no layer); a rival's value counts as ahead of one that wasn't measured.
    questions: n of those asked are won by others, the first three in rivals; llms-txt: who has the file. leads: nothing of
    that. A market whose first site, or every rival, wasn't measured has no row.
    """
    c = F.col
    sites = market.join(columns.where("measured"), "host")
    mine = sites.where("pos = 1").select("market", c("host").alias("me"), *(c(x).alias(f"my_{x}") for x in ("readiness", "reach", "citability", "llms_txt")))
    rivals = sites.where("pos > 1").join(mine, "market")
    ahead = lambda x: F.coalesce(c(x), F.lit(-1)) > F.coalesce(c(f"my_{x}"), F.lit(-1))
    listed = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("pos", "host")))), lambda r: r.host)
    first = lambda cond, x: F.min_by(F.when(cond, c(x)), F.when(cond, c("pos")))
    measures = ("readiness", "reach", "citability")
    seen = rivals.groupBy("market", "me", *(f"my_{x}" for x in (*measures, "llms_txt"))).agg(
        *(listed(ahead(x)).alias(x) for x in measures), *(first(ahead(x), x).alias(f"first_{x}") for x in measures), listed(c("llms_txt")).alias("with_file")
    )
    leader = seen.where(F.size("readiness") > 0).select("market", "me", F.get("readiness", F.lit(0)).alias("host"))
    score = lambda of: F.coalesce(of, F.lit(0))
    widest = leader.join(layers, "host").join(layers.select(c("host").alias("me"), "layer", c("score").alias("own")), ["me", "layer"], "left").groupBy("market").agg(
        F.max_by(F.struct("layer", (score("score") - score("own")).alias("gap")), F.struct(score("score") - score("own"), -F.array_position(F.array(*map(F.lit, ("access", "content", "entity", "agent"))), c("layer")))).alias("wide")
    )
    won = winners.join(mine.select("market", "me"), "market").groupBy("market").agg(
        F.count(F.lit(1)).alias("asked"), _count(c("winner") != c("me")).alias("lost"),
        F.transform(F.slice(F.array_sort(F.collect_list(F.when(c("winner") != c("me"), F.struct("query_id", "query", "winner")))), 1, 3), lambda q: F.concat(q.query, F.lit(" — "), q.winner)).alias("questions"),
    )
    x = seen.join(widest, "market", "left").join(won, "market", "left")
    row = lambda code, who, theirs=None, own=None, layer=None, gap=None, n=None: F.struct(
        F.lit(code).alias("code"), who.alias("rivals"), *(F.lit(v).cast("long").alias(k) if v is None else v.cast("long").alias(k) for k, v in (("theirs", theirs), ("mine", own))),
        (F.lit(None).cast("string") if layer is None else layer).alias("layer"), *(F.lit(v).cast("long").alias(k) if v is None else v.cast("long").alias(k) for k, v in (("gap", gap), ("n", n))),
    )
    wide = c("wide.gap") > 0
    rules = F.array_compact(F.array(
        F.when(F.size("readiness") > 0, row("readiness", c("readiness"), c("first_readiness"), c("my_readiness"), F.when(wide, c("wide.layer")), F.when(wide, c("wide.gap")))),
        F.when(F.size("reach") > 0, row("reach", c("reach"), c("first_reach"), c("my_reach"))),
        F.when(F.size("citability") > 0, row("citability", c("citability"), c("first_citability"), c("my_citability"))),
        F.when(c("lost") > 0, row("questions", c("questions"), c("asked"), None, None, None, c("lost"))),
        F.when(~F.coalesce("my_llms_txt", F.lit(False)) & (F.size("with_file") > 0), row("llms-txt", c("with_file"))),
    ))
    rules = F.when(F.size(rules) > 0, rules).otherwise(F.array(row("leads", F.array().cast("array<string>"))))
    return x.select("market", F.posexplode(rules).alias("at", "r")).select("market", (c("at") + 1).alias("no"), "r.*")
