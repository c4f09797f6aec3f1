"""What crawlers may and can fetch: bot probes, snippet controls, reach, sitemaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import host_of, part, resolve_link

# Crawlers that fetch for a question asked now, and those that gather training data.
SEARCH_BOTS = (
    "OAI-SearchBot", "ChatGPT-User", "PerplexityBot", "Perplexity-User", "Claude-SearchBot", "Claude-User", "Googlebot", "Bingbot",
)
TRAINING_BOTS = ("GPTBot", "ClaudeBot", "Google-Extended", "Applebot-Extended", "CCBot", "meta-externalagent")
CRITICAL_BOTS = ("OAI-SearchBot", "PerplexityBot", "Googlebot", "Bingbot")
# How a challenge page reads.
CHALLENGE = r"(?i)cf-chl|challenge-platform|just a moment\.\.\.|attention required|captcha|access denied"


def bots(spark: SparkSession) -> DataFrame:
    """(token, kind) of the known crawlers; 14 rows."""
    rows = [(t, "search") for t in SEARCH_BOTS] + [(t, "training") for t in TRAINING_BOTS]
    return spark.createDataFrame(rows, "token string, kind string")


def probe_class(probes: DataFrame) -> DataFrame:
    """``probes`` (status, body, error, more) with blocked and inconclusive.

    A challenge page or a status of 400 and above is a block; a timeout decides nothing; any other failure is a block.
    """
    challenge = F.substring(F.coalesce("body", F.lit("")), 1, 20000).rlike(CHALLENGE)
    timed_out = F.coalesce("error", F.lit("")).rlike("(?i)timed out|timeout|aborted")
    blocked = F.when(F.col("status").isNull(), ~timed_out).otherwise((F.col("status") >= 400) | challenge)
    return probes.withColumn("blocked", blocked).withColumn("inconclusive", F.col("status").isNull() & timed_out)


def snippet_controls(pages: DataFrame) -> DataFrame:
    """(page_id, noindex, nosnippet, max_snippet, noai, source, canonical_elsewhere) of ``pages``
    (page_id, url, meta_robots, x_robots_tag, canonical)."""
    meta, header = (F.lower(F.coalesce(c, F.lit(""))) for c in ("meta_robots", "x_robots_tag"))
    every = F.concat_ws(", ", meta, header)
    target = resolve_link(F.col("url"), F.col("canonical"))
    key = lambda u: F.concat(host_of(u), F.regexp_replace(F.coalesce(part(u, "PATH"), F.lit("")), "/+$", ""))
    return pages.select(
        "page_id", every.rlike(r"\b(noindex|none)\b").alias("noindex"), every.rlike(r"\b(nosnippet|none)\b").alias("nosnippet"),
        F.regexp_extract(every, r"max-snippet\s*:\s*(-?\d+)", 1).try_cast("int").alias("max_snippet"), every.rlike(r"\bnoai\b").alias("noai"),
        F.array_join(F.array_compact(F.array(F.when(meta != "", "meta robots"), F.when(header != "", "X-Robots-Tag header"))), " and ").alias("source"),
        F.coalesce((F.coalesce("canonical", F.lit("")) != "") & (key(target) != key(F.col("url"))), F.lit(False)).alias("canonical_elsewhere"),
    )


def crawler_rows(verdicts: DataFrame, files: DataFrame, probes: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, host, token, robots, live_status, reaches): what each crawler may and can fetch.

    ``verdicts`` (page_id, token, allowed); ``files`` (host, body), no row without a robots file; ``probes``
    (host, token, status, blocked), at most one a crawler; ``pages`` (page_id, host).
    """
    known = files.where("body is not null").select("host", F.lit(True).alias("has_file")).distinct()
    live = probes.select("host", "token", F.col("status").alias("live_status"), F.col("blocked").alias("live_blocked"))
    rows = verdicts.join(pages.select("page_id", "host"), "page_id").join(known, "host", "left").join(live, ["host", "token"], "left")
    robots = F.when(F.col("has_file").isNull(), "no-file").when(F.col("allowed"), "allowed").otherwise("blocked")
    return rows.select(
        "page_id", "host", "token", robots.alias("robots"), "live_status",
        ((robots != "blocked") & ~F.coalesce("live_blocked", F.lit(False))).alias("reaches"),
    )


def search_reach(rows: DataFrame) -> DataFrame:
    """(page_id, search_reach) of ``crawler_rows``: how many of the search crawlers get the page."""
    return rows.groupBy("page_id").agg(F.sum((F.col("token").isin(*SEARCH_BOTS) & F.col("reaches")).cast("int")).cast("int").alias("search_reach"))


def sitemap_state(files: DataFrame) -> DataFrame:
    """(host, state) of ``files`` (host, status, urls, referenced): ok, unreferenced, invalid or missing."""
    served = F.coalesce(F.col("status") == 200, F.lit(False))
    listed = served & (F.coalesce("urls", F.lit(0)) > 0)
    state = F.when(listed & F.coalesce("referenced", F.lit(False)), "ok").when(listed, "unreferenced").when(served | (F.col("status") == 422), "invalid")
    return files.select("host", state.otherwise("missing").alias("state"))


def access_checks(home: DataFrame, probes: DataFrame, files: DataFrame) -> DataFrame:
    """(host, check_id, layer, weight, status, earned): what robots files, probes and host files decide.

    ``home``: host, token, allowed at ``/`` of each known crawler. ``probes``: host, blocked, inconclusive of AI
    crawlers. ``files``: host, kind (robots, sitemap, llms, llms-full), status, body, urls, referenced.
    """
    no = lambda tokens: F.sum((F.col("token").isin(*tokens) & ~F.col("allowed")).cast("int"))
    by_robots = home.groupBy("host").agg(no(CRITICAL_BOTS).alias("critical"), no(SEARCH_BOTS).alias("search"), no(TRAINING_BOTS).alias("training"))
    by_probe = probes.groupBy("host").agg(F.bool_or("blocked").alias("any_blocked"), F.bool_or("inconclusive").alias("any_unclear"))
    first = lambda kind, c: F.min(F.when(F.col("kind") == kind, F.col(c)))
    body = F.coalesce("body", F.lit(""))
    linked = (F.col("kind") == "llms") & (F.col("status") == 200) & body.rlike(r"(?m)^#\s+\S") & body.rlike(r"\]\(https?://")
    ok_map = (F.col("kind") == "sitemap") & (F.col("status") == 200) & (F.coalesce("urls", F.lit(0)) > 0)
    by_file = files.groupBy("host").agg(
        first("robots", "status").alias("robots"), first("llms", "status").alias("llms"), first("llms-full", "status").alias("full"),
        F.bool_or(linked).alias("llms_valid"), F.bool_or(ok_map).alias("map_ok"),
        F.bool_or(ok_map & F.coalesce("referenced", F.lit(False))).alias("map_named"),
    )
    f = by_robots.join(by_probe, "host", "left").join(by_file, "host", "left")
    c, yes = F.col, lambda name: F.coalesce(F.col(name), F.lit(False))
    is_ = lambda name, v: F.coalesce(F.col(name) == v, F.lit(False))
    three = lambda ok, some: F.when(ok, "pass").when(some, "warn").otherwise("fail")
    rows = (
        ("search-crawlers", "access", 10, F.when(c("critical") > 0, "fail").when(c("search") > 0, "warn").otherwise("pass")),
        ("training-crawlers", "access", 3, three(c("training") == 0, c("training") < 3)),
        ("firewall", "access", 10, F.when(c("any_blocked").isNull(), "na").when(c("any_blocked"), "fail").when(yes("any_unclear"), "warn").otherwise("pass")),
        ("robots-file", "access", 2, three(is_("robots", 200), is_("robots", 404))),
        ("sitemap", "access", 4, three(yes("map_named"), yes("map_ok"))),
        ("llms-txt", "agent", 6, three(yes("llms_valid"), is_("llms", 200))),
        ("llms-full", "agent", 1, F.when(is_("full", 200), "pass").otherwise("warn")),
    )
    listed = F.inline(F.array(*(F.struct(F.lit(i).alias("check_id"), F.lit(layer).alias("layer"), F.lit(w).alias("weight"), s.alias("status")) for i, layer, w, s in rows)))
    earned = F.when(c("status") == "pass", c("weight") * 1.0).when(c("status") == "warn", c("weight") * 0.5).otherwise(0.0)
    return f.select("host", listed).withColumn("earned", earned)
