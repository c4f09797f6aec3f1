"""One page's report: what it answers of a question, and what keeps engines from using it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import js_round
from .access import SEARCH_BOTS, snippet_controls
from .retrieval import K1, query_terms, verdict

#: Faulty nodes that a report names, the citability below which it speaks, and the shortest quote that is no grave limit.
SHOWN_NODES, LOW_CITABILITY, SHORT_QUOTE = 4, 50, 50


def page_question_match(pairs: DataFrame, queries: DataFrame, index: DataFrame) -> DataFrame:
    """(page_id, query_id, score, coverage, status, missing_terms) of ``pairs`` (page_id, query_id): each page is an index of its own.

    ``queries``: query_id, query; ``index``: postings. In an index of one page a term's weight is fixed and the page has
    the mean length. A page without any of the words, or that isn't indexed, is missing; so is a query without words.
    """
    asked = pairs.join(query_terms(queries), "query_id", "left")
    hit = asked.join(index.where("term IS NOT NULL").select("page_id", "term", "tf"), ["page_id", "term"], "left")
    idf = F.log(F.lit(0.5 / 1.5 + 1))
    rows = hit.groupBy("page_id", "query_id").agg(
        F.sum(idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1)).alias("score"), F.first("tokens").alias("tokens"),
        F.collect_set(F.when(F.col("tf").isNotNull(), F.col("token"))).alias("found"),
    )
    coverage = F.coalesce(F.size("found") / F.nullif(F.size("tokens"), F.lit(0)), F.lit(0.0))
    none = F.array().cast("array<string>")
    return rows.select(
        "page_id", "query_id", js_round(F.coalesce("score", F.lit(0.0)), 2).alias("score"), js_round(coverage, 2).alias("coverage"), verdict(coverage).alias("status"),
        F.coalesce(F.filter("tokens", lambda t: ~F.array_contains("found", t)), none).alias("missing_terms"),
    )


def page_report(signals: DataFrame, node_checks: DataFrame, citability: DataFrame, crawlers: DataFrame | None = None, match: DataFrame | None = None) -> DataFrame:
    """A row per page of ``signals``: its signals, controls, faulty nodes, search crawlers kept out, citability and question match.

    ``signals`` may have status and x_robots_tag. ``crawlers``: ``crawler_rows``; ``match``: ``page_question_match`` of one
    question a page. Both may be left out.
    """
    for name, kind in (("status", "int"), ("x_robots_tag", "string")):
        if name not in signals.columns:
            signals = signals.withColumn(name, F.lit(None).cast(kind))
    kept = signals.select("page_id", "url", "host", "status", "title", "description", "words", "app_shell", "nosnippet_blocks", "jsonld_errors", "jsonld_types")
    faulty = node_checks.where(~F.col("ok")).groupBy("page_id").agg(
        F.slice(F.array_sort(F.collect_list(F.struct("no", "type", "label", "missing_required", "problems"))), 1, SHOWN_NODES).alias("faulty_nodes")
    )
    out = kept.join(snippet_controls(signals), "page_id").join(citability.select("page_id", F.col("score").alias("citability")), "page_id", "left")
    out = out.join(faulty, "page_id", "left")
    if crawlers is None:
        out = out.withColumn("search_kept_out", F.array().cast("array<string>"))
    else:
        kept_out = crawlers.where(F.col("token").isin(*SEARCH_BOTS) & ~F.col("reaches")).groupBy("page_id").agg(F.array_sort(F.collect_set("token")).alias("search_kept_out"))
        out = out.join(kept_out, "page_id", "left")
    asked = ("match_status", "match_coverage", "match_missing")
    if match is None:
        return out.withColumns({n: F.lit(None).cast(t) for n, t in zip(asked, ("string", "double", "array<string>"))})
    return out.join(match.select("page_id", *(F.col(c).alias(n) for c, n in zip(("status", "coverage", "missing_terms"), asked))), "page_id", "left")


def page_findings(report: DataFrame) -> DataFrame:
    """(page_id, rank, severity, code, detail) of ``page_report``: the worst first, then in the order of the rules."""
    c = F.col
    text = lambda x: F.coalesce(x.cast("string"), F.lit(""))

    def rule(cond, severity, code, detail=F.lit("")):
        severity = F.lit(severity) if isinstance(severity, str) else severity
        return F.when(cond, F.struct(severity.alias("severity"), F.lit(code).alias("code"), text(detail).alias("detail")))

    capped = ~c("nosnippet") & (c("max_snippet") >= 0)
    node = lambda n: F.struct(
        F.lit("medium").alias("severity"), F.lit("faulty-node").alias("code"),
        F.concat(n.type, F.when(n.label != "", F.concat(F.lit(" "), n.label)).otherwise(""), F.lit(": "), F.array_join(F.concat(
            F.when(F.size(n.missing_required) > 0, F.array(F.concat(F.lit("missing "), F.array_join(n.missing_required, ", ")))).otherwise(F.array().cast("array<string>")), n.problems
        ), "; ")).alias("detail"),
    )
    before = F.array(
        rule(c("status") >= 400, "high", "status", c("status")), rule(c("noindex"), "high", "noindex", c("source")),
        rule(F.size(F.coalesce("search_kept_out", F.array().cast("array<string>"))) > 0, "high", "crawlers-kept-out", F.array_join("search_kept_out", ", ")),
        rule(c("app_shell"), "high", "app-shell", c("words")), rule(c("nosnippet"), "high", "nosnippet"),
        rule(capped, F.when(c("max_snippet") < SHORT_QUOTE, "high").otherwise("medium"), "max-snippet", c("max_snippet")),
        rule((c("nosnippet_blocks") > 0) & ~c("nosnippet"), "low", "data-nosnippet", c("nosnippet_blocks")),
        rule(c("canonical_elsewhere"), "medium", "canonical-elsewhere"), rule(c("title") == "", "medium", "no-title"),
        rule(c("description") == "", "low", "no-description"),
    )
    after = F.array(
        rule(c("jsonld_errors") > 0, "medium", "jsonld-errors", c("jsonld_errors")), rule(F.size("jsonld_types") == 0, "low", "no-structured-data"),
        rule(c("match_status") != "answered", F.when(c("match_status") == "missing", "high").otherwise("medium"), "question", F.array_join("match_missing", ", ")),
        rule((c("citability") < LOW_CITABILITY) & ~c("app_shell"), "medium", "citability", c("citability")),
    )
    kind = "array<struct<severity:string,code:string,detail:string>>"
    nodes = F.coalesce(F.transform("faulty_nodes", node), F.array().cast(kind))
    found = report.select("page_id", F.posexplode(F.concat(F.array_compact(before), nodes, F.array_compact(after))).alias("no", "f")).select("page_id", "no", "f.*")
    # one page's findings: eighteen at most
    order = Window.partitionBy("page_id").orderBy(F.when(c("severity") == "high", 0).when(c("severity") == "medium", 1).otherwise(2), "no")
    return found.select("page_id", F.row_number().over(order).alias("rank"), "severity", "code", "detail")
