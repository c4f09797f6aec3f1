"""Brands in answers, and roll-ups of sub-queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import compact, js_round


def brand_needles(brand: Column, aliases: Column, host: Column) -> Column:
    """What names a brand in compacted text: brand, aliases, host stem and host, four characters and more."""
    all_ = F.concat(F.array(brand), F.coalesce(aliases, F.array().cast("array<string>")), F.array(F.substring_index(host, ".", 1), host))
    return F.array_distinct(F.filter(F.transform(all_, compact), lambda n: F.length(n) >= 4))


def mentions(text: Column, needles: Column) -> Column:
    return F.exists(needles, lambda n: F.contains(compact(text), n))


def brand_hits(answers: DataFrame, brands: DataFrame) -> DataFrame:
    """(answer_id, brand, position) of ``answers`` (answer_id, text) that name a brand of ``brands`` (brand, needles of four characters and more).

    position: rank of the first top-level list item whose head names it; null outside lists. An answer meets only the brands
    that share the first four characters of a needle with it, so no answer is held against all brands.
    """
    squeezed = answers.where("text IS NOT NULL").select("answer_id", compact(F.col("text")).alias("squeezed")).where(F.length("squeezed") >= 4)
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("squeezed") - 3), lambda i: F.substring("squeezed", i, 4)))
    keys = brands.select("brand", F.explode("needles").alias("needle")).where(F.length("needle") >= 4).select("brand", "needle", F.substring("needle", 1, 4).alias("start")).distinct()
    met = squeezed.select("answer_id", "squeezed", F.explode(grams).alias("start")).join(keys, "start").where(F.contains("squeezed", "needle")).select("answer_id", "brand").distinct()
    needles = brands.groupBy("brand").agg(F.array_distinct(F.flatten(F.collect_list("needles"))).alias("needles"))
    rows = answers.select("answer_id", _item_heads(F.col("text")).alias("heads")).join(met, "answer_id").join(needles, "brand")
    named = F.transform("heads", lambda h: F.exists("needles", lambda n: F.contains(h, n)))
    return rows.select("answer_id", "brand", F.nullif(F.array_position(named, True), F.lit(0)).cast("int").alias("position"))


def _item_heads(text: Column) -> Column:
    """The heads of a text's top-level list items and small headings, compacted, in their order."""
    item = lambda line: F.coalesce(
        F.nullif(F.regexp_extract(line, r"^(?:\d+[.)]|[-*•])\s+(.*)$", 1), F.lit("")),
        F.nullif(F.regexp_extract(line, r"^#{2,4}\s+(?:\d+[.)]\s*)?(.*)$", 1), F.lit("")),
    )
    top = F.filter(F.split(text, "\r?\n", -1), lambda line: ~line.rlike(r"^\s{2,}"))
    return F.transform(F.array_compact(F.transform(top, item)), lambda i: compact(F.get(F.split(i, r":|–|—|\s-\s", -1), F.lit(0))))


def answer_counts(answers: DataFrame) -> DataFrame:
    """Per host of ``answers`` (host, kind, status, mentioned, cited, grounded, position): what was measured and met, and the mean position to one decimal.

    Without a position column there is no mean.
    """
    ok, yes = F.col("status") == "ok", lambda c: F.coalesce(F.col(c), F.lit(False))
    n = lambda cond: F.sum(F.coalesce(cond, F.lit(False)).cast("int")).cast("int")
    open_, grounded = ok & (F.col("kind") != "branded"), ok & yes("grounded")
    position = F.col("position") if "position" in answers.columns else F.lit(None).cast("double")
    return answers.groupBy("host").agg(
        n(ok).alias("measured"), n(ok & yes("mentioned")).alias("mentions"), n(open_).alias("category_measured"), n(open_ & yes("mentioned")).alias("category_mentions"),
        n(grounded & yes("cited")).alias("citations"), n(grounded).alias("grounded_measured"), js_round(F.avg(F.when(ok, position)), 1).alias("average_position"),
    )


def visibility_score(answers: DataFrame) -> DataFrame:
    """(host, measured, score) of ``answers`` (host, kind, status, mentioned, cited, grounded), by ``answer_counts``.

    0.6 unbranded mentions, 0.2 branded, 0.2 citations of grounded answers, with sources or without; weights renormalised
    over what was measured; null if nothing was.
    """
    c = F.col
    share = lambda hit, of: hit / F.nullif(of, F.lit(0))
    parts = answer_counts(answers).select(
        "host", "measured", share(c("category_mentions"), c("category_measured")).alias("u"),
        share(c("mentions") - c("category_mentions"), c("measured") - c("category_measured")).alias("b"), share(c("citations"), c("grounded_measured")).alias("c"),
    )
    weigh = lambda name, w: F.when(c(name).isNotNull(), w).otherwise(0.0)
    total = weigh("u", 0.6) + weigh("b", 0.2) + weigh("c", 0.2)
    summed = sum((F.coalesce(c(name), F.lit(0.0)) * w for name, w in (("u", 0.6), ("b", 0.2), ("c", 0.2))), F.lit(0.0))
    return parts.select("host", "measured", F.when(total > 0, js_round(100 * summed / total)).cast("int").alias("score"))


def issued_queries(rows: DataFrame) -> DataFrame:
    """(key, query): queries of ``rows`` (ordinal, query), white space tidied, the first spelling of each."""
    tidy = F.trim(F.regexp_replace("query", r"\s+", " "))
    return rows.select("ordinal", tidy.alias("query")).where("query <> ''").groupBy(F.lower("query").alias("key")).agg(
        F.min_by("query", F.struct("ordinal", "query")).alias("query")
    )


def fanout_coverage(best: DataFrame) -> DataFrame:
    """(answered, weak, missing, coverage) over ``best`` pages of sub-queries."""
    n = lambda s: F.sum((F.col("status") == s).cast("int"))
    return best.agg(
        n("answered").alias("answered"), n("weak").alias("weak"), n("missing").alias("missing"),
        js_round(100 * n("answered") / F.nullif(F.count(F.lit(1)), F.lit(0))).cast("int").alias("coverage"),
    )
