"""How quotable a page is: seven checks, 100 points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import DANGLING, DEFINES, MAX_LIFT, MIN_LIFT, ascii_edges, fact_count, is_liftable, js_round, word_count


def passage_flaws(signals: DataFrame) -> DataFrame:
    """(page_id, liftable, short, long, dangling): why passages can't be lifted."""
    n = lambda keep: F.size(F.filter("passages", keep))
    return signals.select(
        "page_id", n(is_liftable).alias("liftable"), n(lambda p: word_count(p) < MIN_LIFT).alias("short"),
        n(lambda p: word_count(p) > MAX_LIFT).alias("long"),
        n(lambda p: word_count(p).between(MIN_LIFT, MAX_LIFT) & p.rlike(ascii_edges(DANGLING))).alias("dangling"),
    )


def page_citability(signals: DataFrame) -> DataFrame:
    """Points per check and their sum; 0 for an app shell, null where structure was not read.

    ``signals`` may lack has_date, has_author and jsonld_types; these then count as absent.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in signals.columns else F.lit(False)
    typed = (F.size("jsonld_types") > 0) if "jsonld_types" in signals.columns else F.lit(False)
    read = F.col("structure_read") if "structure_read" in signals.columns else F.lit(True)
    words = word_count(F.col("lead"))
    defines = words.between(12, 90) & ~F.col("lead").rlike(ascii_edges(DANGLING)) & F.get(F.split("lead", "[.!?]", -1), F.lit(0)).rlike(ascii_edges(DEFINES))
    facts = fact_count(F.col("excerpt"))
    out = signals.select(
        "page_id", "host", read.alias("_read"), F.col("app_shell").alias("_shell"),
        F.size(F.filter("passages", is_liftable)).alias("liftable"), facts.alias("facts_found"),
        F.when(defines, 20).when(words >= 12, 8).otherwise(0).alias("lead"),
        F.least(F.lit(20), 5 * F.size(F.filter("passages", is_liftable))).alias("passages"),
        F.when(facts >= 6, 15).when(facts >= 3, 10).when(facts >= 1, 5).otherwise(0).alias("facts"),
        F.when(F.col("tables") > 0, 15).when(F.col("lists") >= 2, 12).when(F.col("lists") == 1, 8).otherwise(0).alias("structure"),
        F.when(F.col("question_headings") >= 2, 10).when(F.col("question_headings") >= 1, 6).otherwise(0).alias("questions"),
        (F.when(flag("has_date"), 5).otherwise(0) + F.when(flag("has_author"), 5).otherwise(0)).alias("provenance"),
        F.when(typed, 10).otherwise(0).alias("schema"),
    )
    total = sum((F.col(c) for c in ("lead", "passages", "facts", "structure", "questions", "provenance", "schema")), F.lit(0))
    return out.withColumn("score", F.when(~F.col("_read"), None).when(F.col("_shell"), 0).otherwise(total)).drop("_read", "_shell")


def best_passage(signals: DataFrame) -> DataFrame:
    """(page_id, passage): the liftable passage with most facts (the first of them), else the first passage."""
    rated = F.transform(F.filter("passages", is_liftable), lambda p: fact_count(p))
    first = F.array_position(rated, F.array_max(rated))
    return signals.select("page_id", F.coalesce(
        F.when(F.size(rated) > 0, F.get(F.filter("passages", is_liftable), (first - 1).cast("int"))), F.get("passages", F.lit(0))
    ).alias("passage"))


def host_citability(pages: DataFrame) -> DataFrame:
    """(host, score, measured, unmeasured): rounded mean over the pages that could be scored."""
    return pages.groupBy("host").agg(
        js_round(F.avg("score")).cast("int").alias("score"), F.count("score").alias("measured"),
        F.sum(F.col("score").isNull().cast("int")).alias("unmeasured"),
    )


# The checks in their order and what each can give.
POSSIBLE = (("lead", 20), ("passages", 20), ("facts", 15), ("structure", 15), ("questions", 10), ("provenance", 10), ("schema", 10))
#: What to do next, by code.
ADVICE = {
    "render": "Put the text into the source that the server sends; readers without scripts find nothing to quote.",
    "lead": "Begin with one short sentence that says what the page is about and for whom.",
    "passages-none": "Write paragraphs of 40 to 80 words; headings and labels alone can't be quoted.",
    "passages-short": "Let each short line grow into a paragraph of 40 to 80 words with one whole statement.",
    "passages-long": "Cut long paragraphs into ones of 40 to 80 words with one statement each.",
    "passages-dangling": "Name the subject at the start of each paragraph, so that it can stand alone.",
    "facts": "Say it in numbers: prices, limits, times, counts, dates.", "structure": "Use lists or tables for steps, plans and comparisons.",
    "questions": "Call the main sections by the questions people ask, and answer in the first sentence.",
    "provenance": "Mark who wrote the page and when it was last changed.", "schema": "Describe the page in structured data.", "none": "Nothing is missing.",
}


def next_step(points: DataFrame, flaws: DataFrame, signals: DataFrame) -> DataFrame:
    """(page_id, code, lost, advice): what would gain each page most, by ``page_citability``, ``passage_flaws`` and its signals.

    The check that loses most points, the earlier one of equals; passages are told apart by their commonest flaw, short
    before long before dangling ones. A page without text has ``render``, one without a loss ``none``; a page without a
    score has no row.
    """
    shells = signals.select("page_id", "app_shell", F.size("passages").alias("_passages"))
    x = points.where("score IS NOT NULL").join(flaws.select("page_id", "short", "long", "dangling"), "page_id").join(shells, "page_id")
    losses = F.array(*(F.struct((most - F.col(c)).alias("lost"), F.lit(-i).alias("no"), F.lit(c).alias("code")) for i, (c, most) in enumerate(POSSIBLE)))
    worst = F.array_max(losses)
    top = F.greatest("short", "long", "dangling")
    flaw = F.when(F.col("_passages") == 0, "passages-none").when(F.col("short") == top, "passages-short").when(F.col("long") == top, "passages-long").otherwise("passages-dangling")
    code = F.when(F.col("app_shell"), "render").when(worst.lost <= 0, "none").when(worst.code == "passages", flaw).otherwise(worst.code)
    advice = F.create_map(*(F.lit(v) for kv in ADVICE.items() for v in kv))
    return x.select("page_id", code.alias("code"), F.when(F.col("app_shell"), 100).otherwise(worst.lost).cast("int").alias("lost")).withColumn("advice", F.element_at(advice, F.col("code")))


def host_pages_by_need(points: DataFrame) -> DataFrame:
    """(host, rank, page_id, score): the scored pages of each host, the hardest to quote first."""
    order = Window.partitionBy("host").orderBy("score", "page_id")
    return points.where("score IS NOT NULL").select("host", F.row_number().over(order).alias("rank"), "page_id", "score")
