"""Sites side by side: each question's winner, tallies per site, leaders per dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import js_round


def question_winners(best: DataFrame) -> DataFrame:
    """(query_id, winner, coverage, hosts) of ``best`` (query_id, host, score, coverage): one row per host's best page.

    The highest coverage wins, then the highest score, then the first host by name; no winner without coverage.
    """
    place = F.struct(-F.col("coverage"), -F.col("score"), "host")
    out = best.groupBy("query_id").agg(
        F.min_by("host", place).alias("winner"), F.max("coverage").alias("coverage"), F.count(F.lit(1)).alias("hosts")
    )
    return out.withColumn("winner", F.when(F.col("coverage") > 0, F.col("winner")))


def site_tallies(best: DataFrame, winners: DataFrame) -> DataFrame:
    """(host, answers, wins): questions that a host answers, and those it wins."""
    answers = best.groupBy("host").agg(F.sum((F.col("status") == "answered").cast("int")).alias("answers"))
    wins = winners.where("winner is not null").groupBy(F.col("winner").alias("host")).agg(F.count(F.lit(1)).cast("int").alias("wins"))
    return answers.join(wins, "host", "left").select("host", F.col("answers").cast("int").alias("answers"), F.coalesce("wins", F.lit(0)).alias("wins"))


def site_columns(hosts: DataFrame, signals: DataFrame, readiness: DataFrame, citability: DataFrame, reach: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """One row per host of ``hosts`` (host); a site without pages keeps a row of nulls.

    ``readiness`` (host, score, grade); ``citability`` (host, score, liftable) per page. ``reach`` (host, search_reach): search
    crawlers let in, that of the home page; ``files`` (host, kind, status): host files, of which llms.txt counts. schema_types: the
    distinct types of a site's structured data, by name.
    """
    typed = F.col("jsonld_types") if "jsonld_types" in signals.columns else F.array().cast("array<string>")
    kinds = signals.select("host", F.explode(typed).alias("t")).distinct().groupBy("host").agg(F.array_sort(F.collect_list("t")).alias("schema_types"))
    pages = signals.groupBy("host").agg(
        F.count(F.lit(1)).alias("pages"), F.sum(F.col("app_shell").cast("int")).alias("app_shell_pages"),
        F.sum(F.size("passages")).alias("paragraphs"),
    )
    cited = citability.groupBy("host").agg(js_round(F.avg("score")).cast("int").alias("citability"), F.sum("liftable").alias("quotable"))
    ready = readiness.select("host", F.col("score").alias("readiness"), "grade")
    out = hosts.select("host").distinct().join(pages, "host", "left").join(ready, "host", "left").join(cited, "host", "left").join(kinds, "host", "left")
    out = out.withColumn("measured", F.col("pages").isNotNull())
    out = out.withColumn("reach", F.lit(None).cast("int")) if reach is None else out.join(reach.groupBy("host").agg(F.max("search_reach").alias("reach")), "host", "left")
    has = None if files is None else files.where("kind = 'llms'").groupBy("host").agg(F.max(F.coalesce(F.col("status") == 200, F.lit(False))).alias("_file"))
    out = out.withColumn("_file", F.lit(None).cast("boolean")) if has is None else out.join(has, "host", "left")
    held = F.when(F.col("measured"), F.coalesce("schema_types", F.array().cast("array<string>")))
    return out.withColumns({"schema_types": held, "llms_txt": F.coalesce("_file", F.lit(False))}).drop("_file")


def leaders(columns: DataFrame, dimensions: dict[str, str]) -> DataFrame:
    """(dimension, host, value, ties) per entry of ``dimensions`` (name: column): a tie gives no leader.

    Only maxima and counts, so no window over all sites; a dimension that no site has is left out.
    """
    long = columns.select("host", F.inline(F.array(*(
        F.struct(F.lit(name).alias("dimension"), F.col(c).cast("double").alias("value")) for name, c in dimensions.items()
    )))).where("value is not null")
    at_value = long.groupBy("dimension", "value").agg(F.min("host").alias("host"), F.count(F.lit(1)).alias("ties"))
    best = at_value.groupBy("dimension").agg(F.max_by(F.struct("host", "value", "ties"), "value").alias("b"))
    return best.select("dimension", F.when(F.col("b.ties") == 1, F.col("b.host")).alias("host"), "b.value", "b.ties")


def metric_changes(history: DataFrame, metrics: tuple[str, ...], lower_is_better: tuple[str, ...] = ("lost",)) -> DataFrame:
    """(host, id, metric, before, after, change, better): each run's metrics against the host's run before it.

    Null where either is null; where less is better a fall counts as better.
    """
    long = history.select("host", "id", "completed_at", F.inline(F.array(*(
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("after")) for m in metrics
    ))))
    order = Window.partitionBy("host", "metric").orderBy("completed_at", "id")
    out = long.withColumn("before", F.lag("after").over(order)).withColumn("change", F.col("after") - F.col("before"))
    sign = F.when(F.col("metric").isin(*lower_is_better), -1).otherwise(1)
    return out.select("host", "id", "metric", "before", "after", "change", (F.col("change") * sign > 0).alias("better"))


def fixed_and_broke(checks: DataFrame) -> DataFrame:
    """(host, run, fixed, broke) of ``checks`` (host, run, check_id, status): failing checks that left or came since the run before."""
    failing = checks.groupBy("host", "run").agg(F.array_sort(F.collect_set(F.when(F.col("status") == "fail", F.col("check_id")))).alias("failing"))
    before = F.lag("failing").over(Window.partitionBy("host").orderBy("run"))
    return failing.withColumn("_b", before).where("_b is not null").select(
        "host", "run", F.array_except("_b", "failing").alias("fixed"), F.array_except("failing", "_b").alias("broke")
    )


def lost_questions(best: DataFrame) -> DataFrame:
    """``best`` (query_id, host, score, coverage, more), a row per query and host, with lost.

    A host loses a question to another whose best page covers more of it, or as much with a higher score.
    """
    top = best.groupBy("query_id").agg(F.max(F.struct("coverage", "score")).alias("_top"))
    return best.join(top, "query_id").withColumn("lost", F.col("_top") > F.struct("coverage", "score")).drop("_top")


def history_entries(runs: DataFrame, pages: DataFrame, board: DataFrame, checks: DataFrame, answers: DataFrame, citability: DataFrame, fanout: DataFrame) -> DataFrame:
    """A row for each of ``runs`` (id, host, completed_at, created_at, status, model) with its headline numbers; what wasn't measured is null.

    All but ``runs`` are by run, in id: ``pages`` (a row a page), ``board`` (layer, score, grade; null layer: the whole),
    ``checks`` (check_id, status), ``answers`` (score, category_mentions, category_measured), ``citability`` (score, a row a
    page), ``fanout`` (answerable_coverage, lost).
    """
    c = F.col
    read = pages.groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("pages"))
    scores = board.groupBy("id").agg(
        F.max(F.when(c("layer").isNull(), c("score"))).alias("readiness"), F.max(F.when(c("layer").isNull(), c("grade"))).alias("grade"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(c("layer").isNotNull(), F.struct("layer", "score"))))).alias("layers"),
    )
    failing = checks.groupBy("id").agg(F.array_sort(F.collect_set(F.when(c("status") == "fail", c("check_id")))).alias("failing"))
    seen = answers.select("id", c("score").alias("visibility"), F.when(c("category_measured") > 0, c("category_mentions")).alias("named"), F.when(c("category_measured") > 0, c("category_measured")).alias("asked"))
    quoted = citability.groupBy("id").agg(js_round(F.avg("score")).cast("int").alias("citability"))
    x = runs
    for part in (read, scores, failing, seen, quoted, fanout.select("id", c("answerable_coverage").alias("answerable"), "lost")):
        x = x.join(part, "id", "left")
    return x.select(
        "id", "host", F.coalesce("completed_at", "created_at").alias("completed_at"), "status", "model", F.coalesce("pages", F.lit(0)).alias("pages"), "readiness", F.coalesce("grade", F.lit("")).alias("grade"),
        F.coalesce("layers", F.create_map().cast("map<string,int>")).alias("layers"), "visibility", "named", "asked", "citability", "answerable", "lost", F.coalesce("failing", F.array().cast("array<string>")).alias("failing"),
    )
