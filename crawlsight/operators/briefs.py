"""What to write next: briefs out of lost, missing and weak questions; ranked tasks out of failing checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import js_round, slug, tokenise
from .retrieval import WEAK

# The order of reasons, and points from which a task is urgent.
REASONS = ("lost", "missing", "weak")
HIGH, MEDIUM = 5, 2


def briefs(hits: DataFrame, keep: int = 8) -> DataFrame:
    """(host, rank, query_id, query, reason, action, target, missing_terms), the ``keep`` first of each host.

    ``hits``: host, query_id, query, status, coverage, url, missing_terms, lost. Questions with the same set of
    tokens are one brief, that of the smallest query_id; a page that carries at least two fifths of the words is
    extended, else a new one is written.
    """
    lost = F.coalesce(F.col("lost"), F.lit(False))
    reason = F.when(lost, 0).when(F.col("status") == "missing", 1).when(F.col("status") == "weak", 2)
    rows = hits.withColumn("_reason", reason).where("_reason is not null").withColumn(
        "_key", F.array_join(F.array_sort(F.array_distinct(tokenise(F.col("query")))), " ")
    ).where("_key <> ''")
    kept = ["query_id", "query", "_reason", "coverage", "url", "missing_terms"]
    one = rows.groupBy("host", "_key").agg(F.min_by(F.struct(*kept), "query_id").alias("q")).select("host", "q.*")
    order = Window.partitionBy("host").orderBy("_reason", F.desc(F.size("missing_terms")), "query", "query_id")
    extend = (F.coalesce("url", F.lit("")) != "") & (F.col("coverage") >= WEAK)
    return one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep).select(
        "host", "rank", "query_id", "query", F.get(F.array(*map(F.lit, REASONS)), F.col("_reason")).alias("reason"),
        F.when(extend, "extend").otherwise("write").alias("action"),
        F.when(extend, F.col("url")).otherwise(F.concat(F.lit("https://"), F.col("host"), F.lit("/"), slug(F.col("query")))).alias("target"),
        "missing_terms",
    )


def readiness_actions(checks: DataFrame) -> DataFrame:
    """(host, rank, check_id, points, priority): one task per failing or warning check, the costliest first.

    points: the share of a host's possible score that the check loses, in per cent to one decimal.
    """
    measured = checks.where("status <> 'na'")
    total = measured.groupBy("host").agg(F.sum("weight").alias("possible"))
    lost = measured.where("status <> 'pass'").join(total, "host").withColumn(
        "points", js_round(100 * (F.col("weight") - F.col("earned")) / F.col("possible"), 1)
    )
    priority = F.when(F.col("points") >= HIGH, "high").when(F.col("points") >= MEDIUM, "medium").otherwise("low")
    order = Window.partitionBy("host").orderBy(F.desc("points"), "check_id")
    return lost.select("host", F.row_number().over(order).alias("rank"), "check_id", "points", priority.alias("priority"))


def stage_states(checks: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """(host, layer, state, gaps): fail before partial before pass; a layer of na checks alone is na.

    ``blocked`` (host, layer) forces a fail.
    """
    code = F.when(F.col("status") == "fail", 3).when(F.col("status") == "warn", 2).when(F.col("status") == "pass", 1).otherwise(0)
    out = checks.groupBy("host", "layer").agg(F.max(code).alias("_c"), F.sum((code >= 2).cast("int")).alias("gaps"))
    if blocked is not None:
        forced = blocked.select("host", "layer", F.lit(3).alias("_f")).distinct()
        out = out.join(forced, ["host", "layer"], "left").withColumn("_c", F.greatest("_c", F.coalesce("_f", F.lit(0))))
    names = F.array(*map(F.lit, ("na", "pass", "partial", "fail")))
    return out.select("host", "layer", F.get(names, F.col("_c")).alias("state"), F.col("gaps").cast("int").alias("gaps"))


def gaps(checks: DataFrame) -> DataFrame:
    """(host, rank, check_id, layer, weight): a host's failing and warning checks, fails first, the heaviest first."""
    order = Window.partitionBy("host").orderBy((F.col("status") != "fail").cast("int"), F.desc("weight"), "check_id")
    rows = checks.where("status in ('fail', 'warn')")
    return rows.select("host", F.row_number().over(order).alias("rank"), "check_id", "layer", "weight", "status")


def rank_actions(readiness: DataFrame, visibility: DataFrame) -> DataFrame:
    """(host, rank, source, action, priority, points): the tasks of ``readiness_actions`` and ``visibility_actions`` in one order.

    The most pressing first; of equals those of visibility, in their own order, then the costliest check, ties by name.
    """
    both = readiness.select("host", F.lit("readiness").alias("source"), F.col("check_id").alias("action"), "priority", "points", F.lit(0).alias("_own")).unionByName(
        visibility.select("host", F.lit("visibility").alias("source"), "action", "priority", F.lit(0.0).alias("points"), F.col("rank").alias("_own"))
    )
    urgency = F.array_position(F.array(*map(F.lit, ("high", "medium", "low"))), F.col("priority"))
    order = Window.partitionBy("host").orderBy(urgency, (F.col("source") != "visibility").cast("int"), F.desc("points"), "_own", "action")
    return both.select("host", F.row_number().over(order).alias("rank"), "source", "action", "priority", "points")
