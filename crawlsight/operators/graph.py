"""Link graph, page selection, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.urls import host_of, part, resolve_link, url_key

# Path families by weight, and paths that are never picked.
FAMILIES = (
    (r"/(about|company|who-we-are|our-story)", 10), (r"/(pricing|plans|price)", 9),
    (r"/(products?|services?|solutions?|features?|platform)", 8), (r"/(faq|faqs|help|support)", 7), (r"/(contact|locations?)", 6),
    (r"/(compare|vs|alternatives?|reviews?|customers?|case-stud)", 6), (r"/(docs|documentation|api)", 4),
    (r"/(blog|news|resources|articles?|insights)", 3),
)
SKIP = (
    r"(?i)\.(pdf|jpe?g|png|gif|svg|webp|zip|mp4|mp3|xml|json|css|js|ico)$|"
    r"/(wp-|cart|checkout|login|signin|signup|register|account|tag/|author/|feed)"
)


def link_edges(signals: DataFrame) -> DataFrame:
    """(from_url, to_url): same-host links of ``signals`` (url, host, hrefs), each once."""
    links = signals.select("url", "host", F.explode("hrefs").alias("href")).withColumn("to_url", resolve_link(F.col("url"), F.col("href")))
    return links.where("to_url is not null").where(host_of(F.col("to_url")) == F.col("host")).select(F.col("url").alias("from_url"), "to_url").distinct()


def pick_pages(links: DataFrame, keep: int = 24) -> DataFrame:
    """(host, url, score, pick_no) of ``links`` (host, url): one page per family first, then by score."""
    path = F.lower(F.coalesce(part(F.col("url"), "PATH"), F.lit("")))
    query = F.coalesce(part(F.col("url"), "QUERY"), F.lit(""))
    family, bonus = F.lit(None).cast("int"), F.lit(0)
    for i, (pattern, weight) in reversed(list(enumerate(FAMILIES))):
        family, bonus = F.when(path.rlike(pattern), i).otherwise(family), F.when(path.rlike(pattern), weight).otherwise(bonus)
    depth = F.size(F.filter(F.split(path, "/"), lambda p: p != ""))
    fit = links.where(~path.rlike(SKIP) & (F.length(query) < 40)).groupBy("host", url_key(F.col("url")).alias("key")).agg(F.min("url").alias("url"))
    scored = fit.select("host", "url", family.alias("family"), (bonus * 3 - depth * 2 - F.when(query != "", 3).otherwise(0)).alias("score"))
    first = F.row_number().over(Window.partitionBy("host", "family").orderBy(F.desc("score"), "url"))
    ranked = scored.withColumn("late", F.when(F.col("family").isNotNull() & (first > 1), 1).otherwise(0))
    no = F.row_number().over(Window.partitionBy("host").orderBy("late", F.desc("score"), "url"))
    return ranked.withColumn("pick_no", no).where(F.col("pick_no") <= keep).select("host", "url", "score", "pick_no")


def cap_per_host(pages: DataFrame, n: int, order: str = "page_id") -> DataFrame:
    """The first ``n`` pages of each host."""
    return pages.withColumn("_n", F.row_number().over(Window.partitionBy("host").orderBy(order))).where(F.col("_n") <= n).drop("_n")


def fingerprints(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, fingerprint, duplicate_of): SHA-256 of the text; the smallest key with it, null for that one itself.

    Plain minima and a join, so a text with very many copies is no task's burden.
    """
    rows = docs.select(key, F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("fingerprint"))
    first = rows.groupBy("fingerprint").agg(F.min(key).alias("_first"))
    return rows.join(first, "fingerprint").select(key, "fingerprint", F.when(F.col("_first") != F.col(key), F.col("_first")).alias("duplicate_of"))


def page_keys(pages: DataFrame) -> DataFrame:
    """(url, page_key): the first 12 hex digits of the URL's SHA-256."""
    return pages.select("url", F.substring(F.sha2(F.col("url").cast("binary"), 256), 1, 12).alias("page_key"))


def reachable(edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """(url, depth) reached from ``seeds`` (url) over ``edges`` (from_url, to_url), the first visit only."""
    seen = seeds.select("url", F.lit(0).alias("depth")).distinct()
    front = seen
    for d in range(1, depth + 1):
        nxt = edges.join(front, edges.from_url == front.url).select(F.col("to_url").alias("url")).distinct()
        front = nxt.join(seen.select("url"), "url", "left_anti").select("url", F.lit(d).alias("depth"))
        seen = seen.union(front)
    return seen
