"""Who a site is, and the llms.txt it could serve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import resolve_link

# What parts a title, pages that llms.txt leaves out, pages that are resources, the sentence for a site without a description.
DESCRIBE = " — describe what you offer and who it is for in one sentence."
TITLE_PARTS = "\\s+[|\\-–—:·•]\\s+"
#: What parts a title in llms.txt.
LINE_PARTS = "\\s+[|\\-–—:]\\s+"
LEGAL = r"(?i)(privacy|terms|cookie|legal|careers?|jobs|login|sitemap|disclaimer)"
RESOURCE = r"(?i)/(docs|blog|guides?|resources|faq|help)"


def _compact(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, "(?i)[^a-z0-9]", ""))


def _shortest(parts: Column) -> Column:
    """The shortest of an array, the first of equals."""
    return F.array_min(F.transform(parts, lambda p, i: F.struct(F.length(p).alias("n"), i.alias("i"), p.alias("p"))))["p"]


def brand_from_title(title: Column, host: Column) -> Column:
    """The shortest part of a title that names the host, up to 40 characters; else the shortest part up to 30; else empty."""
    parts = F.filter(F.transform(F.split(F.coalesce(title, F.lit("")), TITLE_PARTS, -1), F.trim), lambda p: p != "")
    stem = _compact(F.get(F.split(host, r"\."), F.lit(0)))
    named = _shortest(F.filter(parts, lambda p: _compact(p).contains(stem)))
    short = _shortest(parts)
    return F.when(F.length(named) <= 40, named).when(F.length(short) <= 30, short).otherwise("")


def host_identity(signals: DataFrame, profiles: DataFrame | None = None, names: DataFrame | None = None) -> DataFrame:
    """(host, brand, description, logo, category, market, facts): who each host of ``signals`` is.

    brand: that of ``profiles`` (host, brand, description, category, market, facts; all but host may be missing), else the
    organisation's name in ``names`` (host, name), else the home page's site name, its title, the host. description: the
    profile's, else the home page's own, else that of its Open Graph data. logo: its Open Graph image as an absolute
    address. What nobody says is empty.
    """
    c, given = F.col, lambda x: F.when(x != "", x)
    og = (lambda k: F.try_element_at("open_graph", F.lit(k))) if "open_graph" in signals.columns else (lambda _: F.lit(None).cast("string"))
    url = c("url") if "url" in signals.columns else F.lit(None).cast("string")
    home = signals.groupBy("host").agg(F.min_by(F.struct(
        "title", "description", url.alias("url"), og("og:site_name").alias("site"), og("og:description").alias("og_about"), og("og:image").alias("image")
    ), "page_id").alias("h")).select("host", "h.*")
    kinds = {"brand": "string", "description": "string", "category": "string", "market": "string", "facts": "array<string>"}
    if profiles is None:
        rows = home.withColumns({f"own_{k}": F.lit(None).cast(t) for k, t in kinds.items()})
    else:
        has = profiles.columns
        rows = home.join(profiles.select("host", *((c(k) if k in has else F.lit(None).cast(t)).alias(f"own_{k}") for k, t in kinds.items())), "host", "left")
    rows = rows.withColumn("named", F.lit(None).cast("string")) if names is None else rows.join(names.select("host", c("name").alias("named")), "host", "left")
    logo = resolve_link(F.coalesce("url", F.concat(F.lit("https://"), c("host"), F.lit("/"))), given(c("image")))
    return rows.select(
        "host", F.coalesce(given(c("own_brand")), given(c("named")), given(c("site")), given(brand_from_title(c("title"), c("host"))), c("host")).alias("brand"),
        F.coalesce(given(c("own_description")), given(c("description")), given(c("og_about")), F.lit("")).alias("description"), F.coalesce(logo, F.lit("")).alias("logo"),
        F.coalesce("own_category", F.lit("")).alias("category"), F.coalesce("own_market", F.lit("")).alias("market"), F.coalesce("own_facts", F.array().cast("array<string>")).alias("facts"),
    )


def llms_entries(signals: DataFrame, identity: DataFrame) -> DataFrame:
    """(host, page_id, resource, line): the annotated link of each page that a host's llms.txt lists, once per URL."""
    bare = F.regexp_replace("url", "/+$", "")
    path = F.regexp_extract("url", "^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)
    fit = signals.where((F.col("title") != "") & ~path.rlike(LEGAL)).groupBy("host", bare.alias("bare")).agg(
        F.min_by(F.struct("page_id", "url", "title", "h1", "description"), "page_id").alias("p")
    ).select("host", "p.*").join(identity.select("host", "brand"), "host")
    named = F.get(F.filter(F.split("title", LINE_PARTS, -1), lambda x: F.lower(x) != F.lower(F.col("brand"))), F.lit(0))
    given = lambda c: F.when(c != "", c)
    label = F.regexp_replace(F.coalesce(given(named), given(F.get("h1", F.lit(0))), F.col("title")), r"[\[\]]", "")
    line = F.concat(F.lit("- ["), label, F.lit("]("), F.col("url"), F.lit(")"), F.when(F.col("description") != "", F.concat(F.lit(": "), F.col("description"))).otherwise(""))
    return fit.select("host", "page_id", line.alias("line")).select("host", "page_id", F.col("line").rlike(RESOURCE).alias("resource"), "line")


def llms_txt(signals: DataFrame, identity: DataFrame) -> DataFrame:
    """(host, body): a draft of llms.txt from crawled pages, key pages before resources, in page order.

    A host's pages meet in one row here, as one file is one text; ``llms_entries`` has them a row each.
    """
    lines = lambda keep: F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("page_id", "line")))), lambda x: x.line)
    files = llms_entries(signals, identity).groupBy("host").agg(lines(~F.col("resource")).alias("main"), lines(F.col("resource")).alias("docs"))
    about = F.when(F.col("description") != "", F.col("description")).otherwise(
        F.concat("brand", F.lit(DESCRIBE))
    )
    none = F.array().cast("array<string>")
    head = F.array(F.concat(F.lit("# "), F.col("brand")), F.lit(""), F.concat(F.lit("> "), about), F.lit(""), F.lit("## Key pages"), F.lit(""))
    docs = F.when(F.size("docs") > 0, F.concat(F.array(F.lit(""), F.lit("## Resources"), F.lit("")), F.col("docs"))).otherwise(none)
    return identity.join(files, "host").select("host", F.array_join(F.concat(head, F.col("main"), docs, F.array(F.lit(""))), "\n").alias("body"))
