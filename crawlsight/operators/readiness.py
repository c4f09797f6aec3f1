"""Readiness: checks per host in one aggregate, layer scores, total and grade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import js_round
from ..functions.urls import host_of
from .linked_data import SOCIAL

# Check, layer, weight, for the checks that page signals alone decide.
CHECKS = (
    ("server-rendered", "content", 10), ("titles", "content", 4), ("descriptions", "content", 4), ("h1", "content", 3),
    ("structure", "content", 3), ("answer-format", "content", 3), ("lang", "content", 1), ("https", "access", 2), ("canonical", "entity", 2),
)


def checks(signals: DataFrame) -> DataFrame:
    """(host, check_id, layer, weight, status, earned): the page-signal checks; home is the host's first page."""
    titles = signals.groupBy("host", "title").agg(F.count(F.lit(1)).alias("n"))
    shared = titles.groupBy("host").agg(F.max(F.when(F.col("title") == "", 0).otherwise(F.col("n"))).alias("most_shared"))
    home = lambda c: F.min_by(c, "page_id")
    facts = signals.groupBy("host").agg(
        home("app_shell").alias("home_shell"), home("words").alias("home_words"), F.bool_or("app_shell").alias("any_shell"),
        F.bool_or(F.col("title") == "").alias("untitled"), F.avg((F.col("description") != "").cast("int")).alias("described"),
        F.avg((F.size("h1") != 1).cast("int")).alias("bad_h1"),
        F.avg((F.size(F.filter("headings", lambda h: h.level == 2)) < 2).cast("int")).alias("flat"),
        F.sum("question_headings").alias("questions"), home("lang").alias("home_lang"), home("url").alias("home_url"),
        F.avg((F.col("canonical") == "").cast("int")).alias("no_canonical"),
    ).join(shared, "host")
    c, three = F.col, lambda ok, some: F.when(ok, "pass").when(some, "warn").otherwise("fail")
    two = lambda ok: F.when(ok, "pass").otherwise("fail")
    status = {
        "server-rendered": F.when(c("home_shell"), "fail").when((c("home_words") < 150) | c("any_shell"), "warn").otherwise("pass"),
        "titles": F.when(c("untitled"), "fail").when(c("most_shared") > 1, "warn").otherwise("pass"),
        "descriptions": three(c("described") >= 0.9, c("described") >= 0.5), "h1": three(c("bad_h1") == 0, c("bad_h1") <= 0.3),
        "structure": three(c("flat") <= 0.2, c("flat") <= 0.5), "answer-format": three(c("questions") >= 3, c("questions") >= 1),
        "lang": two(c("home_lang") != ""), "https": two(c("home_url").startswith("https")),
        "canonical": three(c("no_canonical") == 0, c("no_canonical") <= 0.3),
    }
    return _rows(facts, CHECKS, status)


# Checks that markup decides, the types of what a site offers, the tags a shared link needs, and telling paths.
MARKUP_CHECKS = (
    ("indexable", "access", 4), ("alt-text", "content", 2), ("offering-schema", "entity", 4), ("faq-schema", "entity", 2),
    ("open-graph", "entity", 3), ("about-contact", "entity", 2), ("jsonld-valid", "entity", 2), ("freshness", "agent", 2),
)
OFFER_TYPES = (
    r"^(Product|Service|SoftwareApplication|WebApplication|MobileApplication|Offer|AggregateOffer|OfferCatalog|Course|Event|MenuItem|Menu|"
    r"FinancialProduct|HowTo|Book|Recipe)$"
)
OG_TAGS = ("og:title", "og:description", "og:image")
ABOUT, CONTACT = "about|company|who-we-are|our-story", "contact|get-in-touch|locations?"
ARTICLES = r"(?i)/(blog|news|articles?|insights|resources|posts?)/"


def markup_checks(signals: DataFrame) -> DataFrame:
    """(host, check_id, layer, weight, status, earned): the checks that robots tags, images, structured data, links and dates decide."""
    home = lambda c: F.min_by(c, "page_id")
    noindex = F.col("meta_robots").rlike("(?i)noindex")
    own = F.transform("hrefs", lambda h: F.when(
        h.rlike("(?i)^(?:https?:)?//") & (host_of(F.concat(F.when(h.startswith("//"), "https:").otherwise(""), h)) != F.col("host")) | h.rlike(r"(?i)^\s*(?:javascript|mailto|tel|data):"), ""
    ).otherwise(F.lower(F.regexp_replace(F.regexp_replace(h, r"(?i)^(?:https?:)?//[^/?#]*", ""), "#.*$", ""))))
    linked = lambda p: F.bool_or(F.exists(own, lambda h: h.rlike(p)))
    article, n = F.col("url").rlike(ARTICLES), lambda cond: F.sum(cond.cast("int"))
    facts = signals.groupBy("host").agg(
        home(noindex).alias("home_noindex"), F.bool_or(noindex).alias("any_noindex"), F.sum("images").alias("images"), F.sum("images_with_alt").alias("with_alt"),
        F.bool_or(F.exists("jsonld_types", lambda t: t.rlike(OFFER_TYPES))).alias("offers"), F.bool_or(F.array_contains("jsonld_types", "FAQPage")).alias("faq"),
        F.sum("question_headings").alias("questions"), home(F.size(F.array_except(F.array(*map(F.lit, OG_TAGS)), F.map_keys("open_graph")))).alias("og_missing"),
        linked(ABOUT).alias("about"), linked(CONTACT).alias("contact"), F.bool_or(F.size("jsonld_types") > 0).alias("typed"), F.sum("jsonld_errors").alias("errors"),
        n(article).alias("articles"), n(article & F.col("has_date")).alias("dated"), n(article & F.col("has_author")).alias("authored"),
    )
    c, alt = F.col, F.col("with_alt") / F.nullif("images", F.lit(0))
    graded = lambda ok, some: F.when(ok, "pass").when(some, "warn").otherwise("fail")
    status = {
        "indexable": F.when(c("home_noindex"), "fail").when(c("any_noindex"), "warn").otherwise("pass"),
        "alt-text": F.when(alt.isNull(), "na").otherwise(graded(alt >= 0.8, alt >= 0.5)),
        "offering-schema": F.when(c("offers"), "pass").otherwise("fail"), "faq-schema": graded(c("faq"), c("questions") > 0),
        "open-graph": graded(c("og_missing") == 0, c("og_missing") < 3), "about-contact": graded(c("about") & c("contact"), c("about") | c("contact")),
        "jsonld-valid": F.when(c("errors") > 0, "fail").when(c("typed"), "pass").otherwise("na"),
        "freshness": F.when(c("articles") == 0, "na").otherwise(graded((c("dated") == c("articles")) & (c("authored") == c("articles")), c("dated") > 0)),
    }
    return _rows(facts, MARKUP_CHECKS, status)


# Checks of the organisation a site names.
ENTITY_CHECKS = (("organization-schema", "entity", 8), ("same-as", "entity", 4))


def entity_checks(signals: DataFrame, organisations: DataFrame) -> DataFrame:
    """(host, check_id, layer, weight, status, earned): what ``organisations`` say of each host of ``signals``, and whether pages link profiles."""
    social = signals.groupBy("host").agg(F.bool_or(F.exists("hrefs", lambda h: h.rlike(SOCIAL))).alias("social"))
    facts = social.join(organisations.select("host", F.size("core").alias("core"), "same_as"), "host", "left")
    graded = lambda ok, some: F.when(ok, "pass").when(some, "warn").otherwise("fail")
    return _rows(facts, ENTITY_CHECKS, {
        "organization-schema": graded(F.col("core") >= 3, F.col("core").isNotNull()), "same-as": graded(F.col("same_as") >= 2, F.col("social")),
    })


# The check of speed.
SPEED_CHECKS = (("speed", "content", 2),)


def speed_checks(signals: DataFrame, fetches: DataFrame | None = None) -> DataFrame:
    """(host, check_id, layer, weight, status, earned): how long each host's home took, by ``fetches`` (page_id, ms).

    Not measured, and not counted, where the home has no time.
    """
    home = signals.groupBy("host").agg(F.min("page_id").alias("page_id"))
    if fetches is None:
        timed = home.withColumn("ms", F.lit(None).cast("double"))
    else:
        timed = home.join(fetches.groupBy("page_id").agg(F.min("ms").alias("ms")), "page_id", "left")
    ms = F.col("ms")
    return _rows(timed, SPEED_CHECKS, {"speed": F.when(ms.isNull(), "na").when(ms < 1500, "pass").when(ms < 4000, "warn").otherwise("fail")})


#: Checks of a site: their number, and their weights by layer.
ALL_CHECKS, ALL_WEIGHTS = 27, {"access": 35, "content": 32, "entity": 27, "agent": 9}


def all_checks(signals: DataFrame, organisations: DataFrame, access: DataFrame, fetches: DataFrame | None = None) -> DataFrame:
    """The 27 checks of every host of ``signals``: of its pages, markup, organisation, ``access_checks`` and speed.

    ``signals`` are read by four aggregates: store them first. A host that ``access`` doesn't know counts as one whose
    files weren't found and whose crawlers nothing was said about: see ``unknown_access``.
    """
    hosts = signals.select("host").distinct()
    told = access.join(hosts, "host", "left_semi")
    silent = unknown_access(hosts.join(access.select("host").distinct(), "host", "left_anti"))
    parts = (checks(signals), markup_checks(signals), entity_checks(signals, organisations), speed_checks(signals, fetches), told, silent)
    out = parts[0]
    for rows in parts[1:]:
        out = out.unionByName(rows)
    return out


# The access and agent checks of a host that has no robots file, sitemap or llms.txt and that no crawler was tried on.
_UNKNOWN = (
    ("search-crawlers", "access", 10, "pass"), ("training-crawlers", "access", 3, "pass"), ("firewall", "access", 10, "na"), ("robots-file", "access", 2, "fail"),
    ("sitemap", "access", 4, "fail"), ("llms-txt", "agent", 6, "fail"), ("llms-full", "agent", 1, "warn"),
)


def unknown_access(hosts: DataFrame) -> DataFrame:
    """The checks that files and probes decide, for hosts that have neither."""
    return _rows(hosts, tuple(x[:3] for x in _UNKNOWN), {x[0]: F.lit(x[3]) for x in _UNKNOWN})


def score_board(check_rows: DataFrame) -> DataFrame:
    """(host, layer, earned, possible, score, grade): each host's layers and, with a null layer, the whole, in one pass over its checks.

    A layer's values have one decimal and the whole adds up those rounded values. A layer in which nothing applies has no
    score, a host in which nothing does scores 0.
    """
    measured = F.col("status") != "na"
    by_layer = check_rows.groupBy("host", "layer").agg(
        js_round(F.sum(F.when(measured, F.col("earned")).otherwise(0.0)), 1).alias("earned"),
        js_round(F.sum(F.when(measured, F.col("weight") * 1.0).otherwise(0.0)), 1).alias("possible"),
    )
    rows = by_layer.groupingSets([[F.col("host"), F.col("layer")], [F.col("host")]], "host", "layer").agg(
        F.sum("earned").alias("earned"), F.sum("possible").alias("possible"), F.grouping("layer").alias("whole")
    )
    share = js_round(100 * F.col("earned") / F.nullif("possible", F.lit(0.0))).cast("int")
    scored = rows.withColumn("score", F.when(F.col("whole") == 1, F.coalesce(share, F.lit(0))).otherwise(share))
    return scored.select("host", "layer", js_round(F.col("earned"), 1).alias("earned"), js_round(F.col("possible"), 1).alias("possible"), "score", F.when(F.col("whole") == 1, grade(F.col("score"))).alias("grade"))


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 55, "D").otherwise("F")


def _rows(facts: DataFrame, checks_: tuple, status: dict) -> DataFrame:
    rows = F.inline(F.array(*(
        F.struct(F.lit(i).alias("check_id"), F.lit(layer).alias("layer"), F.lit(w).alias("weight"), status[i].alias("status")) for i, layer, w in checks_
    )))
    earned = F.when(F.col("status") == "pass", F.col("weight") * 1.0).when(F.col("status") == "warn", F.col("weight") * 0.5).otherwise(0.0)
    return facts.select("host", rows).withColumn("earned", earned)


def layer_scores(check_rows: DataFrame) -> DataFrame:
    """(host, layer, earned, possible, score): one decimal; null where nothing applies."""
    measured = F.col("status") != "na"
    out = check_rows.groupBy("host", "layer").agg(
        js_round(F.sum(F.when(measured, F.col("earned")).otherwise(0.0)), 1).alias("earned"),
        js_round(F.sum(F.when(measured, F.col("weight") * 1.0).otherwise(0.0)), 1).alias("possible"),
    )
    return out.withColumn("score", F.when(F.col("possible") > 0, js_round(100 * F.col("earned") / F.col("possible")).cast("int")))


def readiness_scores(layers: DataFrame) -> DataFrame:
    """(host, score, grade), summed from the rounded layer values."""
    out = layers.groupBy("host").agg(F.sum("earned").alias("e"), F.sum("possible").alias("p"))
    score = F.when(F.col("p") > 0, js_round(100 * F.col("e") / F.col("p")).cast("int")).otherwise(0)
    return out.select("host", score.alias("score")).withColumn("grade", grade(F.col("score")))


# ---------------------------------------------------------------- evidence and fixes

#: Addresses that a check's evidence shows.
SHOWN = 6
#: What to do about a failing check; {n} of {of} pages, {first}: the first of them.
FIXES = {
    "server-rendered": "Send the text of {n} pages in their source; begin with {first}.", "titles": "Give {n} of {of} pages a title of their own; begin with {first}.",
    "descriptions": "Describe {n} of {of} pages in one factual sentence each; begin with {first}.", "h1": "Give {n} of {of} pages exactly one main heading; begin with {first}.",
    "structure": "Part {n} of {of} pages into sections with headings; begin with {first}.", "canonical": "Name the canonical address of {n} of {of} pages; begin with {first}.",
    "indexable": "Take noindex off {n} pages that should be found; begin with {first}.", "alt-text": "Describe the images of {n} pages; begin with {first}.",
    "jsonld-valid": "Mend the structured data of {n} pages; begin with {first}.", "freshness": "Date and sign {n} articles; begin with {first}.",
    "answer-format": "Ask the reader's questions in headings and answer them below.", "lang": "Name the language of the pages.", "https": "Serve the site by https.", "speed": "Answer faster: cache the pages near their readers.",
    "offering-schema": "Describe what is offered in structured data.", "faq-schema": "Mark questions and answers in structured data.", "open-graph": "Give the home page a title, description and image for shared links.",
    "about-contact": "Link an about page and a contact page.", "organization-schema": "Describe the organisation in structured data: name, address, logo, description.", "same-as": "Link the organisation's official profiles.",
    "search-crawlers": "Let search crawlers in by robots.txt.", "training-crawlers": "Decide which training crawlers robots.txt lets in.", "firewall": "Let AI crawlers through the firewall.",
    "robots-file": "Serve a robots.txt.", "sitemap": "Serve a sitemap and name it in robots.txt.", "llms-txt": "Serve an llms.txt with a title and links.", "llms-full": "Serve the site's text as llms-full.txt.",
}


def check_catalogue(spark: SparkSession) -> DataFrame:
    """(check_id, layer, weight, fix): the 27 checks as a table."""
    every = [x[:3] for part in (CHECKS, MARKUP_CHECKS, ENTITY_CHECKS, SPEED_CHECKS, _UNKNOWN) for x in part]
    return spark.createDataFrame([(*x, FIXES[x[0]]) for x in every], "check_id string, layer string, weight int, fix string")


def check_evidence(signals: DataFrame, keep: int = SHOWN) -> DataFrame:
    """(host, check_id, n, of, urls): the pages that each page-level check finds wrong, how many of how many, the ``keep`` first by page_id.

    Checks that no page of a host fails have no row. A page passes through once, and only ``keep`` addresses of a check
    are gathered.
    """
    c = F.col
    shared = signals.where("title <> ''").groupBy("host", "title").agg(F.count(F.lit(1)).alias("_sharing"))
    x = signals.join(shared, ["host", "title"], "left")
    article = c("url").rlike(ARTICLES)
    wrong = {
        "server-rendered": c("app_shell"), "titles": (c("title") == "") | (F.coalesce("_sharing", F.lit(0)) > 1), "descriptions": c("description") == "", "h1": F.size("h1") != 1,
        "structure": F.size(F.filter("headings", lambda h: h.level == 2)) < 2, "canonical": c("canonical") == "", "indexable": c("meta_robots").rlike("(?i)noindex"),
        "alt-text": c("images") > c("images_with_alt"), "jsonld-valid": c("jsonld_errors") > 0, "freshness": article & ~(c("has_date") & c("has_author")),
    }
    of = x.groupBy("host").agg(F.count(F.lit(1)).alias("of"))
    met = x.select("host", "page_id", "url", F.explode(F.array_compact(F.array(*(F.when(cond, F.lit(k)) for k, cond in wrong.items())))).alias("check_id"))
    n = met.groupBy("host", "check_id").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("host", "check_id").orderBy("page_id", "url"))
    shown = met.withColumn("_i", place).where(c("_i") <= keep).groupBy("host", "check_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "url"))), lambda r: r.url).alias("urls"))
    return n.join(shown, ["host", "check_id"]).join(of, "host").select("host", "check_id", "n", "of", "urls")


def fix_texts(check_rows: DataFrame, evidence: DataFrame) -> DataFrame:
    """(host, check_id, status, n, of, urls, fix): what to do about each failing or warning check, with its evidence filled in."""
    fixes = F.create_map(*(F.lit(v) for kv in FIXES.items() for v in kv))
    text = F.try_element_at(fixes, F.col("check_id"))
    for name, value in (("n", F.col("n").cast("string")), ("of", F.col("of").cast("string")), ("first", F.get("urls", F.lit(0)))):
        text = F.replace(text, F.lit(f"{{{name}}}"), F.coalesce(value, F.lit("")))
    return check_rows.where("status IN ('fail', 'warn')").join(evidence, ["host", "check_id"], "left").select("host", "check_id", "status", "n", "of", "urls", text.alias("fix"))
