"""Structured data of pages: every typed node of their JSON-LD, what it lacks, and the organisation a site names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import host_of

LINKED_DATA = "(?is)<script[^>]*type\\s*=\\s*[\"']?application/ld\\+json[\"']?[^>]*>(.*?)</script>"

# Node type, properties it must have, properties it should have, properties of which it must have one.
RULES = (
    ("Organization", "name url", "logo sameAs description contactPoint", ""),
    ("Corporation", "name url", "logo sameAs description", ""),
    ("LocalBusiness", "name address", "telephone openingHoursSpecification geo url", ""),
    ("WebSite", "name url", "potentialAction", ""),
    ("Product", "name", "description image brand", "offers aggregateRating review"),
    ("SoftwareApplication", "name", "applicationCategory operatingSystem description", "offers aggregateRating review"),
    ("WebApplication", "name", "applicationCategory operatingSystem description", "offers aggregateRating review"),
    ("Service", "name", "description provider areaServed offers", ""),
    ("Offer", "price priceCurrency", "availability url", ""),
    ("FAQPage", "mainEntity", "", ""),
    ("Question", "name acceptedAnswer", "", ""),
    ("Article", "headline", "author datePublished dateModified image", ""),
    ("BlogPosting", "headline", "author datePublished dateModified image", ""),
    ("NewsArticle", "headline", "author datePublished dateModified image", ""),
    ("HowTo", "name step", "totalTime image", ""),
    ("BreadcrumbList", "itemListElement", "", ""),
    ("Person", "name", "url sameAs jobTitle", ""),
    ("Event", "name startDate location", "endDate offers description", ""),
    ("Review", "author reviewRating", "itemReviewed", ""),
    ("AggregateRating", "ratingValue", "bestRating", "ratingCount reviewCount"),
)
DATES = ("datePublished", "dateModified", "startDate")
ORGANISATIONS = (
    "^(Organization|Corporation|LocalBusiness|OnlineBusiness|OnlineStore|NGO|EducationalOrganization|MedicalOrganization|ProfessionalService|"
    "Store|Restaurant|LegalService|FinancialService|.*Business)$"
)
SOCIAL = (
    r"(?i)^https?:\/\/(www\.)?(linkedin\.com|twitter\.com|x\.com|facebook\.com|instagram\.com|youtube\.com|github\.com|crunchbase\.com|"
    r"[a-z]{2}\.wikipedia\.org|wikidata\.org|tiktok\.com|g2\.com|trustpilot\.com)\/"
)
DEPTH, SHOWN = 6, 24
# A date is one of ISO 8601 that exists, or one with the month's name, as in mail headers.
NAMED_MONTH = r"(?i)^(?:[a-z]{3,9},?\s+)?(?:\d{1,2}\s+(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*|(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+\d{1,2}),?\s+\d{4}\b"


def _kind(value: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def _string(value: Column) -> Column:
    """A string's text; null for a value of another kind."""
    return F.when(_kind(value) == "STRING", F.try_variant_get(value, "$", "string"))


def _items(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def _children(value: Column) -> Column:
    """What a list or an object holds, but for an object's context; nothing in a plain value."""
    entries = F.map_values(F.map_filter(F.try_variant_get(value, "$", "map<string,variant>"), lambda k, _: k != "@context"))
    held = F.when(_kind(value) == "ARRAY", _items(value)).when(_kind(value) == "OBJECT", entries)
    return F.filter(F.coalesce(held, F.array().cast("array<variant>")), lambda v: _kind(v).isin("ARRAY", "OBJECT"))


def present(value: Column, lists: int = 2) -> Column:
    """Whether a property says something: not null, not blank, not a list of such. Lists in lists, to ``lists``, are opened."""
    kind = _kind(value)
    listed = F.exists(_items(value), lambda v: present(v, lists - 1)) if lists else F.lit(True)
    return F.coalesce(
        F.when(kind == "STRING", F.trim(F.try_variant_get(value, "$", "string")) != "").when(kind == "ARRAY", listed).otherwise(kind != "VOID"), F.lit(False)
    )


def nodes(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, path, types, node) of ``pages`` (page_id, url, html): objects with a type, at most six levels deep.

    path orders a page's nodes from outer to inner ones: list items stand in their order, an object's entries in the
    order of their names. A script that isn't JSON has no nodes; nor has a null source.
    """
    parsed = F.filter(F.transform(F.regexp_extract_all("html", F.lit(LINKED_DATA), F.lit(1)), F.try_parse_json), lambda v: v.isNotNull())
    node = lambda path, v: F.struct(path.alias("path"), v.alias("v"))
    out = pages.where(F.col("html").rlike("(?i)application/ld\\+json")).select(
        "page_id", "url", host_of(F.col("url")).alias("host"), F.transform(parsed, lambda v, i: node(F.array(i), v)).alias("_1")
    )
    for level in range(2, DEPTH + 1):
        inner = lambda x: F.transform(_children(x.v), lambda c, i: node(F.concat(x.path, F.array(i)), c))
        out = out.withColumn(f"_{level}", F.flatten(F.transform(f"_{level - 1}", inner)))
    every = out.select("page_id", "url", "host", F.inline(F.concat(*(f"_{i}" for i in range(1, DEPTH + 1)))))
    typed = F.try_variant_get("v", "$['@type']", "variant")
    types = F.transform(F.when(_kind(typed) == "ARRAY", _items(typed)).otherwise(F.array(typed)), _string)
    return every.where(_kind(F.col("v")) == "OBJECT").select(
        "page_id", "url", "host", "path", F.array_compact(types).alias("types"), F.col("v").alias("node")
    ).where(F.size("types") > 0)


def typed_objects(blocks: Column) -> Column:
    """The distinct types of the objects in an array of parsed blocks, at most six levels deep, contexts left out."""
    level, every = blocks, [blocks]
    for _ in range(2, DEPTH + 1):
        level = F.flatten(F.transform(level, _children))
        every.append(level)
    objects = F.filter(F.concat(*every), lambda v: _kind(v) == "OBJECT")
    typed = F.filter(F.transform(objects, lambda v: F.try_variant_get(v, "$['@type']", "variant")), lambda v: v.isNotNull())
    names = F.flatten(F.transform(typed, lambda t: F.transform(F.when(_kind(t) == "ARRAY", _items(t)).otherwise(F.array(t)), _string)))
    return F.array_distinct(F.array_compact(names))


def organisation_names(typed: DataFrame) -> DataFrame:
    """(host, name) of ``nodes``: the first organisation with a name, at the top of a page's data or in its graph, by page."""
    name = _string(F.try_variant_get("node", "$['name']", "variant"))
    # at the top: a block or an item of a list of blocks; in a graph: one list further in
    top = F.size("path") <= 3
    orgs = typed.where(top & F.exists("types", lambda t: t.rlike("Organization|Business|Corporation"))).withColumn("name", name).where("name IS NOT NULL")
    return orgs.groupBy("host").agg(F.min_by("name", F.struct("page_id", "path")).alias("name"))


def _rule_map() -> Column:
    words = lambda s: F.split(F.lit(s), " ") if s else F.array().cast("array<string>")
    pairs = [x for t, must, should, one in RULES for x in (
        F.lit(t), F.struct(words(must).alias("must"), words(should).alias("should"), words(one).alias("one"))
    )]
    return F.create_map(*pairs)


def node_checks(typed: DataFrame) -> DataFrame:
    """(page_id, host, no, type, label, missing_required, missing_recommended, problems, ok) of ``nodes``.

    A node counts as the first of its types that has rules; nodes without one are left out. The first 24 of a page are kept.
    """
    known = F.array(*(F.lit(r[0]) for r in RULES))
    held = typed.withColumn("type", F.get(F.filter("types", lambda t: F.array_contains(known, t)), F.lit(0))).where("type IS NOT NULL")
    held = held.withColumns({"_m": F.try_variant_get("node", "$", "map<string,variant>"), "_r": F.try_element_at(_rule_map(), F.col("type"))})
    prop = lambda k: F.try_element_at(F.col("_m"), k if isinstance(k, Column) else F.lit(k))
    lacking = lambda keys: F.filter(keys, lambda k: ~present(prop(k)))
    one = F.col("_r.one")
    none_of = (F.size(one) > 0) & ~F.exists(one, lambda k: present(prop(k)))
    empty = F.array().cast("array<string>")
    answer = prop("acceptedAnswer")
    text = F.when(_kind(answer) == "ARRAY", F.try_variant_get(answer, "$[0].text", "variant")).when(_kind(answer) == "OBJECT", F.try_variant_get(answer, "$.text", "variant"))
    given = answer.isNotNull() & (_kind(answer) != "VOID") & (F.coalesce(_string(answer), F.lit("-")) != "")

    def undated(key: str) -> Column:
        said = F.trim(_string(prop(key)))
        dated = (said.rlike(r"^\d{4}(?:-\d|$)") & F.try_to_timestamp(said).isNotNull()) | said.rlike(NAMED_MONTH)
        return F.when(~dated, F.concat(F.lit(f'{key} is not a date: "'), _string(prop(key)), F.lit('".')))

    url = _string(prop("url"))
    problems = F.array_compact(F.array(
        F.when((F.col("type") == "Question") & given & ~present(text), "The accepted answer has no text."),
        *(undated(k) for k in DATES),
        F.when(~url.rlike("(?i)^https?://"), F.concat(F.lit('url is not absolute: "'), url, F.lit('".'))),
    ))
    label = F.coalesce(*(F.when(F.trim(_string(prop(k))) != "", _string(prop(k))) for k in ("name", "headline")), F.lit(""))
    rows = held.select(
        "page_id", "host", "path", "type", F.substring(label, 1, 80).alias("label"),
        F.concat(lacking(F.col("_r.must")), F.when(none_of, F.array(F.array_join(one, " or "))).otherwise(empty)).alias("missing_required"),
        lacking(F.col("_r.should")).alias("missing_recommended"), problems.alias("problems"),
    ).withColumn("ok", (F.size("missing_required") == 0) & (F.size("problems") == 0))
    # one page's nodes: bounded by what one page holds
    cols = ("path", "type", "label", "missing_required", "missing_recommended", "problems", "ok")
    by_page = rows.groupBy("page_id", "host").agg(F.slice(F.array_sort(F.collect_list(F.struct(*cols))), 1, SHOWN).alias("_n"))
    return by_page.select("page_id", "host", F.posexplode("_n").alias("no", "_x")).select("page_id", "host", "no", *(f"_x.{c}" for c in cols[1:]))


def organisations(typed: DataFrame) -> DataFrame:
    """(host, page_id, types, core, same_as): a host's first organisation node: which core properties it has, how many profiles."""
    m = F.try_variant_get("node", "$", "map<string,variant>")
    prop = lambda k: F.try_element_at(m, F.lit(k))
    said = lambda k: F.when(_kind(prop(k)) != "VOID", ~F.coalesce(F.try_variant_get(prop(k), "$", "string"), F.lit("-")).isin("", "false", "0"))
    core = F.array_compact(F.array(*(F.when(said(k), k) for k in ("name", "url", "logo", "description"))))
    same = prop("sameAs")
    count = F.when(same.isNull() | (_kind(same) == "VOID"), 0).when(_kind(same) == "ARRAY", F.size(_items(same))).otherwise(1)
    orgs = typed.where(F.exists("types", lambda t: t.rlike(ORGANISATIONS)))
    first = orgs.groupBy("host").agg(F.min_by(F.struct("page_id", "types", core.alias("core"), count.alias("same_as")), F.struct("page_id", "path")).alias("o"))
    return first.select("host", "o.*")
