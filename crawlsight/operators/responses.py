"""What a response is to a reader that runs no scripts: a page, a file, a challenge, a sitemap, a Markdown text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import ascii_edges, collapse, word_count
from ..functions.urls import resolve_link
from ..sources.tables import Stored
from .signals import HIDDEN, MOUNT, attribute, plain, tag_with

# Wording of bot challenges and sign-in pages, types that are text.
CHALLENGE = r"(?i)cf-chl|challenge-platform|just a moment\.\.\.|attention required|enable javascript and cookies|captcha|are you a robot"
SIGN_IN = r"(?i)sign\s?in|log\s?in|password"
TEXTUAL = r"(?i)html|xml|text/plain|json|markdown|javascript"
_PAGE_HEAD = r"(?is)^\s*<(!doctype|html)"


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def is_html_page(responses: DataFrame) -> Column:
    """Whether a response (status, content_type, body) is a page: no error, and HTML by its type or, without one, by its body."""
    kind = _text("content_type")
    html = kind.rlike("(?i)html") | ((kind == "") & _text("body").rlike("(?i)<html"))
    return F.coalesce(F.col("status") < 400, F.lit(False)) & html


def file_probes(responses: DataFrame) -> DataFrame:
    """``responses`` (status, content_type, body, more) to requests for text files: a page served in a file's place is no file.

    Such a page's status becomes 404. Only a file that was served keeps its body; a null body or type is empty.
    """
    page = _text("content_type").rlike("(?i)html") | _text("body").rlike(_PAGE_HEAD)
    served = F.coalesce(F.col("status") == 200, F.lit(False))
    return responses.withColumns({
        "status": F.when(served & page, 404).otherwise(F.col("status")), "content_type": _text("content_type"),
        "body": F.when(served & ~page, _text("body")).otherwise(""),
    })


def agent_view(responses: DataFrame) -> DataFrame:
    """What a reader has after each of ``responses`` (url, content_type, body, more).

    Adds title, text (16,000 characters), words, readable, app_shell, challenge and login_wall. What is no page is its own
    text, can be read if its type is textual or missing, and is never a shell, challenge or wall. Nulls are empty.
    """
    c = F.col
    body, kind = _text("body"), _text("content_type")
    staged = responses.withColumns({
        "_page": kind.rlike("(?i)html|xml") | body.rlike(r"(?i)<html[\s>]"), "_shown": F.regexp_replace(body, HIDDEN, " "),
    })
    shown = c("_shown")
    inside = F.regexp_extract(shown, ascii_edges(r"(?is)<body\b[^>]*>(.*?)(?:</body>|$)"), 1)
    main, article = (plain(F.regexp_extract(shown, ascii_edges(rf"(?is)<{t}\b[^>]*>(.*?)</{t}>"), 1)) for t in ("main", "article"))
    staged = staged.withColumns({
        "_body": F.when(~c("_page"), collapse(body)).when(plain(inside) != "", plain(inside)).otherwise(plain(shown)),
        "_main": F.when(main != "", main).otherwise(article),
        "title": F.when(c("_page"), plain(F.regexp_extract(body, "(?is)<title[^>]*>(.*?)</title>", 1))).otherwise(""),
    })
    words = word_count(c("_body"))
    scripts = F.regexp_count(body, F.lit(ascii_edges(r"(?i)<script\b[^>]*\ssrc\s*=")))
    password = body.rlike(ascii_edges(r"(?is)<input\b[^>]*\stype\s*=\s*[\"']?password\b"))
    begin = F.concat_ws(" ", "title", F.substring("_body", 1, 600))
    return staged.withColumns({
        "text": F.substring(F.when(c("_page") & (c("_main") != ""), c("_main")).otherwise(c("_body")), 1, 16_000), "words": words,
        "readable": c("_page") | (kind == "") | kind.rlike(TEXTUAL),
        "app_shell": c("_page") & (words < 120) & (body.rlike(MOUNT) | (scripts >= 3)),
        "challenge": c("_page") & F.substring(body, 1, 20_000).rlike(CHALLENGE) & (words < 400),
        "login_wall": c("_page") & password & (words < 500) & begin.rlike(SIGN_IN),
    }).drop("_page", "_shown", "_body", "_main")


# ---------------------------------------------------------------- sitemaps


def sitemap_locations(xml: Column) -> Column:
    """The addresses that a sitemap lists, in order; CDATA and ``&amp;`` are read."""
    found = F.regexp_extract_all(xml, F.lit(r"(?i)<loc>\s*(?:<!\[CDATA\[)?\s*([^<\]\s]+)"), F.lit(1))
    return F.transform(found, lambda x: F.replace(x, F.lit("&amp;"), F.lit("&")))


def sitemap_states(probes: DataFrame) -> DataFrame:
    """``probes`` (status, body, more) of sitemaps with kind (index, pages or null), locations and the status that counts.

    A file that was served but is no sitemap has status 422.
    """
    body, served = _text("body"), F.coalesce(F.col("status") == 200, F.lit(False))
    kind = F.when(served & body.rlike("(?i)<sitemapindex"), "index").when(served & body.rlike("(?i)<urlset"), "pages")
    return probes.withColumns({
        "kind": kind, "locations": F.when(kind.isNotNull(), sitemap_locations(body)).otherwise(F.array().cast("array<string>")),
        "status": F.when(served & kind.isNull(), 422).otherwise(F.col("status")),
    })


def host_sitemaps(probes: DataFrame, tried: int = 4) -> DataFrame:
    """(host, url, status, kind): the sitemap of each host: the first of its ``tried`` probes (host, seq, url, status, body) that is one.

    A host without one has its first probe's address and status, 422 if that was served but is none; without any probe
    it has no row.
    """
    rows = sitemap_states(probes.withColumn("_i", F.row_number().over(Window.partitionBy("host").orderBy("seq", "url"))).where(F.col("_i") <= tried))
    none = F.col("kind").isNull()
    best = rows.groupBy("host").agg(F.min_by(F.struct("url", "status", "kind"), F.struct(none.alias("none"), F.col("_i").alias("i"))).alias("x"))
    return best.select("host", "x.url", "x.status", "x.kind")


def sitemap_pages(roots: DataFrame, files: DataFrame, depth: int = 3) -> DataFrame:
    """(host, url, sitemap, level): the pages that each host's sitemaps list, through index files and the files they name.

    ``roots`` (host, url) are where each host's reading starts, ``files`` (url, status, body) what was fetched. An index
    file is opened ``depth`` levels deep at most, each file once per host, so files that name each other end. An index
    whose files name no page is taken to list pages itself. A page counts once per host, at its first level, by the
    sitemap that comes first. Files that are null, failed or no sitemap list nothing.
    """
    # every level joins the files again: they are read once, to addresses
    state = sitemap_states(files).where("kind IS NOT NULL").groupBy("url").agg(F.first(F.struct("kind", "locations")).alias("f")).select("url", "f.kind", "f.locations")
    store = Stored(files.sparkSession, "sitemaps")
    known = store.put(state, "files")
    frontier = store.put(roots.select("host", F.col("url").alias("sitemap")).where("sitemap IS NOT NULL").distinct(), "level0")
    seen, read, level = frontier, [], 0
    while level <= depth:
        opened = frontier.join(known, frontier.sitemap == known.url).select("host", "sitemap", "kind", F.explode_outer("locations").alias("at"), F.lit(level).alias("level"))
        opened = store.put(opened, f"opened{level}")
        read.append(opened)
        found = opened.where("kind = 'index' AND at IS NOT NULL").select("host", F.col("at").alias("sitemap")).distinct()
        level += 1
        frontier = store.put(found.join(seen, ["host", "sitemap"], "left_anti"), f"level{level}")
        seen = seen.union(frontier)
        if not frontier.limit(1).count():
            break
    rows = read[0]
    for more in read[1:]:
        rows = rows.union(more)
    pages = rows.where("kind = 'pages' AND at IS NOT NULL")
    # a host whose indexes led to no page: what its first level names is pages
    empty = rows.where("kind = 'index' AND level = 0 AND at IS NOT NULL").join(pages.select("host").distinct(), "host", "left_anti")
    every = pages.union(empty)
    first = every.groupBy("host", "at").agg(F.min(F.struct("level", "sitemap")).alias("x"))
    return first.select("host", F.col("at").alias("url"), "x.sitemap", "x.level")


# ---------------------------------------------------------------- Markdown


def _clean(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def markdown_pages(pages: DataFrame) -> DataFrame:
    """Each of ``pages`` (url, body, more) as a Markdown text: headings, links, paragraphs, title, description, text, fingerprint.

    A line of one to six # and a blank is a heading; every other line with text, but for a fence's own line, is a paragraph
    without its marks. Links are those of all lines, resolved, http and https only, repeats kept. The first heading is the
    title, the first paragraph the description. Null bodies are empty; a column of such a name is replaced.
    """
    # Unicode blanks end a line's text as well
    lines = F.transform(F.split(_text("body"), r"\r?\n", -1), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    level = lambda x: F.length(F.regexp_extract(x, "^(#{1,6}) ", 1))
    heads = F.filter(F.transform(F.filter("_lines", lambda x: x.rlike("^#{1,6} ")), lambda x: F.struct(level(x).alias("level"), _clean(F.substring(x, level(x) + 2, F.length(x))).alias("text"))), lambda h: h.text != "")
    marks = lambda x: F.regexp_replace(F.regexp_replace(x, "[*_`]", ""), r"!?\[|\]", "")
    paragraphs = F.transform(F.filter("_lines", lambda x: (x != "") & ~x.rlike("^#{1,6} ") & ~x.startswith("```")), lambda x: _clean(marks(x)))
    targets = F.flatten(F.transform("_lines", lambda x: F.regexp_extract_all(x, F.lit(r"\]\(\s*([^)\s]*)[^)]*\)"), F.lit(1))))
    links = F.filter(F.transform(targets, lambda x: resolve_link(F.col("url"), x)), lambda x: x.rlike("(?i)^https?://"))
    out = pages.withColumn("_lines", lines).withColumns({"headings": heads, "paragraphs": paragraphs, "links": links}).drop("_lines")
    said = F.concat_ws(" ", F.transform("headings", lambda h: h.text), "paragraphs")
    return out.withColumns({
        "title": F.coalesce(F.get(F.transform("headings", lambda h: h.text), F.lit(0)), F.lit("")), "description": F.coalesce(F.get("paragraphs", F.lit(0)), F.lit("")),
        "text": _clean(said),
    }).withColumn("fingerprint", F.sha2(F.col("text").cast("binary"), 256))


# ---------------------------------------------------------------- metadata


def page_description(html: Column) -> Column:
    """The description of a page, that of its Open Graph data where it has none of its own."""
    own = collapse(attribute(tag_with(html, "meta", "name", "description"), "content"))
    return F.when(own != "", own).otherwise(collapse(attribute(tag_with(html, "meta", "property", "og:description"), "content")))
