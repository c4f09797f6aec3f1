"""Texts for people and coding agents out of briefs and tasks: outlines, FAQ data, one brief a host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import js_round

#: How a page for each kind of sub-query is built; {title} and {brand} are filled in.
OUTLINES = {
    "equivalent": ("Heading: {title}", "One paragraph that answers, in the reader's words, what {brand} does here", "Section: how it works, step by step", "Section: prices and limits", "Section: questions, each answered at once"),
    "canonicalization": ("Heading: {title}", "The category by its usual name, and the place of {brand} in it", "Section: what the category is, in one definition", "Section: where {brand} fits it and where not", "Section: other words for it"),
    "specification": ("Heading: {title}", "For whom this is, first: segment, size, place or use", "Section: what {brand} does in that case", "Section: an example with real numbers", "Section: what it needs and where it ends"),
    "generalization": ("Heading: {title}", "What holds in general, without advertising", "Section: the choices in a table", "Section: the place of {brand} among them", "Section: a list for choosing"),
    "comparison": ("Heading: {title}", "Whom {brand} suits better, and whom the other", "Section: both in one table", "Section: what speaks for {brand}, with proof", "Section: what speaks for the other", "Section: changing over"),
    "follow_up": ("Heading: {title}", "The answer in the first paragraph", "Section: what comes after the start with {brand}", "Section: the doubt behind the question, and proof", "Section: related questions"),
    "entailment": ("Heading: {title}", "The fact that the question takes for granted about {brand}, with its source", "Section: proof in numbers, dates and names", "Section: where that is written down"),
}
TITLE = 60


def _sentence(query: Column) -> Column:
    text = F.trim(F.regexp_replace(query, r"(?U)\s+", " "))
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, F.length(text)))


def brief_title(query: Column) -> Column:
    """A query as a title: sentence case, no last mark, at most 60 characters, cut between words."""
    text = F.regexp_replace(_sentence(query), r"[?.!]+$", "")
    return F.when(F.length(text) > TITLE, F.concat(F.regexp_replace(F.substring(text, 1, TITLE - 3), r"\s+\S*$", ""), F.lit("…"))).otherwise(text)


def brief_question(query: Column) -> Column:
    """A query as a question."""
    text = F.regexp_replace(_sentence(query), r"[.!]+$", "")
    return F.when(text.endswith("?"), text).otherwise(F.concat(text, F.lit("?")))


def faq_data(question: Column, answer: Column) -> Column:
    """Structured data of one question and its answer, as JSON."""
    one = F.struct(F.lit("Question").alias("@type"), question.alias("name"), F.struct(F.lit("Answer").alias("@type"), answer.alias("text")).alias("acceptedAnswer"))
    return F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit("FAQPage").alias("@type"), F.array(one).alias("mainEntity")))


def _per_cent(share: Column) -> Column:
    return F.concat(js_round(100 * share).cast("int").cast("string"), F.lit(" %"))


def brief_texts(briefs: DataFrame, identity: DataFrame) -> DataFrame:
    """``briefs`` (host, rank, query, reason, action, target, missing_terms, and type, coverage, matched, rival_url, rival_coverage, which may be missing) with title, outline, schema and markdown.

    A kind that is unknown or missing is built like an equivalent question. ``identity``: host, brand; a host without a row
    is its own brand. schema: FAQ data with the answer left to be written. One text a brief.
    """
    c = F.col
    kinds = {"type": "string", "coverage": "double", "matched": "array<string>", "rival_url": "string", "rival_coverage": "double"}
    x = briefs.withColumns({k: F.lit(None).cast(t) for k, t in kinds.items() if k not in briefs.columns})
    x = x.join(identity.groupBy("host").agg(F.min("brand").alias("_brand")), "host", "left").withColumn("_brand", F.coalesce("_brand", "host"))
    outlines = F.create_map(*(v for k, lines in OUTLINES.items() for v in (F.lit(k), F.array(*map(F.lit, lines)))))
    x = x.withColumn("title", brief_title(c("query")))
    lines = F.coalesce(F.try_element_at(outlines, c("type")), F.array(*map(F.lit, OUTLINES["equivalent"])))
    x = x.withColumn("outline", F.transform(lines, lambda s: F.replace(F.replace(s, F.lit("{title}"), c("title")), F.lit("{brand}"), c("_brand"))))
    cover = F.array_join("missing_terms", ", ")
    todo = F.concat(F.lit("TO WRITE: 40 to 60 words that name "), c("_brand"), F.lit(" and cover "), F.when(cover != "", cover).otherwise("the question"), F.lit("."))
    x = x.withColumn("schema", faq_data(brief_question(c("query")), todo))
    own = F.coalesce(_per_cent(c("coverage")), F.lit("few"))
    found = F.when((c("reason") == "lost") & c("rival_url").isNotNull(), F.concat(F.lit("another site comes first: "), c("rival_url"), F.lit(" has "), F.coalesce(_per_cent(c("rival_coverage")), F.lit("more")), F.lit(" of the words, this one "), own)).when(
        c("reason") == "missing", F.lit("no page has enough of the words")
    ).otherwise(F.concat(F.lit("the best page has "), own, F.lit(" of the words")))
    has = F.coalesce("matched", F.array().cast("array<string>"))
    text = F.concat(
        F.array(F.concat(F.lit("## "), F.initcap("action"), F.lit(": "), c("title")), F.lit(""), F.concat(F.lit("Question: "), c("query")), F.concat(F.lit("Page: "), c("target")), F.concat(F.lit("Found: "), found),
                F.concat(F.lit("Must cover: "), F.when(cover != "", cover).otherwise("the question as it is asked"))),
        F.when(F.size(has) > 0, F.array(F.concat(F.lit("Has: "), F.array_join(has, ", ")))).otherwise(F.array().cast("array<string>")),
        F.array(F.lit(""), F.lit("### Outline")), F.transform("outline", lambda s: F.concat(F.lit("- "), s)),
        F.array(F.lit(""), F.lit("### FAQ data"), F.lit("```json"), c("schema"), F.lit("```")),
    )
    return x.withColumn("markdown", F.array_join(text, "\n")).drop("_brand", *(k for k in kinds if k not in briefs.columns))


#: A text's tokens are about a quarter of its characters.
PER_TOKEN = 4


def fix_lines(identity: DataFrame, board: DataFrame, tasks: DataFrame, texts: DataFrame) -> DataFrame:
    """(host, section, no, part, line): the lines of each host's brief for a coding agent, a row each, in the order of section, no and part.

    ``identity``: host, brand, description; ``board``: host, layer, earned, possible, score, grade; ``tasks``: host, rank, action,
    points, fix; ``texts``: ``brief_texts``. Sections: 0 the head, 1 what was measured, 2 tasks, 3 what to write, 4 rules.
    """
    c, row = F.col, lambda df, section, no, part, line: df.select("host", F.lit(section).alias("section"), no.cast("int").alias("no"), F.lit(part).alias("part"), line.alias("line"))
    zero = F.lit(0)
    head = row(identity, 0, zero, 0, F.concat(F.lit("# Make "), c("host"), F.lit(" visible in AI answers"))).union(
        row(identity, 0, zero, 1, F.concat(F.lit("Readers of all kinds should be able to reach, read and rightly describe "), c("brand"), F.lit(".")))
    ).union(row(identity.where("description <> ''"), 0, zero, 2, F.concat(F.lit("What it is: "), c("description"))))
    whole, layers = board.where("layer IS NULL"), board.where("layer IS NOT NULL AND score IS NOT NULL")
    decimal = lambda name: F.regexp_replace(c(name).cast("decimal(20,1)").cast("string"), r"\.0$", "")
    measured = row(whole, 1, zero, 0, F.concat(F.lit("Readiness: "), c("score").cast("string"), F.lit(" of 100, grade "), c("grade"))).union(
        row(layers, 1, F.array_position(F.array(*map(F.lit, ("access", "content", "entity", "agent"))), c("layer")), 0, F.concat(F.lit("- "), c("layer"), F.lit(": "), decimal("earned"), F.lit(" of "), decimal("possible")))
    )
    gain = F.when(c("points") > 0, F.concat(F.lit(" (+"), decimal("points"), F.lit(" points)"))).otherwise("")
    todo = row(tasks, 2, c("rank"), 0, F.concat(F.lit("## "), c("rank").cast("string"), F.lit(". "), c("action"), gain)).union(row(tasks.where("fix IS NOT NULL"), 2, c("rank"), 1, c("fix")))
    # a brief's headings stand one level lower here
    write = row(texts, 3, c("rank"), 0, F.regexp_replace("markdown", r"(?m)^(#+) ", "#$1 "))
    rules = row(identity, 4, zero, 0, F.lit("Rules: invent no fact, price, customer or number; leave what is unknown marked to be written. Open only what is listed in robots.txt. Measure again afterwards."))
    return head.union(measured).union(todo).union(write).union(rules)


def fix_briefs(lines: DataFrame) -> DataFrame:
    """(host, text, tokens) of ``fix_lines``: one text a host, as long as its tasks, and about how many tokens it has."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "no", "part", "line"))), lambda x: x.line), "\n")
    return lines.groupBy("host").agg(text.alias("text")).withColumn("tokens", F.ceil(F.length("text") / PER_TOKEN).cast("int"))
