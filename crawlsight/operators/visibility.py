"""How visible a brand is in answers, and how far a fan-out of sub-queries reaches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import ascii_edges, compact, js_round
from ..functions.urls import own_domain, source_domain
from .answers import answer_counts, mentions

# Sites that compare products and are nobody's rival.
PLATFORMS = (
    "G2", "Capterra", "Gartner", "Forrester", "TrustRadius", "Trustpilot", "GetApp", "Software Advice", "Clutch", "Reddit", "Quora", "LinkedIn",
    "Wikipedia", "Forbes", "Google", "YouTube", "Crunchbase", "Glassdoor", "Yelp",
)
# Answers that disown a company as a whole, and one that is named (after these words).
UNKNOWN = (
    r"(?i)(don't|do not|couldn't|could not|can't|cannot|was unable to|am unable to)\s+(have|find|locate|identify)\s+(any\s+)?(specific\s+|reliable\s+|credible\s+)?"
    r"(information|details|records?)\s+(about|on)\s+(a\s+|the\s+)?(company|business|brand|organi[sz]ation|firm|entity)|not (familiar|aware) with (a |the )?"
    r"(company|business|brand|organi[sz]ation)|no (reliable |credible )?(information|record) (exists )?(about|on) (a |the )?(company|business)"
)
DISOWNED = r"(?i)(don't|do not|couldn't|could not|can't|cannot|unable to|no)[^.]{0,40}(information|details|record)s?\s+(about|on)\s+[\"“]?"
# The kinds of sub-queries, in the order in which they are shown.
FANOUT_TYPES = ("equivalent", "canonicalization", "specification", "generalization", "comparison", "follow_up", "entailment")
SHOWN_RIVALS, SHOWN_DOMAINS, ASKED = 8, 12, 12


def is_platform(name: Column) -> Column:
    return compact(name).isin(sorted({"".join(c for c in p.lower() if c.isalnum()) for p in PLATFORMS}))


def recognises(text: Column, brand: Column, needles: Column) -> Column:
    """Whether an answer names the brand, and not only to say that it knows nothing of it."""
    quoted = F.regexp_replace(brand, r"([.*+?^${}()|\[\]\\])", r"\\$1")
    disowned = F.regexp_like(text, F.concat(F.lit(DISOWNED), quoted, F.lit(ascii_edges(r"\b(?!['’]s)"))))
    return mentions(text, needles) & ~text.rlike(UNKNOWN) & ~disowned


def normalised_sources(sources: Column) -> Column:
    """``sources``, array of (uri, title), with the domain of each."""
    return F.transform(sources, lambda s: F.struct(
        s.uri.alias("uri"), F.coalesce(s.title, F.lit("")).alias("title"), source_domain(s.uri, F.coalesce(s.title, F.lit(""))).alias("domain")
    ))


def cites(sources: Column, host: Column) -> Column:
    """Whether any of the sources is on the host's own domain."""
    return F.exists(sources, lambda s: own_domain(s.domain, host))


def rival_names(names: Column, needles: Column, keep: int = 12) -> Column:
    """The first ``keep`` names that are neither the brand's nor a platform's."""
    return F.slice(F.filter(names, lambda n: ~mentions(n, needles) & ~is_platform(n)), 1, keep)


def prompt_queue(prompts: DataFrame, keep: int = ASKED) -> DataFrame:
    """(host, no, kind, text) of ``prompts`` (host, kind, ordinal, text): custom, then category, then branded ones; equal texts once; the first ``keep`` of a host."""
    rows = prompts.select("host", "kind", "ordinal", F.trim("text").alias("text")).where("text <> ''")
    place = F.struct(F.array_position(F.array(*map(F.lit, ("custom", "category", "branded"))), F.col("kind")).alias("kind_no"), "ordinal")
    one = rows.groupBy("host", F.lower("text").alias("key")).agg(F.min(F.struct(place.alias("place"), "text", "kind")).alias("p"))
    ranked = one.withColumn("no", F.row_number().over(Window.partitionBy("host").orderBy("p.place", "key")))
    return ranked.where(F.col("no") <= keep).select("host", "no", "p.kind", "p.text")


def share_of_voice(answers: DataFrame, brands: DataFrame, keep: int = SHOWN_RIVALS) -> DataFrame:
    """(host, name, mentions, brand, rank) over the unbranded answers of ``answers`` (host, answer_id, kind, status, mentioned, competitors).

    The ``keep`` most named rivals, each once an answer and by the first spelling met, platforms left out, and always the
    brand of ``brands`` (host, brand, needles) itself. Ties go to the brand, then to the rival met first.
    """
    asked = answers.where("status = 'ok' and kind <> 'branded'")
    own = asked.groupBy("host").agg(F.sum(F.coalesce(F.col("mentioned"), F.lit(False)).cast("int")).alias("mentions"))
    named = asked.select("host", "answer_id", F.posexplode("competitors").alias("at", "name")).withColumn("name", F.trim("name")).where("name <> ''")
    # one answer's spellings count each, as names that differ in it do
    each = named.groupBy("host", "answer_id", "name").agg(F.min("at").alias("at")).join(brands, "host")
    rivals = each.where(~mentions(F.col("name"), F.col("needles")) & ~is_platform(F.col("name")))
    counts = rivals.groupBy("host", compact(F.col("name")).alias("key")).agg(
        F.count(F.lit(1)).cast("int").alias("mentions"), F.min(F.struct("answer_id", "at", "name")).alias("first")
    )
    top = counts.withColumn("n", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("mentions"), "first"))).where(F.col("n") <= keep)
    rows = top.select("host", "first.name", "mentions", F.lit(False).alias("brand"), "n").union(
        brands.join(own, "host", "left").select("host", F.col("brand").alias("name"), F.coalesce("mentions", F.lit(0)).cast("int").alias("mentions"), F.lit(True).alias("brand"), F.lit(0).alias("n"))
    )
    order = Window.partitionBy("host").orderBy(F.desc("mentions"), F.desc("brand"), "n")
    return rows.withColumn("rank", F.row_number().over(order)).drop("n")


def cited_domains(answers: DataFrame, keep: int = SHOWN_DOMAINS, by_name: bool = False) -> DataFrame:
    """(host, domain, count, own): in how many of ``answers`` (host, answer_id, sources, with domains) each domain is cited; the ``keep`` most cited.

    Ties go to the domain met first or, ``by_name``, in alphabetical order, as for the domains that answer a fan-out.
    """
    cited = answers.select("host", "answer_id", F.posexplode("sources").alias("at", "s")).select("host", "answer_id", "at", F.col("s.domain").alias("domain")).where("domain <> ''")
    once = cited.groupBy("host", "answer_id", "domain").agg(F.min("at").alias("at"))
    counts = once.groupBy("host", "domain").agg(F.count(F.lit(1)).cast("int").alias("count"), F.min(F.struct("answer_id", "at")).alias("first"))
    order = Window.partitionBy("host").orderBy(F.desc("count"), "domain" if by_name else "first", "domain")
    top = counts.withColumn("n", F.row_number().over(order)).where(F.col("n") <= keep)
    return top.select("host", "domain", "count", own_domain(F.col("domain"), F.col("host")).alias("own"))


def valid_plan(plans: DataFrame, keep: int = 12) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) of ``plans`` (plan_id, type, query): a plan has 1 to ``keep`` rows of known kinds, of 3 to 240 characters; one bad row rejects it."""
    bad = ~F.coalesce(F.col("type").isin(*FANOUT_TYPES) & F.length("query").between(3, 240), F.lit(False))
    judged = plans.groupBy("plan_id").agg(F.max(bad.cast("int")).alias("bad"), F.count(F.lit(1)).alias("n")).select("plan_id", ((F.col("bad") == 1) | (F.col("n") > keep)).alias("bad"))
    both = plans.join(judged, "plan_id")
    return both.where("not bad").drop("bad"), both.where("bad").drop("bad")


def _reached() -> Column:
    return F.coalesce(F.col("mentioned"), F.lit(False)) | F.coalesce(F.col("cited"), F.lit(False))


def fanout_summary(queries: DataFrame) -> DataFrame:
    """Per seed of ``queries`` (seed, type, status, mentioned, cited, retrieval, lost): reach of the live half and of the index.

    retrieval: answered, weak or missing, null where the index was not asked. Shares are null where nothing was measured.
    """
    ok, n = F.col("status") == "ok", lambda cond: F.sum(F.coalesce(cond, F.lit(False)).cast("int")).cast("int")
    share = lambda hit, of: js_round(100 * hit / F.nullif(of, F.lit(0))).cast("int")
    asked, answered = n(F.col("retrieval").isNotNull()), n(F.col("retrieval") == "answered")
    return queries.groupBy("seed").agg(
        n(ok).alias("measured"), n(ok & F.col("mentioned")).alias("mentions"), n(ok & F.col("cited")).alias("cited"), share(n(ok & _reached()), n(ok)).alias("coverage"),
        answered.alias("answerable"), n(F.col("retrieval") == "weak").alias("weak"), n(F.col("retrieval").isNotNull() & F.col("lost")).alias("lost"), share(answered, asked).alias("answerable_coverage"),
    )


def fanout_by_type(queries: DataFrame, answerable: bool = False) -> DataFrame:
    """(seed, type, type_no, measured, hits): ok sub-queries that were reached or, ``answerable``, those that the index answers; kinds without rows are left out."""
    rows = queries.where("retrieval is not null" if answerable else "status = 'ok'")
    hit = F.col("retrieval") == "answered" if answerable else _reached()
    number = F.array_position(F.array(*map(F.lit, FANOUT_TYPES)), F.col("type")).cast("int")
    return rows.groupBy("seed", "type").agg(F.count(F.lit(1)).cast("int").alias("measured"), F.sum(hit.cast("int")).cast("int").alias("hits")).withColumn("type_no", number).where("type_no > 0")


# What the address of a cited site says about it.
REVIEW_SITES = r"(g2|capterra|clutch|trustpilot|trustradius|getapp|softwareadvice|gartner|yelp|tripadvisor|glassdoor|producthunt)\."
COMMUNITY = r"(reddit|quora|stackoverflow|stackexchange|medium|linkedin|youtube)\."
REFERENCE = r"(wikipedia|wikidata|crunchbase|bloomberg|forbes)\."


def cited_site_class(domain: Column) -> Column:
    """review, community, reference or other; null for none."""
    return F.when(domain.rlike(REVIEW_SITES), "review").when(domain.rlike(COMMUNITY), "community").when(domain.rlike(REFERENCE), "reference").when(domain.isNotNull(), "other")


def visibility_actions(answers: DataFrame, domains: DataFrame) -> DataFrame:
    """(host, rank, action, priority, n, of): what answers call for, the most pressing first, then in the order of the rules.

    ``answers``: host, kind, status, mentioned, cited, grounded, position, inaccuracies (array); ``domains``:
    ``cited_domains``. absent: n of the unbranded answers leave the brand out; sources: n of the cited sites are
    others'; entity: n of the branded answers don't know it; accuracy: n wrong statements; never-cited: n mentions
    without a link. A host without measured answers has no action.
    """
    ok, branded = F.col("status") == "ok", F.col("kind") == "branded"
    missed = ok & ~F.coalesce("mentioned", F.lit(False))
    n = lambda cond: F.sum(cond.cast("int")).cast("int")
    facts = answer_counts(answers).join(answers.groupBy("host").agg(
        n(missed & ~branded).alias("absent"), n(missed & branded).alias("unknown"), n(ok & branded).alias("branded"),
        F.sum(F.coalesce(F.size(F.coalesce("inaccuracies", F.array().cast("array<string>"))), F.lit(0))).cast("int").alias("wrong"),
    ), "host").join(domains.where("NOT own").groupBy("host").agg(F.count(F.lit(1)).cast("int").alias("others")), "host", "left")
    c = F.col

    def rule(cond, action, priority, n, of):
        priority = F.lit(priority) if isinstance(priority, str) else priority
        return F.when(cond, F.struct(F.lit(action).alias("action"), priority.alias("priority"), n.alias("n"), of.alias("of")))

    others = F.coalesce("others", F.lit(0))
    rows = F.array_compact(F.array(
        rule(c("absent") > 0, "absent", F.when(c("absent") / c("category_measured") >= 0.5, "high").otherwise("medium"), c("absent"), c("category_measured")),
        rule(others > 0, "sources", "high", others, others),
        rule(c("unknown") > 0, "entity", F.when(c("unknown") == c("branded"), "high").otherwise("medium"), c("unknown"), c("branded")),
        rule(c("wrong") > 0, "accuracy", "high", c("wrong"), c("wrong")),
        rule((c("grounded_measured") > 0) & (c("citations") == 0) & (c("mentions") > 0), "never-cited", "medium", c("mentions"), c("grounded_measured")),
    ))
    found = facts.where("measured > 0").select("host", F.posexplode(rows).alias("no", "a")).select("host", "no", "a.*")
    order = Window.partitionBy("host").orderBy(F.when(c("priority") == "high", 0).otherwise(1), "no")  # five rows a host
    return found.select("host", F.row_number().over(order).alias("rank"), "action", "priority", "n", "of")
