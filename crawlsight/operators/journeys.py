"""Agent trails: what a fetch met, what a page proves, how a journey ended."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.window import Window

from ..functions.text import ascii_edges
from ..functions.urls import host_of, own_domain, part, resolve_link, url_key

SLOW_MS, THIN_WORDS = 2500, 120
# What proves that a page answers an intent.
PROOFS = {
    "pricing": r"(?i)(?:[$€£¥₹]\s?\d[\d,.]*|\d[\d,.]*\s?(?:USD|EUR|GBP|INR)\b|\bfree\s+(?:plan|tier|forever)\b|\bper\s+(?:month|year|seat|user|device)\b|\/\s?(?:mo|month|yr|year|seat|user)\b|\bstarting\s+at\b|\bcontact\s+(?:us|sales)\s+for\s+pricing\b)",
    "contact": r"(?i)(?:[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}|(?:\+\d{1,3}[\s.-]?)?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}\b|\btalk\s+to\s+sales\b|\bbook\s+a\s+(?:demo|call|meeting)\b|\bcontact\s+form\b|\bsupport@|\bhello@|\bsales@)",
    "docs": r"(?i)(?:\bAPI\s+(?:key|reference|token|endpoint|docs?)\b|\bAuthorization:\s|\bBearer\s+(?:token|<)|\bcurl\s+-|https?:\/\/api\.|\bbase\s+URL\b|\bnpm\s+install\b|\bpip\s+install\b|\bSDK\b)",
    "signup": r"(?i)(?:\bsign\s?up\b|\bcreate\s+(?:an?\s+)?account\b|\bstart\s+(?:your\s+)?(?:free\s+)?trial\b|\bget\s+started\s+free\b|\badd\s+to\s+(?:cart|basket)\b|\bcheckout\b|\bbuy\s+now\b|\brequest\s+access\b)",
    "policy": r"(?i)(?:\brefund\b|\breturns?\s+(?:policy|within)\b|\bcancel(?:lation)?\s+(?:policy|any\s?time)\b|\bmoney[-\s]?back\b|\b\d+[-\s]?day\s+(?:refund|return|trial|guarantee)\b|\bSLA\b|\buptime\s+guarantee\b)",
    "what": r"(?i)(?:\bwe\s+(?:are|help|build|make|provide|offer)\b|\bour\s+(?:platform|product|mission|customers?)\b|\bfor\s+(?:teams|developers|businesses|enterprises|agencies)\b|\btrusted\s+by\b|\bfounded\s+in\b)",
}
# Paths and link words that lead to an intent, the strongest first.
ROUTES = {
    "pricing": (r"(?i)\/(pricing|plans?|prices?|packages?|cost|subscriptions?)\b", r"(?i)\b(pricing|plans|price|cost|how much)\b", r"(?i)\/(products?|features?|store|shop|buy)\b"),
    "contact": (r"(?i)\/(contact|contact-us|get-in-touch|support|help|sales|demo|book)\b", r"(?i)\b(contact|support|talk to|get in touch|sales|help)\b", r"(?i)\/(about|company|team|locations?)\b"),
    "what": (r"(?i)\/(about|about-us|company|who-we-are|our-story|mission)\b", r"(?i)\/(products?|services?|solutions?|platform|features?)\b", r"(?i)\b(about|what we do|products|platform|solutions)\b"),
    "docs": (r"(?i)\/(docs?|documentation|developers?|api|reference|guides?)\b", r"(?i)\b(docs|documentation|developers|api|reference)\b", r"(?i)\/(resources|support|help)\b"),
    "signup": (r"(?i)\/(signup|sign-up|register|start|trial|get-started|checkout|cart|order|buy)\b", r"(?i)\b(sign up|get started|start free|try|buy|order|subscribe)\b", r"(?i)\/(pricing|plans?|products?)\b"),
    "policy": (r"(?i)\/(refund|returns?|cancel|cancellation|policy|policies|terms|sla|guarantee|warranty)\b", r"(?i)\b(refund|return|cancel|policy|terms|sla|guarantee)\b", r"(?i)\/(support|help|faq|legal)\b"),
}
# How bad each issue is.
SEVERITY = {
    "robots_blocked": "blocker", "firewall_blocked": "blocker", "auth_wall": "blocker", "not_found": "friction", "server_error": "blocker",
    "unreachable": "blocker", "javascript_only": "blocker", "thin_content": "friction", "slow_response": "friction", "wrong_content_type": "friction",
    "redirected": "note", "left_the_site": "friction", "no_route": "blocker", "unverified_answer": "note", "budget_exhausted": "friction",
}
BLOCKED, BROKEN = ("robots_blocked", "firewall_blocked", "auth_wall"), ("not_found", "server_error", "unreachable")
# Words that say nothing about a task.
TASK_STOP = (
    "find what where when which does their they this that with from about into your have much many page site website company there would should could tell"
).split()


def fetch_issues(log: DataFrame) -> DataFrame:
    """``log`` with issues: the codes each fetch earns, in order. Null status, error and flags are allowed."""
    c = F.col
    status, kind = F.coalesce("status", F.lit(0)), F.coalesce("content_type", F.lit(""))
    yes = lambda name: F.coalesce(c(name), F.lit(False))
    ok = status.between(200, 299)
    readable = (kind == "") | kind.rlike(r"(?i)html|xml|text/plain|json|markdown")
    same = (url_key(c("url")) == url_key(c("final_url"))) & (F.coalesce(part(c("url"), "PROTOCOL"), c("url")) == F.coalesce(part(c("final_url"), "PROTOCOL"), c("final_url")))
    code = lambda cond, name: F.when(cond, F.lit(name))
    rest = F.array(
        code(yes("challenge"), "firewall_blocked").when(status.isin(401, 407) | yes("login_wall"), "auth_wall").when(status.isin(403, 429), "firewall_blocked")
        .when(status.isin(404, 410), "not_found").when(status >= 500, "server_error"),
        code(ok & ~readable, "wrong_content_type").when(ok & yes("app_shell"), "javascript_only").when(ok & (F.coalesce("words", F.lit(0)) < THIN_WORDS), "thin_content"),
        code(c("ms") > SLOW_MS, "slow_response"), code((F.coalesce("final_url", F.lit("")) != "") & ~same, "redirected"),
    )
    stopped = F.coalesce("error", F.lit("")) != ""
    return log.withColumn("issues", F.array_compact(F.concat(
        F.array(code(yes("robots_blocked"), "robots_blocked")), F.when(stopped, F.array(F.lit("unreachable"))).otherwise(rest)
    )))


def prove_intent(text: Column, proof: str) -> Column:
    """The words around the first proof in a text, 90 characters each side; empty without one."""
    proof = ascii_edges(proof)
    at, hit = F.regexp_instr(text, F.lit(proof)), F.regexp_substr(text, F.lit(proof))
    begin = F.greatest(F.lit(1), at - 90)
    end = F.least(F.length(text), at + F.length(hit) + 89)
    window = F.trim(F.regexp_replace(F.substring(text, begin, end - begin + 1), r"\s+", " "))
    return F.when(F.coalesce(at, F.lit(0)) == 0, "").otherwise(
        F.concat(F.when(begin > 1, "…").otherwise(""), window, F.when(end < F.length(text), "…").otherwise(""))
    )


def intent_proofs(pages: DataFrame) -> DataFrame:
    """(page_id, intent, evidence) of every page (page_id, text) that proves an intent."""
    tests = F.inline(F.array(*(F.struct(F.lit(i).alias("intent"), prove_intent(F.col("text"), p).alias("evidence")) for i, p in PROOFS.items())))
    return pages.select("page_id", tests).where("evidence <> ''")


def custom_terms(task: Column) -> Column:
    """The first six words of a task that say what it is about."""
    found = F.regexp_extract_all(F.lower(task), F.lit("[a-z][a-z0-9-]{3,}"), F.lit(0))
    return F.slice(F.filter(found, lambda w: ~w.isin(TASK_STOP)), 1, 6)


def _read() -> Column:
    """Whether a step fetched a page that can be read."""
    issues = F.coalesce("issues", F.array().cast("array<string>"))
    return (F.col("action") == "fetch") & (F.coalesce("status", F.lit(999)) < 400) & (F.coalesce("words", F.lit(0)) >= THIN_WORDS) & ~F.array_contains(issues, "javascript_only")


def _any(steps: DataFrame, name: str) -> Column:
    """Whether a step of the journey has the flag; it may be missing or null."""
    return F.coalesce(F.bool_or(name), F.lit(False)) if name in steps.columns else F.lit(False)


def journey_metrics(steps: DataFrame) -> DataFrame:
    """(journey_id, steps, fetches, searches, readable, blocked, broken, ms, slowest_ms, bytes, outcome) of ``steps``.

    ``steps``: journey_id, action, status, ms, bytes, words, issues. An answer completes a journey if one of its steps is
    ``verified`` or its task ``custom``; these flags may be missing. Sums without a fetch are 0.
    """
    fetch = F.col("action") == "fetch"
    met = lambda codes: fetch & F.coalesce(F.arrays_overlap("issues", F.array(*map(F.lit, codes))), F.lit(False))
    n = lambda cond: F.sum(F.coalesce(cond.cast("int"), F.lit(0)))
    total = lambda how, name: F.coalesce(how(F.when(fetch, F.col(name))), F.lit(0))
    out = steps.groupBy("journey_id").agg(
        F.count(F.lit(1)).alias("steps"), n(fetch).alias("fetches"), n(F.col("action") == "search").alias("searches"), n(_read()).alias("readable"),
        n(F.col("action") == "answer").alias("answers"), n(met(BLOCKED)).alias("blocked"), n(met(BROKEN)).alias("broken"),
        total(F.sum, "ms").alias("ms"), total(F.max, "ms").alias("slowest_ms"), total(F.sum, "bytes").alias("bytes"),
        (_any(steps, "verified") | _any(steps, "custom")).alias("proven"),
    )
    answered = F.col("answers") > 0
    outcome = F.when(F.col("readable") == 0, "blocked").when(answered & F.col("proven"), "completed").when(answered, "partial").otherwise("stalled")
    return out.withColumn("outcome", outcome).drop("answers", "proven")


def journey_issues(steps: DataFrame) -> DataFrame:
    """(journey_id, rank, code, severity, step, url): what stood in each journey's way, the worst and earliest first.

    ``steps``: journey_id, n, action, url, final_url, status, words, issues; the flags ``verified``, ``custom`` and
    ``exhausted`` may be missing. A code counts once per url. A journey that gave up after it had read a page found no route.
    """
    url = F.when(F.coalesce("final_url", F.lit("")) != "", F.col("final_url")).otherwise(F.coalesce("url", F.lit("")))
    met = steps.select("journey_id", F.col("n").alias("step"), url.alias("url"), F.explode("issues").alias("code"))
    met = met.groupBy("journey_id", "code", "url").agg(F.min("step").alias("step"))
    does = lambda action: F.coalesce(F.bool_or(F.col("action") == action), F.lit(False))
    runs = steps.groupBy("journey_id").agg(
        does("answer").alias("answered"), does("giveup").alias("gave_up"), F.bool_or(_read()).alias("read"), F.max("n").alias("last"),
        F.min(F.when(F.col("action") == "answer", F.col("n"))).alias("answer"), _any(steps, "verified").alias("verified"),
        _any(steps, "custom").alias("custom"), _any(steps, "exhausted").alias("exhausted"),
    )
    c = F.col
    rule = lambda cond, code, step: F.when(cond, F.struct(F.lit(code).alias("code"), step.cast("long").alias("step")))
    rules = F.array_compact(F.array(
        rule(c("gave_up") & ~c("answered") & c("read"), "no_route", c("last")), rule(c("exhausted") & ~c("answered"), "budget_exhausted", F.lit(None)),
        rule(c("answered") & ~c("verified") & ~c("custom"), "unverified_answer", c("answer")),
    ))
    told = runs.select("journey_id", F.inline(rules)).select("journey_id", "code", F.lit("").alias("url"), "step")
    severity = F.try_element_at(F.create_map(*(F.lit(x) for kv in SEVERITY.items() for x in kv)), c("code"))
    rows = met.withColumn("step", c("step").cast("long")).unionByName(told).withColumn("severity", severity)
    order = Window.partitionBy("journey_id").orderBy(
        F.when(c("severity") == "blocker", 0).when(c("severity") == "friction", 1).otherwise(2), F.coalesce("step", F.lit(99)), "code", "url"
    )
    return rows.select("journey_id", F.row_number().over(order).alias("rank"), "code", "severity", "step", "url")


def issue_counts(issues: DataFrame) -> DataFrame:
    """(journey_id, blockers, friction) of ``journey_issues``."""
    n = lambda s: F.sum((F.col("severity") == s).cast("int"))
    return issues.groupBy("journey_id").agg(n("blocker").alias("blockers"), n("friction").alias("friction"))


def rank_routes(links: DataFrame, visited: DataFrame | None = None) -> DataFrame:
    """(page_id, intent, href, text, score) of ``links`` (page_id, host, pos, href, text): those that lead towards an intent.

    Links that leave the host or that ``visited`` (page_id, key) has are left out; of equal ones the first counts. An
    earlier route scores higher, a deeper path lower.
    """
    own = links.where(own_domain(host_of(F.col("href")), F.col("host"))).withColumn("key", url_key(F.col("href")))
    first = own.groupBy("page_id", "key").agg(F.min_by(F.struct("href", "text"), "pos").alias("l"))
    if visited is not None:
        first = first.join(visited.select("page_id", "key"), ["page_id", "key"], "left_anti")
    path = F.coalesce(part(F.col("l.href"), "PATH"), F.lit("/"))
    path = F.when(path == "", "/").otherwise(path)
    subject = F.concat(path, F.lit(" "), F.coalesce("l.text", F.lit("")))
    depth = F.size(F.filter(F.split(path, "/"), lambda x: x != ""))

    def strength(routes: tuple) -> Column:
        found = F.when(subject.rlike(ascii_edges(routes[0])), len(routes) * 10)
        for i, r in enumerate(routes[1:], 1):
            found = found.when(subject.rlike(ascii_edges(r)), (len(routes) - i) * 10)
        return found

    ranks = F.inline(F.array(*(F.struct(F.lit(i).alias("intent"), (strength(r) - depth).alias("score")) for i, r in ROUTES.items())))
    return first.select("page_id", "l.href", "l.text", ranks).where("score IS NOT NULL").select("page_id", "intent", "href", "text", "score")


def next_moves(pages: DataFrame, routes: DataFrame) -> DataFrame:
    """(page_id, intent, action, url, found): what a reader of each of ``pages`` (page_id, title, text) does next for every intent.

    A page that proves the intent is the answer; else the best of ``rank_routes`` is fetched, ties by address; else the reader gives up.
    """
    said = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit("")))
    proofs = F.inline(F.array(*(F.struct(F.lit(i).alias("intent"), prove_intent(said, p).alias("found")) for i, p in PROOFS.items())))
    best = routes.groupBy("page_id", "intent").agg(F.min_by("href", F.struct((-F.col("score")).alias("s"), "href")).alias("href"))
    rows = pages.select("page_id", proofs).join(best, ["page_id", "intent"], "left")
    proven = F.col("found") != ""
    return rows.select(
        "page_id", "intent", F.when(proven, "answer").when(F.col("href").isNotNull(), "fetch").otherwise("giveup").alias("action"),
        F.when(~proven, F.col("href")).alias("url"), "found",
    )


def admit_moves(moves: DataFrame, visited: DataFrame, spent: DataFrame | None = None, fetches: int = 8, searches: int = 2) -> DataFrame:
    """The proposed ``moves`` (journey_id, n, host, action, url, query) that a journey may make, in the order of n.

    A fetch is resolved against its host's root, must stay on the host by http or https, and be new to the journey
    (``visited``: journey_id, key); it comes out as an absolute address without hash. A search needs three characters, blanks
    at its ends not counted. Of both kinds only so many are let in, less those that ``spent`` (journey_id, fetches, searches)
    says were made; without it each visited key is one fetch. Of equal addresses the first counts. Other actions pass.
    """
    c = F.col
    fetch, search = c("action") == "fetch", c("action") == "search"
    target = resolve_link(F.concat(F.lit("https://"), c("host"), F.lit("/")), c("url"))
    query = F.trim(F.coalesce("query", F.lit(""))) if "query" in moves.columns else F.lit("")
    rows = moves.withColumn("_target", F.when(fetch, target)).withColumn("_key", url_key(c("_target")))
    on_site = F.coalesce(F.lower(part(c("_target"), "PROTOCOL")).isin("http", "https") & own_domain(host_of(c("_target")), host_of(F.concat(F.lit("https://"), c("host")))), F.lit(False))
    rows = rows.where(F.when(fetch, on_site).when(search, F.length(query) >= 3).otherwise(True))
    if spent is None:
        spent = visited.groupBy("journey_id").agg(F.countDistinct("key").alias("fetches"), F.lit(0).alias("searches"))
    used = spent.groupBy("journey_id").agg(F.max("fetches").alias("_fetches"), F.max("searches").alias("_searches"))
    seen = visited.select("journey_id", c("key").alias("_key")).distinct()
    rows = rows.join(seen, ["journey_id", "_key"], "left_anti").join(used, "journey_id", "left")
    # one journey's moves: a few dozen
    again = Window.partitionBy("journey_id", "action", F.coalesce("_key", c("n").cast("string"))).orderBy("n")
    kinds = Window.partitionBy("journey_id", "action").orderBy("n")
    rows = rows.withColumn("_again", F.row_number().over(again)).where("_again = 1").withColumn("_i", F.row_number().over(kinds))
    left = lambda most, name: c("_i") <= most - F.coalesce(name, F.lit(0))
    rows = rows.where(F.when(fetch, left(fetches, "_fetches")).when(search, left(searches, "_searches")).otherwise(True))
    own = {"url": F.when(fetch, c("_target")).otherwise(c("url"))} | ({"query": F.when(search, query).otherwise(c("query"))} if "query" in moves.columns else {})
    return rows.select(*(own[x].alias(x) if x in own else x for x in moves.columns))
