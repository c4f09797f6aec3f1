"""Registered queries of answers, journeys, histories and addresses, over the rows that events, orders and lines make.

The given tables hold no trails and no answers of models. These queries read an event as a step of an agent, an order as an
answer whose lines are what it names and cites, a customer's orders as the runs of a site, and a supplier's row as a line of
a robots file. ``_STEPS`` and the like are these readings, in words that both engines know; all that follows them is
written twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as ur
from ..functions.text import compact
from ..operators import answers, compare, journeys, robots, visibility
from ..sources.tables import read_table
from .queries import _collapse, _host, _round, query

# ---------------------------------------------------------------- journeys

#: An event as a step: journeys are a user's steps of a thousand events.
_STEPS = """
  user_id || '-' || CAST(floor(event_id / 1000) AS BIGINT) AS journey_id, CAST(event_id AS INT) AS n,
  CASE WHEN event_type IN ('view', 'click', 'error') THEN 'fetch' WHEN event_type = 'signup' AND value >= 60 THEN 'answer' WHEN event_type = 'signup' AND value < 6 THEN 'giveup' ELSE 'search' END AS action,
  'https://site.example/' || (event_id % 7) AS url, CASE WHEN event_id % 11 = 0 THEN 'https://www.site.example/moved' WHEN event_id % 11 = 1 THEN '' ELSE 'https://www.site.example/' || (event_id % 7) || '/' END AS final_url,
  CASE WHEN event_type <> 'error' THEN 200 WHEN event_id % 6 = 0 THEN 404 WHEN event_id % 6 = 1 THEN 403 WHEN event_id % 6 = 2 THEN 503 WHEN event_id % 6 = 3 THEN 401 WHEN event_id % 6 = 4 THEN 302 END AS status,
  CASE WHEN event_type = 'error' AND event_id % 6 = 5 THEN 'reset' END AS error,
  CASE WHEN event_id % 13 = 0 THEN 'application/pdf' WHEN event_id % 13 > 1 THEN 'text/html; charset=utf-8' END AS content_type,
  CAST(floor(value * 40) AS BIGINT) AS ms, CASE WHEN event_id % 9 > 0 THEN CAST(floor(value * 1000) AS BIGINT) END AS bytes, CASE WHEN event_id % 8 > 0 THEN CAST(floor(value * 4) AS INT) END AS words,
  event_id % 17 = 0 AS app_shell, event_id % 19 = 0 AS challenge, CASE WHEN event_id % 2 = 0 THEN event_id % 23 = 0 END AS login_wall, event_id % 29 = 0 AS robots_blocked,
  event_id % 3 = 0 AS verified, user_id % 5 = 0 AS custom, event_id % 31 = 0 AS exhausted"""

_STEP_KEY = "regexp_replace(regexp_replace({0}, '^https://(www\\.)?', ''), '/+$', '')"
_ISSUES = f"""
  raw AS (SELECT {_STEPS} FROM events),
  st AS (SELECT *, list_filter([CASE WHEN robots_blocked THEN 'robots_blocked' END] || CASE WHEN error IS NOT NULL THEN ['unreachable'] ELSE [
    CASE WHEN challenge THEN 'firewall_blocked' WHEN status = 401 OR login_wall THEN 'auth_wall' WHEN status = 403 THEN 'firewall_blocked' WHEN status = 404 THEN 'not_found' WHEN status >= 500 THEN 'server_error' END,
    CASE WHEN status = 200 THEN CASE WHEN content_type LIKE '%pdf' THEN 'wrong_content_type' WHEN app_shell THEN 'javascript_only' WHEN coalesce(words, 0) < {journeys.THIN_WORDS} THEN 'thin_content' END END,
    CASE WHEN ms > {journeys.SLOW_MS} THEN 'slow_response' END,
    CASE WHEN final_url <> '' AND {_STEP_KEY.format('url')} <> {_STEP_KEY.format('final_url')} THEN 'redirected' END] END, lambda x: x IS NOT NULL) AS issues FROM raw),
  flagged AS (SELECT *, action = 'fetch' AS f, action = 'fetch' AND coalesce(status, 999) < 400 AND coalesce(words, 0) >= {journeys.THIN_WORDS} AND NOT list_contains(issues, 'javascript_only') AS readable FROM st)"""
_SEVERE = "CASE " + " ".join(f"WHEN code IN ({', '.join(repr(c) for c, s in journeys.SEVERITY.items() if s == kind)}) THEN '{kind}'" for kind in ("blocker", "friction", "note")) + " END"
_OBSTACLES = f"""{_ISSUES},
  ex AS (SELECT journey_id, n, coalesce(nullif(final_url, ''), url) AS url, unnest(issues) AS code FROM st),
  run AS (SELECT journey_id, bool_or(action = 'answer') AS answered, bool_or(action = 'giveup') AS gave_up, bool_or(readable) AS has_read, max(n) AS latest, min(n) FILTER (action = 'answer') AS at_answer,
    bool_or(verified) AS verified, bool_or(custom) AS custom, bool_or(exhausted) AS exhausted FROM flagged GROUP BY journey_id),
  ob AS (SELECT journey_id, code, url, min(n)::BIGINT AS step FROM ex GROUP BY ALL
    UNION ALL SELECT journey_id, 'no_route', '', latest FROM run WHERE gave_up AND NOT answered AND has_read
    UNION ALL SELECT journey_id, 'budget_exhausted', '', NULL FROM run WHERE exhausted AND NOT answered
    UNION ALL SELECT journey_id, 'unverified_answer', '', at_answer FROM run WHERE answered AND NOT verified AND NOT custom),
  sv AS (SELECT *, {_SEVERE} AS severity FROM ob)"""


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = read_table(spark, sf_dir, "events").selectExpr(*_columns(_STEPS))
    return journeys.fetch_issues(raw)


def _columns(text: str) -> list[str]:
    """The select items of a reading; commas inside brackets and quotes don't part them."""
    items, depth, quoted, start = [], 0, False, 0
    for i, c in enumerate(text):
        quoted ^= c == "'"
        depth += 0 if quoted else (c == "(") - (c == ")")
        if c == "," and not quoted and not depth:
            items, start = [*items, text[start:i].strip()], i + 1
    return [*items, text[start:].strip()]


@query(f"WITH {_ISSUES} SELECT n, journey_id, array_to_string(issues, ',') AS issues FROM st")
def step_issues(spark, sf_dir):
    """What each step met."""
    return _steps(spark, sf_dir).select("n", "journey_id", F.array_join("issues", ",").alias("issues"))


def _any_of(codes: tuple) -> str:
    return "f AND len(list_intersect(issues, [" + ", ".join(f"'{c}'" for c in codes) + "])) > 0"


@query(f"""WITH {_OBSTACLES}, m AS (SELECT journey_id, count(*) AS steps, count(*) FILTER (f) AS fetches, count(*) FILTER (action = 'search') AS searches, count(*) FILTER (readable) AS readable,
    count(*) FILTER ({_any_of(journeys.BLOCKED)}) AS blocked, count(*) FILTER ({_any_of(journeys.BROKEN)}) AS broken, coalesce(sum(ms) FILTER (f), 0)::BIGINT AS ms, coalesce(max(ms) FILTER (f), 0) AS slowest_ms, coalesce(sum(bytes) FILTER (f), 0)::BIGINT AS bytes
    FROM flagged GROUP BY journey_id),
  c AS (SELECT journey_id, count(*) FILTER (severity = 'blocker') AS blockers, count(*) FILTER (severity = 'friction') AS friction FROM sv GROUP BY journey_id)
  SELECT m.*, CASE WHEN readable = 0 THEN 'blocked' WHEN answered AND (verified OR custom) THEN 'completed' WHEN answered THEN 'partial' ELSE 'stalled' END AS outcome, coalesce(blockers, 0) AS blockers, coalesce(friction, 0) AS friction
  FROM m JOIN run USING (journey_id) LEFT JOIN c USING (journey_id)""")
def journey_outcomes(spark, sf_dir):
    """How each journey went, and how much stood in its way."""
    steps = _steps(spark, sf_dir)
    counts = journeys.issue_counts(journeys.journey_issues(steps))
    return journeys.journey_metrics(steps).join(counts, "journey_id", "left").na.fill(0, ["blockers", "friction"])


@query(f"""WITH {_OBSTACLES} SELECT journey_id, row_number() OVER (PARTITION BY journey_id ORDER BY CASE severity WHEN 'blocker' THEN 0 WHEN 'friction' THEN 1 ELSE 2 END, coalesce(step, 99), code, url)::INT AS rank,
  code, severity, step, url FROM sv""")
def journey_obstacles(spark, sf_dir):
    """What stood in each journey's way, the worst first."""
    return journeys.journey_issues(_steps(spark, sf_dir))


#: An event as a move that an agent proposes: its own host's pages, other hosts, mail links, searches.
_MOVES = """
  user_id || '-' || CAST(floor(event_id / 1000) AS BIGINT) AS journey_id, CAST(event_id AS INT) AS n, 'site.example' AS host,
  CASE WHEN event_type IN ('view', 'click', 'error') THEN 'fetch' WHEN event_type = 'signup' THEN 'answer' ELSE 'search' END AS action,
  CASE WHEN event_id % 7 = 0 THEN 'https://other.example/p' WHEN event_id % 7 = 1 THEN 'mailto:me@site.example' WHEN event_id % 7 = 2 THEN 'https://www.site.example/p' || (event_id % 20) || '#top'
    WHEN event_id % 7 = 3 THEN 'p' || (event_id % 20) || '/' WHEN event_id % 7 = 4 THEN 'http://blog.site.example/p' || (event_id % 20) ELSE '/p' || (event_id % 20) END AS url,
  CASE WHEN event_id % 4 = 0 THEN '  ab ' ELSE ' ' || event_type || ' ' END AS query"""


@query(f"""WITH mv AS (SELECT {_MOVES} FROM events),
  ab AS (SELECT *, CASE WHEN action <> 'fetch' THEN NULL WHEN starts_with(url, 'http') THEN regexp_replace(url, '#.*$', '') WHEN starts_with(url, 'mailto') THEN NULL ELSE 'https://site.example/' || ltrim(url, '/') END AS target FROM mv),
  ky AS (SELECT *, regexp_replace(regexp_replace(target, '^https?://(www\\.)?', ''), '/+$', '') AS key FROM ab WHERE CASE action WHEN 'fetch' THEN target IS NOT NULL AND NOT starts_with(target, 'https://other') WHEN 'search' THEN length(trim(query)) >= 3 ELSE TRUE END),
  fresh AS (SELECT * FROM ky WHERE key IS NULL OR NOT (split_part(journey_id, '-', 1)::BIGINT % 2 = 0 AND key IN ('site.example/p1', 'site.example/p2'))),
  one AS (SELECT * FROM fresh QUALIFY row_number() OVER (PARTITION BY journey_id, action, coalesce(key, n::VARCHAR) ORDER BY n) = 1),
  num AS (SELECT *, row_number() OVER (PARTITION BY journey_id, action ORDER BY n) AS i, CASE WHEN split_part(journey_id, '-', 1)::BIGINT % 2 = 0 THEN 2 ELSE 0 END AS used FROM one)
  SELECT journey_id, n, host, action, CASE WHEN action = 'fetch' THEN target ELSE url END AS url, CASE WHEN action = 'search' THEN trim(query) ELSE query END AS query FROM num WHERE CASE action WHEN 'fetch' THEN i <= 8 - used WHEN 'search' THEN i <= 2 ELSE TRUE END""")
def admitted_moves(spark, sf_dir):
    """The moves that journeys may make; those of users with even ids have seen two pages before."""
    moves = read_table(spark, sf_dir, "events").selectExpr(*_columns(_MOVES))
    even = F.substring_index("journey_id", "-", 1).cast("long") % 2 == 0
    seen = moves.where(even).select("journey_id").distinct().select("journey_id", F.explode(F.array(F.lit("site.example/p1"), F.lit("site.example/p2"))).alias("key"))
    return journeys.admit_moves(moves, seen)


# ---------------------------------------------------------------- answers

#: An order as an answer about the site of its customer's nation.
_ANSWERS = """
  'site' || c_nationkey || '.example.com' AS host, o_orderkey AS answer_id, CASE WHEN o_orderpriority = '5-LOW' THEN 'branded' WHEN o_orderpriority = '1-URGENT' THEN 'custom' ELSE 'category' END AS kind,
  CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'ok' END AS status, CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey % 3 = 0 END AS mentioned, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 5 = 0 END AS cited,
  o_orderkey % 2 = 0 AS grounded, CASE WHEN o_orderkey % 3 = 0 THEN CAST(1 + o_orderkey % 9 AS INT) END AS position"""
#: A line as what an answer names and the source that it cites.
_NAMED = """
  l_orderkey AS answer_id, l_linenumber AS no, CASE WHEN l_partkey % 10 = 0 THEN 'Trust Pilot' WHEN l_linenumber % 3 = 0 THEN upper(p_name) WHEN l_linenumber % 3 = 1 THEN replace(p_name, ' ', '-') ELSE ' ' || p_name END AS name,
  'https://www.site' || (l_suppkey % 30) || CASE WHEN l_suppkey % 3 = 0 THEN '.example.com/x' ELSE '.example.org:8080/y?z=1' END AS uri,
  CASE WHEN l_partkey % 4 = 0 THEN 'WWW.Site' || (l_partkey % 25) || '.Example.com ' WHEN l_partkey % 4 = 1 THEN 'docs.site' || (l_partkey % 25) || '.example.com' WHEN l_partkey % 4 = 2 THEN p_name END AS title"""
_ANSWERED = f"""
  an AS (SELECT {_ANSWERS} FROM orders JOIN customer ON c_custkey = o_custkey), nm AS (SELECT {_NAMED} FROM lineitem JOIN part ON p_partkey = l_partkey),
  src AS (SELECT *, CASE WHEN regexp_matches(lower(trim(title)), '^[a-z0-9-]+(\\.[a-z0-9-]+)+$') THEN regexp_replace(lower(trim(title)), '^www\\.', '') ELSE {_host('uri')} END AS domain FROM nm),
  cnt AS (SELECT host, count(*) FILTER (status = 'ok') AS measured, count(*) FILTER (status = 'ok' AND mentioned) AS mentions, count(*) FILTER (status = 'ok' AND kind <> 'branded') AS category_measured,
    count(*) FILTER (status = 'ok' AND kind <> 'branded' AND mentioned) AS category_mentions, count(*) FILTER (status = 'ok' AND grounded AND cited) AS citations, count(*) FILTER (status = 'ok' AND grounded) AS grounded_measured,
    {_round("avg(position) FILTER (status = 'ok')", 1)} AS average_position FROM an GROUP BY host)"""
_CITED = """cd AS (SELECT host, domain, count(DISTINCT answer_id)::INT AS count, min((answer_id, no)) AS first FROM src JOIN an USING (answer_id) WHERE domain <> '' GROUP BY ALL),
  top AS (SELECT *, domain = host OR suffix(domain, '.' || host) AS own FROM cd QUALIFY row_number() OVER (PARTITION BY host ORDER BY count DESC, first, domain) <= 12)"""


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders")
    return orders.join(read_table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).selectExpr(*_columns(_ANSWERS))


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(answer_id, names, sources): what the lines of an order say, in their order."""
    lines = read_table(spark, sf_dir, "lineitem").join(read_table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey")).selectExpr(*_columns(_NAMED))
    rows = lines.groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("no", "name", "uri", "title"))).alias("l"))
    sources = visibility.normalised_sources(F.transform("l", lambda x: F.struct(x.uri.alias("uri"), x.title.alias("title"))))
    return rows.select("answer_id", F.transform("l", lambda x: x["name"]).alias("competitors"), sources.alias("sources"))


@query(f"WITH {_ANSWERED} SELECT * FROM cnt")
def answer_tallies(spark, sf_dir):
    """What was measured and met in the answers about each site."""
    return answers.answer_counts(_answers(spark, sf_dir)).withColumns({c: F.col(c).cast("long") for c in ("measured", "mentions", "category_measured", "category_mentions", "citations", "grounded_measured")})


@query(f"""WITH {_ANSWERED}, sh AS (SELECT host, measured, category_mentions / nullif(category_measured, 0) AS u, (mentions - category_mentions) / nullif(measured - category_measured, 0) AS b, citations / nullif(grounded_measured, 0) AS c FROM cnt)
  SELECT host, measured::INT AS measured, {_round("100 * (coalesce(u * 0.6, 0) + coalesce(b * 0.2, 0) + coalesce(c * 0.2, 0)) / nullif(CASE WHEN u IS NULL THEN 0 ELSE 0.6 END + CASE WHEN b IS NULL THEN 0 ELSE 0.2 END + CASE WHEN c IS NULL THEN 0 ELSE 0.2 END, 0)", 0)}::INT AS score FROM sh""")
def visibility_scores(spark, sf_dir):
    """How visible each site is in the answers about it."""
    return answers.visibility_score(_answers(spark, sf_dir))


_PLAIN = "regexp_replace(lower({0}), '[^a-z0-9]', '', 'g')"


@query(f"""WITH {_ANSWERED}, own AS (SELECT host, arg_min(p_name, p_partkey) AS brand FROM (SELECT *, 'site' || (p_partkey % 25) || '.example.com' AS host FROM part) GROUP BY host),
  asked AS (SELECT * FROM an WHERE status = 'ok' AND kind <> 'branded'),
  ri AS (SELECT host, {_PLAIN.format('name')} AS key, answer_id, no, trim(name) AS name FROM asked JOIN nm USING (answer_id) JOIN own USING (host) WHERE NOT contains({_PLAIN.format('name')}, {_PLAIN.format('brand')}) AND {_PLAIN.format('name')} <> 'trustpilot'),
  once AS (SELECT host, key, name, answer_id, min(no) AS no FROM ri GROUP BY ALL),
  rc AS (SELECT host, count(*) AS mentions, min((answer_id, no, name)) AS first FROM once GROUP BY host, key),
  rt AS (SELECT host, mentions, first[3] AS name, row_number() OVER (PARTITION BY host ORDER BY mentions DESC, first) AS n FROM rc QUALIFY n <= 8),
  al AS (SELECT host, name, mentions, FALSE AS brand, n FROM rt UNION ALL SELECT host, own.brand, count(*) FILTER (mentioned), TRUE, 0 FROM own LEFT JOIN asked USING (host) GROUP BY host, own.brand)
  SELECT host, name, mentions::INT AS mentions, brand, row_number() OVER (PARTITION BY host ORDER BY mentions DESC, brand DESC, n)::INT AS rank FROM al""")
def named_rivals(spark, sf_dir):
    """Whom the unbranded answers about each site name."""
    part = read_table(spark, sf_dir, "part").withColumn("host", F.concat(F.lit("site"), F.col("p_partkey") % 25, F.lit(".example.com")))
    brands = part.groupBy("host").agg(F.min_by("p_name", "p_partkey").alias("brand")).withColumn("needles", F.array(compact(F.col("brand"))))
    return visibility.share_of_voice(_answers(spark, sf_dir).join(_named(spark, sf_dir), "answer_id", "left"), brands)


@query(f"WITH {_ANSWERED}, {_CITED} SELECT host, domain, count, own FROM top")
def cited_sites(spark, sf_dir):
    """The domains that answers about each site cite most."""
    return visibility.cited_domains(_answers(spark, sf_dir).join(_named(spark, sf_dir), "answer_id"))


@query(f"""WITH {_ANSWERED}, {_CITED}, ot AS (SELECT host, count(*) AS others FROM top WHERE NOT own GROUP BY host),
  fa AS (SELECT host, count(*) FILTER (status = 'ok' AND NOT coalesce(mentioned, FALSE) AND kind <> 'branded') AS absent, count(*) FILTER (status = 'ok' AND NOT coalesce(mentioned, FALSE) AND kind = 'branded') AS unknown,
    count(*) FILTER (status = 'ok' AND kind = 'branded') AS branded, count(*) FILTER (answer_id % 10 = 0) AS wrong FROM an GROUP BY host),
  j AS (SELECT * FROM fa JOIN cnt USING (host) LEFT JOIN ot USING (host) WHERE measured > 0),
  rw AS (SELECT host, 0 AS no, 'absent' AS action, CASE WHEN absent / category_measured >= 0.5 THEN 'high' ELSE 'medium' END AS priority, absent AS n, category_measured AS "of" FROM j WHERE absent > 0
    UNION ALL SELECT host, 1, 'sources', 'high', others, others FROM j WHERE others > 0
    UNION ALL SELECT host, 2, 'entity', CASE WHEN unknown = branded THEN 'high' ELSE 'medium' END, unknown, branded FROM j WHERE unknown > 0
    UNION ALL SELECT host, 3, 'accuracy', 'high', wrong, wrong FROM j WHERE wrong > 0
    UNION ALL SELECT host, 4, 'never-cited', 'medium', mentions, grounded_measured FROM j WHERE grounded_measured > 0 AND citations = 0 AND mentions > 0)
  SELECT host, row_number() OVER (PARTITION BY host ORDER BY (priority <> 'high')::INT, no)::INT AS rank, action, priority, n::INT AS n, "of"::INT AS "of" FROM rw""")
def answer_actions(spark, sf_dir):
    """What the answers about each site call for; one in ten says something wrong."""
    asked = _answers(spark, sf_dir).join(_named(spark, sf_dir), "answer_id", "left")
    asked = asked.withColumn("inaccuracies", F.when(F.col("answer_id") % 10 == 0, F.array(F.lit("wrong"))))
    return visibility.visibility_actions(asked, visibility.cited_domains(asked))


#: The text of an answer that lists what its order's lines name.
_LINE = "CASE WHEN l_linenumber % 4 = 0 THEN '   - ' || p_name WHEN l_linenumber % 4 = 1 THEN l_linenumber || '. **' || upper(p_name) || '**: good' WHEN l_linenumber % 4 = 2 THEN '- nothing: ' || p_name ELSE 'As said, ' || p_name END"


@query(f"""WITH li AS (SELECT l_orderkey AS answer_id, l_linenumber AS no, p_partkey, {_LINE} AS line FROM lineitem JOIN part ON p_partkey = l_partkey),
  br AS (SELECT DISTINCT p_name AS brand, {_PLAIN.format('p_name')} AS needle FROM part WHERE length({_PLAIN.format('p_name')}) >= 4),
  tx AS (SELECT answer_id, {_PLAIN.format("string_agg(line, chr(10) ORDER BY no, p_partkey)")} AS squeezed FROM li GROUP BY answer_id),
  it AS (SELECT *, row_number() OVER (PARTITION BY answer_id ORDER BY no, p_partkey) AS i FROM li WHERE no % 4 IN (1, 2)),
  fst AS (SELECT answer_id, needle, min(i) AS i FROM it JOIN br ON no % 4 = 1 AND contains({_PLAIN.format('split_part(line, chr(58), 1)')}, needle) GROUP BY ALL)
  SELECT answer_id, brand, i::INT AS position FROM tx JOIN br ON contains(squeezed, needle) LEFT JOIN fst USING (answer_id, needle)""")
def brand_positions(spark, sf_dir):
    """Which names each answer holds, and their places in its list."""
    part = read_table(spark, sf_dir, "part")
    lines = read_table(spark, sf_dir, "lineitem").join(part, F.col("p_partkey") == F.col("l_partkey"))
    rows = lines.groupBy(F.col("l_orderkey").alias("answer_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "p_partkey", F.expr(_LINE).alias("line")))).alias("l"))
    texts = rows.select("answer_id", F.array_join(F.transform("l", lambda x: x.line), "\n").alias("text"))
    brands = part.select(F.col("p_name").alias("brand"), F.array(compact(F.col("p_name"))).alias("needles")).distinct()
    return answers.brand_hits(texts, brands)


#: An order as a sub-query of its customer's fan-out.
_FANOUT = f"""
  o_custkey AS seed, CASE {' '.join(f"WHEN o_orderkey % 8 = {i} THEN '{t}'" for i, t in enumerate(visibility.FANOUT_TYPES))} ELSE 'odd' END AS type, CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'ok' END AS status,
  CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey % 3 = 0 END AS mentioned, CASE WHEN o_orderkey % 11 > 0 THEN o_orderkey % 5 = 0 END AS cited,
  CASE WHEN o_orderkey % 6 = 0 THEN 'answered' WHEN o_orderkey % 6 = 1 THEN 'weak' WHEN o_orderkey % 6 < 5 THEN 'missing' END AS retrieval, o_orderkey % 4 = 0 AS lost"""


@query(f"""WITH q AS (SELECT {_FANOUT} FROM orders), c AS (SELECT seed, count(*) FILTER (status = 'ok') AS measured, count(*) FILTER (status = 'ok' AND mentioned) AS mentions, count(*) FILTER (status = 'ok' AND cited) AS cited,
    count(*) FILTER (status = 'ok' AND (coalesce(mentioned, FALSE) OR coalesce(cited, FALSE))) AS reached, count(*) FILTER (retrieval = 'answered') AS answerable, count(*) FILTER (retrieval = 'weak') AS weak,
    count(*) FILTER (retrieval IS NOT NULL AND lost) AS lost, count(retrieval) AS asked FROM q GROUP BY seed)
  SELECT seed, measured::INT AS measured, mentions::INT AS mentions, cited::INT AS cited, {_round('100 * reached / nullif(measured, 0)', 0)}::INT AS coverage, answerable::INT AS answerable, weak::INT AS weak, lost::INT AS lost,
    {_round('100 * answerable / nullif(asked, 0)', 0)}::INT AS answerable_coverage FROM c""")
def fanout_reach(spark, sf_dir):
    """How far each fan-out reaches, in answers and in the index."""
    return visibility.fanout_summary(read_table(spark, sf_dir, "orders").selectExpr(*_columns(_FANOUT)))


_BY_TYPE = "SELECT seed, type, list_position([" + ", ".join(f"'{t}'" for t in visibility.FANOUT_TYPES) + "], type)::INT AS type_no, {0} AS answerable, count(*)::INT AS measured, count(*) FILTER ({1})::INT AS hits FROM q WHERE {2} AND type <> 'odd' GROUP BY seed, type"


@query(f"""WITH q AS (SELECT {_FANOUT} FROM orders) {_BY_TYPE.format('FALSE', 'coalesce(mentioned, FALSE) OR coalesce(cited, FALSE)', "status = 'ok'")}
  UNION ALL {_BY_TYPE.format('TRUE', "retrieval = 'answered'", 'retrieval IS NOT NULL')}""")
def fanout_types(spark, sf_dir):
    """How each kind of sub-query fares, in answers and in the index."""
    rows = read_table(spark, sf_dir, "orders").selectExpr(*_columns(_FANOUT))
    halves = [visibility.fanout_by_type(rows, a).withColumn("answerable", F.lit(a)) for a in (False, True)]
    return halves[0].unionByName(halves[1])


_PROMPTS = "conv_id AS host, CASE WHEN turn % 3 = 0 THEN 'category' WHEN turn % 3 = 1 THEN 'branded' ELSE 'custom' END AS kind, turn AS ordinal, CASE WHEN turn % 4 = 3 THEN ' HELLO ' WHEN turn % 4 = 2 THEN 'hello' ELSE text END AS text"


@query(f"""WITH p AS (SELECT {_PROMPTS} FROM conversations), r AS (SELECT host, kind, ordinal, trim(text) AS text, list_position(['custom', 'category', 'branded'], kind) AS k FROM p WHERE trim(text) <> ''),
  o AS (SELECT host, lower(text) AS key, min((k, ordinal)) AS place, arg_min(text, (k, ordinal)) AS text, arg_min(kind, (k, ordinal)) AS kind FROM r GROUP BY ALL)
  SELECT host, row_number() OVER (PARTITION BY host ORDER BY place, key)::INT AS no, kind, text FROM o QUALIFY no <= {visibility.ASKED}""")
def asked_prompts(spark, sf_dir):
    """The prompts of each conversation in the order in which they would be asked."""
    return visibility.prompt_queue(read_table(spark, sf_dir, "conversations").selectExpr(*_columns(_PROMPTS)))


# ---------------------------------------------------------------- histories

_RUNS = "o_custkey AS host, o_orderkey AS id, o_orderdate AS completed_at, CASE WHEN o_orderkey % 9 > 0 THEN CAST(o_orderkey % 101 AS INT) END AS score, CAST(o_orderkey % 13 AS INT) AS lost"


@query(f"""WITH r AS (SELECT {_RUNS} FROM orders), l AS (SELECT host, id, completed_at, 'score' AS metric, score::DOUBLE AS after, 1 AS sign FROM r UNION ALL SELECT host, id, completed_at, 'lost', lost, -1 FROM r),
  b AS (SELECT *, lag(after) OVER (PARTITION BY host, metric ORDER BY completed_at, id) AS before FROM l)
  SELECT host, id, metric, before, after, after - before AS change, (after - before) * sign > 0 AS better FROM b""")
def run_changes(spark, sf_dir):
    """Each run's numbers against those of the site's run before."""
    return compare.metric_changes(read_table(spark, sf_dir, "orders").selectExpr(*_columns(_RUNS)), ("score", "lost"))


@query("""WITH c AS (SELECT o_custkey AS host, o_orderkey AS run, 'c' || (l_partkey % 6) AS check_id, l_returnflag = 'R' AS bad FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
  r AS (SELECT host, run, lag(run) OVER (PARTITION BY host ORDER BY run) AS prev FROM (SELECT DISTINCT host, run FROM c)), f AS (SELECT DISTINCT run, check_id FROM c WHERE bad)
  SELECT r.host, r.run, coalesce((SELECT string_agg(p.check_id, ',' ORDER BY p.check_id) FROM f p WHERE p.run = r.prev AND NOT EXISTS (SELECT 1 FROM f n WHERE n.run = r.run AND n.check_id = p.check_id)), '') AS fixed,
    coalesce((SELECT string_agg(n.check_id, ',' ORDER BY n.check_id) FROM f n WHERE n.run = r.run AND NOT EXISTS (SELECT 1 FROM f p WHERE p.run = r.prev AND p.check_id = n.check_id)), '') AS broke FROM r WHERE prev IS NOT NULL""")
def fixed_checks(spark, sf_dir):
    """The failing checks that left or came with each run."""
    rows = read_table(spark, sf_dir, "lineitem").join(read_table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    checks = rows.selectExpr("o_custkey AS host", "o_orderkey AS run", "'c' || (l_partkey % 6) AS check_id", "CASE WHEN l_returnflag = 'R' THEN 'fail' ELSE 'pass' END AS status")
    return compare.fixed_and_broke(checks).select("host", "run", F.array_join("fixed", ",").alias("fixed"), F.array_join("broke", ",").alias("broke"))


# ---------------------------------------------------------------- robots rules and addresses

BOTS = ("GPTBot", "bingbot")
#: A supplier as a line of a robots file; ten make a file.
_ROBOTS = """
  CAST(floor(s_suppkey / 10) AS BIGINT) AS host, s_suppkey AS no, CASE WHEN s_suppkey % 10 = 0 THEN 'User-agent: *' WHEN s_suppkey % 10 = 4 AND s_suppkey % 3 > 0 THEN 'USER-AGENT : gptbot # ours' WHEN s_suppkey % 10 = 5 AND s_suppkey % 7 > 3 THEN 'User-agent: bingbot'
    WHEN s_suppkey % 10 = 9 THEN 'Sitemap: https://h' || s_suppkey || '.example/map.xml' WHEN s_suppkey % 4 = 0 THEN 'Allow: /p' || (s_suppkey % 5) || '*5$' WHEN s_suppkey % 4 = 1 THEN 'Disallow: /p' || (s_suppkey % 6)
    WHEN s_suppkey % 4 = 2 THEN 'disallow: /*' || (s_suppkey % 8) || '.x # no' ELSE 'Disallow:' END AS line"""
_ASKED = "l_orderkey * 10 + l_linenumber AS page_id, CAST(floor(l_suppkey / 10) AS BIGINT) AS host, '/p' || (l_partkey % 7) || '/' || (l_orderkey % 50) || CASE WHEN l_linenumber % 2 = 0 THEN '.x' ELSE '' END AS path"


@query(f"""WITH f AS (SELECT {_ROBOTS} FROM supplier), p AS (SELECT host, no, lower(trim(split_part(line, ':', 1))) AS name, trim(split_part(split_part(line, ':', 2), '#', 1)) AS val FROM f),
  u AS (SELECT * FROM p WHERE name IN ('user-agent', 'allow', 'disallow')),
  o AS (SELECT *, (name = 'user-agent' AND coalesce(lag(name) OVER (PARTITION BY host ORDER BY no), '') <> 'user-agent')::INT AS opens FROM u),
  g AS (SELECT *, sum(opens) OVER (PARTITION BY host ORDER BY no) AS grp FROM o),
  ag AS (SELECT DISTINCT host, grp, lower(val) AS agent FROM g WHERE name = 'user-agent'), ru AS (SELECT host, grp, name = 'allow' AS allow, val FROM g WHERE name <> 'user-agent' AND val <> ''),
  bot AS (SELECT unnest({list(BOTS)}) AS token), pick AS (SELECT host, token, bool_or(agent = lower(token)) AS own FROM ag, bot GROUP BY ALL),
  say AS (SELECT DISTINCT host, token, allow, val FROM pick JOIN ag USING (host) JOIN ru USING (host, grp) WHERE agent = CASE WHEN own THEN lower(token) ELSE '*' END),
  q AS (SELECT {_ASKED} FROM lineitem),
  h AS (SELECT page_id, host, path, token, arg_max(allow, (length(val), allow)) FILTER (path LIKE CASE WHEN suffix(val, '$') THEN replace(left(val, length(val) - 1), '*', '%') ELSE replace(val, '*', '%') || '%' END) AS allow
    FROM q CROSS JOIN bot LEFT JOIN say USING (host, token) GROUP BY ALL)
  SELECT page_id, token, coalesce(allow, TRUE) AS allowed FROM h""")
def crawler_verdicts(spark, sf_dir):
    """Which pages each crawler may read."""
    lines = read_table(spark, sf_dir, "supplier").selectExpr(*_columns(_ROBOTS))
    files = lines.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("no", "line"))).alias("l")).select("host", F.array_join(F.transform("l", lambda x: x.line), "\n").alias("body"))
    pages = read_table(spark, sf_dir, "lineitem").selectExpr(*_columns(_ASKED)).distinct()
    bots = spark.createDataFrame([(b,) for b in BOTS], "token string")
    return robots.robots_verdict(pages, robots.robots_rules(files), bots)


_ADDRESSES = """
  event_id, (event_id * 7 % 300) || '.' || CASE WHEN event_id % 3 = 0 THEN event_id % 256 WHEN event_id % 3 = 1 THEN 168 ELSE 18 END || '.' || (user_id % 256) || '.' || CASE WHEN event_id % 50 = 0 THEN 'x' ELSE '' || (event_id % 256) END AS address,
  CASE WHEN event_id % 5 = 0 THEN 'ftp://' WHEN event_id % 5 = 1 THEN 'HTTP://' WHEN event_id % 5 = 2 THEN 'https://me:pw@' ELSE 'https://' END || CASE WHEN event_id % 4 = 0 THEN 'localhost' WHEN event_id % 4 = 1 THEN 'a.localhost' ELSE 'www.site' || user_id || '.example' END || '/p?q=1' AS url"""


@query(f"""WITH a AS (SELECT {_ADDRESSES} FROM events), o AS (SELECT *, try_cast(split_part(address, '.', 1) AS INT) AS a1, try_cast(split_part(address, '.', 2) AS INT) AS a2, try_cast(split_part(address, '.', 4) AS INT) AS a4 FROM a)
  SELECT event_id, a1 <= 255 AND a4 IS NOT NULL AND a1 NOT IN (0, 10, 127) AND a1 < 224 AND NOT (a1 = 169 AND a2 = 254) AND NOT (a1 = 172 AND a2 BETWEEN 16 AND 31) AND NOT (a1 = 192 AND a2 IN (0, 168))
      AND NOT (a1 = 198 AND a2 IN (18, 19)) AND NOT (a1 = 100 AND a2 BETWEEN 64 AND 127) AS public,
    regexp_matches(url, '(?i)^https?://www') AS admissible FROM o""")
def safe_addresses(spark, sf_dir):
    """Which addresses may be fetched."""
    rows = read_table(spark, sf_dir, "events").selectExpr(*_columns(_ADDRESSES))
    return rows.select("event_id", ur.public_ipv4(F.col("address")).alias("public"), ur.admissible(F.col("url")).alias("admissible"))


_TARGETS = "CAST(floor(page_id / 12) AS BIGINT) AS list_id, page_id, CASE WHEN page_id % 4 = 0 THEN url WHEN page_id % 4 = 1 THEN ' ' || regexp_replace(url, '^[a-zA-Z]+://', '') WHEN page_id % 8 = 2 THEN 'nowhere' WHEN page_id % 8 = 3 THEN '' ELSE upper(url) END AS entry"


@query(f"""WITH t AS (SELECT {_TARGETS} FROM pages), h AS (SELECT list_id, page_id, regexp_replace(lower(regexp_extract(trim(regexp_replace(entry, '(?i)^https?://', '')), '^[^/?#:]*')), '^www\\.', '') AS host FROM t),
  o AS (SELECT list_id, host, min(page_id) AS first FROM h WHERE contains(host, '.') GROUP BY ALL)
  SELECT list_id, row_number() OVER (PARTITION BY list_id ORDER BY first)::INT AS pos, host FROM o QUALIFY pos <= 4""")
def target_hosts(spark, sf_dir):
    """The hosts that lists of targets mean."""
    rows = read_table(spark, sf_dir, "pages").selectExpr(*_columns(_TARGETS))
    lists = rows.groupBy("list_id").agg(F.array_sort(F.collect_list(F.struct("page_id", "entry"))).alias("l"))
    return ur.hosts_of(lists.select("list_id", F.transform("l", lambda x: x.entry).alias("entries")))
