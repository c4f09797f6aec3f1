"""robots.txt as tables: rules, verdicts per page and bot, sitemaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def robots_lines(files: DataFrame) -> DataFrame:
    """(host, line_no, name, value) of ``files`` (host, body): comments cut, fields in lower case."""
    lines = files.select("host", F.posexplode(F.split(F.coalesce("body", F.lit("")), "\r?\n", -1)).alias("line_no", "raw"))
    line = F.trim(F.regexp_replace("raw", "#.*$", ""))
    return lines.withColumn("line", line).where("instr(line, ':') > 0").select(
        "host", "line_no", F.lower(F.trim(F.substring_index("line", ":", 1))).alias("name"),
        F.trim(F.expr("substring(line, instr(line, ':') + 1)")).alias("value"),
    )


def robots_rules(files: DataFrame) -> DataFrame:
    """(host, group_no, agent, allow, path, line_no): a group's rules for each agent it names.

    Consecutive user-agent lines share a group; other fields neither end nor open one; rules before any agent are dropped.
    """
    lines = robots_lines(files).where("name in ('user-agent', 'allow', 'disallow')")
    order = Window.partitionBy("host").orderBy("line_no")
    is_agent = F.col("name") == "user-agent"
    opens = is_agent & (F.coalesce(F.lag("name").over(order), F.lit("")) != "user-agent")
    grouped = lines.withColumn("group_no", F.sum(opens.cast("int")).over(order)).where("group_no > 0")
    agents = grouped.where(is_agent).select("host", "group_no", F.lower("value").alias("agent")).distinct()
    rules = grouped.where(~is_agent).select("host", "group_no", (F.col("name") == "allow").alias("allow"), F.col("value").alias("path"), "line_no")
    return agents.join(rules, ["host", "group_no"], "left").select("host", "group_no", "agent", "allow", "path", "line_no")


def robots_sitemaps(files: DataFrame) -> DataFrame:
    return robots_lines(files).where("name = 'sitemap' and value <> ''").select("host", "line_no", F.col("value").alias("url"))


#: Crawlers that can be asked about at a time.
MOST_BOTS = 10_000


def _tokens(bots: DataFrame) -> list[str]:
    """The crawlers of a dimension table, each once."""
    found = sorted(r.token for r in bots.select("token").where("token IS NOT NULL").distinct().limit(MOST_BOTS + 1).collect())
    if len(found) > MOST_BOTS:
        raise ValueError(f"robots rules are read for {MOST_BOTS} crawlers at most")
    return found


def robots_for(rules: DataFrame, bots: DataFrame) -> DataFrame:
    """(host, token, allow, path): all groups that name the token, else all ``*`` groups. ``bots``: token, a small dimension table."""
    tokens = _tokens(bots)
    if not tokens:
        return rules.select("host", F.lit("").alias("token"), "allow", "path").limit(0)
    every = F.array(*map(F.lit, tokens))
    # a rule of ``*`` speaks to all crawlers, another to those whose name it has
    heard = F.when(F.col("agent") == "*", every).otherwise(F.filter(every, lambda t: F.lower(t) == F.col("agent")))
    named = rules.select("host", "agent", "allow", "path", F.explode(heard).alias("token"))
    exact = named.where("agent <> '*'").select("host", "token").distinct()
    return named.where("agent <> '*'").select("host", "token", "allow", "path").union(
        named.where("agent = '*'").join(exact, ["host", "token"], "left_anti").select("host", "token", "allow", "path")
    )


def path_regex(path):
    """A rule's path as a regular expression: ``*`` is anything, a last ``$`` ends it."""
    quoted = F.regexp_replace(path, r"([.\\+?\[\](){}|^$])", r"\\$1")
    open_ = F.regexp_replace(F.regexp_replace(quoted, r"\\\$$", "\\$"), r"\*", ".*")
    return F.concat(F.lit("^"), open_)


def robots_verdict(pages: DataFrame, rules: DataFrame, bots: DataFrame) -> DataFrame:
    """(page_id, token, allowed) of ``pages`` (page_id, host, path): longest path wins, Allow wins ties, else allowed.

    The rules of a host for a crawler are one array, as long as its robots file has lines; a page meets that array in its own row.
    A page_id that is repeated with other paths has a row for each.
    """
    rule = F.struct(F.length("path").alias("n"), "allow", path_regex(F.col("path")).alias("rx"))
    own = robots_for(rules, bots).where("path <> ''").distinct().groupBy("host", "token").agg(F.collect_list(rule).alias("_rules"))
    asked = pages.select("page_id", "host", F.col("path").alias("page_path"), F.explode(F.array(*map(F.lit, _tokens(bots))).cast("array<string>")).alias("token"))
    met = asked.join(own, ["host", "token"], "left")
    hits = F.filter("_rules", lambda r: F.regexp_like("page_path", r.rx))
    best = F.array_max(F.transform(hits, lambda r: F.struct(r.n.alias("col1"), r.allow.alias("col2"))))
    return met.select("page_id", "token", F.coalesce(best.getField("col2"), F.lit(True)).alias("allowed"))
