"""URL expressions. Nothing raises: what can't be parsed gives null or the input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def part(url: Column, name: str) -> Column:
    return F.try_parse_url(url, F.lit(name))


def host_of(url: Column) -> Column:
    """The host without a leading ``www.``."""
    return F.regexp_replace(F.lower(part(url, "HOST")), r"^www\.", "")


def url_key(url: Column) -> Column:
    """One key for a page: host without www, path without trailing slashes, query; scheme and hash don't count."""
    path = F.regexp_replace(F.coalesce(part(url, "PATH"), F.lit("")), "/+$", "")
    query = F.coalesce(F.concat(F.lit("?"), part(url, "QUERY")), F.lit(""))
    return F.coalesce(F.concat(host_of(url), F.when(path == "", "/").otherwise(path), query), url)


def path_of(url: Column) -> Column:
    """Path and query, ``/`` if empty, the input itself if it can't be parsed."""
    path = F.coalesce(part(url, "PATH"), F.lit(""))
    query = F.coalesce(F.concat(F.lit("?"), part(url, "QUERY")), F.lit(""))
    return F.when(part(url, "HOST").isNull(), url).otherwise(F.concat(F.when(path == "", "/").otherwise(path), query))


def own_domain(domain: Column, host: Column) -> Column:
    return (domain == host) | domain.endswith(F.concat(F.lit("."), host))


def source_domain(uri: Column, title: Column) -> Column:
    """The title where it looks like a domain, else the uri's host, else empty."""
    clean = F.lower(F.trim(F.coalesce(title, F.lit(""))))
    return F.when(clean.rlike(r"^[a-z0-9-]+(\.[a-z0-9-]+)+$"), F.regexp_replace(clean, r"^www\.", "")).otherwise(
        F.coalesce(host_of(uri), F.lit(""))
    )


def admissible(url: Column) -> Column:
    """http or https, no credentials, not this machine."""
    host = F.coalesce(F.lower(part(url, "HOST")), F.lit(""))
    return (
        F.coalesce(F.lower(part(url, "PROTOCOL")), F.lit("")).isin("http", "https") & part(url, "USERINFO").isNull()
        & (host != "") & (host != "localhost") & ~host.endswith(".localhost")
    )


def public_ipv4(address: Column) -> Column:
    """Whether an IPv4 address is none of the private, local, shared or reserved ranges."""
    o = [F.try_element_at(F.split(address, r"\."), F.lit(i)).try_cast("int") for i in (1, 2, 3)]
    bad = (
        o[0].isin(0, 10, 127) | (o[0] >= 224) | ((o[0] == 169) & (o[1] == 254)) | ((o[0] == 172) & o[1].between(16, 31))
        | ((o[0] == 192) & (o[1] == 168)) | ((o[0] == 192) & (o[1] == 0)) | ((o[0] == 198) & o[1].between(18, 19))
        | ((o[0] == 100) & o[1].between(64, 127))
    )
    shaped = address.rlike(r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$")
    return F.coalesce(shaped & ~bad, F.lit(False))


def resolve_link(base: Column, href: Column) -> Column:
    """An absolute URL without hash; null for script, mail, phone and data links."""
    h = F.regexp_replace(F.trim(href), "#.*$", "")
    origin = F.concat(part(base, "PROTOCOL"), F.lit("://"), part(base, "HOST"))
    folder = F.regexp_extract(F.coalesce(part(base, "PATH"), F.lit("/")), "^(.*/)", 1)
    return (
        F.when(h.rlike("(?i)^(javascript|mailto|tel|data):"), None)
        .when(h.rlike("(?i)^[a-z][a-z0-9+.-]*:"), h)
        .when(h.startswith("//"), F.concat(part(base, "PROTOCOL"), F.lit(":"), h))
        .when(h.startswith("/"), F.concat(origin, h))
        .when(h == "", F.regexp_replace(base, "#.*$", ""))
        .when(h.startswith("?"), F.concat(origin, F.coalesce(part(base, "PATH"), F.lit("/")), h))
        .otherwise(F.concat(origin, F.when(folder == "", "/").otherwise(folder), h))
    )


def target_host(value: Column) -> Column:
    """The host that an entry of a target list means, with or without a scheme; null for what is no host name."""
    raw = F.regexp_replace(value, r"^[\s\u00A0]+|[\s\u00A0]+$", "")
    host = host_of(F.when(raw.rlike("(?i)^https?://"), raw).otherwise(F.concat(F.lit("https://"), raw)))
    return F.when((raw != "") & host.contains("."), host)


def hosts_of(targets: DataFrame, keep: int = 4) -> DataFrame:
    """(list_id, pos, host): the hosts of each target list, ``targets`` (list_id, entries), each once in the order of the list, the first ``keep``.

    Entries that are null, blank or no host name are left out; ``pos`` counts from 1. A null or empty list has no rows.
    """
    each = targets.select("list_id", F.posexplode("entries").alias("at", "entry")).select("list_id", "at", target_host(F.col("entry")).alias("host"))
    first = each.where("host IS NOT NULL").groupBy("list_id", "host").agg(F.min("at").alias("at"))
    order = Window.partitionBy("list_id").orderBy("at")
    return first.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= keep).select("list_id", "pos", "host")
