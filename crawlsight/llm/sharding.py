"""Shards by balanced label propagation.

Documents with equal group keys are linked. All start with a label, a shard; then, round after round, each group
that isn't placed asks for the shard that holds most of it among those with room, else for any shard with room,
and is let in whole as far as the room goes, until every group is placed or none that is left fits anywhere. Rounds are
joins and sums in Spark, whatever the number of groups. The driver sees the room of each shard and two kinds of
groups, fewer than shards of each: those larger than a shard, which fill as few shards as they can before the first
round, and those that fit nowhere whole after the last, which fill the largest room left. Unlinked documents fill the
rest. Every shard ends within one document of the others.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from zlib import crc32

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Store, numbered

SHARDS = 16
#: Parts into which the groups that ask for a shard are dealt to be added up.
PARTS = 256


def place(groups: Sequence[tuple], room: list[int], labels: bool = True) -> tuple[dict[tuple, int], list[tuple]]:
    """Whole ``groups`` (key, size, documents per shard) into ``room``, which shrinks: ({key: shard}, those that fit nowhere).

    The largest come first. Each goes to that of its shards with room that holds most of it, else (or without
    ``labels``) to the shard where least room is left over; ties go by a hash of the group.
    """
    at, left = {}, []
    for g in sorted(groups, key=lambda g: (-g[1], g[0])):
        key, n, held = g
        fit = [s for s, r in enumerate(room) if r >= n]
        if not fit:
            left.append(g)
            continue
        best = max(fit, key=lambda s: (held[s] if labels else 0, 0 if labels and held[s] else -room[s], crc32(repr((key, s)).encode())))
        at[key] = best
        room[best] -= n
    return at, left


def place_large(groups: Sequence[tuple], room: list[int]) -> tuple[dict[tuple, int], dict[tuple, list[tuple[int, int]]], list[tuple], list[int]]:
    """(whole, pieces, left, room): as ``place``, where a group larger than every shard first fills whole ones.

    pieces: {key: [(shard, documents)]} of those; what is left of them is placed as a group under key + (0,).
    If some groups fit nowhere by their labels, the shard where least room is left over decides, if that splits fewer.
    """
    room, pieces, rest = list(room), {}, []
    most = max(room)
    for key, n, held in sorted(groups, key=lambda g: (-g[1], g[0])):
        while n > most:
            s = max(range(len(room)), key=lambda s: (room[s], held[s], -s))
            if not room[s]:
                break
            take = min(room[s], n)
            pieces.setdefault(key, []).append((s, take))
            room[s], n = room[s] - take, n - take
        if n:
            rest.append(((*key, 0) if key in pieces else key, n, held))
    tries = []
    for labels in (True, False):
        r = list(room)
        tries.append((*place(rest, r, labels), r))
        if not tries[-1][1]:
            break
    whole, left, room = min(tries, key=lambda t: len(t[1]))
    return whole, pieces, left, room


def _round(left: DataFrame, room: Sequence[int], turn: int) -> DataFrame:
    """``left`` (g1, g2, n, held) with ``target``, null if no shard has room, and ``ok``: whether the target takes it.

    A group asks for that of its shards with room that holds most of it, else for any shard with room.
    """
    rooms = F.array(*(F.lit(r).cast("long") for r in room))
    ask = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(len(room) - 1)), lambda s: F.when(
        F.get(rooms, s) >= F.col("n"), F.struct(F.get(F.col("held"), s).alias("held"), F.xxhash64("g1", "g2", s).alias("tie"), s.alias("s"))
    )))
    wanted = left.withColumn("target", ask["s"]).withColumn("part", F.pmod(F.xxhash64("g1", "g2", F.lit(turn)), F.lit(PARTS)).cast("int"))
    # groups are let in part by part, until the room of their target is used up
    parts = wanted.groupBy("target", "part").agg(F.sum("n").alias("m"))
    before = Window.partitionBy("target").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("target", "part", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("target", "part").orderBy("g1", "g2").rowsBetween(Window.unboundedPreceding, -1)
    return (
        wanted.withColumn("mine", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .join(F.broadcast(starts), ["target", "part"], "left")
        .select("g1", "g2", "n", "held", "target", F.coalesce(F.col("start") + F.col("mine") + F.col("n") <= F.get(rooms, F.col("target")), F.lit(False)).alias("ok"))
    )


def _placed(store: Store, facts: DataFrame, quota: list[int]) -> tuple[DataFrame, list[int]]:
    """(row, shard) of ``facts``, shard null for unlinked documents, and the room that these have in each shard."""
    spark, shards = facts.sparkSession, len(quota)
    label = F.pmod(F.xxhash64("row"), F.lit(shards))
    groups = store.put(facts.groupBy("g1", "g2").agg(
        F.count(F.lit(1)).alias("n"), F.array(*(F.count(F.when(label == i, 1)) for i in range(shards))).alias("held")
    ).where("n > 1"), "groups")
    listed = lambda df: [((r["g1"], r["g2"]), r["n"], r["held"]) for r in df.collect()]
    large = max(quota) + 1
    whole, pieces, rest, room = place_large(listed(groups.where(F.col("n") >= large)), quota)
    left, settled, turn = groups.where(F.col("n") < large), [], 0
    while left.limit(1).count():
        now = store.put(_round(left, room, turn), f"round{turn}")
        for r in now.where("ok").groupBy("target").agg(F.sum("n").alias("n")).collect():
            room[r["target"]] -= r["n"]
        settled.append(now.where("ok").select("g1", "g2", F.col("target").alias("shard")))
        # each is larger than every room that is left, and all that is left fits into these rooms: fewer than shards
        rest += listed(now.where("target is null"))
        left, turn = now.where("target is not null and not ok").select("g1", "g2", "n", "held"), turn + 1
    for key, n, _ in sorted(rest, key=lambda g: (-g[1], g[0])):  # these fit nowhere whole: fill the largest room first
        while n:
            s = max(range(shards), key=room.__getitem__)
            take = min(room[s], n)
            pieces.setdefault(key[:2], []).append((s, take))
            room[s], n = room[s] - take, n - take
    sizes = {}
    for key, s in whole.items():
        if key[2:]:
            sizes[key[:2]] = s
    rows = [(*k, [s], [0]) for k, s in whole.items() if not k[2:]]
    for key, parts in pieces.items():
        to, ends = [s for s, _ in parts], [0]
        for _, take in parts:
            ends.append(ends[-1] + take)
        rows.append((*key, [*to, sizes[key]], ends[1:]) if key in sizes else (*key, to, ends[1:-1]))
    known = spark.createDataFrame(rows, "g1 long, g2 long, to array<int>, ends array<long>")
    docs = facts.select("row", "g1", "g2").join(F.broadcast(known), ["g1", "g2"], "left")
    one = docs.where("size(to) = 1").select("row", F.col("to")[0].alias("shard"))
    cut = numbered(docs.where("size(to) > 1"), ["g1", "g2"], ["row"], "k")
    cut = cut.select("row", F.get("to", F.size(F.filter("ends", lambda e: e <= F.col("k")))).alias("shard"))
    other = docs.where("to is null").select("row", "g1", "g2")
    if settled:
        other = other.join(reduce(DataFrame.union, settled), ["g1", "g2"], "left").select("row", "shard")
    else:
        other = other.select("row", F.lit(None).cast("int").alias("shard"))
    return store.put(one.union(cut).union(other), "placed"), room


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of ``docs`` (doc_id, text, more); counts at most one apart.

    Equal texts are linked (null and empty alike are one group); a group larger than a shard fills several.
    size is the UTF-8 bytes of the text plus one, slot counts from 0 without gaps in each shard. Repeated rows
    are documents of their own; a null doc_id is kept; no rows give no rows; further columns are not read.
    """
    spark = docs.sparkSession
    store = Store(spark, "shard")
    text = F.coalesce(F.col("text"), F.lit(""))
    raw = text.cast("binary")
    facts = store.put(docs.select(
        "doc_id", F.monotonically_increasing_id().alias("row"),  # tells repeated rows apart once stored
        (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
        F.xxhash64(raw).alias("g1"), F.conv(F.substring(F.sha2(raw, 256), 1, 15), 16, 10).cast("long").alias("g2"),
    ), "facts")
    total = facts.count()
    quota = [total // shards + (i < total % shards) for i in range(shards)]
    placed, room = _placed(store, facts, quota)
    single = placed.where("shard is null").select("row").withColumn("_all", F.lit(0))
    ends, at = [], 0
    for r in room:
        at += r
        ends.append(at)
    free = numbered(single, ["_all"], ["row"], "no", salts=1024)
    free = free.select("row", F.size(F.filter(F.array(*(F.lit(e).cast("long") for e in ends)), lambda e: e <= F.col("no"))).alias("shard"))
    every = facts.join(placed.where("shard is not null").union(free), "row")
    return numbered(every.select("doc_id", "row", "size", "text_crc32", "shard"), ["shard"], ["row"], "slot").select(
        "doc_id", "size", "text_crc32", "shard", "slot"
    )


def cut_edges(shards: DataFrame, group: Sequence[str]) -> DataFrame:
    """(links, cut): how many links ``shards`` (shard and the columns of ``group``) have, and how many part documents of two shards.

    Every two rows of a group are linked. Counts per group and shard are squared, so no pair is made. One row.
    """
    n = F.col("n").cast("decimal(38,0)")
    cells = shards.groupBy(*group, "shard").agg(F.count(F.lit(1)).alias("n"))
    sums = cells.groupBy(*group).agg(F.sum(n).alias("n"), F.sum(n * n).alias("within"))
    links = lambda x: F.coalesce(F.sum(x / 2), F.lit(0)).cast("long")
    return sums.agg(links(F.col("n") * F.col("n") - F.col("n")).alias("links"), links(F.col("n") * F.col("n") - F.col("within")).alias("cut"))
