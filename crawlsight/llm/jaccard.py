"""Exact Jaccard self-join on word shingles by partitioning the shingle universe (pigeonhole).

Sets are dealt to bands by size. In a band whose pairs can differ by at most H shingles, the shingles are
hashed to segments. Most segments are indexed by what falls into them; some, where the cost model says so,
also by each one-deletion neighbour, so that they match up to one difference. With m segments, d of them with
neighbours, and m + d = H + 1 + k, every pair in reach agrees in at least k + 1 signatures of whole segments
or in one with neighbours; so each set may leave its k most frequent whole-segment signatures out. The coldest
agreeing one is never left out by either side.

Equal sets are one class, indexed once. Buckets with the same members, of which near copies have many, are
merged into one with a weight. Some members of each bucket are compared with everyone in it, as long as that joins
components; then the members of different components that share a bucket are compared. Parity sketches part
pairs out of reach before any set is fetched, and what is left is verified on the sets themselves. Links inside
a component need no comparison, so the components are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Store, components, slices

#: Growth of the bands' sizes.
BAND = 1.3
#: Words of the small sketches.
FOLD = 16
_GOLD, _MIX = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``n``-word shingles of a text.

    Words are runs without the six ASCII spaces, A-Z in lower case. With fewer words the whole sequence is one
    shingle; without words the set is empty.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, "u8")
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), "u8", len(words))
    size = min(n, len(h))
    total = np.full(len(h) - size + 1, size, "u8")
    for i in range(size):
        total = _mixed(total * np.uint64(_GOLD) + h[i : len(h) - size + 1 + i])
    return np.unique(total)


@dataclass(frozen=True)
class Reach:
    """What a threshold of ``num`` / 100 allows."""

    num: int

    def largest(self, size: int) -> int:
        """The largest partner of a set of this size."""
        return size * 100 // self.num

    def apart(self, total: int) -> int:
        """Shingles that only one of two sets with ``total`` members together has, at most."""
        return total - 2 * -(-self.num * total // (100 + self.num))


@lru_cache
def band_edges(limit: int) -> tuple[int, ...]:
    edges = [1]
    while edges[-1] <= limit:
        edges.append(max(edges[-1] + 1, math.ceil(edges[-1] * BAND)))
    return tuple(edges)


@dataclass(frozen=True)
class Allocation:
    """Segments of a band: ``m`` in all, the first ``d`` with one-deletion neighbours; ``k`` may be left out."""

    m: int
    d: int
    k: int
    apart: int


def allocate(smallest: int, largest: int, sets: int, reach: Reach) -> Allocation:
    """The cheapest allocation for a band of sets of these sizes, by signatures and expected chance agreements.

    A signature costs 1. Two sets agree by chance in a segment that holds few shingles, the likelier the fewer;
    each such pair costs 1 as well.
    """
    top = largest + reach.largest(largest)
    apart = max(0, *(reach.apart(t) for t in range(max(2 * smallest, top - 50), top + 1)))
    k = 0 if apart < 3 else 1 + apart // 4
    best = None
    for d in range(0, min(apart + 1, 4)):
        m = apart + 1 + k - d
        if m < d or m < 1 or m - d < k:
            continue
        filled = smallest / m
        chance = sets * math.exp(-filled) / 1000
        cost = (m - d) * (1 + chance) + d * (2 + filled) * (1 + chance * filled)
        if best is None or cost < best[0]:
            best = (cost, Allocation(m, d, k, apart))
    return best[1]


def segment_sums(hashes: np.ndarray, m: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per segment: the wrapped sum of the mixed hashes in it, and how many; with each hash's segment."""
    mixed = _mixed(hashes + np.uint64(seed * _GOLD & (1 << 64) - 1))
    at = (mixed % np.uint64(m)).astype("i8")
    body = _mixed(mixed)
    low = np.bincount(at, (body & np.uint64(0xFFFFFFFF)).astype("f8"), m).astype("u8")
    high = np.bincount(at, (body >> np.uint64(32)).astype("f8"), m).astype("u8")
    return low + (high << np.uint64(32)), np.bincount(at, minlength=m), at


def signatures(hashes: np.ndarray, g: int, plan: Allocation) -> tuple[np.ndarray, np.ndarray]:
    """(whole, near): a signature per whole segment; of segments with neighbours, all of theirs."""
    sums, _, at = segment_sums(hashes, plan.m, g)
    where = (np.arange(plan.m, dtype="u8") + np.uint64(g << 32)) * np.uint64(_GOLD)
    whole = _mixed(sums[plan.d :] ^ where[plan.d :])
    if not plan.d:
        return whole, whole[:0]
    inner = at < plan.d
    body = _mixed(_mixed(hashes[inner] + np.uint64(g * _GOLD & (1 << 64) - 1)))
    less = _mixed((sums[at[inner]] - body) ^ where[at[inner]])
    return whole, np.unique(np.concatenate([_mixed(sums[: plan.d] ^ where[: plan.d]), less]))


def parity_sketch(hashes: np.ndarray, apart: int) -> np.ndarray:
    """For each of about 16 x ``apart`` cells, whether an odd number of hashes is in it, as 64-bit words.

    Two sets that differ by h members differ in at most h cells; unrelated sets differ in half of all cells.
    """
    cells = 64 * -(-16 * max(1, apart) // 64)
    odd = np.bincount((_mixed(hashes ^ np.uint64(_MIX)) % np.uint64(cells)).astype("i8"), minlength=cells) & 1
    return np.packbits(odd.astype("u1")).view("i8")


def folded(sketch: np.ndarray) -> np.ndarray:
    """A parity sketch of FOLD words at most: it differs in no more cells than the whole one."""
    return np.bitwise_xor.reduce(np.pad(sketch, (0, -len(sketch) % FOLD)).reshape(-1, FOLD), 0) if len(sketch) > FOLD else sketch


_LONGS = pa.list_(pa.int64())
_GROUP = pa.struct([("g", pa.int32()), ("whole", _LONGS), ("near", _LONGS), ("sketch", _LONGS), ("fold", _LONGS)])
_SIGNED = pa.schema([("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("groups", pa.list_(_GROUP))])
_SIGNED_DDL = "n long, h1 long, h2 long, groups array<struct<g:int,whole:array<long>,near:array<long>,sketch:array<long>,fold:array<long>>>"


def _digest(h: np.ndarray) -> list[int]:
    return np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), "i8").tolist()


def _signed(docs: DataFrame, n: int, reach: Reach, keep: Sequence[str]) -> tuple[DataFrame, list[int]]:
    """(doc_id, *keep, n, h1, h2, groups): size and 128-bit hash of each set; signatures in every band it can pair in.

    With it the k of each band. A task signs each set once; the other rows that have it get null groups.
    """
    sizes, most = _sizes(docs)
    edges = band_edges(most + 1)
    counts = [0] * len(edges)
    for size, c in sizes.items():
        counts[int(np.searchsorted(edges, size, side="right")) - 1] += c
    plans = [allocate(lo, hi - 1, max(1, c), reach) for lo, hi, c in zip(edges, edges[1:], counts, strict=False)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[bytes] = set()  # sets this task has signed; forgetting some only signs them again
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["_text"].to_pylist(), strict=True):
                h = shingle_set(text, n)
                h1, h2 = _digest(h)
                groups = None
                if len(h) and doc_id is not None and (h1, h2) not in done:  # a row without an id links with nothing
                    done.add((h1, h2))
                    own, groups = int(np.searchsorted(edges, len(h), side="right")) - 1, []
                    for g in range(own, -1, -1):
                        if reach.largest(edges[g + 1] - 1) < len(h):
                            break
                        whole, near = signatures(h, g, plans[g])
                        sketch = parity_sketch(h, plans[g].apart)
                        groups.append({"g": g, "whole": whole.view("i8"), "near": near.view("i8"), "sketch": sketch, "fold": folded(sketch)})
                rows.append((len(h), h1, h2, groups))
            if len(done) > 1_000_000:
                done.clear()
            cols = zip(*rows) if rows else [[]] * 4
            own_columns = batch.columns[:-1]
            yield pa.RecordBatch.from_arrays(
                [*own_columns, *(pa.array(c, t) for c, t in zip(cols, _SIGNED.types, strict=True))], names=[*batch.schema.names[:-1], *_SIGNED.names]
            )

    ks = [p.k for p in plans]
    source = docs.select("doc_id", *keep, F.col("text").alias("_text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{kept}, {_SIGNED_DDL}"), ks


def _sizes(docs: DataFrame) -> tuple[dict[int, int], int]:
    """For the cost model, how many texts have about how many words (a few hundred counts); the most words possible."""
    chars = F.coalesce(F.length("text"), F.lit(0))
    step = F.ceil(F.log(1.1, F.greatest(chars / 6, F.lit(1.0)))).cast("int")
    rows = docs.groupBy(step.alias("b")).agg(F.count(F.lit(1)).alias("c"), F.max(chars).alias("most")).collect()
    most = max((r["most"] for r in rows), default=0) // 2 + 1
    return {min(most, max(1, int(1.1 ** r["b"]))): r["c"] for r in rows}, most


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_SET = pa.schema([("doc_id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("members", pa.binary())])
#: Tables of up to this many rows (a few numbers each) are sent to every executor.
SENT_ROWS = 1_000_000


def _sent(df: DataFrame) -> DataFrame:
    """A stored table, sent to every executor if it is small enough."""
    return F.broadcast(df) if df.count() <= SENT_ROWS else df


def _sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(id, members) of the classes ``wanted`` (id, doc_id, h1, h2): their shingle hashes, made again from the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [shingle_set(t, n) for t in batch[1].to_pylist()]
            keys = np.array([_digest(h) for h in found], "i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch[0], pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array([h.tobytes() for h in found], pa.binary())], schema=_SET
            )

    few = _sent(wanted)
    texts = docs.select("doc_id", "text").join(few.select("doc_id"), "doc_id", "left_semi")
    made = texts.mapInArrow(run, "doc_id long, h1 long, h2 long, members binary")
    # an id may stand for several texts: the hash tells which; copies of a text are one
    return made.join(few, ["doc_id", "h1", "h2"]).groupBy("id").agg(F.any_value("members").alias("members"))


def _linked(pairs: DataFrame, sets: DataFrame, num: int) -> DataFrame:
    """The pairs (a, b) whose shingle sets reach the threshold, compared exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            keep = []
            for i, (x, y) in enumerate(zip(batch[2].to_pylist(), batch[3].to_pylist(), strict=True)):
                left, right = np.frombuffer(x, "u8"), np.frombuffer(y, "u8")
                both = len(np.intersect1d(left, right, assume_unique=True))
                if both and 100 * both >= num * (len(left) + len(right) - both):
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch[0].take(at), batch[1].take(at)], schema=_PAIR)

    both = pairs.join(sets.select(F.col("id").alias("b"), F.col("members").alias("mb")), "b").join(
        sets.select(F.col("id").alias("a"), F.col("members").alias("ma")), "a"
    )
    return both.select("a", "b", "ma", "mb").mapInArrow(run, "a long, b long")


#: Rows of a file of signed sets, each of which has hundreds of signatures: the tasks that count these hold few files' at a time.
FILE_ROWS = 512
#: Parts of the signatures, by their remainder, that are counted one after the other: shuffle files of one part are on disk at a time.
PARTS = 2
#: Members of each bucket that are compared with everyone in it, turn by turn, before what is left is compared.
CHOSEN = (3, 8, 16)
#: What is left is compared if it is no more than so many pairs for a row of the index, or a turn has not halved it.
LEFT = 20


def similar(docs: DataFrame, n: int = 5, num: int = 80, keep: Sequence[str] = (), group: bool = False) -> DataFrame:
    """(doc_id, *keep, n_shingles, component_id) of ``docs`` (doc_id, text, more).

    Two documents link when 100 x shared shingles >= ``num`` x shingles in either; component_id is the smallest
    doc_id reachable by links, itself included. Null, empty and blank texts have no shingles and link with
    nothing; equal sets always link; rows of one doc_id are documents of their own; a null doc_id stays alone
    with a null component; no rows give no rows; further columns are not read. With ``group`` also that: a number
    for each component of several rows, for which repeated doc_ids don't count as one; null for rows alone.
    """
    store = Store(docs.sparkSession, "jaccard")
    coded, ks = _signed(docs, n, Reach(num), keep)
    signed = store.put(coded.withColumn("_row", F.monotonically_increasing_id()), "signed", FILE_ROWS)
    # a class is known by the first row that carries its signatures
    classes = store.put(
        signed.where("n > 0 and doc_id is not null").groupBy("h1", "h2", "n").agg(
            F.min(F.when(F.col("groups").isNotNull(), F.struct("_row", "doc_id"))).alias("c"),
            F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows"),
        ).select("h1", "h2", "n", F.col("c._row").alias("id"), F.col("c.doc_id").alias("doc_id"), "least", "rows"), "classes",
    )
    groups = signed.where("groups is not null").join(_sent(classes.select("id")), F.col("_row") == F.col("id"), "left_semi").select(
        F.col("_row").alias("id"), "n", F.explode("groups").alias("x")
    ).select("id", "n", "x.g", "x.whole", "x.near", "x.sketch", "x.fold")
    buckets = _buckets(store, groups, ks)
    sketches = store.put(
        groups.select("id", "n", "g", "sketch", "fold").join(_sent(store.put(buckets.select("id").distinct(), "ids")), "id", "left_semi"), "sketches"
    )
    # the signatures, by far the most of it, are not read any more
    own = store.put(signed.select("doc_id", *keep, "n", "h1", "h2"), "own")
    store.drop("signed")
    labels, rows, before = None, buckets.count(), None
    for turn in range(len(CHOSEN) + 1):
        here, left = buckets, None
        if labels is not None:
            here, left = _split_buckets(store, buckets, labels, f"split{turn}")
        if left == 0:
            break
        last = turn == len(CHOSEN) or left is not None and (left <= LEFT * rows or before is not None and left > before / 2)
        before = left
        pairs = _all_pairs(here, sketches, num) if last else _some_pairs(here, turn, num, ks)
        pairs = store.put(_in_reach(pairs, sketches, num), f"pairs{turn}")
        ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        wanted = store.put(classes.select("id", "doc_id", "h1", "h2").join(_sent(store.put(ends, f"ends{turn}")), "id", "left_semi"), f"wanted{turn}")
        sets = store.put(_sets(docs, wanted, n), f"sets{turn}")
        links = store.put(_linked(pairs, sets, num), f"links{turn}")
        store.drop(f"pairs{turn}", f"ends{turn}", f"wanted{turn}", f"sets{turn}", *([f"split{turn}"] if turn else []))
        labels = _joined_labels(store, labels, links, f"labels{turn}")
        if last:
            break
    far = classes.join(labels.select("id", "component_id"), "id", "left").withColumn("component_id", F.coalesce("component_id", "id"))
    # only classes of several rows, or with links, have a component other than the row itself
    least = far.groupBy("component_id").agg(F.min("least").alias("first"), F.sum("rows").alias("all")).where("all > 1")
    known = store.put(far.join(least, "component_id").select("h1", "h2", "n", "first", F.col("component_id").alias("group")), "known")
    out = store.put(
        own.join(_sent(known), ["h1", "h2", "n"], "left").select(
            "doc_id", *keep, F.col("n").alias("n_shingles"),
            F.when(F.col("doc_id").isNotNull(), F.coalesce("first", "doc_id")).alias("component_id"),
            *([F.when(F.col("doc_id").isNotNull(), F.col("group")).alias("group")] if group else []),
        ), "result",
    )
    store.drop("own", "classes", "ids", "sketches", "buckets", "known", *(f"{x}{t}" for x in ("split", "links", "labels") for t in range(len(CHOSEN) + 1)))
    return out


def _buckets(store: Store, groups: DataFrame, ks: list[int]) -> DataFrame:
    """(sig, id, n, g, w): the buckets of several sets, without the signatures each set may leave out.

    Buckets with the same members are one, known by the smallest of their ``w`` signatures.
    """
    rows = groups.select("id", "n", "g", F.lit(True).alias("is_whole"), F.explode("whole").alias("sig")).union(
        groups.where(F.size("near") > 0).select("id", "n", "g", F.lit(False).alias("is_whole"), F.explode("near").alias("sig"))
    )
    found = []
    for part in range(PARTS):
        here = rows.where(F.pmod("sig", F.lit(PARTS)) == part)
        counts = store.put(here.groupBy("sig").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "counts")
        found.append(store.put(here.join(counts, "sig"), f"found{part}"))
    found = reduce(DataFrame.union, found)
    k = F.element_at(F.array(*map(F.lit, ks or [0])), F.col("g") + 1)
    hot = F.col("is_whole") & (F.col("c") > 8)
    ranked = found.withColumn("r", F.row_number().over(Window.partitionBy("id", "g").orderBy(F.desc(hot), F.desc("c"), "sig")))
    spots = store.put(ranked.where(~hot | (F.col("r") > k)).select("sig", "id", "n", "g"), "spots")
    members = [F.bit_xor(F.xxhash64("id", F.lit(seed))).alias(f"f{seed}") for seed in (1, 2)]
    each = spots.groupBy("sig", "g").agg(F.count(F.lit(1)).alias("c"), *members).where("c > 1")
    once = store.put(each.groupBy("g", "c", "f1", "f2").agg(F.min("sig").alias("sig"), F.count(F.lit(1)).alias("w")).select("sig", "w"), "once")
    out = store.put(spots.join(_sent(once), "sig"), "buckets")
    store.drop("counts", "spots", "once", *(f"found{part}" for part in range(PARTS)))
    return out


def _joined_labels(store: Store, labels: DataFrame | None, links: DataFrame, name: str) -> DataFrame:
    """``labels`` (id, component_id) of linked classes, with the components that ``links`` (a, b) join."""
    if labels is None:
        return store.put(components(store, links, f"{name}_"), name)
    here = labels.select(F.col("id").alias("a"), F.col("component_id").alias("ca")), labels.select(F.col("id").alias("b"), F.col("component_id").alias("cb"))
    between = links.join(here[0], "a", "left").join(here[1], "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    moved = store.put(components(store, between, f"{name}_"), f"{name}_moved")
    old = labels.join(moved.select(F.col("id").alias("component_id"), F.col("component_id").alias("to")), "component_id", "left")
    new = moved.join(labels.select("id"), "id", "left_anti")
    return store.put(old.select("id", F.coalesce("to", "component_id").alias("component_id")).union(new), name)


def _split_buckets(store: Store, buckets: DataFrame, labels: DataFrame, name: str) -> tuple[DataFrame, int]:
    """The buckets whose members are in different components, with component_id, and how many pairs are apart in them."""
    known = buckets.join(_sent(labels), "id", "left").withColumn("component_id", F.coalesce("component_id", "id"))
    parts = known.groupBy("sig", "component_id").agg(F.count(F.lit(1)).alias("c"))
    split = parts.groupBy("sig").agg(F.sum("c").alias("all"), F.sum(F.col("c") * F.col("c")).alias("same"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    split = store.put(split.select("sig", ((F.col("all") * F.col("all") - F.col("same")) / 2).alias("apart")), name)
    return known.join(_sent(split.select("sig")), "sig", "left_semi"), int(split.agg(F.sum("apart")).first()[0] or 0)


def _sizes_in_reach(num: int) -> Column:
    return F.expr(f"100 * least(n, n2) >= {num} * greatest(n, n2)")


def _some_pairs(buckets: DataFrame, turn: int, num: int, ks: list[int]) -> DataFrame:
    """(g, a, b): some members of each bucket with everyone in it, where two signatures say so.

    Like buckets choose the same members, others in each turn. These turns only join components early, at
    little cost; what they leave out is compared in the last turn.
    """
    if "component_id" not in buckets.columns:
        buckets = buckets.withColumn("component_id", F.col("id"))
    member = F.struct("id", "n", "component_id")
    chosen = buckets.groupBy("sig").agg(
        F.array_distinct(F.array(*(F.min_by(member, F.xxhash64("id", F.lit(100 * turn + j))) for j in range(CHOSEN[turn])))).alias("p")
    )
    k = F.element_at(F.array(*map(F.lit, ks or [0])), F.col("g") + 1)
    return (
        buckets.join(chosen, "sig")
        .select("w", "id", "n", "g", "component_id", F.array_contains("p.id", F.col("id")).alias("is_chosen"), F.explode("p").alias("q"))
        .withColumn("n2", F.col("q.n"))
        .where((F.col("component_id") != F.col("q.component_id")) & _sizes_in_reach(num))
        .where((F.col("id") < F.col("q.id")) | ~F.col("is_chosen"))  # a pair of two chosen ones comes once
        .groupBy("g", F.least("id", "q.id").alias("a"), F.greatest("id", "q.id").alias("b")).agg(F.sum("w").alias("w"))
        .where((F.col("w") > 1) | (k == 0)).select("g", "a", "b")
    )


def _cells_apart(x: str, y: str) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda acc, c: acc + c)


def _most_apart(num: int) -> Column:
    """The most that sets of n and n2 in reach differ by; shared >= num (n + n2) / (100 + num), rounded up."""
    return F.expr(f"n + n2 - 2 * ((({num} * (n + n2)) + {99 + num}) div {100 + num})")


def _all_pairs(buckets: DataFrame, sketches: DataFrame, num: int) -> DataFrame:
    """(g, a, b): all in a bucket that are in different components and that their small sketches allow, once each."""
    rows = buckets.join(sketches.select("id", "g", "fold"), ["id", "g"])
    left = rows.select("sig", "g", F.col("id").alias("a"), "n", F.col("component_id").alias("ca"), F.col("fold").alias("fa"))
    right = rows.select(
        F.col("sig").alias("sig2"), F.col("id").alias("b"), F.col("n").alias("n2"), F.col("component_id").alias("cb"), F.col("fold").alias("fb")
    )
    pairs = left.join(right, F.expr("sig = sig2 and a < b and ca <> cb") & _sizes_in_reach(num) & (_cells_apart("fa", "fb") <= _most_apart(num)))
    return pairs.select("g", "a", "b").distinct()


def _in_reach(pairs: DataFrame, sketches: DataFrame, num: int) -> DataFrame:
    """(a, b): the pairs that their whole sketches allow."""
    sa = sketches.select(F.col("id").alias("a"), "g", "n", F.col("sketch").alias("sa"))
    sb = sketches.select(F.col("id").alias("b"), "g", F.col("n").alias("n2"), F.col("sketch").alias("sb"))
    near = pairs.join(sa, ["a", "g"]).join(sb, ["b", "g"]).where(_cells_apart("sa", "sb") <= _most_apart(num))
    return near.select("a", "b").distinct()
