"""Embedding near-duplicates by lattice hashing.

Vectors of one label are projected at random to two blocks of eight dimensions, each decoded to the nearest
point of the E8 lattice; the two points are the vector's cell in a table. Each vector also probes the cells
that its blocks are nearest to next. Vectors that meet in a cell, one of them at home there, are compared by
cosine in double precision; a pair is counted in the first cell in which it meets. Large cells are compared
block by block, and equal vectors are one vector with a weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Store, components

THRESHOLD = 0.98
#: Tables, scale of the projections (cells get finer with it), neighbours that each block probes.
TABLES, SCALE, PROBES = 5, 2.0, 4
#: Vectors of a cell that are compared with one another in one go.
SIDE = 400


@lru_cache
def roots() -> np.ndarray:
    """The 240 shortest vectors of E8: the steps to the neighbouring lattice points."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(v) for v in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array(out)


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with even sums."""
    r = np.rint(x)
    off = x - r
    odd = np.flatnonzero(r.sum(1) % 2)
    worst = np.abs(off[odd]).argmax(1)
    r[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
    return r


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8, which is D8 and D8 moved by one half."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


@lru_cache
def _projections(dims: int) -> np.ndarray:
    rng = np.random.default_rng(7)
    return rng.standard_normal((TABLES, dims, 16)) * (SCALE / np.sqrt(8))


def cells(unit: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(home, probed): a key per table; 2 x PROBES keys per table."""
    home = np.empty((len(unit), TABLES), "i8")
    probed = np.empty((len(unit), TABLES, 2 * PROBES), "i8")
    weights = np.random.default_rng(11).integers(1, 2**62, (TABLES, 16), dtype="i8") | 1
    salt = (label.astype("i8") * 0x9E3779B1 + 12345) * 0x7FFFFFFF
    with np.errstate(over="ignore"):
        for t, p in enumerate(_projections(unit.shape[1])):
            spots = unit @ p
            base, steps = salt + t * 1_000_003, []
            for block in (0, 1):
                x, w = spots[:, 8 * block : 8 * block + 8], weights[t, 8 * block : 8 * block + 8]
                point = nearest_e8(x)
                base = base + (2 * point).astype("i8") @ w
                near = np.argsort(-((x - point) @ roots().T), 1, kind="stable")[:, :PROBES]
                steps.append((2 * roots()).astype("i8")[near] @ w)
            home[:, t] = base
            probed[:, t] = base[:, None] + np.concatenate(steps, 1)
    return home, probed.reshape(len(unit), -1)


_VECTOR = pa.schema([
    ("vec_id", pa.int64()), ("label", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("unit", pa.binary()),
    ("home", pa.list_(pa.int64())), ("probed", pa.list_(pa.int64())),
])
_VECTOR_DDL = "vec_id long, label long, h1 long, h2 long, unit binary, home array<long>, probed array<long>"


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        by_size: dict[int, list] = {}
        for vec_id, label, v in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if v and label is not None and None not in v:
                by_size.setdefault(len(v), []).append((vec_id, label, v))
        for rows in by_size.values():
            x = np.array([r[2] for r in rows], "f8")
            most = np.abs(x).max(1)
            ok = np.isfinite(most) & (most > 0)
            x, most = x[ok], most[ok]
            if not len(x):
                continue
            x /= most[:, None]  # so that squares neither overflow nor vanish
            x /= np.sqrt((x * x).sum(1))[:, None]
            ids, labels = (np.array([r[i] for r in rows], "i8")[ok] for i in (0, 1))
            home, probed = cells(x, labels)
            keys = np.array([np.frombuffer(xxhash.xxh3_128_digest(v.tobytes()), "i8") for v in x])
            yield pa.RecordBatch.from_arrays([
                pa.array(ids), pa.array(labels), pa.array(keys[:, 0]), pa.array(keys[:, 1]),
                pa.array([v.tobytes() for v in x], pa.binary()), pa.array(list(home), pa.list_(pa.int64())), pa.array(list(probed), pa.list_(pa.int64())),
            ], schema=_VECTOR)


_LINKS = pa.schema([("vec_id", pa.int64()), ("n", pa.int64()), ("root", pa.int64())])


def _compare(threshold: float):
    """Rows (key, i, j, side, at_home, vec_id, label, weight, unit, home, probed) sorted by key, i, j -> (vec_id, n, root)."""

    def links(rows: dict) -> pa.RecordBatch:
        """Of whole groups: per vector, the weight of those it links with, and the least of its component here."""
        key, i, j = rows["key"], rows["i"], rows["j"]
        cut = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        left, right = [], []
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(key)], strict=True):
            if i[a] == j[a]:
                x, y = np.triu_indices(b - a, 1)
            else:
                side = rows["side"][a:b]
                x, y = (v.ravel() for v in np.meshgrid(np.flatnonzero(side == i[a]), np.flatnonzero(side == j[a]), indexing="ij"))
            left.append(x + a)
            right.append(y + a)
        left, right = np.concatenate(left), np.concatenate(right)
        good_l, good_r = [], []
        for at in range(0, len(left), 20_000):
            x, y = left[at : at + 20_000], right[at : at + 20_000]
            keep = (rows["at_home"][x] | rows["at_home"][y]) & (rows["label"][x] == rows["label"][y])
            x, y = x[keep], y[keep]
            ok = np.einsum("ij,ij->i", rows["unit"][x], rows["unit"][y]) >= threshold
            x, y = x[ok], y[ok]
            hx, hy, far = rows["home"][x], rows["home"][y], np.iinfo("i8").max
            first = np.where(hx == hy, hx, far).min(1, initial=far)
            for h, p in ((hx, rows["probed"][y]), (hy, rows["probed"][x])):
                for t in range(h.shape[1]):
                    met = (p == h[:, t : t + 1]).any(1)
                    first = np.where(met & (h[:, t] < first), h[:, t], first)
            ok = first == key[x]  # a pair counts where it meets first, by key
            good_l.append(x[ok])
            good_r.append(y[ok])
        x, y = np.concatenate(good_l), np.concatenate(good_r)
        ids, where = np.unique(np.concatenate([rows["vec_id"][x], rows["vec_id"][y]]), return_inverse=True)
        a, b = where[: len(x)], where[len(x) :]
        n = np.bincount(a, rows["weight"][y], len(ids)) + np.bincount(b, rows["weight"][x], len(ids))
        root = np.arange(len(ids))
        while len(x):
            low = np.minimum(root[a], root[b])
            nxt = root.copy()
            np.minimum.at(nxt, a, low)
            np.minimum.at(nxt, b, low)
            nxt = nxt[nxt]
            if (nxt == root).all():
                break
            root = nxt
        return pa.RecordBatch.from_arrays([pa.array(ids.astype("i8")), pa.array(n.astype("i8")), pa.array(ids[root].astype("i8"))], schema=_LINKS)

    def arrays(t: pa.Table) -> dict:
        out = {c: t[c].to_numpy() for c in ("key", "i", "j", "side", "at_home", "vec_id", "label", "weight")}
        out["unit"] = np.array([np.frombuffer(v, "f8") for v in t["unit"].to_pylist()])
        for c in ("home", "probed"):
            out[c] = np.stack(t[c].to_numpy())
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            if held.num_rows < 4 * SIDE:
                continue
            k, i, j = (held[c].to_numpy() for c in ("key", "i", "j"))
            cut = np.flatnonzero((k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            if len(cut):  # the last group may go on
                yield links(arrays(held.slice(0, int(cut[-1]))))
                held = held.slice(int(cut[-1]))
        if held is not None and held.num_rows > 1:
            yield links(arrays(held))

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of ``vectors`` (vec_id, embedding, label, more).

    Vectors of one label link when their cosine reaches ``threshold``. Null and empty vectors, zero vectors,
    null or non-finite components and null labels link with nothing; vectors of different lengths are never
    compared; equal vectors always link. n_links counts other rows; component_id is the smallest vec_id
    reachable. A repeated vec_id gives a row per row, all alike: its vectors are in one component, and n_links is the
    most that one of them has. No rows give no rows; further columns are not read. Links are found with a probability that the tables give (0.99 and more at the threshold itself).
    """
    store = Store(vectors.sparkSession, "lattice")
    all_ids = vectors.select("vec_id")
    hashed = store.put(
        vectors.select("vec_id", F.col("label").cast("long").alias("label"), "embedding").where("vec_id is not null").mapInArrow(_hashed, _VECTOR_DDL), "hashed"
    )
    # equal vectors of a label are one class; a vec_id that is repeated with other vectors is in several
    classes = store.put(
        hashed.groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("weight"))
        .withColumn("class", F.monotonically_increasing_id()), "classes",
    )
    members = hashed.select("vec_id", "label", "h1", "h2").join(classes, ["label", "h1", "h2"]).select("vec_id", "first", "class", "weight")
    one = store.put(
        hashed.join(classes.withColumnRenamed("first", "vec_id"), ["vec_id", "label", "h1", "h2"])
        .dropDuplicates(["class"]).select(F.col("class").alias("vec_id"), "label", "weight", "unit", "home", "probed"), "one",
    )
    spots = one.select("vec_id", F.explode("home").alias("key"), F.lit(True).alias("at_home")).union(
        one.select("vec_id", F.explode(F.array_distinct("probed")).alias("key"), F.lit(False).alias("at_home"))
    )
    spots = spots.groupBy("key", "vec_id").agg(F.max("at_home").alias("at_home"))
    sizes = spots.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("at_home").alias("any")).where("n > 1 and any")
    sides = F.ceil(F.col("n") / SIDE).cast("int")
    met = spots.join(sizes.select("key", sides.alias("sides")), "key").select(
        "key", "vec_id", "at_home", "sides", F.pmod(F.xxhash64("vec_id"), "sides").cast("int").alias("side")
    )
    # a large cell: each side with itself and with every other side
    met = store.put(met.select("key", "vec_id", "at_home", "side", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)).alias("o")).select(
        "key", "vec_id", "at_home", "side", F.least("side", "o").alias("i"), F.greatest("side", "o").alias("j")
    ), "met")
    blocks = met.join(one, "vec_id").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = store.put(
        blocks.select("key", "i", "j", "side", "at_home", "vec_id", "label", "weight", "unit", "home", "probed").mapInArrow(
            _compare(threshold), "vec_id long, n long, root long"
        ), "found",
    )
    first = lambda of, name: classes.select(F.col("class").alias(of), F.col("first").alias(name))
    edges = found.join(first("vec_id", "a"), "vec_id").join(first("root", "b"), "root").select("a", "b").union(
        members.select(F.col("vec_id").alias("a"), F.col("first").alias("b"))
    )
    comp = components(store, edges)
    counts = found.groupBy(F.col("vec_id").alias("class")).agg(F.sum("n").alias("n"))
    linked = members.join(counts, "class", "left").select(
        "vec_id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links")
    ).groupBy("vec_id").agg(F.max("n_links").alias("n_links"))
    return all_ids.join(linked, "vec_id", "left").join(comp.withColumnRenamed("id", "vec_id"), "vec_id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.col("vec_id").eqNullSafe(F.coalesce("component_id", "vec_id")).alias("kept"),
    )
