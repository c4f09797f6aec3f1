"""Content-addressed store of token-id streams.

A rolling hash over the ids cuts each document's stream into chunks, so equal passages give equal chunks.
Chunks are addressed by SHA-256 and stored once. A recipe per document, in ascending doc_id order, lists its
chunks and carries the Merkle root over them; a manifest carries the tree above.

Files below a store's folder, all Parquet: ``chunks`` (digest, n, ids: little-endian unsigned, of 16 bits each where
all are below 65,536, else of 32; addresses are always of the 32-bit form),
``recipes`` (part, block, doc_id, start, n_tokens, root, chunks[digest, n]; ascending), ``manifest`` (part,
block, first_doc, last_doc, docs, tokens, root), ``tree`` (part, docs, tokens, root): Merkle roots over the recipes
of a block, the blocks of a part and, by ``root``, the parts.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Store, encoder, slices

END_ID = 1
#: Ids in a chunk, and the ids that the rolling hash sees (a power of two). A cut needs MASK_BITS zero bits.
LEAST, MOST, SEEN, MASK_BITS = 128, 2048, 16, 9
#: Documents in a block of the manifest.
BLOCK = 1024

_CHUNK = pa.struct([("digest", pa.binary()), ("n", pa.int32()), ("ids", pa.binary())])
_CODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("root", pa.binary()), ("chunks", pa.list_(_CHUNK))])
CHUNKS = "digest binary, n int, ids binary"
RECIPE_COLUMNS = ("part", "block", "doc_id", "start", "n_tokens", "root", "chunks")
RECIPES = (
    "part int, block int, doc_id long, start long, n_tokens long, root binary, chunks array<struct<digest:binary,n:int>>"
)


def cut_points(ids: np.ndarray, stops: np.ndarray) -> list[list[int]]:
    """Ends of the chunks of each stream, counted from its start, by content: a shift in front of a passage leaves
    its inner cuts. ``ids`` holds the streams one after another, ``stops`` where each ends.

    No chunk but the last of a stream has less than LEAST ids, more than the rolling hash sees, so that the hash
    runs over all streams at once without changing a cut.
    """
    mixed = ids.astype("u8") * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    rolled, seen = mixed, 1  # ids i - j, j < SEEN, each shifted by j; doubling the span needs log2(SEEN) sums
    while seen < SEEN:
        wider = rolled.copy()
        wider[seen:] += rolled[:-seen] << np.uint64(seen)
        rolled, seen = wider, 2 * seen
    wanted = np.flatnonzero(rolled >> np.uint64(64 - MASK_BITS) == 0) + 1
    upto = np.searchsorted(wanted, stops).tolist()
    out, start, first = [], 0, 0
    for stop, last in zip(stops.tolist(), upto, strict=True):
        ends, begin = [], start
        if stop - start > LEAST:
            for at in wanted[first:last].tolist():
                while at - begin > MOST:
                    begin += MOST
                    ends.append(begin - start)
                if at - begin >= LEAST:
                    begin = at
                    ends.append(at - start)
            while stop - begin > MOST:
                begin += MOST
                ends.append(begin - start)
        if stop > begin:
            ends.append(stop - start)
        out.append(ends)
        start, first = stop, last
    return out


def merkle_root(digests: Sequence[bytes]) -> bytes:
    """Pairwise SHA-256 up to one root; an odd last node moves up as it is."""
    level = list(digests)
    while len(level) > 1:
        paired = [hashlib.sha256(level[i] + level[i + 1]).digest() for i in range(0, len(level) - 1, 2)]
        level = paired + level[len(paired) * 2 :]
    return level[0] if level else hashlib.sha256(b"").digest()


def _narrow(ids: np.ndarray) -> bytes:
    return ids.astype("<u2").tobytes() if ids.max() < 65536 else ids.tobytes()


def _wide(raw: bytes, n: int) -> bytes:
    return np.frombuffer(raw, "<u2").astype("<u4").tobytes() if len(raw) == 2 * n else raw


def _coded(docs: DataFrame, tokenizer_path: str, end_id: int, by_word: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path, by_word)
        sent: set[bytes] = set()  # chunks this task has passed on; forgetting some only passes them on again
        for batch in slices(batches, 1024):
            ids, stops = enc.encode(batch[1].to_pylist(), end_id)
            ids = np.ascontiguousarray(ids, "<u4")
            starts = np.concatenate([[0], stops[:-1]]).astype("i8")
            digests, sizes, parts, roots, ends_at = [], [], [], [], [0]
            for start, ends in zip(starts.tolist(), cut_points(ids, stops), strict=True):
                begin, mine = start, []
                for end in ends:
                    part = ids[begin : start + end]
                    digest = hashlib.sha256(part).digest()
                    mine.append(digest)
                    sizes.append(len(part))
                    parts.append(None if digest in sent else _narrow(part))
                    sent.add(digest)
                    begin = start + end
                digests += mine
                roots.append(merkle_root(mine))
                ends_at.append(len(digests))
            if len(sent) > 500_000:
                sent.clear()
            chunks = pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip((digests, sizes, parts), _CHUNK, strict=True)], fields=list(_CHUNK))
            yield pa.RecordBatch.from_arrays(
                [batch[0], pa.array(stops - starts), pa.array(roots, pa.binary()), pa.ListArray.from_arrays(pa.array(ends_at, pa.int32()), chunks)], schema=_CODED
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_tokens long, root binary, chunks array<struct<digest:binary,n:int,ids:binary>>"
    )


def write(
    docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, by_word: bool = True
) -> None:
    """Write ``docs`` (doc_id, text, more) as a store below ``path``, which only Spark needs to reach.

    Null and empty texts are one end id; repeated rows get a recipe each; no rows give empty files; a null
    doc_id comes first; further columns are not read.
    """
    spark = docs.sparkSession
    store = Store(spark, "idstore")
    coded = store.put(_coded(docs, tokenizer_path, end_id, by_word), "coded")
    chunk = coded.select(F.explode("chunks").alias("c")).where("c.ids is not null").select("c.digest", "c.n", "c.ids")
    chunk.repartition("digest").dropDuplicates(["digest"]).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/chunks")

    narrow = coded.select(
        "doc_id", "n_tokens", "root",
        F.transform("chunks", lambda c: F.struct(c["digest"].alias("digest"), c["n"].alias("n"))).alias("chunks"),
    )
    dealt = store.put(
        narrow.repartitionByRange("doc_id", "root").withColumn("part", F.spark_partition_id()), "dealt"
    )
    # ids before each part, then before each document of the part
    sums = dealt.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))  # a row per part
    inside = Window.partitionBy("part").orderBy("doc_id", "root")
    recipes = (
        dealt.withColumn("start", F.coalesce(F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("block", F.floor((F.row_number().over(inside) - 1) / BLOCK).cast("int"))
        .join(F.broadcast(starts), "part")
        .withColumn("start", F.col("start") + F.col("part_start"))
        .select(*RECIPE_COLUMNS)
    )
    recipes.repartitionByRange("start").sortWithinPartitions("start").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/recipes")
    _blocks(read_recipes(spark, path)).write.mode("overwrite").parquet(f"{path}/manifest")
    _parts(spark.read.parquet(f"{path}/manifest")).write.mode("overwrite").parquet(f"{path}/tree")
    store.drop()


def _rooted(grouped: DataFrame) -> DataFrame:
    """``grouped`` with the Merkle root of the roots in its column ``roots``, array of (at, root), in order of at."""
    plain = [c for c in grouped.columns if c != "roots"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [merkle_root([x["root"] for x in r]) for r in batch["roots"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in plain), pa.array(found, pa.binary())], names=[*plain, "root"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in grouped.select(*plain).schema.fields)
    return grouped.select(*plain, F.array_sort("roots").alias("roots")).mapInArrow(run, f"{schema}, root binary")


def _blocks(recipes: DataFrame) -> DataFrame:
    """A row per block of at most BLOCK recipes, with the Merkle root over their roots."""
    return _rooted(recipes.groupBy("part", "block").agg(
        F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.count(F.lit(1)).alias("docs"),
        F.sum("n_tokens").alias("tokens"), F.collect_list(F.struct(F.col("start").alias("at"), "root")).alias("roots"),
    ))


def _parts(manifest: DataFrame) -> DataFrame:
    """A row per part of the store: the Merkle root over its blocks, which are as many as a task's recipes / BLOCK."""
    return _rooted(manifest.groupBy("part").agg(
        F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"), F.collect_list(F.struct(F.col("block").alias("at"), "root")).alias("roots"),
    ))


def root(spark, path: str) -> bytes:
    """The store's Merkle root, over its parts (a few numbers and 32 bytes each)."""
    return merkle_root([r["root"] for r in spark.read.parquet(f"{path}/tree").orderBy("part").select("root").collect()])


def read_recipes(spark, path: str) -> DataFrame:
    return spark.read.schema(RECIPES).parquet(f"{path}/recipes")


_CHECKED = pa.schema([("digest", pa.binary()), ("size", pa.int32()), ("crc", pa.int64()), ("ids", pa.binary())])


def _checked_chunks(spark, path: str, with_ids: bool) -> DataFrame:
    """The chunks, each proven by its own address: (digest, size, crc, ids), ids of 32 bits or left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1000):
            crcs, wide = [], []
            for digest, n, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                ids = _wide(raw, n)
                if hashlib.sha256(ids).digest() != digest or len(ids) != 4 * n:
                    raise ValueError("a chunk does not match its address")
                crcs.append(zlib.crc32(ids))
                wide.append(ids if with_ids else None)
            yield pa.RecordBatch.from_arrays([batch["digest"], batch["n"], pa.array(crcs, pa.int64()), pa.array(wide, pa.binary())], schema=_CHECKED)

    chunks = spark.read.schema(CHUNKS).parquet(f"{path}/chunks").select("digest", "n", "ids")
    return chunks.mapInArrow(run, "digest binary, size int, crc long, ids binary")


@lru_cache(maxsize=20_000)
def _zeros(n_bytes: int) -> tuple[int, ...]:
    """The 32 x 32 bit matrix that moves a CRC-32 past ``n_bytes`` zero bytes, as columns."""
    if n_bytes == 1:
        step = (0xEDB88320, *(1 << i for i in range(31)))  # one zero bit
        for _ in range(3):
            step = tuple(_apply(step, c) for c in step)
        return step
    half = _zeros(n_bytes // 2)
    both = tuple(_apply(half, c) for c in half)
    return tuple(_apply(_zeros(1), c) for c in both) if n_bytes % 2 else both


def _apply(matrix: Sequence[int], vector: int) -> int:
    out = i = 0
    while vector:
        if vector & 1:
            out ^= matrix[i]
        vector >>= 1
        i += 1
    return out


def crc_joined(crcs: Sequence[int], sizes: Sequence[int]) -> int:
    """CRC-32 of byte strings put together, from the CRC-32 and size of each."""
    total = 0
    for crc, size in zip(crcs, sizes, strict=True):
        total = (_apply(_zeros(size), total) if size and total else total) ^ crc
    return total


def _rebuilt(spark, path: str, with_ids: bool) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of each document out of its recipe, its root and every address verified."""
    chunks = _checked_chunks(spark, path, with_ids).select("digest", "size", "crc", *(["ids"] if with_ids else []))
    steps = read_recipes(spark, path).select("doc_id", "start", "n_tokens", "root", F.posexplode("chunks").alias("at", "c")).select(
        "doc_id", "start", "n_tokens", "root", "at", F.col("c.digest").alias("digest")
    )
    # left, so that a missing chunk is noticed
    rows = steps.join(chunks, "digest", "left").groupBy("start", "doc_id", "n_tokens", "root").agg(
        F.array_sort(F.collect_list(F.struct("at", "digest", "size", "crc", *(["ids"] if with_ids else [])))).alias("steps")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["steps"]
            flat, ends = lists.values, lists.offsets.to_numpy()
            digests, sizes, crcs = (flat.field(i).to_numpy(zero_copy_only=False).tolist() for i in (1, 2, 3))
            bodies = flat.field(4).to_numpy(zero_copy_only=False).tolist() if with_ids else None
            roots, n_tokens = batch["root"].to_pylist(), batch["n_tokens"].to_pylist()
            crc, whole = [], []
            for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
                mine = sizes[a:b]
                if any(c is None or c != c for c in crcs[a:b]) or sum(mine) != n_tokens[i] or merkle_root(digests[a:b]) != roots[i]:
                    raise ValueError(f"document {batch['doc_id'][i]} cannot be put together from the store")
                crc.append(crc_joined([int(c) for c in crcs[a:b]], [4 * int(n) for n in mine]))
                if with_ids:
                    whole.append(b"".join(bodies[a:b]))
            out = [batch["doc_id"], batch["start"], batch["n_tokens"], pa.array(crc, pa.int64())]
            if with_ids:
                out.append(pa.array(whole, pa.binary()))
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(out)])

    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else ""))


def digests(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) read back from a store, with every address and root verified.

    Each chunk's bytes are read once, checked against the address and summed up as a CRC; only addresses, sizes
    and CRCs move. A document's CRC is that of its chunks put together in recipe order; its Merkle root is
    computed again from the addresses. A chunk that is missing or differs is an error. ``documents`` gives the
    ids themselves.
    """
    return _rebuilt(spark, path, False)


def documents(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) put together from a store and verified as by ``digests``; ids little-endian unsigned 32-bit."""
    return _rebuilt(spark, path, True).drop("ids_crc32")


def verify_manifest(spark, path: str) -> DataFrame:
    """Nodes of the manifest's tree, (part, block), block null for a part, whose root differs from what is below; empty if the store is whole."""
    manifest = spark.read.parquet(f"{path}/manifest")
    blocks = manifest.alias("m").join(_blocks(read_recipes(spark, path)).alias("n"), ["part", "block"], "full").where("not (m.root <=> n.root)")
    parts = spark.read.parquet(f"{path}/tree").alias("m").join(_parts(manifest).alias("n"), "part", "full").where("not (m.root <=> n.root)")
    return blocks.select("part", "block").union(parts.select("part", F.lit(None).cast("int")))
