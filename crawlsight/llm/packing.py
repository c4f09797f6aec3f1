"""Best-fit packing of token streams into sequences of a fixed length.

Best-fit decreasing places the longest piece first, each in the open sequence that it fills best. Pieces of
one length are interchangeable, so the global run needs only how many pieces each length has: at most
``capacity`` counts, whatever the corpus. ``plan`` runs best-fit decreasing over those counts, with a segment
tree over remaining capacities that finds the tightest open capacity in logarithmic time, and treats all open
sequences with one remaining capacity at once. The plan is a list of runs ("pieces r0.. of length L go k to a
sequence into sequences b0.. at offset o"); Spark numbers the pieces of each length and looks each one up.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Store, binaries, encoder, numbered, slices

CAPACITY, END_ID = 4096, 1


class CapacityTree:
    """Segment tree over remaining capacities 0..n: how many open sequences have each."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.tree = [0] * (2 * self.size)

    def add(self, capacity: int, count: int) -> None:
        i = capacity + self.size
        while i:
            self.tree[i] += count
            i //= 2

    def tightest(self, need: int) -> int | None:
        """The least capacity >= need that is open."""
        i = need + self.size
        if self.tree[i]:
            return need
        while i > 1:
            if i % 2 == 0 and self.tree[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.tree[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over {length: pieces}: runs (length, r0, sequences, per_sequence, b0, offset).

    Pieces r0 + i of that length (i < sequences * per_sequence) go to sequence b0 + i // per_sequence, at
    offset + (i % per_sequence) * length. The number of runs depends on the lengths, not on the pieces.
    """
    tree, open_at, runs, bins = CapacityTree(capacity), defaultdict(deque), [], 0

    def put(left: int, b0: int, n: int) -> None:
        if n and left:
            open_at[left].append((b0, n))
            tree.add(left, n)

    for length in sorted((k for k in counts if k > 0), reverse=True):
        todo, rank = counts[length], 0
        while todo:
            left = tree.tightest(length)
            if left is None:
                k = capacity // length
                n = max(1, todo // k)
                b0, left, bins = bins, capacity, bins + n
            else:
                b0, n = open_at[left].popleft()
                tree.add(left, -n)
                k = left // length
            full = min(n, todo // k)  # sequences that take k pieces of this length
            if full:
                runs.append((length, rank, full, k, b0, capacity - left))
                put(left - k * length, b0, full)
                rank, todo = rank + full * k, todo - full * k
            if full < n and todo and todo < k:  # the last pieces share one more sequence
                runs.append((length, rank, 1, todo, b0 + full, capacity - left))
                put(left - todo * length, b0 + full, 1)
                rank, todo, full = rank + todo, 0, full + 1
            put(left, b0 + full, n - full)
    return runs


def token_pieces(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, by_word: bool = True
) -> DataFrame:
    """(doc_id, piece, start, length, ids): the token ids of each document with ``end_id``, cut every ``capacity``.

    ids: little-endian unsigned 32-bit. A null or empty text has only the end id. Repeated rows stay apart.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path, by_word)
        for batch in slices(batches, 1024):
            ids, stops = enc.encode(batch[1].to_pylist(), end_id)
            sizes = np.diff(stops, prepend=0)
            n = -(-sizes // capacity)  # pieces of each document
            of = np.repeat(np.arange(len(n)), n)
            piece = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(sizes[of] - start, capacity)
            at = stops[of] - sizes[of] + start
            yield pa.RecordBatch.from_arrays(
                [batch[0].take(pa.array(of)), pa.array(piece.astype("i4")), pa.array(start), pa.array(length), binaries(ids, at, at + length)], schema=_PIECE
            )

    return docs.select("doc_id", "text").mapInArrow(
        cut, "doc_id long, piece int, start long, length long, ids binary"
    )


_PIECE = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())]
)


#: The parts of a length that are numbered apart: some at least, then one for so many bytes of ids, more bytes where these would be too many parts.
LEAST_PARTS, PART_BYTES, MOST_PARTS = 32, 64 << 20, 1 << 18


def _parts(counts: dict[int, int], capacity: int) -> list[int]:
    """In how many parts the pieces of each length, 0 to ``capacity``, are numbered: at most MOST_PARTS + (LEAST_PARTS + 1) x lengths in all."""
    size = max(PART_BYTES, -(-sum(4 * n * c for n, c in counts.items()) // MOST_PARTS))
    return [LEAST_PARTS + 4 * n * counts.get(n, 0) // size for n in range(capacity + 1)]


def assign(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (doc_id, piece, length, more) with sequence_id and offset. Read several times: store it first.

    The driver gets one count per length (at most ``capacity`` rows) and broadcasts the plan, whose size
    depends on the number of lengths alone.
    """
    counts = {int(n): int(c) for n, c in pieces.groupBy("length").count().collect()}
    if too_long := [n for n in counts if not 0 < n <= capacity]:
        raise ValueError(f"pieces of 1 to {capacity} ids are packed, not of {too_long[0]}")
    runs = sorted(plan(counts, capacity))
    table = np.array(runs or [(0, 0, 1, 1, 0, 0)], dtype="i8")
    # runs of a length follow one another, so (length, r0) is sorted and one search finds the run
    most = max(counts.values(), default=1) + 1
    if most * (capacity + 1) >= 2**62:
        raise ValueError("too many pieces of one length for one 64-bit key")
    shared = pieces.sparkSession.sparkContext.broadcast((table[:, 0] * most + table[:, 1], table))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, runs_ = shared.value
        for batch in batches:
            rank = batch["_rank_in_length"].to_numpy()
            length = batch["length"].to_numpy()
            r = runs_[np.maximum(np.searchsorted(keys, length * most + rank, side="right") - 1, 0)]
            i = rank - r[:, 1]
            keep = [j for j, n in enumerate(batch.schema.names) if n != "_rank_in_length"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(j) for j in keep), pa.array(r[:, 4] + i // r[:, 3]), pa.array(r[:, 5] + i % r[:, 3] * r[:, 0])],
                names=[*(batch.schema.names[j] for j in keep), "sequence_id", "offset"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    folded = F.split(F.lit(",".join(map(str, _parts(counts, capacity)))), ",").cast("array<int>")  # one literal, looked up by place
    ranked = numbered(pieces, ["length"], ["doc_id", "piece"], "_rank_in_length", salts=F.get(folded, F.col("length").cast("int")))
    return ranked.select(*pieces.columns, "_rank_in_length").mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, by_word: bool = True
) -> DataFrame:
    """Pack ``docs`` (doc_id, text, more) into as few sequences as best-fit decreasing finds.

    Returns a row per piece: doc_id, piece, start (its document's ids before it), length, ids (little-endian
    unsigned 32-bit), sequence_id, offset (gapless from 0 in its sequence). Only documents longer than
    ``capacity`` are cut. Null and empty texts are one end id; no rows give no rows; ties are broken by
    doc_id and piece; a repeated row is packed again; further columns are not read.
    """
    store = Store(docs.sparkSession, "pack")
    return assign(store.put(token_pieces(docs, tokenizer_path, capacity, end_id, by_word), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids) of packed pieces: each group is one sequence, so at most ``capacity`` ids."""
    return packed.groupBy("sequence_id").agg(
        F.sum("length").alias("length"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("h")))), lambda x: x.h), ""
        ).alias("_h"),
    ).select("sequence_id", "length", F.unhex("_h").alias("ids"))
