"""How document filters interact: what each removes, in every order.

A filter's failure is a bit, so five filters make 32 subsets, and a document is a 32-bit word whose bit S says that it
survives the subset S. How many documents survive each subset, per part and label, is a positional count of those
words; every figure of every order follows from these counts. The words are added by carry-save adders: three words
become a sum and a carry word, 32 counters at once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
#: Groups of part and label that a task counts at a time.
HELD = 4096
_SPACE = r"[\x20\x09-\x0D]+"


def text_failures(text: Column) -> Column:
    """The bits of the filters A to D (1, 2, 4, 8) that a text fails; they look at the text alone."""
    words = F.array_remove(F.split(text, _SPACE, -1), "")  # split once: Spark shares equal expressions of a projection
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    return (
        F.when(n < 200, 1).otherwise(0)
        + F.when(100 * distinct.cast("long") < 50 * n.cast("long"), 2).otherwise(0)
        + F.when(100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") > 3 * F.length(text).cast("long"), 4).otherwise(0)
        + F.when(text.rlike("[#$%&*|]"), 8).otherwise(0)
    )


def survival_words() -> np.ndarray:
    """For each set of failed filters, as bits: the word whose bit S is set if none of them is in the subset S."""
    n = 1 << len(FILTERS)
    return np.array([sum(1 << s for s in range(n) if not s & failed) for failed in range(n)], "<u4")


class Planes:
    """Counts, for each bit position, the words that have it set. Plane k holds words that stand for 2^k."""

    def __init__(self):
        self.planes: list[np.ndarray] = []

    def add(self, words: np.ndarray) -> None:
        carry, k = words, 0
        while len(carry):
            if k == len(self.planes):
                self.planes.append(carry[:0])
            own, up = np.concatenate([self.planes[k], carry]), []
            while len(own) > 2:
                third = len(own) // 3
                a, b, c = own[:third], own[third : 2 * third], own[2 * third : 3 * third]
                half = a ^ b
                up.append(a & b | half & c)
                own = np.concatenate([half ^ c, own[3 * third :]])
            self.planes[k], carry, k = own, np.concatenate([words[:0], *up]), k + 1

    def counts(self) -> np.ndarray:
        out = np.zeros(32, "i8")
        for k, plane in enumerate(self.planes):
            bits = np.unpackbits(plane.astype("<u4").view("u1").reshape(-1, 4), axis=1, bitorder="little")
            out += bits.sum(0, dtype="i8") << k
        return out


def _survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, good, toxic, survivors): this task's documents that survive each subset."""
    table, held = survival_words(), {}

    def told() -> pa.RecordBatch:
        keys = list(held)
        out = pa.RecordBatch.from_arrays([
            pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), pa.array([k[2] for k in keys], pa.bool_()),
            pa.array([held[k].counts().tolist() for k in keys], pa.list_(pa.int64())),
        ], names=["part", "good", "toxic", "survivors"])
        held.clear()
        return out

    for batch in (b for b in batches if b.num_rows):
        words = table[batch["failed"].to_numpy()]
        coded = batch["part"].dictionary_encode()
        label = batch["good"].to_numpy(zero_copy_only=False) * 2 + batch["toxic"].to_numpy(zero_copy_only=False)
        group = coded.indices.to_numpy().astype("i8") * 4 + label
        order = np.argsort(group, kind="stable")
        keys, at = np.unique(group[order], return_index=True)
        for g, rows in zip(keys.tolist(), np.split(order, at[1:]), strict=True):
            held.setdefault((coded.dictionary[g // 4].as_py(), bool(g & 2), bool(g & 1)), Planes()).add(words[rows])
        if len(held) > HELD:
            yield told()
    if held:
        yield told()


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, good, toxic, failed) of each row of ``docs``: its lang, whether a label calls it so, and the filters it fails."""
    text = F.coalesce("text", F.lit(""))
    # only digests are compared: E looks for an equal text under a smaller doc_id
    facts = docs.select(
        "doc_id", F.coalesce("lang", F.lit("")).alias("part"), text_failures(text).alias("failed"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest")
    )
    first = facts.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").withColumn("first", F.lit(True))
    label = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return facts.join(first, ["doc_id", "digest"], "left").join(label, "doc_id", "left").select(
        "part", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"),
        (F.col("failed") + F.when(copy, 16).otherwise(0)).alias("failed"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each of the filters A to E removes from ``docs`` (doc_id, text, lang, more), in all 120 orders.

    A: under 200 words; B: less than half of the words distinct; C: more than 3 % A-Z; D: one of ``#$%&*|``; E: a smaller
    doc_id has the same text. Null texts and langs are empty; a row with a null doc_id is no copy and has no label;
    rows repeated with their doc_id are no copies of one another and count each; of several ``labels`` (doc_id,
    quality, toxic) of a document one that says 1 is enough. Further columns are not read; no rows give no rows.
    Returns part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.
    """
    counted = failures(docs, labels).mapInArrow(_survivors, "part string, good boolean, toxic boolean, survivors array<long>")
    n = 1 << len(FILTERS)
    total = lambda s, when: F.sum(F.when(when, F.col("survivors")[s]).otherwise(0))
    of = {"all": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    parts = counted.groupBy("part").agg(*(F.array(*(total(s, when) for s in range(n))).alias(k) for k, when in of.items()))

    def weighted(bit: int) -> Column:
        """A filter's removals summed over all orders: a subset comes before it in as many as its and the rest's orders make."""
        k = len(FILTERS)
        each = (
            factorial(s.bit_count()) * factorial(k - 1 - s.bit_count()) * (F.col("all")[s] - F.col("all")[s | bit])
            for s in range(n) if not s & bit
        )
        return reduce(Column.__add__, each)

    steps = []
    for order in permutations(FILTERS):
        before = 0
        for i, f in enumerate(order):
            bit = 1 << FILTERS.index(f)
            steps.append({"filter_order": "".join(order), "step": i + 1, "before": before, "after": before | bit, "bit": bit, "no": FILTERS.index(f)})
            before |= bit
    listed = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,before:int,after:int,bit:int,no:int>>")
    shared = parts.withColumn("shares", F.array(*(weighted(1 << i) for i in range(len(FILTERS)))))
    at = lambda k, s: F.element_at(k, s + 1)
    x = shared.select("part", *of, "shares", F.inline(listed))
    lost = lambda k: at(k, F.col("before")) - at(k, F.col("after"))
    return x.select(
        "part", "filter_order", "step", at("all", F.col("after")).alias("kept"), lost("all").alias("removed"),
        (at("all", F.lit(0)) - at("all", F.col("bit")) - lost("all")).alias("redundant"),
        (at("all", F.lit(n - 1) - F.col("bit")) - at("all", F.lit(n - 1))).alias("unique_fails"),
        lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), at("shares", F.col("no")).alias("shapley"),
    )
