"""Language-model scores by deleted interpolation.

The model is P(w | v) = a f(w | v) + b f(w) + c / (V + 1): maximum-likelihood estimates of two words, of one and of
none, mixed by weights (a, b, c) that depend on how often the context v was seen, in buckets of powers of two. The
weights are learned by expectation-maximisation on the counts of a deleted part of the training texts, against
estimates from the rest; the scores use counts of all training texts.

Counts are not taken row by row. Texts are cut into blocks; a block asks for each of its distinct words and pairs
once, in one row per hash bucket, with how often its training texts hold it. A bucket adds up what all blocks say
and answers each of them. So a frequent pair is one entry per block and buckets are as even as hashes are, whatever
the words; the number of buckets follows the corpus, so what a task holds doesn't. Nothing of the vocabulary reaches
the driver: it sees sums and the weights of at most 64 buckets.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Store
from .texts import one_array, spaced_words, text_blocks

#: Bytes of text in a block, and in the corpus for each hash bucket.
BLOCK, PER_BUCKET = 8_000_000, 8_000_000
#: One in so many training texts is deleted from the counts that the weights are learned against.
PARTS = 16
ROUNDS, LEVELS = 25, 64
#: Words that no text can hold, as they have a space: the end of a text, and what stands before its first word.
_OWN = (b" end", b" start")
END, START = 0, 1
TRAIN, HELD_OUT, DELETED = 0, 1, 2

_BLOCKS = "block long, deleted boolean, ids array<long>, held_out array<boolean>, sizes array<long>, codes binary, words array<binary>, train_tokens long"
_ASKED = "block long, deleted boolean, pairs boolean, bucket int, keys binary, n binary"
_TOLD = "block long, deleted boolean, pairs boolean, bucket int, n binary, rest binary, distinct long"
_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "double": pa.float64()}
    fields = (f.split() for f in ddl.split(", "))
    return pa.schema([(n, pa.list_(kinds[t[6:-1]]) if t.startswith("array") else kinds[t]) for n, t in fields])


def _encoded(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Blocks of texts as codes of words that each block numbers by itself; deleted texts have blocks of their own."""
    no = TaskContext.get().partitionId() << 32
    for deleted, rows in text_blocks(batches, "text", size, lambda b: (b["part"].to_numpy() == DELETED).astype("i8")):
        words, n = spaced_words(one_array(rows["text"]))
        coded = words.dictionary_encode()
        sizes = n + 1
        ends = np.cumsum(sizes) - 1
        codes = np.full(int(sizes.sum()), END, "<u4")
        inside = np.ones(len(codes), bool)
        inside[ends] = False
        codes[inside] = coded.indices.to_numpy() + len(_OWN)
        held = rows["part"].to_numpy() == HELD_OUT
        yield pa.RecordBatch.from_arrays([
            pa.array([no]), pa.array([bool(deleted)]), pa.array([rows["doc_id"].to_pylist()], pa.list_(pa.int64())), pa.array([held.tolist()]),
            pa.array([sizes.tolist()], pa.list_(pa.int64())), pa.array([codes.tobytes()], pa.binary()),
            pa.array([[*_OWN, *coded.dictionary.cast(pa.binary()).to_pylist()]], pa.list_(pa.binary())), pa.array([int(sizes[~held].sum())]),
        ], schema=_arrow(_BLOCKS))
        no += 1


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing function."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Block:
    """A block's words and pairs of words, in the order in which it asks for them."""

    def __init__(self, row: dict, buckets: int):
        self.sizes = np.array(row["sizes"], "i8")
        self.w = np.frombuffer(row["codes"], "<u4").astype("i8")
        self.starts = np.cumsum(self.sizes) - self.sizes
        v = np.empty_like(self.w)
        v[1:] = self.w[:-1]
        v[self.starts] = START
        n = len(row["words"])
        both, self.pair = np.unique(v * n + self.w, return_inverse=True)
        self.v_of, self.w_of = both // n, both % n
        # a word is known by 128 bits: 64 are its key, others choose its bucket, so keys only need to differ inside a bucket
        h = np.frombuffer(b"".join(blake2b(x, digest_size=16).digest() for x in row["words"]), "<u8").reshape(-1, 2)
        salt = np.uint64(0x9E3779B97F4A7C15)
        h2 = _mixed(_mixed(h[self.v_of] ^ salt) + h[self.w_of])
        self.train = np.repeat(~np.array(row["held_out"], bool), self.sizes)
        self.keys, self.order, self.cuts, self.used = {}, {}, {}, {}
        for pairs, x in ((False, h), (True, h2)):
            bucket = (x[:, 1] % np.uint64(buckets)).astype("i8")
            self.order[pairs] = np.argsort(bucket, kind="stable")
            self.used[pairs], at = np.unique(bucket[self.order[pairs]], return_index=True)
            self.cuts[pairs] = np.append(at, len(bucket))
            self.keys[pairs] = x[:, 0]

    def counts(self) -> dict[bool, np.ndarray]:
        """How often the block's training texts hold each word and each pair; the start counts once for each text."""
        words = np.bincount(self.w[self.train], minlength=len(self.keys[False]))
        words[START] = self.train[self.starts].sum()
        return {False: words, True: np.bincount(self.pair[self.train], minlength=len(self.v_of))}

    def told(self, rows: list[dict], column: str) -> dict[bool, np.ndarray]:
        """What the buckets say about each word and pair."""
        out = {k: np.zeros(len(x), "i8") for k, x in self.keys.items()}
        for r in rows:
            i = int(np.searchsorted(self.used[r["pairs"]], r["bucket"]))
            a, b = self.cuts[r["pairs"]][i : i + 2]
            out[r["pairs"]][self.order[r["pairs"]][a:b]] = np.frombuffer(r[column], "<i8")
        return out

    def estimates(self, n: dict[bool, np.ndarray], total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(level, f(w | v), f(w)) of each pair; a context that was never seen has level 0 and the estimate 0."""
        seen = n[False][self.v_of]
        level = np.where(seen > 0, 1 + np.log2(np.maximum(seen, 1)).astype("i8"), 0)
        return level, n[True] / np.maximum(seen, 1), n[False][self.w_of] / max(total, 1)


def _rows(table: pa.Table) -> list[dict]:
    return table.to_pylist()


def train_and_score(docs: DataFrame, store: Store | None = None, block_bytes: int = BLOCK) -> DataFrame:
    """Score every row of ``docs`` (doc_id, text, more; further columns are not read).

    Words are maximal runs without ASCII white space, A-Z lower-cased; each text ends with one more token. Texts whose
    crc32(doc_id as text) mod 7 is 2 are held out, all others train; of these, those whose (crc32 div 7) mod ``PARTS`` is 0
    are the deleted part. Returns a row per row: doc_id, held_out, n_tokens, n_known (tokens seen in training),
    train_tokens, base_score (add-one estimates of single words, log10) and score (log10 of the model's probability of
    the text). A null text is empty, so only its end counts; a null doc_id has the checksum of the empty text; repeated
    rows count and are scored each; without a deleted part the weights are equal; no rows give no rows.
    """
    spark = docs.sparkSession
    store = store or Store(spark, "language-model")
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    part = F.when(crc % 7 == 2, HELD_OUT).when(F.floor(crc / 7) % PARTS == 0, DELETED).otherwise(TRAIN)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), part.cast("int").alias("part"))
    blocks = store.put(texts.mapInArrow(lambda b: _encoded(b, block_bytes), _BLOCKS), "blocks")
    size, total = blocks.agg(F.sum(F.length("codes")), F.sum("train_tokens")).first()
    # a token is four bytes here and, as a rule, six in the text
    buckets, total = max(64, (size or 0) * 3 // 2 // PER_BUCKET), int(total or 0)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                block = _Block(row, buckets)
                for pairs, n in block.counts().items():
                    order, cuts = block.order[pairs], block.cuts[pairs]
                    keys, n = block.keys[pairs][order], n[order].astype("<i8")
                    spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
                    yield pa.RecordBatch.from_arrays([
                        pa.array([row["block"]] * len(spans)), pa.array([row["deleted"]] * len(spans)), pa.array([pairs] * len(spans)),
                        pa.array(block.used[pairs].astype("i4")), pa.array([keys[a:b].tobytes() for a, b in spans], pa.binary()),
                        pa.array([n[a:b].tobytes() for a, b in spans], pa.binary()),
                    ], schema=_arrow(_ASKED))

    def add(table: pa.Table) -> pa.Table:
        """All blocks' counts of one bucket's words or pairs, summed; each block gets those that it asked for."""
        rows = _rows(table)
        keys = [np.frombuffer(r["keys"], "<u8") for r in rows]
        sizes = [len(k) for k in keys]
        unique, at = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.concatenate([np.frombuffer(r["n"], "<i8") for r in rows])
        deleted = np.repeat([r["deleted"] for r in rows], sizes)
        sums = np.bincount(at, n, len(unique)).astype("i8")
        rest = sums - np.bincount(at[deleted], n[deleted], len(unique)).astype("i8")
        ends = np.cumsum(sizes)
        told, kept = sums[at].astype("<i8"), rest[at].astype("<i8")
        spans = list(zip((ends - sizes).tolist(), ends.tolist(), strict=True))
        return pa.Table.from_arrays([
            *(table[c] for c in ("block", "deleted", "pairs", "bucket")), pa.array([told[a:b].tobytes() for a, b in spans], pa.binary()),
            pa.array([kept[a:b].tobytes() if r["deleted"] else b"" for r, (a, b) in zip(rows, spans, strict=True)], pa.binary()),
            pa.array([0 if i or rows[0]["pairs"] else int((sums > 0).sum()) for i in range(len(rows))]),
        ], schema=_arrow(_TOLD))

    told = store.put(blocks.mapInArrow(ask, _ASKED).groupBy("pairs", "bucket").applyInArrow(add, _TOLD), "told")
    distinct, rest_tokens = told.agg(F.sum("distinct")).first()[0] or 0, blocks.where("not deleted").agg(F.sum("train_tokens")).first()[0] or 0
    words = int(distinct) - (total > 0)  # the start is no word

    def weigh(left: pa.Table, right: pa.Table) -> pa.Table:
        """What EM needs of a deleted block: each pair's level, estimates from the rest, and count."""
        block = _Block(_rows(left)[0], buckets)
        level, two, one = block.estimates(block.told(_rows(right), "rest"), int(rest_tokens))
        n = block.counts()[True]
        x = [level.astype("<i8"), two.astype("<f8"), one.astype("<f8"), n.astype("<i8")]
        return pa.table([pa.array([a.tobytes()], pa.binary()) for a in x], names=["level", "two", "one", "n"])

    kind = "level binary, two binary, one binary, n binary"
    deleted = blocks.where("deleted").groupBy("block").cogroup(told.where("deleted").groupBy("block")).applyInArrow(weigh, kind)
    weights = _learn(store.put(deleted, "deleted"), words)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        row = _rows(left)[0]
        block = _Block(row, buckets)
        n = block.told(_rows(right), "n")
        level, two, one = block.estimates(n, total)
        a, b, c = weights[level].T
        chance = np.log10(a * two + b * one + c / (words + 1))
        alone = np.log10((n[False] + 1) / (total + words + 1))
        of = lambda x: np.add.reduceat(x, block.starts)  # noqa: E731  each text has a token at least
        return pa.table([
            pa.array(row["ids"], pa.int64()), pa.array(row["held_out"]), pa.array(block.sizes), pa.array(of((n[False][block.w] > 0).astype("i8"))),
            pa.array(np.full(len(block.sizes), total)), pa.array(of(alone[block.w])), pa.array(of(chance[block.pair])),
        ], schema=_arrow(_SCORES))

    return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(score, _SCORES)


def _learn(deleted: DataFrame, words: int) -> np.ndarray:
    """Weights (a, b, c) per level by expectation-maximisation; ``deleted`` has packed levels, estimates and counts.

    A level's weights start equal and keep one made-up token spread over them, so none is ever 0. A context that was
    never seen gives no estimate of two words, so level 0 has no weight on it.
    """
    def start() -> np.ndarray:
        w = np.full((LEVELS, 3), 1 / 3)
        w[0] = (0, 1 / 2, 1 / 2)
        return w

    weights = prior = start()
    for _ in range(ROUNDS):
        now = weights

        def expect(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((LEVELS, 3))
            for batch in batches:
                for i in range(batch.num_rows):
                    level, two, one, n = (np.frombuffer(batch.column(j)[i].as_py(), t) for j, t in enumerate(("<i8", "<f8", "<f8", "<i8")))
                    mix = now[level] * np.array([two, one, np.full(len(two), 1 / (words + 1))]).T
                    mix *= (n / mix.sum(1))[:, None]
                    for j in range(3):
                        sums[:, j] += np.bincount(level, mix[:, j], LEVELS)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(LEVELS)), *(pa.array(s) for s in sums.T)], names=["level", "a", "b", "c"])

        got = deleted.mapInArrow(expect, "level long, a double, b double, c double").groupBy("level").agg(F.sum("a"), F.sum("b"), F.sum("c")).collect()
        sums = np.zeros((LEVELS, 3))
        for r in got:
            sums[r[0]] = r[1:]
        weights = (sums + prior) / (sums.sum(1) + 1)[:, None]
        if np.abs(weights - now).max() < 1e-6:
            break
    return weights
