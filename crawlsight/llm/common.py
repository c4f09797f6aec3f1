"""What the training-data operators share: stored tables, gapless numbering, link components, token ids."""

from __future__ import annotations

import json
import os
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

# ---------------------------------------------------------------- stored tables


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; one of our own only on a single machine where it is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-crawlsight-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


#: With this setting of Spark a query deletes its shuffle files when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Store:
    """Tables of one run in the shared folder. Each cuts the lineage and survives a lost executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def put(self, df: DataFrame, name: str, file_rows: int = 0) -> DataFrame:
        """Store a table; with ``file_rows`` in files of so many rows at most, so that tasks that read it can be small.

        What was shuffled to make it is deleted: the table stands for it from then on.
        """
        conf = df.sparkSession.conf
        before = conf.get(CLEANUP, None)
        conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", file_rows).parquet(self.path(name))
        finally:
            conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
        return self.get(name, df.schema)

    def get(self, name: str, schema: T.StructType | str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more (all of them without a name)."""
        jvm = self.spark.sparkContext._jvm
        for path in [self.path(n) for n in names] or [self.base]:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


# ---------------------------------------------------------------- gapless numbers


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, salts: int | Column = 64) -> DataFrame:
    """Number the rows of each key from 0 without gaps, no key in one task.

    Rows of a key are dealt to ``salts`` parts by a hash of ``order``; each part is numbered by a window and
    starts after the parts before it. ``keys`` must have few values (the counts per key and part are broadcast:
    at most values x salts rows); ``order`` should tell rows apart. ``salts`` may be a column that depends on the keys.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    counts = salted.groupBy(*keys, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys, "_salt").orderBy(*order)
    return (
        salted.withColumn("_rank", F.row_number().over(inside).cast("long") - 1)
        .join(F.broadcast(starts), [*keys, "_salt"])
        .withColumn(out, F.col("_rank") + F.col("_start"))
        .drop("_rank", "_start", "_salt")
    )


# ---------------------------------------------------------------- components


def components(store: Store, edges: DataFrame, name: str = "cc") -> DataFrame:
    """(id, component_id) of every id in ``edges`` (a, b): the smallest id reachable, itself included.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until every edge points at the root of
    its star. Only per-key minima and equi-joins; each step is stored, so lineage stays short and nothing of
    the graph reaches the driver but two sums.
    """
    edge = store.put(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(),
        f"{name}0",
    )
    seen, i = None, 0
    while True:
        both = edge.select("v", "u").union(edge.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.join(low, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        # after the large step every pair is (v, u) with u < v
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = (
            large.join(low, "v")
            .select(F.explode(F.array(
                F.struct(F.col("v"), F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u"))
            )).alias("e")).select("e.v", "e.u").where("v <> u").distinct()
        )
        i += 1
        nxt = store.put(small, f"{name}{i}")
        now = nxt.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))
        ).first()
        store.drop(f"{name}{i - 1}")
        edge = nxt
        if tuple(now) == seen:
            break
        seen = tuple(now)
    return edge.groupBy("v").agg(F.min("u").alias("component_id")).select(F.col("v").alias("id"), "component_id")


# ---------------------------------------------------------------- token ids

_MARKS = ".,;:!?*%$#&|"
_SPACE = re.compile("[ \t\n\r]+")
#: Letters below this code point are composed already and are lower-cased alike everywhere.
_PLAIN = "\u0250"


def gathered(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs pool[start : start + size] one after another."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return pool[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)]


class _Codes(dict):
    """Numbers words in the order in which they are first asked for; ``new`` lists those since it was last emptied."""

    def __init__(self, words: Iterable[str] = ()):
        super().__init__((w, i) for i, w in enumerate(words))
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = code = len(self)
        self.new.append(word)
        return code


class WordEncoder:
    """Token ids of texts through the tokenizers library.

    With ``by_word`` the vocabulary must drop white space and never join across it (the 49k word vocabulary
    does); each distinct word is then encoded once and remembered. Of more than ``limit`` words the less used
    half is forgotten.
    """

    #: Characters that are split into words at a time.
    AT_ONCE = 3_000_000

    def __init__(self, path: str, by_word: bool = True, limit: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer, self.by_word, self.limit = Tokenizer.from_file(path), by_word, limit
        self.light = None
        if by_word:
            with open(path, encoding="utf-8") as f:
                model = json.load(f)["model"]
            suffix = model.get("end_of_word_suffix")
            if suffix:  # the same model without the steps that lower-case letters don't need
                merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
                self.light = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges, cache_capacity=0, end_of_word_suffix=suffix))
                self.light.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
                self.ends_word = np.zeros(max(model["vocab"].values()) + 1, bool)
                self.ends_word[[i for t, i in model["vocab"].items() if t.endswith(suffix)]] = True
        self._reset(_Codes(), np.zeros(0, "<u4"), np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0, "i8"))

    def _reset(self, known: _Codes, pool: np.ndarray, start: np.ndarray, size: np.ndarray, used: np.ndarray) -> None:
        """``known``: words and their codes; the ids of code c are pool[start[c] : start[c] + size[c]]."""
        self.known, self.pool, self.filled, self.start, self.size, self.used = known, pool, len(pool), start, size, used

    def _append(self, codes: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        end = self.filled + len(ids)
        if end > len(self.pool):
            self.pool = np.resize(self.pool, max(end, 2 * len(self.pool)))
        self.pool[self.filled : end] = ids
        self.start[codes] = self.filled + np.cumsum(sizes) - sizes
        self.size[codes] = sizes
        self.filled = end

    def _learn(self) -> None:
        """Encode new words. Letters and the marks after them are encoded apart, so a word is encoded once for
        all its endings; the vocabulary's own splitting parts them as well."""
        known = self.known
        new, at = known.new, len(known) - len(known.new)
        joined, letters, other = [], [], []
        for w in new:  # grows while parts of words are added
            core = w.rstrip(_MARKS)
            if core.isalpha() and (core.isascii() or max(core) < _PLAIN):
                low = core.lower()
                if low == w:
                    letters.append(at)
                elif low.isalpha():
                    joined.append((at, known[low], known[w[len(core) :]]))
                else:
                    other.append(at)
            else:
                other.append(at)
            at += 1
        first = at - len(new)
        if at > len(self.start):
            more = max(at, 2 * len(self.start)) - len(self.start)
            self.start, self.size, self.used = (np.concatenate([x, np.zeros(more, "i8")]) for x in (self.start, self.size, self.used))
        if not self.light:
            letters, other = [], sorted(letters + other)
        for i in range(0, len(letters), 100_000):
            self._encode_letters(letters[i : i + 100_000], new, first)
        self._encode_other(other, new, first)
        if joined:
            codes, low, tail = np.array(joined).T
            sizes = self.size[[low, tail]]
            order = np.array([low, tail]).T.ravel()
            self._append(codes, gathered(self.pool, self.start[order], self.size[order]), sizes.sum(0))
        new.clear()

    def _encode_letters(self, codes: list[int], new: list[str], first: int) -> None:
        """Words of lower-case letters: each ends with its one id that ends a word."""
        words = [new[c - first] for c in codes]
        found = self.light.encode_batch_fast([" ".join(words[i : i + 5000]) for i in range(0, len(words), 5000)], add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, "<u4") for e in found])
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) != len(codes):
            self._encode_other(codes, new, first)
        else:
            self._append(np.array(codes), ids, np.diff(ends, prepend=0))

    def _encode_other(self, codes: list[int], new: list[str], first: int) -> None:
        plain = []
        for c in codes:
            w = new[c - first]
            if "<|" in w or not w or w.isspace():
                ids = np.asarray(self.tokenizer.encode(w, add_special_tokens=False).ids, "<u4")
                self._append(np.array([c]), ids, np.array([len(ids)]))
            else:
                plain.append(c)
        for i in range(0, len(plain), 5000):
            part = [new[c - first] for c in plain[i : i + 5000]]
            found = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            begins = np.cumsum([0] + [len(w) + 1 for w in part])
            cuts = np.searchsorted(np.fromiter((o[0] for o in found.offsets), "i8"), begins)
            self._append(np.array(plain[i : i + 5000]), np.asarray(found.ids, "<u4"), np.diff(cuts))

    def _forget(self) -> None:
        n = len(self.known)
        keep = np.sort(np.argpartition(-self.used[:n], self.limit // 2)[: self.limit // 2])
        words = list(self.known)
        start, size, used = self.start[keep], self.size[keep], self.used[keep] // 2
        pool = gathered(self.pool, start, size)
        self._reset(_Codes([words[i] for i in keep.tolist()]), pool, np.cumsum(size) - size, size, used)

    def _parts(self, text: str) -> Iterator[str]:
        """A long text in parts that end at white space."""
        at = 0
        while len(text) - at > self.AT_ONCE:
            space = _SPACE.search(text, at + self.AT_ONCE)
            if not space:
                break
            yield text[at : space.start()]
            at = space.end()
        yield text[at:] if at else text

    def encode(self, texts: Sequence[str | None], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, stops): all texts' ids (unsigned 32-bit), each text's followed by ``end`` if given, and where each text's stop."""
        tail = np.array([] if end is None else [end], "<u4")
        if not self.by_word:
            found = self.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
            parts = [x for e in found for x in (np.asarray(e.ids, "<u4"), tail)]
            return np.concatenate(parts) if parts else tail[:0], np.cumsum([len(e.ids) + len(tail) for e in found]).astype("i8")
        out, totals = [], np.full(len(texts), len(tail), "i8")
        parts: list[str] = []
        owners: list[int] = []  # the text of each part
        chars = 0
        for i, text in enumerate(texts):
            for part in self._parts(text) if text else ():
                parts.append(part)
                owners.append(i)
                chars += len(part)
                if chars > self.AT_ONCE:
                    out.append(self._encoded(parts, owners, totals))
                    parts, owners, chars = [], [], 0
        out.append(self._encoded(parts, owners, totals))
        ids, stops = np.concatenate(out), np.cumsum(totals)
        if len(tail):
            ids = np.insert(ids, stops - np.arange(1, len(stops) + 1), end)
        return ids, stops

    def _encoded(self, parts: list[str], owners: list[int], totals: np.ndarray) -> np.ndarray:
        """The ids of ``parts``; adds how many each owner has of them to ``totals``."""
        if not parts:
            return np.zeros(0, "<u4")
        # only plain spaces part words here; what other white space a word holds, the library drops
        split = pc.split_pattern(pa.array([p.replace("\n", " ").replace("\t", " ").replace("\r", " ") for p in parts], pa.string()), " ")
        coded = split.values.dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # much faster than to_pylist
        codes = np.fromiter(map(self.known.__getitem__, words), "i8", len(words))
        if self.known.new:
            self._learn()
        at = coded.indices.to_numpy()
        self.used[codes] += np.bincount(at, minlength=len(words))
        codes = codes[at]
        sizes = self.size[codes]
        before = np.concatenate([[0], np.cumsum(sizes)])[split.offsets.to_numpy()]
        np.add.at(totals, owners, np.diff(before))
        ids = gathered(self.pool, self.start[codes], sizes)
        if len(self.known) > self.limit:
            self._forget()
        return ids


def binaries(ids: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> pa.Array:
    """The runs ids[start : stop] as little-endian unsigned 32-bit bytes; runs follow one another without gaps."""
    if not len(starts):
        return pa.array([], pa.binary())
    offsets = np.concatenate([starts[:1], stops]) * 4
    if offsets[-1] >= 2**31:
        return pa.array([ids[a:b].tobytes() for a, b in zip(starts.tolist(), stops.tolist(), strict=True)], pa.binary())
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.astype("<i4")), pa.py_buffer(np.ascontiguousarray(ids, "<u4"))])


def slices(batches: Iterator[pa.RecordBatch], size: int = 256) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that what a task holds at a time stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(col, upper, upper.lower())


_ENCODERS: dict[tuple[str, bool], WordEncoder] = {}


def encoder(path: str, by_word: bool = True) -> WordEncoder:
    """The encoder of this worker process; what it remembers lasts from task to task."""
    if (path, by_word) not in _ENCODERS:
        _ENCODERS[path, by_word] = WordEncoder(path, by_word)
    return _ENCODERS[path, by_word]
