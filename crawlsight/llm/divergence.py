"""How far the vocabulary of each source lies from that of the others and of its language.

The kept terms of a language are sorted and cut into ranges of ``RANGE`` terms; each range is a minimal acyclic
transducer whose ordinals, with those of the ranges before it, number the terms of the language in their order. A
second pass over the texts sends each block's distinct words, with their counts per source, to the range that they
fall in, where they run through its transducer; words that it doesn't know end there. All that follows works on
ordinals: counts per range are small matrices of sources and terms, and ordinals break ties. Only the terms that are
reported are spelled again.

The driver holds one row per range (a term and two numbers) and one number per (lang, source) group. The result itself
has a row for each pair of sources, so the groups are few next to it.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Store
from .texts import letter_terms, one_array, text_blocks
from .transducer import Transducer

RANGE, BLOCK = 4096, 16_000_000
#: Blocks whose words meet in one task; sources of a language that are compared at a time.
TOGETHER, SOURCES = 64, 256
LEAST_DOCS, SCALE, TOP = 3, 1_000_000_000, 200

_RANGES = "lang string, first string, n_terms long, transducer binary"
_WORDS = "range int, part long, words array<binary>, sources array<string>, word binary, source binary, n binary"
_COUNTS = "range int, part long, lang string, sources array<string>, source binary, ordinal binary, n binary"
_VALUES = "lang string, a int, b int, ordinal long, value long"


def _document_counts(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """(lang, term, docs): in how many documents of a language each term stands, block by block."""
    for _, rows in text_blocks(batches, "text", block):
        terms, doc = letter_terms(one_array(rows["text"]))
        coded = terms.dictionary_encode()
        lang = one_array(rows["lang"]).dictionary_encode()
        n = len(coded.dictionary)
        once = np.unique(doc * n + coded.indices.to_numpy())
        pair, docs = np.unique(lang.indices.to_numpy().astype("i8")[once // max(n, 1)] * n + once % max(n, 1), return_counts=True)
        yield pa.RecordBatch.from_arrays([
            lang.dictionary.take(pa.array(pair // max(n, 1))), coded.dictionary.take(pa.array(pair % max(n, 1))).cast(pa.string()), pa.array(docs),
        ], names=["lang", "term", "docs"])


def _transducers(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Sorted (lang, term) rows as transducers of up to ``size`` terms of one language."""
    lang, terms = None, []

    def made() -> pa.RecordBatch:
        packed = Transducer.build(t.encode() for t in terms).pack()
        return pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([terms[0]]), pa.array([len(terms)]), pa.array([packed], pa.binary())], names=["lang", "first", "n_terms", "transducer"])

    for batch in batches:
        for k, t in zip(batch["lang"].to_pylist(), batch["term"].to_pylist(), strict=True):
            if terms and (k != lang or len(terms) == size):
                yield made()
                terms = []
            lang = k
            terms.append(t)
    if terms:
        yield made()


def _probability(count: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / (total + terms)), exactly."""
    count = count.astype(object) if count.size and count.max() >= 2**63 // SCALE - 1 else count
    return (1 + SCALE * (count + 1) // (total + terms)).astype("i8")


def _excess(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q); p and q are at most SCALE + 1, so the square fits."""
    d = p - q
    return d * d // q


def divergence(
    docs: DataFrame, store: Store | None = None, size: int = RANGE, block: int = BLOCK, together: int = TOGETHER, at_once: int = SOURCES
) -> DataFrame:
    """Compare the sources of each language of ``docs`` (text, lang, source, more; further columns are not read).

    Null text, lang and source are empty. Terms are maximal runs of letters (A-Z lower-cased, all characters beyond
    ASCII); a language keeps those in at least ``LEAST_DOCS`` of its documents. Returns lang, source, part, item, value,
    rank: part ``pair`` has every other source of the language, part ``term`` the TOP terms that the source uses more
    often than its language does. Ranks go by value, then by item in UTF-8 order. Repeated rows count each; a language
    with one source has no pairs, one without kept terms pairs of value 0; no rows give no rows. ``size`` (terms of a
    range), ``block`` (bytes of text), ``together`` (parts that meet, 2 at least) and ``at_once`` (sources) shape the work, not the result.
    """
    spark = docs.sparkSession
    store = store or Store(spark, "divergence")
    texts = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")))
    found = texts.select("text", "lang").mapInArrow(lambda b: _document_counts(b, block), "lang string, term string, docs long")
    kept = store.put(found.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= LEAST_DOCS).select("lang", "term"), "kept")
    tasks = max(1, kept.count() // (2 * size))
    ranges = store.put(kept.repartitionByRange(tasks, "lang", "term").sortWithinPartitions("lang", "term").mapInArrow(lambda b: _transducers(b, size), _RANGES), "ranges")
    groups = store.put(texts.groupBy("lang", "source").count().select("lang", "source"), "groups")

    index = sorted(ranges.select("lang", "first", "n_terms").collect(), key=lambda r: (r[0].encode(), r[1].encode()))
    lang_of, n_of = [r[0] for r in index], [r[2] for r in index]
    starts: dict[str, tuple[int, list[bytes]]] = {}  # the first range of each language, and where its ranges begin
    terms: dict[str, int] = {}
    offset = []  # the ordinal of each range's first term
    for i, (lang, first, n) in enumerate(index):
        starts.setdefault(lang, (i, []))[1].append(first.encode())
        offset.append(terms.get(lang, 0))
        terms[lang] = offset[-1] + n
    numbered = {(r[0], r[1]): i for i, r in enumerate(index)}

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The distinct words of each block, with their counts per source, for the ranges they fall in."""
        part = TaskContext.get().partitionId() // together
        for _, rows in text_blocks(batches, "text", block):
            words, doc = letter_terms(one_array(rows["text"]))
            coded = words.dictionary_encode()
            of_doc = [x.dictionary_encode() for x in (one_array(rows["lang"]), one_array(rows["source"]))]
            lang, source = (x.indices.to_numpy().astype("i8")[doc] for x in of_doc)
            spelled, n_words, n_sources = coded.dictionary.to_pylist(), len(coded.dictionary), len(of_doc[1].dictionary)
            key, count = np.unique((lang * n_words + coded.indices.to_numpy()) * n_sources + source, return_counts=True)
            source, key = key % max(n_sources, 1), key // max(n_sources, 1)
            both, at = np.unique(key, return_inverse=True)  # the words of each language
            to = np.full(len(both), -1, "i8")
            for k, name in enumerate(of_doc[0].dictionary.to_pylist()):
                mine = slice(*np.searchsorted(both, (k * n_words, (k + 1) * n_words)))
                if name in starts:
                    first, begins = starts[name]
                    if len(begins) == 1:
                        to[mine] = first
                    else:  # words before the first range begins are in none
                        to[mine] = [first + i if i >= 0 else -1 for i in (bisect_right(begins, spelled[w]) - 1 for w in (both[mine] % n_words).tolist())]
            order = np.argsort(to[at], kind="stable")
            cuts = np.append(np.flatnonzero(np.diff(to[at][order], prepend=-2)), len(order)).tolist()
            out = []
            for a, b in pairwise(cuts):
                rows_, r = order[a:b], int(to[at[order[a]]])
                if r >= 0:
                    w, wi = np.unique(at[rows_], return_inverse=True)
                    s, si = np.unique(source[rows_], return_inverse=True)
                    out.append((r, [spelled[j] for j in (both[w] % n_words).tolist()], of_doc[1].dictionary.take(pa.array(s)).to_pylist(),
                                wi.astype("<u4").tobytes(), si.astype("<u4").tobytes(), count[rows_].astype("<i8").tobytes()))
            if out:
                r, w, s, *packed = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([
                    pa.array(r, pa.int32()), pa.array([part] * len(r)), pa.array(w, pa.list_(pa.binary())), pa.array(s, pa.list_(pa.string())), *(pa.array(x, pa.binary()) for x in packed),
                ], names=["range", "part", "words", "sources", "word", "source", "n"])

    def counted(r: int, part: int, rows: list[tuple[list[str], np.ndarray, np.ndarray, np.ndarray]]) -> pa.Table:
        """One row of a range's counts from several of (sources, source, ordinal, n)."""
        names: dict[str, int] = {}
        cells = [np.array([names.setdefault(s, len(names)) for s in sources], "i8")[source] * size + ordinal for sources, source, ordinal, _ in rows]
        cell, at = np.unique(np.concatenate(cells), return_inverse=True)
        sums = np.bincount(at, np.concatenate([x[3] for x in rows]), len(cell)).astype("<i8")
        return pa.table([
            pa.array([r], pa.int32()), pa.array([part]), pa.array([lang_of[r]]), pa.array([list(names)], pa.list_(pa.string())),
            *(pa.array([x.tobytes()], pa.binary()) for x in ((cell // size).astype("<u4"), (cell % size).astype("<u4"), sums)),
        ], names=["range", "part", "lang", "sources", "source", "ordinal", "n"])

    def recount(words: pa.Table, ranges_: pa.Table) -> pa.Table:
        """Counts of a range's terms per source, over the blocks of one part: the blocks' words run through the transducer."""
        automaton, rows = Transducer.unpack(ranges_["transducer"][0].as_py()), []
        for row in words.to_pylist():
            ends = np.cumsum([len(w) for w in row["words"]])
            spelled = np.frombuffer(b"".join(row["words"]), "u1")
            ordinal = automaton.ordinals(spelled, np.concatenate([[0], ends[:-1]]), ends)[np.frombuffer(row["word"], "<u4")]
            hit = ordinal >= 0
            rows.append((row["sources"], np.frombuffer(row["source"], "<u4")[hit], ordinal[hit], np.frombuffer(row["n"], "<i8")[hit]))
        return counted(words["range"][0].as_py(), words["part"][0].as_py(), rows)

    def merged(table: pa.Table) -> pa.Table:
        rows = [(x["sources"], np.frombuffer(x["source"], "<u4"), np.frombuffer(x["ordinal"], "<u4").astype("i8"), np.frombuffer(x["n"], "<i8")) for x in table.to_pylist()]
        return counted(table["range"][0].as_py(), table["part"][0].as_py(), rows)

    def with_number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            no = [numbered[x] for x in zip(b["lang"].to_pylist(), b["first"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(no, pa.int32()), b["transducer"]], names=["range", "transducer"])

    words = texts.mapInArrow(dealt, _WORDS)
    automata = ranges.mapInArrow(with_number, "range int, transducer binary")
    # a range's automaton goes to each part of its blocks
    sent = store.put(words, "words")
    asked = sent.select("range", F.col("part").alias("of_part")).distinct().join(automata, "range").withColumnRenamed("range", "of_range")
    counts = store.put(sent.groupBy("range", "part").cogroup(asked.groupBy("of_range", "of_part")).applyInArrow(recount, _COUNTS), "counts")
    parts, step = (sent.agg(F.max("part")).first()[0] or 0) + 1, 0
    while parts > 1:  # together rows of a range become one, until each range has one
        step, parts = step + 1, -(-parts // together)
        counts = store.put(counts.withColumn("part", F.floor(F.col("part") / together)).groupBy("range", "part").applyInArrow(merged, _COUNTS), f"counts{step}")

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                n = np.bincount(np.frombuffer(row["source"], "<u4"), np.frombuffer(row["n"], "<i8"), len(row["sources"])).astype("i8")
                yield pa.RecordBatch.from_arrays([pa.array([row["lang"]] * len(n), pa.string()), pa.array(row["sources"], pa.string()), pa.array(n)], names=["lang", "source", "n"])

    by_source = counts.mapInArrow(totals, "lang string, source string, n long").groupBy("lang", "source").agg(F.sum("n").alias("n"))
    every = groups.join(by_source, ["lang", "source"], "left").select(
        "lang", "source", F.coalesce("n", F.lit(0)).alias("n"), (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("no")
    )
    every = store.put(every, "sources")
    sizes: dict[str, np.ndarray] = {}  # the counts of each language's groups, by number
    for lang, found_ in every.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("no", "n"))).alias("x")).collect():
        sizes[lang] = np.array([n for _, n in found_], "i8")

    packed = "range int, a int, b int, lang string, number binary, ordinal binary, n binary, all binary"

    def by_number(table: pa.Table, sources: pa.Table) -> pa.Table:
        """A range's counts by source number, cut into blocks of sources, for each pair of blocks; and the language's own counts."""
        no = dict(zip(sources["source"].to_pylist(), sources["no"].to_pylist(), strict=True))
        number, ordinal, n = [], [], []
        for row in table.to_pylist():
            number.append(np.array([no[s] for s in row["sources"]], "i8")[np.frombuffer(row["source"], "<u4")])
            ordinal.append(np.frombuffer(row["ordinal"], "<u4"))
            n.append(np.frombuffer(row["n"], "<i8"))
        number, ordinal, n = (np.concatenate(x) for x in (number, ordinal, n))
        r = table["range"][0].as_py()
        whole = np.bincount(ordinal, n, n_of[r]).astype("<i8").tobytes()
        blocks = -(-len(sizes[lang_of[r]]) // at_once)
        out = []
        for x in range(blocks):
            mine = number // at_once == x
            for y in range(blocks):
                out.append((r, min(x, y), max(x, y), lang_of[r], *(z[mine].astype(t).tobytes() for z, t in ((number, "<u4"), (ordinal, "<u4"), (n, "<i8"))), whole))
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[f.split()[0] for f in packed.split(", ")])

    def values(table: pa.Table) -> pa.Table:
        """Of one range and two blocks of sources: the sums for each pair, ordinal null, and the best terms of each source, b null."""
        rows = table.to_pylist()
        lang, r = rows[0]["lang"], rows[0]["range"]
        x, y, total, size = rows[0]["a"], rows[0]["b"], terms[lang], sizes[lang]
        number, ordinal, n = (np.concatenate([np.frombuffer(row[c], t) for row in rows]) for c, t in (("number", "<u4"), ("ordinal", "<u4"), ("n", "<i8")))
        matrix: dict[int, np.ndarray] = {}
        order = np.argsort(number, kind="stable")
        used, at = np.unique(number[order], return_index=True)
        for k, (i, j) in zip(used.tolist(), pairwise(np.append(at, len(order)).tolist()), strict=True):
            matrix[k] = np.bincount(ordinal[order[i:j]], n[order[i:j]], n_of[r]).astype("i8")
        none = np.zeros(n_of[r], "i8")
        mine = {k: range(k * at_once, min((k + 1) * at_once, len(size))) for k in {x, y}}
        p = {i: _probability(matrix.get(i, none), int(size[i]), total) for k in mine for i in mine[k]}
        a, b, where, value = [], [], [], []
        for k, l in {(x, y), (y, x)}:
            others = np.array([p[j] for j in mine[l]])
            for i in mine[k]:
                sums = _excess(p[i], others).sum(1)
                for j, s in zip(mine[l], sums.tolist(), strict=True):
                    if i != j:
                        a.append(i), b.append(j), where.append(None), value.append(s)
        if x == y:
            q = _probability(np.frombuffer(rows[0]["all"], "<i8"), int(size.sum()), total)
            for i in matrix:
                if i // at_once == x:
                    best = np.flatnonzero((matrix[i] > 0) & (p[i] > q))
                    f = _excess(p[i][best], q[best])
                    top = np.lexsort((best, -f))[:TOP]
                    a.extend([i] * len(top)), b.extend([None] * len(top)), where.extend((best[top] + offset[r]).tolist()), value.extend(f[top].tolist())
        return pa.table([pa.array([lang] * len(a), pa.string()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(where, pa.int64()), pa.array(value, pa.int64())], names=["lang", "a", "b", "ordinal", "value"])

    def spell(rows: pa.Table, ranges_: pa.Table) -> pa.Table:
        automaton, r = Transducer.unpack(ranges_["transducer"][0].as_py()), rows["range"][0].as_py()
        items = [automaton.term(o - offset[r]).decode() for o in rows["ordinal"].to_pylist()]
        return pa.table([rows["lang"], rows["no"], pa.array(items, pa.string()), rows["value"], rows["rank"]], names=["lang", "no", "item", "value", "rank"])

    # a range's rows are few (one per part of the blocks); its sources come along with them
    meta = counts.select(F.col("range").alias("of_range"), "lang").distinct().join(every.select("lang", "source", "no"), "lang").select("of_range", "source", "no")
    numbers = counts.groupBy("range").cogroup(meta.groupBy("of_range")).applyInArrow(by_number, packed)
    value = store.put(numbers.groupBy("range", "a", "b").applyInArrow(values, _VALUES), "values")

    name = every.select("lang", "source", F.col("no").alias("a"))
    other = every.select("lang", F.col("source").alias("item"), F.col("no").alias("b"))
    summed = value.where("b is not null").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    pairs = name.join(other, "lang").where("a <> b").join(summed, ["lang", "a", "b"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    of_group = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(of_group))

    best = Window.partitionBy("lang", "no").orderBy(F.desc("value"), "ordinal")
    top = value.where("ordinal is not null").select("lang", F.col("a").alias("no"), "ordinal", "value").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= TOP)
    begins = {lang: np.array(offset[first : first + len(b)]) for lang, (first, b) in starts.items()}

    def with_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = [starts[k][0] + int(np.searchsorted(begins[k], o, side="right")) - 1 for k, o in zip(b["lang"].to_pylist(), b["ordinal"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(r, pa.int32())], names=[*b.schema.names, "range"])

    placed = top.mapInArrow(with_range, "lang string, no int, ordinal long, value long, rank int, range int")
    used = placed.select(F.col("range").alias("of_range")).distinct().join(automata.withColumnRenamed("range", "of_range"), "of_range")
    spelled = placed.groupBy("range").cogroup(used.groupBy("of_range")).applyInArrow(spell, "lang string, no int, item string, value long, rank int")
    named = spelled.join(every.select("lang", "source", "no"), ["lang", "no"]).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.union(named)
