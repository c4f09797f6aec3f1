"""Benchmark decontamination with a positional inverted index. Native column expressions only.

A benchmark item is cut into windows of consecutive words. Two anchors of each window, its rarest words in the
corpus, are looked up in the index: postings (term, doc_id, pos) of the words that some window has as an
anchor. The rarer anchor's postings, moved by its offset in the window, give where the window would begin;
the other anchor's must agree exactly (phrase) or within a slop (proximity). Phrases are then held against
the document's words, so every match is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Store, ascii_lower

#: Words: runs of these characters after A-Z are in lower case.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Tables of up to this many rows (words of the benchmark, ids of candidates) are sent to every executor.
SENT_ROWS = 1_000_000


def words(text: Column) -> Column:
    """The words of a text, in order; none of null."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_id, window, words): each run of ``size`` words; a shorter item that has words is one window."""
    w = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - size + 1))
    return w.select("item_id", F.explode(at).alias("at"), "w").select(
        "item_id", F.slice("w", F.col("at"), F.least(F.lit(size), F.size("w"))).alias("words")
    ).select("item_id", F.xxhash64("words").alias("window"), "words")


def _sent(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SENT_ROWS else df


def index(store: Store, docs: DataFrame, phrases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings, anchors): the stored index, and phrases (window, words) with their two rarest words.

    postings: term, doc_id, row, pos (from 1) of every anchor in every document; the row without a term gives
    the document's number of words as pos. anchors: window, words, size, t1, o1, t2, o2 (offsets from 1; t2 is
    null for one word), without the phrases that hold a word the corpus doesn't have.
    """
    terms = store.put(phrases.select(F.explode("words").alias("term")).distinct(), "terms")
    n_terms = terms.count()
    found = docs.select(F.explode(words(F.col("text"))).alias("term")).join(_sent(terms, n_terms), "term")
    counts = store.put(found.groupBy("term").agg(F.count(F.lit(1)).alias("n")), "counts")
    spots = phrases.select("window", F.size("words").alias("size"), F.posexplode("words").alias("o", "term"))
    spots = spots.join(_sent(counts, n_terms), "term")
    rarest = F.array_sort(F.collect_list(F.struct("n", "o", "term")))
    anchors = spots.groupBy("window", "size").agg(rarest.alias("r")).where("size(r) = size")  # at most a window's words
    anchors = store.put(anchors.join(phrases, "window").select(
        "window", "words", "size", F.col("r")[0]["term"].alias("t1"), (F.col("r")[0]["o"] + 1).alias("o1"),
        F.when(F.col("size") > 1, F.get("r", F.lit(1))["term"]).alias("t2"), (F.get("r", F.lit(1))["o"] + 1).alias("o2"),
    ), "anchors")
    wanted = store.put(
        anchors.select("t1").union(anchors.where("t2 is not null").select("t2")).distinct().select(F.col("t1").alias("term"), F.lit(True).alias("hit")),
        "wanted",
    )
    # the last element of each document, which can't be a word, says how many words it has
    listed = F.array_append(words(F.col("text")), F.lit("#"))
    spread = docs.select("doc_id", "row", F.posexplode(listed).alias("pos", "term"))
    postings = spread.join(_sent(wanted, n_terms), "term", "left").where("hit or term = '#'").select(
        F.when(F.col("hit"), F.col("term")).alias("term"), "doc_id", "row", F.when(F.col("hit"), F.col("pos") + 1).otherwise(F.col("pos")).alias("pos")
    )
    return store.put(postings, "postings"), anchors


def candidates(postings: DataFrame, anchors: DataFrame, slop: int = 0) -> DataFrame:
    """(window, row, start, gap): the rarest word's list moved by its offset and met by the second rarest's.

    gap 0: the two words stand exactly as in the window; up to ``slop``: within so many words of it.
    """
    p = postings.where("term is not null")
    first = anchors.join(p, anchors.t1 == p.term).select(
        "window", "t2", F.col("o2"), "row", (F.col("pos") - F.col("o1") + 1).alias("start")
    )
    if not slop:
        first = first.where("start >= 1")
    one = first.where("t2 is null").select("window", "row", "start", F.lit(0).alias("gap"))
    wanted = first.where("t2 is not null").select(
        "window", "t2", "row", "start", F.explode(F.sequence(F.lit(-slop), F.lit(slop))).alias("gap"), "o2"
    ).withColumn("at", F.col("start") + F.col("o2") - 1 + F.col("gap"))
    second = p.select(F.col("term").alias("t2"), F.col("row"), F.col("pos").alias("at"))
    return one.union(wanted.join(second, ["t2", "row", "at"]).select("window", "row", "start", F.abs("gap").alias("gap")))


def matches(docs: DataFrame, items: DataFrame, size: int = WINDOW, slop: int = 0, store: Store | None = None) -> DataFrame:
    """(doc_id, row, n_words, hits) of ``docs`` (doc_id, text, more); hits: array of (window, start, size, kind).

    kind is "phrase" (the window's words stand at start, exactly) or, with a ``slop``, "proximity" (its two
    rarest words within so many words of their places). start counts words from 1.
    """
    store = store or Store(docs.sparkSession, "decontaminate")
    # a row is known by its content, the same in every scan however the input is split
    docs = docs.select("doc_id", "text", F.struct(F.xxhash64("doc_id", "text").alias("row"), F.xxhash64("text", "doc_id", F.lit(1)).alias("row2")).alias("row"))
    phrases = store.put(windows(items, size).groupBy("window").agg(F.first("words").alias("words")), "phrases")
    postings, anchors = index(store, docs, phrases)
    near = store.put(
        candidates(postings, anchors, slop).groupBy("window", "row", "start").agg(F.min("gap").alias("gap")), "near"
    )
    rows = store.put(near.select("row").distinct(), "rows")
    some = docs.join(_sent(rows, rows.count()), "row", "left_semi")
    sized = near.join(anchors.select("window", "words", "size"), "window")
    # the words of a document that candidates point at: one run for each start and size, however many windows do
    spots = sized.select("row", "start", "size").distinct().groupBy("row").agg(F.collect_list(F.struct("start", "size")).alias("c"))
    runs = some.select("row", words(F.col("text")).alias("d")).join(spots, "row").select("row", F.explode(
        F.transform("c", lambda x: F.struct(x.start.alias("start"), x["size"].alias("size"), F.slice(F.col("d"), F.greatest(x.start, F.lit(1)), x["size"]).alias("w")))
    ).alias("x")).select("row", "x.*").dropDuplicates(["row", "start", "size"])
    kind = F.when((F.col("gap") == 0) & (F.col("start") >= 1) & (F.col("w") == F.col("words")), "phrase").when(F.lit(slop > 0), "proximity")
    held = sized.join(runs, ["row", "start", "size"]).withColumn("kind", kind).where("kind is not null").groupBy("row").agg(
        F.collect_list(F.struct("window", "start", "size", "kind")).alias("hits")  # phrases: at most one for each word and size
    )
    every = postings.where("term is null").select("doc_id", "row", F.col("pos").cast("long").alias("n_words"))
    return every.join(held, "row", "left")


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, keep_row: bool = False) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, item_ids, contaminated) of ``docs`` (doc_id, text, more).

    n_hit: words inside any occurrence of a window of ``items`` (item_id, text, more); item_ids: the items with
    one, as strings in order. Null and empty texts have no words and no hits; empty items have no window; a
    repeated row is judged as often as it stands; no rows give no rows. With ``keep_row`` also row (row, row2), two
    hashes of doc_id and text by which rows are told apart, whatever their ids.
    """
    store = Store(docs.sparkSession, "decontaminate")
    found = store.put(matches(docs, items, size, store=store), "found")
    of_item = store.put(windows(items, size).select("window", F.col("item_id").cast("string").alias("item")).distinct(), "items")
    # windows that begin at one word are one; a document has at most as many as words
    hits = found.where("hits is not null").select("row", F.explode("hits").alias("h")).where("h.kind = 'phrase'")
    # (repeated rows are one here and get the same counts below)
    covered = hits.groupBy("row", F.col("h.start").alias("start")).agg(F.max("h.size").alias("size"))
    so_far = Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    stop = F.col("start") + F.col("size")
    new = stop - F.greatest(F.col("start"), F.least(stop, F.coalesce(F.max(stop).over(so_far), F.lit(0))))
    counts = covered.withColumn("new", new).groupBy("row").agg(F.sum("new").alias("n_hit"))
    named = hits.select("row", F.col("h.window").alias("window")).distinct().join(of_item, "window").groupBy("row").agg(
        F.array_sort(F.collect_set("item")).alias("item_ids")
    )
    out = store.put(
        found.select("doc_id", "row", "n_words").join(counts, "row", "left").join(named, "row", "left").select(
            "doc_id", *(["row"] if keep_row else []), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
            F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
            (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        ), "result",
    )
    store.drop("terms", "counts", "phrases", "anchors", "wanted", "postings", "near", "rows", "found", "items")
    return out
