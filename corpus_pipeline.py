"""The corpus pipeline: documents judged, deduplicated, decontaminated, cleaned of secrets and packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the
next one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlsight.llm import decontaminate, jaccard, packing, quality, secrets
from crawlsight.llm.common import Store
from crawlsight.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Rows of up to this many documents (16 bytes each) are sent to every executor.
SENT_ROWS = 1_000_000
#: A row is known by two 64-bit hashes of its id and text, the same in every scan; only exact repeats share them.
ROW = ("row", "row2")


def _known(docs: DataFrame) -> DataFrame:
    """``docs`` with ROW, which tells apart null and repeated ids with different texts."""
    return docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("row"), F.xxhash64("text", "doc_id", F.lit(1)).alias("row2"))


def _without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``docs`` and ROW but for ``rows``, a stored table; the texts stay where they are if these are few."""
    return _known(docs).join(F.broadcast(rows) if rows.count() <= SENT_ROWS else rows, list(ROW), "left_anti")


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are judged good and not toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.judge(docs, labels, keep=COLUMNS).where("kept").select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group that five-word shingles link at 0.8.

    Null ids come last. Exact repeats, of id and text, are one; other documents under one id are documents each.
    """
    store = Store(spark, "copies")
    # the join tells rows apart by themselves, so its ids only need to be there
    rows = _known(docs).select(F.coalesce("doc_id", "row").alias("doc_id"), "text", *ROW, F.col("doc_id").alias("own"))
    groups = jaccard.similar(rows, n=5, num=80, keep=(*ROW, "own"), group=True)
    ids = store.put(groups.groupBy("group", "own", *ROW).agg(F.count(F.lit(1)).alias("rows")), "groups")
    first = ids.where("group is not null").groupBy("group").agg(F.min(F.struct(F.col("own").isNull().alias("none"), "own", *ROW)).alias("f"))
    copies = store.put(ids.where("group is not null").select(*ROW).join(first.select("f.row", "f.row2"), list(ROW), "left_anti"), "rows")
    # exact repeats, of id and text, are one; few rows have any
    repeated = store.put(ids.where("rows > 1").select(*ROW), "repeated")
    few = F.broadcast(repeated) if repeated.count() <= SENT_ROWS else repeated
    kept = _without(docs, copies)
    once = kept.join(few, list(ROW), "left_semi").dropDuplicates(list(ROW))
    return kept.join(few, list(ROW), "left_anti").union(once).select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a run of ten words of a benchmark item."""
    found = decontaminate.contamination(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep_row=True)
    leaks = found.where("contaminated").select("row.*").distinct()
    return _without(docs, Store(spark, "leaks").put(leaks, "rows")).select(*COLUMNS)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by the name of its kind."""
    _, ledger = secrets.scan(docs.select("doc_id", "text"))
    hits = Store(spark, "redactions").put(ledger.where(F.size("findings") > 0).select("blob", "findings"), "hits")
    few = hits.count() <= SENT_ROWS // 10
    text = secrets.redact(F.col("text"), F.coalesce("findings", F.array().cast(secrets.FINDINGS)))
    return (
        docs.select(*COLUMNS, secrets.address(F.coalesce("text", F.lit(""))).alias("blob"))
        .join(F.broadcast(hits) if few else hits, "blob", "left")
        .withColumn("text", text)
        .withColumn("n_chars", F.when(F.size("findings") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
        .select(*COLUMNS)
    )


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids in sequences of 4096."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality classifier", good_documents),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", decontaminated),
    ("secret scans", without_secrets),
    ("best-fit packing", packed),
]

#: Token ids, shingle components and a fitted classifier are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    store = Store(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for i, (_, stage) in enumerate(STAGES):
        docs = store.put(stage(spark, docs, sf_dir), str(i))
    return docs
