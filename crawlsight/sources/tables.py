"""Reading and writing the library's tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


CRAWL = (
    "target string, startedAt string, completedAt string, warnings array<string>, pages array<struct<id:string,url:string,status:int,title:string,description:string,"
    "canonicalUrl:string,headings:array<struct<level:int,text:string>>,text:string,links:array<string>,jsonLd:array<variant>,fingerprint:string,contentType:string,duplicateOf:string>>, "
    "crawlEdges array<struct<from:string,to:string>>, failures array<struct<url:string,error:string>>, _corrupt_record string"
)


def read_crawl_json(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Crawl documents, one JSON document a site (or a line each), as tables: runs, pages, edges, failures, rejected.

    What a document leaves out is null, an absent list gives no rows. A file that isn't such a document is in rejected,
    with its text, and in no other table.
    """
    read = spark.read.schema(CRAWL).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
    docs = read.json(path)
    good = docs.where("_corrupt_record IS NULL AND target IS NOT NULL")
    each = lambda name, *cols: good.select("target", F.explode(name).alias("x")).select("target", *cols)
    return {
        "runs": good.select("target", F.col("startedAt").alias("started_at"), F.col("completedAt").alias("completed_at"), "warnings"),
        "pages": each(
            "pages", F.col("x.id").alias("page_id"), F.col("x.url").alias("url"), F.coalesce("x.status", F.lit(0)).alias("status"), F.coalesce("x.title", F.lit("")).alias("title"),
            F.coalesce("x.description", F.lit("")).alias("description"), F.coalesce("x.canonicalUrl", F.lit("")).alias("canonical"), F.col("x.headings").alias("headings"),
            F.coalesce("x.text", F.lit("")).alias("text"), F.col("x.links").alias("links"), F.to_json("x.jsonLd").alias("jsonld"), F.col("x.fingerprint").alias("fingerprint"),
            F.col("x.contentType").alias("content_type"), F.col("x.duplicateOf").alias("duplicate_of"),
        ),
        "edges": each("crawlEdges", F.col("x.from").alias("source"), F.col("x.to").alias("target_url")),
        "failures": each("failures", F.col("x.url").alias("url"), F.col("x.error").alias("error")),
        "rejected": docs.where("_corrupt_record IS NOT NULL OR target IS NULL").select("_corrupt_record"),
    }


class Stored:
    """Tables of one run in the folder that all executors share: each cuts the lineage and survives a lost executor."""

    def __init__(self, spark: SparkSession, name: str):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:  # tests and single machines only
            if not spark.conf.get("spark.master", "").startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = tempfile.mkdtemp(prefix="spark-crawlsight-")
            spark.conf.set("spark.checkpoint.dir", base)
        self.spark, self.base = spark, f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{self.base}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.base}/{name}")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the folder that all executors share and read again, for what several readers need."""
    return Stored(df.sparkSession, name).put(df, "rows")


RESPONSE = {"page_id": "long", "url": "string", "final_url": "string", "status": "int", "ms": "double", "bytes": "long", "content_type": "string", "x_robots_tag": "string", "headers": "map<string,string>", "html": "string"}


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Raw pages as ``RESPONSE`` says, from Parquet that has page_id, url and html at least.

    What a table lacks is null, but the final address is then the address; content type and robots tag are taken from the
    headers, whose names count in any case, where they have no column of their own.
    """
    found = spark.read.parquet(path)
    has = set(found.columns)
    rows = found.select(*((F.col(c) if c in has else F.lit(None)).cast(t).alias(c) for c, t in RESPONSE.items()))
    header = lambda name: F.get(F.filter(F.map_entries("headers"), lambda e: F.lower(e.key) == name), F.lit(0)).getField("value")
    return rows.withColumns({
        "final_url": F.coalesce("final_url", "url"), "content_type": F.coalesce("content_type", header("content-type")), "x_robots_tag": F.coalesce("x_robots_tag", header("x-robots-tag")),
        "bytes": F.coalesce("bytes", F.octet_length("html").cast("long")),
    })


def write_snapshot(df: DataFrame, path: str) -> None:
    """A run's rows below its snapshot_id. A run that is written again replaces itself; other runs stay as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_id").parquet(path)


def merged_history(old: DataFrame, new: DataFrame, keep: int = 60) -> DataFrame:
    """Both histories (id, host, completed_at, status, more): new rows replace old ones by id, failed runs go, newest ``keep`` per host stay."""
    rows = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1))).where("status <> 'failed'")
    last = rows.withColumn("_i", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("_new"), F.desc("completed_at")))).where("_i = 1")
    order = Window.partitionBy("host").orderBy(F.desc("completed_at"), "id")
    return last.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= keep).drop("_i", "_n", "_new")


def history_diff(history: DataFrame, metric: str = "score") -> DataFrame:
    """(host, id, before, after, delta): each run against the host's previous one; null where either is null."""
    order = Window.partitionBy("host").orderBy("completed_at", "id")
    return history.select("host", "id", F.lag(metric).over(order).alias("before"), F.col(metric).alias("after")).withColumn("delta", F.col("after") - F.col("before"))


TRAIL = "type string, journey struct<id:string,intent:string,host:string,outcome:string,answer:string,answerUrl:string,steps:array<struct<n:int,action:string,url:string,status:int,words:int,issues:array<string>>>>, message string"


def read_trails(lines: DataFrame) -> DataFrame:
    """(run, at, kind, journey, message) of ``lines`` (run, at, value): the lines that a run wrote while it went, batch or stream.

    kind: progress or result, with the journey so far, or error, with a message; a line that is none of these, isn't JSON
    or carries no journey is ``unreadable`` and keeps its text as the message.
    """
    parsed = lines.withColumn("_x", F.from_json("value", TRAIL, {"mode": "PERMISSIVE"}))
    whole = F.col("_x.type").isin("progress", "result") & F.col("_x.journey").isNotNull()
    kind = F.when(whole | (F.col("_x.type") == "error"), F.col("_x.type")).otherwise("unreadable")
    return parsed.select("run", "at", kind.alias("kind"), F.when(whole, F.col("_x.journey")).alias("journey"), F.when(kind == "error", F.col("_x.message")).when(kind == "unreadable", F.col("value")).alias("message"))


def last_states(trails: DataFrame) -> DataFrame:
    """(run, state, journey, message, lines): where each run of ``read_trails`` stands.

    state: done once it has a result, failed once it has an error and no result, else walking; journey: the result's, else
    that of the last progress; a run with unreadable lines alone is walking without a journey. Batch, or a stream in
    complete mode: only maxima, so the order of lines in a batch doesn't matter.
    """
    c = F.col
    of = lambda kind, value: F.max_by(F.when(c("kind") == kind, value), F.when(c("kind") == kind, c("at")))
    has = lambda kind: F.bool_or(c("kind") == kind)
    x = trails.groupBy("run").agg(
        has("result").alias("done"), has("error").alias("failed"), of("result", c("journey")).alias("result"), of("progress", c("journey")).alias("progress"), of("error", c("message")).alias("message"),
        F.count(F.lit(1)).alias("lines"),
    )
    state = F.when(c("done"), "done").when(c("failed"), "failed").otherwise("walking")
    return x.select("run", state.alias("state"), F.coalesce("result", "progress").alias("journey"), F.when(~c("done"), c("message")).alias("message"), "lines")
