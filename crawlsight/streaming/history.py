"""The history of runs as a log that several streams write to, and that no replay or second writer damages.

Each writer owns a folder and each of its batches a folder in that, written whole: a replayed batch replaces itself,
writers never touch one another's files. Readers take the batches that are complete and merge them by run id. Compaction
writes the merged rows as a new version together with the last batch of each writer that it holds; a version counts once
it is complete, so a crash leaves the former one in force.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

#: Rows of a host that are kept, newest first.
KEPT = 60


def _complete(spark: SparkSession, path: str) -> list[str]:
    """Sub-folders of ``path`` whose write has ended, by name."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()]
    return sorted(n for n in names if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))


def _batches(spark: SparkSession, path: str) -> dict[str, list[int]]:
    """The complete batches of each writer."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/log")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    writers = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return {w: sorted(int(b.removeprefix("batch=")) for b in _complete(spark, f"{path}/log/{w}")) for w in writers}


def history_writer(path: str, writer: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: writes a batch of runs (id, host, completed_at, status, more) under this writer's name.

    Writers that run at the same time need different names; one that goes on from its checkpoint keeps its own.
    """
    if not re.fullmatch(r"[A-Za-z0-9_-]+", writer):
        raise ValueError("a writer's name has letters, digits, - and _ only")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/log/{writer}/batch={number}")

    return write


def history_sink(runs: DataFrame, path: str, writer: str, checkpoint: str, every: str | None = "15 seconds") -> StreamingQuery:
    """Write a stream of runs to the history at ``path``: a batch ``every`` so often, or what there is and no more if it is None."""
    out = runs.writeStream.foreachBatch(history_writer(path, writer)).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()


def _merged(rows: DataFrame, keep: int) -> DataFrame:
    # the same run may be written again; what was completed last counts, then the later batch
    last = Window.partitionBy("id").orderBy(F.desc("completed_at"), F.desc("_batch"), F.desc("_writer"))
    once = rows.withColumn("_i", F.row_number().over(last)).where("_i = 1")
    newest = Window.partitionBy("host").orderBy(F.desc("completed_at"), "id")
    return once.where("status <> 'failed'").withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= keep).drop("_i", "_n")


def _rows(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, dict[str, int]]:
    """All rows that count, with _writer and _batch, and the last batch of each writer among them."""
    versions = sorted((v for v in _complete(spark, f"{path}/merged")), key=lambda v: int(v.removeprefix("version=")))
    wide = f"{schema}, _writer string, _batch long"
    held: dict[str, int] = {}
    rows = spark.createDataFrame([], wide)
    if versions:
        base = f"{path}/merged/{versions[-1]}"
        held = {r.writer: r.batch for r in spark.read.schema("writer string, batch long").parquet(f"{base}/upto").collect()}
        rows = spark.read.schema(wide).parquet(f"{base}/rows")
    for writer, numbers in sorted(_batches(spark, path).items()):
        fresh = [n for n in numbers if n > held.get(writer, -1)]
        if fresh:
            files = [f"{path}/log/{writer}/batch={n}" for n in fresh]
            number = F.regexp_extract(F.input_file_name(), r"batch=(\d+)/", 1).cast("long")
            rows = rows.unionByName(spark.read.schema(schema).parquet(*files).withColumns({"_writer": F.lit(writer), "_batch": number}))
            held = {**held, writer: fresh[-1]}
    return rows, held


def read_history(spark: SparkSession, path: str, schema: str, keep: int = KEPT) -> DataFrame:
    """The history at ``path``: each run once, failed ones left out, the newest ``keep`` of each host."""
    return _merged(_rows(spark, path, schema)[0], keep).drop("_writer", "_batch")


def compact_history(spark: SparkSession, path: str, schema: str, keep: int = KEPT) -> None:
    """Merge what has been logged into a new version. One process at a time; writers and readers go on meanwhile.

    A failed run stays in the log's order until it is merged, so it still replaces an earlier state of itself.
    """
    rows, held = _rows(spark, path, schema)
    versions = [int(v.removeprefix("version=")) for v in _complete(spark, f"{path}/merged")]
    base = f"{path}/merged/version={max(versions, default=0) + 1}"
    _merged(rows, keep).write.mode("overwrite").parquet(f"{base}/rows")
    spark.createDataFrame(sorted(held.items()), "writer string, batch long").coalesce(1).write.mode("overwrite").parquet(f"{base}/upto")
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{base}/_SUCCESS")
    done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(done, True).close()
