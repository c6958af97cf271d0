"""Resumable ingestion: bounded micro-batches with durable checkpoints, and the done and failed
ledger that decides what is left."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..runtime import shared_folder


def remaining(df: DataFrame, ledger: DataFrame, key: str, retry_failed: bool = False) -> DataFrame:
    """Rows still to do, with ``why``: new, or retry for failed ones if asked for. A key that has
    both a done and a failed entry is done; padded keys should be trimmed before."""
    state = ledger.groupBy(key).agg(F.max((F.col("status") == "done").cast("int")).alias("_done"))
    j = df.join(state, key, "left")
    keep = F.col("_done").isNull() | (F.lit(retry_failed) & (F.col("_done") == 0))
    return j.where(keep).withColumn("why", F.when(F.col("_done").isNull(), "new").otherwise("retry")).drop("_done")


def coverage(ledger: DataFrame) -> DataFrame:
    """``(status, error_code, n, share)``; rows without a status are pending."""
    from pyspark.sql import Window as W

    c = ledger.groupBy(F.coalesce("status", F.lit("pending")).alias("status"), F.coalesce("error_code", F.lit("")).alias("error_code")).agg(F.count("*").alias("n"))
    return c.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy(F.lit(1))), 6))


def run_available(stream: DataFrame, sink: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame], key: list[str] | None = None) -> None:
    """Process all data there is in micro-batches and stop; a second call resumes after the last
    finished batch. A batch is written under its number, so one that is repeated after a failure
    overwrites itself and nothing comes twice."""

    def write(batch: DataFrame, number: int) -> None:
        out = transform(batch)
        (out.dropDuplicates(key) if key else out).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    running = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        running.awaitTermination()
    except KeyboardInterrupt:  # what ended is in the checkpoint; the next call goes on from there
        running.stop()
        raise


def ingest_paragraphs(spark: SparkSession, source: str, work: str | None = None, files_per_batch: int = 30) -> DataFrame:
    """Paragraphs of a documents source, ingested as a stream of files. ``work`` holds checkpoint
    and sink and must be shared on a cluster; by default it is in the session's checkpoint folder."""
    if work is None:
        work = f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    schema = spark.read.parquet(source).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isFile():  # streams read folders
        reader, source = reader.option("pathGlobFilter", path.getName()), path.getParent().toString()
    stream = reader.parquet(source)

    def paragraphs(batch: DataFrame) -> DataFrame:
        p = batch.where("text is not null").select("doc_id", F.posexplode(text.paragraphs(F.col("text"))).alias("paragraph_no", "content"))
        return p.withColumn("paragraph_id", text.content_id(F.col("content")))

    run_available(stream, f"{work}/out", f"{work}/checkpoint", paragraphs)
    return spark.read.parquet(f"{work}/out").select("doc_id", "paragraph_no", "paragraph_id", "content")


def hourly(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Count and sum of events by type and hour, for a table or a stream (late rows are waited for)."""
    if events.isStreaming:
        events = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    w = events.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select("event_type", F.col("window.start").alias("hour"), "n", "total")


def per_key(spark: SparkSession, keys: list[str], folder: str, run: Callable[[str], DataFrame]) -> DataFrame:
    """The results of ``run(key)`` for each key, kept under ``folder`` as each of them ends. Keys that
    have ended before, in this or in an interrupted call, are not run again."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for key in keys:
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/key={key}/_SUCCESS")
        if not fs.exists(done):
            run(key).write.mode("overwrite").parquet(f"{folder}/key={key}")
    return spark.read.parquet(folder).where(F.col("key").isin(keys))
