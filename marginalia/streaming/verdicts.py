"""The review log as a stream: records once each, latest verdict by fingerprint."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.text import content_hash
from marginalia.sources import views as V
from marginalia.storage import shared_folder


def latest(stream: DataFrame) -> DataFrame:
    """(fingerprint, last): the verdict, time and place of the latest record of the review check.

    The greatest (time, place) wins in whatever order records arrive, and a
    record that arrives twice changes nothing, so neither ids nor a watermark
    are kept: the state is one row for each fingerprint.
    """
    return stream.where(F.col("check") == "review").groupBy("fingerprint").agg(F.max(F.struct("ts", "seq", "verdict")).alias("last"))


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table read as a stream, in the shape of records."""
    schema = V.table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    hashes = V.table(spark, sf_dir, "documents").select("doc_id", content_hash(F.col("text")).alias("fingerprint"))
    n = V.table(spark, sf_dir, "documents").count()
    kind = F.col("event_type")
    verdict = F.when(kind.isin("purchase", "signup"), "approved").when(kind == "error", "rejected").when(kind == "click", "comment").otherwise("question")
    rows = events.select(F.col("event_id").cast("string").alias("id"), (F.col("event_id") % n).alias("doc_id"), verdict.alias("verdict"), F.when(kind == "signup", "security").otherwise("review").alias("check"), F.unix_seconds(F.date_trunc("day", "ts").cast("timestamp")).alias("ts"), F.col("event_id").alias("seq"))
    return rows.join(hashes, "doc_id").drop("doc_id")


def follow(state: DataFrame, folder: str) -> None:
    """Runs all that is available and writes what each trigger changed to ``folder``, in a folder of the trigger's own.

    A trigger that is run again replaces its own folder only.
    """

    def keep(rows: DataFrame, trigger: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/changes/{trigger}")

    run = state.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(keep).trigger(availableNow=True).start()
    run.awaitTermination()


def merged(spark: SparkSession, folder: str, state: DataFrame) -> DataFrame:
    """The table that the changes of all triggers add up to: the latest one of each fingerprint."""
    found = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/changes")
    if not found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found):
        return spark.createDataFrame([], state.schema)
    every = spark.read.schema(state.schema).option("recursiveFileLookup", True).parquet(f"{folder}/changes")
    return every.groupBy("fingerprint").agg(F.max("last").alias("last"))


def latest_from_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fingerprint, verdict) of all that is available, through the stream."""
    folder = f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    state = latest(events_stream(spark, sf_dir))
    follow(state, folder)
    return merged(spark, folder, state).select("fingerprint", F.col("last.verdict").alias("verdict"))
