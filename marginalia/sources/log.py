"""The review log: one JSON record a line, in one or many files."""

from __future__ import annotations

import os
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators import verdicts
from marginalia.schema import RECORD


def read(spark: SparkSession, path: str) -> DataFrame:
    """Valid records with ``seq``, their place in the log; blank and malformed lines go, a missing log is empty.

    The place is the file, then the split and the line within it. Each write
    has a folder named by its time, so the names of files are in the order of
    the log, which need not be sorted.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], RECORD + ", ts BIGINT, seq STRUCT<file: STRING, at: BIGINT>, email STRING")
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(F.col("value").alias("line"), place.alias("seq"))
    good = verdicts.parsed(lines.where(F.trim("line") != "")).where("valid")
    return good.select("r.*", F.col("r.timestamp").alias("ts"), "seq", F.col("r.identity.email").alias("email")).fillna({"version": 0})


def _now(path: str) -> str:
    """A folder of a log for what is written now; plain files of an older log sort before it."""
    return f"{path.rstrip('/')}/t{time.time_ns():020d}-{uuid.uuid4().hex}"


def append(records: DataFrame, path: str) -> None:
    """Adds records in a folder of their own, so writers need no lock."""
    records.write.json(_now(path))


def rewrite(records: DataFrame, path: str) -> None:
    """Replaces a log: the new one is complete beside the old one before names change."""
    spark = records.sparkSession
    fresh = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    records.write.json(_now(fresh))
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    system = path_of(path).getFileSystem(spark._jsc.hadoopConfiguration())
    old = path_of(f"{fresh}.old")
    if system.exists(path_of(path)):
        system.rename(path_of(path), old)
    system.rename(path_of(fresh), path_of(path))
    system.delete(old, True)


def record(spark: SparkSession, fingerprint: str, verdict: str, email: str, check: str = "review", revision: str = "unknown", state: str = "unknown", path: str | None = None, line: int | None = None, note: str | None = None, at: int | None = None) -> DataFrame:
    """One record to append; verdicts are taken in any case."""
    known = verdict.strip().lower()
    if known not in ("approved", "rejected", "question", "comment"):
        raise ValueError(f"unknown verdict: {verdict}")
    row = (str(uuid.uuid4()), 1, fingerprint, check, known, ("email", email), ("vcs", "git", revision), state, int(time.time()) if at is None else at, path, line, note, None, None)
    return spark.createDataFrame([row], RECORD)


def root(start: str, marker: str) -> str:
    """The folder that holds the log: the nearest one above with a version-control folder, else with ``marker``, else ``start``."""
    for wanted in (".git", marker):
        folder = os.path.abspath(start)
        while True:
            if os.path.exists(os.path.join(folder, wanted)):
                return folder
            if folder == os.path.dirname(folder):
                break
            folder = os.path.dirname(folder)
    return os.path.abspath(start)
