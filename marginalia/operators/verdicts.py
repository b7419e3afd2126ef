"""The review log: latest verdicts, approved hashes, merging of logs, validity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.schema import BLOCK_STATES, RECORD, VERDICTS


def latest(records: DataFrame, check: str | None = "review") -> DataFrame:
    """(fingerprint, verdict): the last by time, then by place in the log; only one check counts."""
    own = records if check is None else records.where(F.col("check") == check)
    return own.groupBy("fingerprint").agg(F.max_by("verdict", F.struct("ts", "seq")).alias("verdict"))


def latest_in_log(records: DataFrame) -> DataFrame:
    """(fingerprint, verdict): the last in the log, of any check."""
    return records.groupBy("fingerprint").agg(F.max_by("verdict", "seq").alias("verdict"))


def approved(verdicts: DataFrame) -> DataFrame:
    return verdicts.where(F.col("verdict") == "approved").select(F.col("fingerprint").alias("hash"))


def reviews(records: DataFrame) -> DataFrame:
    """All records of a fingerprint, in log order, with their notes if the log has any."""
    note = F.col("note") if "note" in records.columns else F.lit(None).cast("string").alias("note")
    return records.groupBy("fingerprint").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("seq", "verdict", "email", "check", note))).alias("reviews"))


def synced(remote: DataFrame, local: DataFrame) -> DataFrame:
    """The union of two logs with one record an id, the remote one first; readers order it by time, side and place."""
    both = remote.withColumn("side", F.lit(0)).unionByName(local.withColumn("side", F.lit(1)))
    first = F.row_number().over(Window.partitionBy("id").orderBy("side", "seq"))
    return both.withColumn("_n", first).where("_n = 1").drop("_n")


def parsed(lines: DataFrame) -> DataFrame:
    """Records of a log's lines (column ``line``); ``valid`` tells what a strict reader would take."""
    r = F.from_json("line", RECORD)
    return lines.withColumn("r", r).withColumn("valid", F.coalesce(parseable(F.col("r")), F.lit(False)))


def parseable(r: Column) -> Column:
    needed = [r[x].isNotNull() for x in ("id", "fingerprint", "check", "timestamp")]
    tagged = [r["identity"]["type"] == "email", r["identity"]["email"].isNotNull(), r["repo_ref"]["type"] == "vcs", r["repo_ref"]["system"] == "git", r["repo_ref"]["revision"].isNotNull()]
    every = r["verdict"].isin(VERDICTS) & r["block_state"].isin(BLOCK_STATES)
    for x in needed + tagged:
        every = every & x
    return F.coalesce(every, F.lit(False))


def schema_valid(r: Column) -> Column:
    """The published schema's further limits: a check, a revision in hexadecimal, no negative time."""
    return parseable(r) & (F.length(r["check"]) > 0) & r["repo_ref"]["revision"].rlike("^[0-9a-f]{7,64}$") & (r["timestamp"] >= 0)


def verify_counts(records: DataFrame, intact: Callable[[Column], Column] | None = None) -> DataFrame:
    """(attested, unattested, invalid): records with and without attestations, and attestations that don't hold.

    ``intact`` tells of an attestation whether it holds; without it, its structure is checked.
    """
    intact = intact or intact_of
    n = F.coalesce(F.size("attestations"), F.lit(0))
    bad = F.size(F.filter("attestations", lambda a: ~F.coalesce(intact(a), F.lit(False))))
    return records.agg(F.sum((n > 0).cast("bigint")).alias("attested"), F.sum((n <= 0).cast("bigint")).alias("unattested"), F.sum(F.when(n > 0, bad).otherwise(0).cast("bigint")).alias("invalid"))


def intact_of(a: Column) -> Column:
    """The structural check of an attestation; a signature check can take its place."""
    return (a["kind"] == "PGP") & (a["canonicalization"] == "JCS_V1") & a["signature"].startswith("-----BEGIN PGP SIGNATURE-----")


def signing_payload(record: DataFrame) -> Column:
    """Canonical JSON of a record without its attestations: keys in order, nulls kept."""
    keys = sorted(c for c in record.columns if c != "attestations")
    return F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
