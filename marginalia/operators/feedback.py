"""Blocks with their reviews, as JSON or XML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import cdata, escaped, newlines
from marginalia.operators import verdicts


def with_reviews(blocks: DataFrame, records: DataFrame, include_approved: bool = False) -> DataFrame:
    """Blocks that have records, with all of them and the latest in the log; approved ones go unless asked for."""
    known = blocks.join(verdicts.latest_in_log(records).select(F.col("fingerprint").alias("hash"), F.col("verdict").alias("latest_verdict")), "hash")
    if not include_approved:
        known = known.where(F.col("latest_verdict") != "approved")
    return known.join(verdicts.reviews(records).select(F.col("fingerprint").alias("hash"), "reviews"), "hash")


def as_json(reviews: Column) -> Column:
    return F.to_json(F.transform(reviews, lambda r: F.struct(r["verdict"].alias("verdict"), r["email"].alias("author"), r["check"].alias("check"))))


def as_xml() -> Column:
    """One block's element over columns start_line, kind, hash, content and reviews."""
    end = F.col("start_line") + newlines(F.col("content")) + F.when(F.col("content").endswith("\n"), 0).otherwise(1)
    said = lambda note: F.when(note.isNull(), "").otherwise(F.concat(F.lit("          <comment>"), escaped(note), F.lit("</comment>\n")))
    listed = F.transform("reviews", lambda r: F.concat(F.lit('        <review verdict="'), escaped(r["verdict"]), F.lit('" author="'), escaped(r["email"]), F.lit('">\n'), said(r["note"]), F.lit("        </review>\n")))
    return F.concat(
        F.lit('    <block start_line="'), F.col("start_line").cast("string"), F.lit('" end_line="'), end.cast("string"), F.lit('" kind="'), escaped(F.col("kind")), F.lit('" hash="'), F.col("hash"), F.lit('">\n'),
        F.lit("      <context><![CDATA[\n"), cdata(F.col("content")), F.lit("\n]]></context>\n      <reviews>\n"), F.array_join(listed, ""), F.lit("      </reviews>\n    </block>\n"),
    )
