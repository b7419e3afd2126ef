"""Text splitters: paragraphs, sentences and Markdown sections, as expressions over files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.text import MARK, WS, content_hash, line_span, masked, newlines, paragraph_class, unmasked

#: Fixed value: a sentence ends after a stop and the white space that follows it.
SENTENCE = r"[^.!?]*[.!?][ \t\n\x0C\r]*|[^.!?]+"


def paragraphs(files: DataFrame, code: bool = False) -> DataFrame:
    """Blocks of each file: texts and the blank lines between them, without loss and in order.

    Positions come from a window over a file's own blocks, so only a file's
    chunks meet in one place.
    """
    marked = F.regexp_replace(masked(F.col("content")), rf"(\n[\n{WS}]*\n)", f"{MARK}$1{MARK}")
    cut = files.select("path", "language", F.posexplode(F.split(marked, MARK)).alias("at", "chunk")).where(F.col("chunk") != "").withColumn("chunk", unmasked(F.col("chunk")))
    order = Window.partitionBy("path").orderBy("at")
    before = F.coalesce(F.sum(newlines(F.col("chunk"))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    gap = F.col("chunk").rlike(rf"^\n[\n{WS}]*\n\z")
    kind = F.when(gap, "gap").otherwise(paragraph_class(F.col("chunk")) if code else F.lit("Paragraph"))
    start, end = line_span(F.col("before"), F.col("chunk"))
    placed = cut.withColumn("before", before).withColumn("ord", F.row_number().over(order) - 1)
    return placed.select("path", "language", "ord", kind.alias("kind"), F.col("chunk").alias("content"), content_hash(F.col("chunk")).alias("hash"), start.cast("int").alias("start_line"), end.cast("int").alias("end_line"))


def sentences(blocks: DataFrame) -> DataFrame:
    """Sub-blocks of each block: its sentences but blank ones; the whole if there are none."""
    found = F.filter(F.regexp_extract_all("content", F.lit(SENTENCE), F.lit(0)), lambda s: s.rlike(rf"[^\n{WS}]"))
    whole = F.when(F.size(found) > 0, found).otherwise(F.array("content"))
    keys = [c for c in ("path", "ord", "hash") if c in blocks.columns]
    return blocks.select(*(F.col(k).alias(f"parent_{k}" if k != "path" else k) for k in keys), F.posexplode(whole).alias("sub_ord", "content")).withColumn("kind", F.lit("Sentence")).withColumn("hash", content_hash(F.col("content")))


def sections(files: DataFrame) -> DataFrame:
    """Markdown sections: a section starts at a heading no deeper than all headings before it.

    Headings within fences don't count. What precedes the first heading is the
    preamble; blank chunks go.
    """
    lines = files.select("path", "language", F.posexplode(F.split("content", "\n")).alias("line", "text"))
    order = Window.partitionBy("path").orderBy("line")
    upto, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    fence = F.col("text").rlike(r"^ {0,3}(```|~~~)").cast("int")
    lines = lines.withColumn("fenced", F.sum(fence).over(upto) % 2 + fence > 0)
    level = F.when(~F.col("fenced") & F.col("text").rlike(r"^ {0,3}#{1,6}([ \t]|$)"), F.length(F.regexp_extract("text", r"^ {0,3}(#{1,6})", 1)))
    lines = lines.withColumn("level", level)
    lines = lines.withColumn("start", F.col("level").isNotNull() & (F.col("level") <= F.coalesce(F.min("level").over(before), F.lit(7))))
    lines = lines.withColumn("section", F.sum(F.col("start").cast("int")).over(upto))
    last = F.max("line").over(Window.partitionBy("path"))
    # Every line but a file's last one ends with the line feed it was cut at.
    lines = lines.withColumn("text", F.when(F.col("line") < last, F.concat("text", F.lit("\n"))).otherwise(F.col("text")))
    joined = lines.groupBy("path", "language", "section").agg(F.array_join(F.array_sort(F.collect_list(F.struct("line", "text")))["text"], "").alias("content"), F.min("line").alias("start_line"), F.max("level").alias("deepest"))
    kept = joined.where(F.col("content").rlike(rf"[^\n{WS}]"))
    kind = F.when(F.col("section") == 0, "Preamble").otherwise("Section")
    _, end = line_span(F.col("start_line"), F.col("content"))
    return kept.select("path", "language", F.col("section").alias("ord"), kind.alias("kind"), "content", content_hash(F.col("content")).alias("hash"), "start_line", end.alias("end_line"))

