"""The provided tables in the shape of review inputs: files, records, code blocks, snapshots, commits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions.text import content_hash


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = F.concat_ws("/", "lang", "source")
    return docs.select("doc_id", folder.alias("dir"), F.concat(folder, F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.lit("Text").alias("language"), F.col("text").alias("content"))


def conversation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each conversation: its turns in order, parted by blank lines. A file is one conversation's size."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return turns.select(F.concat(F.lit("conv/"), F.col("conv_id").cast("string"), F.lit(".md")).alias("path"), F.lit("Text").alias("language"), F.array_join("t.text", "\n\n").alias("content"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as review records on documents: id, fingerprint, check, verdict, ts, seq, email, note."""
    hashes = table(spark, sf_dir, "documents").select("doc_id", content_hash(F.col("text")).alias("fingerprint"))
    n = table(spark, sf_dir, "documents").count()
    kind = F.col("event_type")
    verdict = F.when(kind.isin("purchase", "signup"), "approved").when(kind == "error", "rejected").when(kind == "click", "comment").otherwise("question")
    events = table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("id"),
        (F.col("event_id") % n).alias("doc_id"),
        verdict.alias("verdict"),
        F.when(kind == "signup", "security").otherwise("review").alias("check"),
        F.unix_seconds(F.date_trunc("day", "ts").cast("timestamp")).alias("ts"),
        F.col("event_id").alias("seq"),
        F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@example.com")).alias("email"),
        F.when(kind == "click", F.concat(F.lit("see <"), F.col("event_id").cast("string"), F.lit("> & more"))).alias("note"),
    )
    return events.join(hashes, "doc_id").drop("doc_id")


def code_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` rows as blocks of source files, 25 a file: path, ord, kind, content, tags, start_line, end_line."""
    parts = table(spark, sf_dir, "part")
    kinds = F.array(*map(F.lit, CODE_KINDS))
    of = Window.partitionBy("path").orderBy("ord")
    height = F.col("p_size") % 5 + 1
    blocks = parts.select(
        F.concat(F.lit("src/f"), F.floor(F.col("p_partkey") / 25).cast("string"), F.lit(".rs")).alias("path"),
        (F.col("p_partkey") % 25).cast("int").alias("ord"),
        F.element_at(kinds, ((F.col("p_partkey") * 7 + F.col("p_size")) % len(CODE_KINDS) + 1).cast("int")).alias("kind"),
        F.concat(F.col("p_name"), F.lit("\n")).alias("content"),
        F.when(F.col("p_size") % 9 == 0, F.array(F.lit("test"))).otherwise(F.array().cast("array<string>")).alias("tags"),
        height.cast("int").alias("height"),
    )
    end = F.sum("height").over(of)
    return blocks.withColumn("end_line", end.cast("int")).withColumn("start_line", (F.col("end_line") - F.col("height")).cast("int")).drop("height")


#: The kinds that code blocks take in turn.
CODE_KINDS = ["import", "import", "gap", "module", "CodeParagraph", "gap", "impl", "method", "comment", "import", "struct", "const"]


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(path, hash, content) of documents before and after: every seventh altered, every eleventh gone, every thirteenth new."""
    files = document_files(spark, sf_dir)
    before = files.where("doc_id % 13 <> 0").select("path", content_hash(F.col("content")).alias("hash"), "content")
    altered = F.when(F.col("doc_id") % 7 == 0, F.concat("content", F.lit("\nappended"))).otherwise(F.col("content"))
    after = files.where("doc_id % 11 <> 0").select("path", content_hash(altered).alias("hash"), altered.alias("content"))
    return before, after


def moved_snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(path, hash, content) of documents before and after: every ninth in another folder, the next after it too with a line more, every eleventh gone, every thirteenth new."""
    files = document_files(spark, sf_dir)
    n = F.col("doc_id")
    before = files.where("doc_id % 13 <> 0").select("path", content_hash(F.col("content")).alias("hash"), "content")
    text = F.when(n % 9 == 1, F.concat("content", F.lit("\nappended"))).otherwise(F.col("content"))
    path = F.when(n % 9 < 2, F.concat(F.lit("moved/"), F.col("path"))).otherwise(F.col("path"))
    after = files.where("doc_id % 11 <> 0").select(path.alias("path"), content_hash(text).alias("hash"), text.alias("content"))
    return before, after


#: Order keys that are numbered together.
KEYS = 20_000


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as a history: each follows the one before, every tenth also merges the one five before."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.floor(F.col("o_orderkey") / KEYS).alias("bucket"))
    # One row for KEYS keys passes the window that is not partitioned.
    before = F.coalesce(F.sum("count").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = orders.groupBy("bucket").count().select("bucket", before.alias("before"))
    n = F.row_number().over(Window.partitionBy("bucket").orderBy("o_orderkey"))
    numbered = orders.withColumn("i", n).join(offsets, "bucket").select((F.col("i") + F.col("before")).cast("bigint").alias("n"), F.col("o_orderpriority").alias("summary"))
    n = F.col("n")
    return numbered.select("n", "summary", F.when(n > 1, n - 1).alias("first_parent"), F.when((n % 10 == 0) & (n > 5), n - 5).alias("second_parent"))


def last_commit(commits: DataFrame) -> int:
    """The number of the latest commit, 0 if there is none."""
    return commits.agg(F.max("n")).first()[0] or 0
