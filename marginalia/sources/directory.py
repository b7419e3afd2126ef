"""A directory tree as a table, and the blocks of its files."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from marginalia.functions import kinds as K
from marginalia.operators import code, merge, split

SKIPPED = ("target", "node_modules")
FILES_A_PARTITION = 500


class _Files(InputPartition):
    def __init__(self, root: str, paths: list[str]):
        self.root, self.paths = root, paths


class DirectorySource(DataSource):
    """Regular files below ``path`` as (path, mtime, size, content); hidden and build folders are pruned while walking.

    Files that can't be read are skipped. Names that start with an underscore
    are kept, which Spark's own binary reader would drop. The path has to be
    readable on all executors. With the option ``content`` set to false only
    times and sizes are read.
    """

    @classmethod
    def name(cls) -> str:
        return "review_directory"

    def schema(self) -> str:
        return "path string, mtime bigint, size bigint, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _DirectoryReader(self.options["path"], self.options.get("content", "true") == "true")


class _DirectoryReader(DataSourceReader):
    def __init__(self, root: str, content: bool = True):
        self.root, self.content = root, content

    def partitions(self) -> list[_Files]:
        found = []
        for folder, folders, files in os.walk(self.root):
            folders[:] = sorted(f for f in folders if not f.startswith(".") and f not in SKIPPED)
            found += [os.path.relpath(os.path.join(folder, f), self.root) for f in sorted(files) if not f.startswith(".") and f not in SKIPPED]
        return [_Files(self.root, found[i : i + FILES_A_PARTITION]) for i in range(0, len(found), FILES_A_PARTITION)] or [_Files(self.root, [])]

    def read(self, partition: _Files):
        for path in partition.paths:
            full = os.path.join(partition.root, path)
            try:
                if os.path.isfile(full):
                    stat = os.stat(full)
                    if not self.content:
                        yield path, int(stat.st_mtime), stat.st_size, None
                        continue
                    with open(full, "rb") as file:
                        yield path, int(stat.st_mtime), stat.st_size, file.read()
            except OSError:
                continue


def files(spark: SparkSession, root: str) -> DataFrame:
    """Files with language and type; texts that aren't UTF-8 go, binaries stay without content."""
    spark.dataSource.register(DirectorySource)
    return typed(spark.read.format("review_directory").load(root))


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, mtime, size) of the files, unread."""
    spark.dataSource.register(DirectorySource)
    return spark.read.format("review_directory").option("content", "false").load(root).select("path", "mtime", "size")


def read_files(listed: DataFrame, root: str) -> DataFrame:
    """The files of a listing, read in tasks; those that can't be read are skipped."""

    def run(batches):
        for batch in batches:
            rows = []
            for path, mtime, size in zip(*(batch[c] for c in ("path", "mtime", "size"))):
                try:
                    with open(os.path.join(root, path), "rb") as file:
                        rows.append((path, mtime, size, file.read()))
                except OSError:
                    continue
            yield pd.DataFrame(rows, columns=["path", "mtime", "size", "content"])

    import pandas as pd

    return typed(listed.select("path", "mtime", "size").repartition("path").mapInPandas(run, "path string, mtime bigint, size bigint, content binary"))


def typed(raw: DataFrame) -> DataFrame:
    """Files (path, mtime, size, content in bytes) with language and type; texts that aren't UTF-8 go, binaries stay without content."""
    path = F.col("path")
    kind = K.file_type(path, F.col("content"))
    rows = raw.select("path", "mtime", "size", kind.alias("type"), F.coalesce(K.language(path), F.when(kind == "Binary", "Unknown").otherwise("Text")).alias("language"), F.col("content").cast("string").alias("content"))
    return rows.where((F.col("type") == "Binary") | F.is_valid_utf8("content"))


def blocks(found: DataFrame, as_text: bool = False) -> DataFrame:
    """Blocks of files by language: items of code, sections of Markdown, paragraphs of the rest; merged, with hashes.

    Code that can't be parsed keeps its paragraphs, told apart as comments and
    code, or as plain text with ``as_text``, which the blobs of a revision take.
    """
    text = found.where(F.col("type") != "Binary").select("path", "language", "content")
    parsed = code.blocks(text.where(F.col("language").isin(code.LANGUAGES)), fallback=True)
    marked = split.sections(text.where(F.col("language") == "Markdown"))
    plain = split.paragraphs(text.where(F.col("language").isin("Text", "Toml", "Nix", "Just")))
    lisp = split.paragraphs(text.where(F.col("language") == "Elisp"), code=not as_text)
    bare = [d.withColumn("tags", F.array().cast("array<string>")) for d in (marked, plain, lisp)]
    columns = ["path", "ord", "kind", "content", "tags", "start_line", "end_line"]
    every = parsed.select(*columns)
    for d in bare:
        every = every.unionByName(d.select(*(F.col(c).cast("int") if c in ("ord", "start_line", "end_line") else F.col(c) for c in columns)))
    kind = F.regexp_replace("kind", f"^{code.LOOSE}", "")
    if as_text:
        kind = F.when(F.col("kind").startswith(code.LOOSE) & (kind != "gap"), "Paragraph").otherwise(kind)
    return merge.optimized(every).withColumn("kind", kind)


def file_hashes(found: DataFrame, split_blocks: DataFrame) -> DataFrame:
    """(path, hash): of the blocks in order; of nothing for a file without any; a fixed word for a binary."""
    listed = F.array_sort(F.collect_list(F.struct("ord", "hash")))["hash"]
    own = split_blocks.groupBy("path").agg(F.array_join(listed, "").alias("joined"))
    joined = found.select("path", "type").join(own, "path", "left")
    return joined.select("path", F.when(F.col("type") == "Binary", "binary_skipped").otherwise(F.sha2(F.coalesce("joined", F.lit("")), 256)).alias("hash"))


def stale(listing: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Paths of a listing that a snapshot lacks or holds with another time or size: what has to be processed again."""
    return listing.select("path", "mtime", "size").join(snapshot.select("path", "mtime", "size"), ["path", "mtime", "size"], "left_anti").select("path")
