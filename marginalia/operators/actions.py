"""Lookups and session actions over blocks and trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.storage import written


#: Leading hash digits that name a folder of an index.
DIGITS = 2


def indexed(blocks: DataFrame, folder: str) -> None:
    """Writes blocks as a table clustered by hash: a folder for the first digits, sorted within, so a lookup reads one folder's few row groups."""
    keyed = blocks.withColumn("digits", F.substring("hash", 1, DIGITS))
    keyed.repartitionByRange("hash").sortWithinPartitions("hash").write.mode("overwrite").partitionBy("digits").parquet(folder)


def with_prefix(blocks: DataFrame, prefix: str) -> DataFrame:
    """Blocks whose hash starts with ``prefix``; of an index only the folder that can hold them is read."""
    found = blocks.where(F.col("hash").startswith(prefix))
    if "digits" in blocks.columns:
        digits = F.col("digits")
        found = found.where(digits == prefix[:DIGITS] if len(prefix) >= DIGITS else digits.startswith(prefix))
    return found


def by_prefix(blocks: DataFrame, sub_split, prefix: str) -> DataFrame:
    """The one block whose hash starts with ``prefix``; sub-blocks are looked at only if no block matches."""
    found = with_prefix(blocks, prefix).limit(2)
    if found.isEmpty():
        found = sub_split(blocks).where(F.col("hash").startswith(prefix)).limit(2)
    n = found.count()
    if n == 0:
        raise LookupError(f"nothing has a hash that starts with {prefix}")
    if n > 1:
        raise LookupError(f"several hashes start with {prefix}: give more digits")
    return found


def by_content(blocks: DataFrame, text: str) -> DataFrame:
    """The one block that contains ``text``: a function or method, or any kind if none of those does."""
    holding = blocks.where(F.col("content").contains(text))
    own = holding.where(F.col("kind").isin("function", "method")).limit(2)
    found = holding.limit(2) if own.isEmpty() else own
    if found.count() != 1:
        raise LookupError(f"{'nothing holds' if found.isEmpty() else 'several blocks hold'} {text!r}")
    return found


def fuzzy_counts(blocks: DataFrame, needle) -> DataFrame:
    """For each file how many blocks the lookup of ``needle`` would choose from."""
    hit = F.col("content").contains(needle)
    own = F.count_if(hit & F.col("kind").isin("function", "method"))
    return blocks.groupBy("path").agg(own.alias("own"), F.count_if(hit).alias("every")).select("path", F.when(F.col("own") > 0, F.col("own")).otherwise(F.col("every")).alias("n"))


def actions(nodes: DataFrame, verdict: str, note: str | None = None) -> DataFrame:
    """The record an action on each node writes: its own hash, or a fixed word for the root."""
    fingerprint = F.when(F.col("kind") == "root", "root").otherwise(F.col("hash"))
    return nodes.select(fingerprint.alias("fingerprint"), F.lit("review").alias("check"), F.lit(verdict).alias("verdict"), F.when(F.col("path") != "", F.col("path")).alias("path_hint"), F.lit(note).cast("string").alias("note"))


def applied(shown: DataFrame, path: str, verdict: str) -> DataFrame:
    """What a session still shows after a verdict on a file or directory: approved and rejected subtrees go."""
    if verdict not in ("approved", "rejected"):
        return shown
    if path == "":
        return shown.limit(0)
    return shown.where(~((F.col("path") == path) | F.col("path").startswith(f"{path}/")))


def visible(shown: DataFrame) -> DataFrame:
    """The paths a session shows: files with blocks left and all directories above them."""
    from marginalia.operators.tree import ancestors

    files = shown.select("path").distinct()
    return files.unionByName(files.select(F.explode(ancestors(F.col("path"))).alias("path"))).distinct()


def nested_json(nodes: DataFrame) -> DataFrame:
    """(path, view) of the root: type, name, path, hash and children, nested, built level by level from the deepest."""
    deepest = nodes.agg(F.max("depth")).first()[0] or 0

    def own(rows: DataFrame, children) -> DataFrame:
        head = F.to_json(F.struct(F.col("kind").alias("type"), "name", "path", "hash"))
        return rows.select("parent", F.concat(F.when(F.col("kind") == "file", "file:").otherwise("dir:"), "name").alias("key"), F.concat(F.substring(head, 1, F.length(head) - 1), F.lit(',"children":['), children, F.lit("]}")).alias("view"), "path")

    below = None
    for depth in range(deepest, -1, -1):
        rows = nodes.where(F.col("depth") == depth)
        if below is None:
            below = written(own(rows, F.lit("")), "views")
            continue
        joined = below.groupBy(F.col("parent").alias("p")).agg(F.array_join(F.array_sort(F.collect_list(F.struct("key", "view")))["view"], ",").alias("inner"))
        met = rows.join(joined, F.col("path") == F.col("p"), "left")
        below = written(own(met, F.coalesce("inner", F.lit(""))), "views")
    return below.select("path", "view")


def view_pieces(nodes: DataFrame) -> DataFrame:
    """(key, piece): the text of ``nested_json`` in pieces, whose order by key gives the whole.

    A file is one piece, a directory opens with one and closes with another, so
    no row grows with the tree. A key holds the entries from the root down;
    what closes a directory sorts behind all entries below it.
    """
    parts = F.split("path", "/")
    entry = F.concat(F.when(F.col("kind") == "file", "file:").otherwise("dir:"), "name")
    above = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.concat(F.lit("dir:"), p))
    key = F.when(F.col("kind") == "root", F.array().cast("array<string>")).otherwise(F.concat(above, F.array(entry)))
    first = nodes.where("kind <> 'root'").groupBy("parent").agg(F.min_by("path", entry).alias("path")).select("path", F.lit(True).alias("leads"))
    head = F.to_json(F.struct(F.col("kind").alias("type"), "name", "path", "hash"))
    comma = F.when((F.col("kind") == "root") | F.col("leads"), "").otherwise(",")
    opened = F.concat(comma, F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"children":['))
    closing = F.struct(F.concat(key, F.array(F.lit("~"))).alias("key"), F.lit("]}").alias("piece"))
    alone = F.array(F.struct(key.alias("key"), F.concat(opened, F.lit("]}")).alias("piece")))
    both = F.array(F.struct(key.alias("key"), opened.alias("piece")), closing)
    return nodes.join(first, "path", "left").select(F.inline(F.when(F.col("kind") == "file", alone).otherwise(both)))


def write_view(nodes: DataFrame, path: str) -> None:
    """Writes the nested view as text files that make one JSON document when joined in the order of their numbers."""
    view_pieces(nodes).orderBy("key").select("piece").write.text(path)
