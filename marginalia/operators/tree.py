"""The hierarchy of files and directories: hashes, ancestors, coverage, nesting."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.text import canonical, signature
from marginalia.operators import order, review
from marginalia.storage import written


def file_hashes(blocks: DataFrame) -> DataFrame:
    """(path, hash): the SHA-256 of a file's block hashes in order."""
    listed = F.array_sort(F.collect_list(F.struct("ord", "hash")))["hash"]
    return blocks.groupBy("path").agg(F.sha2(F.array_join(listed, ""), 256).alias("hash"))


def ancestors(path: Column) -> Column:
    """Array of all directories above a path, from the root ''."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "(^|/)[^/]*$", "")


def name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def digests(entries: DataFrame) -> DataFrame:
    """(path, hash) of directories from their entries (parent, entry, hash): a digest of all of them in order.

    A directory is a stream of sorted rows through one digest, so its length costs no memory.
    """
    piece = canonical(F.concat("entry", F.lit(":"), "hash", F.lit("|")))
    # Each piece ends in a bar, so what is canonical can be told piece by piece; the line feed belongs to the last one only.
    cut = entries.select("parent", "entry", F.substring(piece, F.lit(1), F.length(piece) - 1).alias("piece"))
    dealt = cut.repartition("parent").sortWithinPartitions("parent", "entry").select("parent", "piece")

    def run(batches):
        parent, state, done = None, None, []
        for batch in batches:
            for at, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if at != parent:
                    if state is not None:
                        done.append((parent, state))
                    parent, state = at, hashlib.sha256()
                state.update(piece.encode("utf-8", "surrogatepass"))
            if done:
                yield _hashed(done)
                done = []
        if state is not None:
            yield _hashed([(parent, state)])

    return dealt.mapInArrow(run, "path string, hash string")


def _hashed(done: list) -> pa.RecordBatch:
    for _, state in done:
        state.update(b"\n")
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([state.hexdigest() for _, state in done], pa.string())], ["path", "hash"])


def nodes(files: DataFrame) -> DataFrame:
    """(path, kind, name, parent, depth, hash) of files, directories and the root.

    Directories are hashed level by level from the deepest, over the children
    only. Each level is written, so none is made again for those above it.
    """
    own = files.select("path", F.lit("file").alias("kind"), name(F.col("path")).alias("name"), parent(F.col("path")).alias("parent"), F.size(F.split("path", "/")).alias("depth"), "hash")
    own = written(own, "files")
    deepest = own.agg(F.max("depth")).first()[0] or 0
    level, done = own.where(F.lit(False)), own
    for depth in range(deepest - 1, -1, -1):
        children = own.where(F.col("depth") == depth + 1).unionByName(level)
        # Entries sort by kind and name; names of one directory are distinct.
        level = digests(children.select("parent", F.concat(F.when(F.col("kind") == "file", "file:").otherwise("dir:"), "name").alias("entry"), "hash"))
        level = level.select("path", F.lit("root" if depth == 0 else "directory").alias("kind"), name(F.col("path")).alias("name"), parent(F.col("path")).alias("parent"), F.lit(depth).alias("depth"), "hash")
        level = written(level, "level")
        done = done.unionByName(level)
    return done


def renewed(old: DataFrame, files: DataFrame, changed: DataFrame) -> DataFrame:
    """The nodes of ``files`` (path, hash) from those before some paths changed: only directories above ``changed`` paths are hashed again, all others are kept."""
    affected = written(changed.select(F.explode(ancestors(F.col("path"))).alias("path")).distinct().withColumn("depth", F.when(F.col("path") == "", 0).otherwise(F.size(F.split("path", "/")))), "affected")
    columns = ["path", "kind", "name", "parent", "depth", "hash"]
    leaves = files.select("path", F.lit("file").alias("kind"), name(F.col("path")).alias("name"), parent(F.col("path")).alias("parent"), F.size(F.split("path", "/")).alias("depth"), "hash")
    kept = old.where("kind <> 'file'").join(affected.select("path"), "path", "left_anti").select(*columns)
    level, done = leaves.where(F.lit(False)), leaves.unionByName(kept)
    for depth in range((affected.agg(F.max("depth")).first()[0] if not affected.isEmpty() else -1), -1, -1):
        above = affected.where(F.col("depth") == depth).select(F.col("path").alias("parent"))
        children = leaves.unionByName(kept).where(F.col("depth") == depth + 1).join(above, "parent", "left_semi").select(*columns).unionByName(level)
        level = digests(children.select("parent", F.concat(F.when(F.col("kind") == "file", "file:").otherwise("dir:"), "name").alias("entry"), "hash"))
        level = level.select("path", F.lit("root" if depth == 0 else "directory").alias("kind"), name(F.col("path")).alias("name"), parent(F.col("path")).alias("parent"), F.lit(depth).alias("depth"), "hash")
        level = written(level, "level")
        done = done.unionByName(level)
    return done


def labels(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Interval labels of the tree: (path, rank) of files, and (path, kind, depth, first, last) of every directory, the root and every file.

    Files are numbered in pre-order, which is the order of their paths' parts;
    a node's interval holds the numbers of all files below it. A file opens
    the directories that it doesn't share with the one before and closes those
    that it doesn't share with the one after, so every directory is one row,
    however many files lie below it.
    """
    listed = files.select("path", F.split("path", "/").alias("parts"), F.lit(0).alias("all"))
    placed = order.ranked(listed, "all", ["parts"]).select("path", "parts", "rank")
    beside = order.neighbours(placed, "parts")

    def shared(other: str) -> Column:
        """How many leading parts a path shares with the one beside it, its own name left out; -1 without one, so the root counts as not shared."""
        same = F.transform("parts", lambda part, i: part.eqNullSafe(F.get(F.col(other), i)))
        first = F.array_position(same, F.lit(False))
        upto = F.when(first == 0, F.size("parts")).otherwise(first - 1)
        return F.when(F.col(other).isNull(), -1).otherwise(F.least(upto, F.size("parts") - 1))

    def ends(other: str, kind: str) -> DataFrame:
        depths = F.when(shared(other) + 1 < F.size("parts"), F.sequence(shared(other).cast("int") + 1, F.size("parts") - 1)).otherwise(F.array().cast("array<int>"))
        opened = beside.select("rank", "parts", F.explode(depths).alias("depth"))
        return opened.select(F.array_join(F.slice("parts", 1, F.col("depth")), "/").alias("path"), "depth", F.col("rank").alias(kind))

    folders = ends("before", "first").join(ends("after", "last").drop("depth"), "path")
    inner = folders.select("path", F.when(F.col("depth") == 0, "root").otherwise("directory").alias("kind"), "depth", "first", "last")
    leaves = placed.select("path", F.lit("file").alias("kind"), F.size("parts").alias("depth"), F.col("rank").alias("first"), F.col("rank").alias("last"))
    return placed.select("path", "rank"), inner.unionByName(leaves)


def below(labelled: DataFrame, files: DataFrame, path: str) -> DataFrame:
    """(path, rank) of the files below a directory, or the file itself, by a range of numbers."""
    own = labelled.where(F.col("path") == path).select("first", "last")
    return files.join(F.broadcast(own.limit(1)), F.col("rank").between(F.col("first"), F.col("last"))).select("path", "rank")


def block_nodes(blocks: DataFrame) -> DataFrame:
    """(path, kind, name, parent, depth, hash, ord, parent_ord, start_line) of blocks as nodes below their file or, where one encloses them, their impl, at any depth."""
    held = nested(blocks).select("path", "ord", F.get(F.reverse("chain"), F.lit(0)).cast(dict(blocks.dtypes)["ord"]).alias("parent_ord"), F.size("chain").alias("above"))
    rows = blocks.select("path", "ord", "hash", "content", "start_line", F.col("kind").alias("block_kind")).join(held, ["path", "ord"])
    return rows.select("path", F.lit("block").alias("kind"), signature(F.col("content"), F.col("block_kind")).alias("name"), F.col("path").alias("parent"), (F.size(F.split("path", "/")) + F.col("above") + 1).alias("depth"), "hash", "ord", "parent_ord", "start_line")


def by_path(nodes: DataFrame, path: str) -> DataFrame:
    """The file or directory at a path."""
    return nodes.where((F.col("path") == path) & (F.col("kind") != "block"))


def by_hash(nodes: DataFrame, digest: str, path: str | None = None, start_line: int | None = None) -> DataFrame:
    """Nodes of a hash; a path and a first line narrow them."""
    found = nodes.where(F.col("hash") == digest)
    found = found if path is None else found.where(F.col("path") == path)
    return found if start_line is None else found.where(F.col("start_line") == start_line)


def breadcrumbs(blocks: DataFrame) -> DataFrame:
    """(path, ord, crumbs): the file, the whole chain of impls and interfaces around a block from the outermost in, itself among them if it is one, and the block's own signature."""
    named = blocks.withColumn("label", signature(F.col("content"), F.col("kind")))
    held = nested(named, "label")
    own = F.when(F.col("kind").isin(*ENCLOSING), F.array("label")).otherwise(F.array().cast("array<string>"))
    file = F.concat(F.lit("File ("), "path", F.lit(")"))
    return held.select("path", "ord", F.concat_ws(" -> ", file, F.col("labels"), own, F.col("label")).alias("crumbs"))


def subtree_blocks(blocks: DataFrame, path: str) -> DataFrame:
    """The blocks below a file or directory; all of them below the root."""
    return blocks if path == "" else blocks.where((F.col("path") == path) | F.col("path").startswith(f"{path}/"))


def context_lines(files: DataFrame, spans: DataFrame, around: int) -> DataFrame:
    """(path, ord, line, text, inside): a block's lines (path, ord, start_line, end_line) with ``around`` lines of its file before and after."""
    lines = files.select("path", F.posexplode(F.split("content", "\n")).alias("line", "text"))
    near = (F.col("line") >= F.col("start_line") - around) & (F.col("line") < F.col("end_line") + around)
    met = lines.join(spans.select(F.col("path").alias("p"), "ord", "start_line", "end_line"), (F.col("path") == F.col("p")) & near)
    return met.select("path", "ord", "line", "text", ((F.col("line") >= F.col("start_line")) & (F.col("line") < F.col("end_line"))).alias("inside"))


def first_children(nodes: DataFrame) -> DataFrame:
    """(parent, path) of the child each directory shows first: directories before files, then by name."""
    place = F.struct(F.when(F.col("kind") == "file", F.concat(F.lit("file:"), "name")).otherwise(F.concat(F.lit("dir:"), "name")).alias("key"), "path")
    return nodes.where("path <> ''").groupBy("parent").agg(F.min(place)["path"].alias("path"))


def closure(files: DataFrame) -> DataFrame:
    """(path, ancestor) of every file and each directory above it."""
    return files.select("path", F.explode(ancestors(F.col("path"))).alias("ancestor"))


def covered(files: DataFrame, tree: DataFrame, approved: DataFrame) -> DataFrame:
    """The paths of files that an approved hash covers: their own or a directory's."""
    numbered, labelled = labels(files)
    good = tree.join(approved, "hash", "left_semi").select("path")
    spans = labelled.join(good, "path", "left_semi").select(F.lit(None).cast("string").alias("path"), F.col("first").alias("rank"), "last")
    # The greatest end of all intervals that began so far tells whether one still holds a file.
    events = numbered.select("path", "rank", F.lit(None).cast("bigint").alias("last")).unionByName(spans)
    return order.running_max(events, "rank", F.col("path").isNotNull(), "last").where(F.col("path").isNotNull() & (F.col("reach") >= F.col("rank"))).select("path").distinct()


def subtree_counts(files: DataFrame) -> DataFrame:
    """(ancestor, n_files) of every directory and the root: the length of its interval."""
    return labels(files)[1].where("kind <> 'file'").select(F.col("path").alias("ancestor"), (F.col("last") - F.col("first") + 1).alias("n_files"))


#: Kinds that enclose other blocks.
ENCLOSING = ("impl", "interface")


def nested(blocks: DataFrame, label: str | None = None) -> DataFrame:
    """Blocks with ``chain``, the ords of the impls and interfaces around each from the outermost in, and ``labels``, their ``label`` column.

    A sweep over a file's blocks by first line, end and ord holds a stack of
    those still open: the nearest that contains a block is its parent, whose
    chain it continues. A file is a sorted stream, so only the stack is held.
    """
    shown = F.col(label) if label else F.lit(None).cast("string")
    rows = blocks.select("path", "ord", "kind", "start_line", "end_line", shown.alias("label"))
    dealt = rows.repartition("path").sortWithinPartitions("path", "start_line", "end_line", "ord")
    kinds = dict(rows.dtypes)

    def run(batches):
        path, stack = (), []
        for batch in batches:
            chains, labels = [], []
            for at, own, kind, start, end, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (at,) != path:
                    path, stack = (at,), []
                while stack and start > stack[-1][1]:
                    stack.pop()
                chain, names = next(((c, n) for s, e, c, n in reversed(stack) if start >= s and end <= e), ((), ()))
                chains.append(chain)
                labels.append(names)
                if kind in ENCLOSING:
                    stack.append((start, end, (*chain, own), (*names, text)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chains, pa.list_(pa.int64())), pa.array(labels, pa.list_(pa.string()))], [*batch.schema.names, "chain", "labels"])

    return dealt.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in kinds.items()) + ", chain array<bigint>, labels array<string>")


def enclosing(blocks: DataFrame) -> DataFrame:
    """Each block with ``impl_ord``, the latest impl or interface before it that contains its lines."""
    nearest = F.get(F.reverse("chain"), F.lit(0)).cast(dict(blocks.dtypes)["ord"])
    return nested(blocks).select("path", "ord", "kind", "start_line", "end_line", nearest.alias("impl_ord"))


def overlapping(blocks: DataFrame, spans: DataFrame) -> DataFrame:
    """Blocks whose lines overlap a span (path, s, e) of their file.

    Spans count from their first line on, blocks are asked at their end: the
    greatest end of the spans that began before tells whether one reaches
    into the block, so no block meets more than its place in the order.
    """
    names = blocks.columns
    asked = blocks.withColumn("_at", F.col("end_line").cast("bigint")).withColumn("_span", F.lit(0)).withColumn("_end", F.lit(None).cast("bigint"))
    begun = spans.select("path", F.col("s").cast("bigint").alias("_at"), F.lit(1).alias("_span"), F.col("e").cast("bigint").alias("_end"))
    upto = Window.partitionBy("path").orderBy("_at", "_span").rowsBetween(Window.unboundedPreceding, 0)
    met = asked.unionByName(begun, allowMissingColumns=True).withColumn("_reach", F.max("_end").over(upto))
    return met.where((F.col("_span") == 0) & (F.col("_reach") > F.col("start_line"))).select(*names)


def siblings(blocks: DataFrame) -> DataFrame:
    order = Window.partitionBy("path").orderBy("ord")
    return blocks.withColumn("before", F.lag("ord").over(order)).withColumn("after", F.lead("ord").over(order))


def next_remaining(blocks: DataFrame, remaining: Column) -> DataFrame:
    """Blocks in session order (``group``, ``band``, ``priority``) with ``at``, which ascends, and ``next`` (path, ord), the first remaining block after each, in whatever file."""
    return order.following(blocks, review.SESSION, remaining, ["path", "ord"])


def next_after_subtree(blocks: DataFrame, remaining: Column) -> DataFrame:
    """(node, next): for every file, directory and the root the first remaining block after its first one that doesn't lie in it; null if there is none.

    A node's blocks are one run in each group, since groups order by path. So
    the answer follows the run of the first group whose successor lies
    outside; successors of all runs come from ``next_remaining``.
    """
    placed = next_remaining(blocks, remaining).select("path", "group", "at", "next")
    ends = placed.groupBy("path", "group").agg(F.max_by(F.struct("at", "next"), "at").alias("end"))
    every = F.concat(ancestors(F.col("path")), F.array("path"))
    runs = ends.select("group", F.explode(every).alias("node"), "end").groupBy("node", "group").agg(F.max_by("end", "end.at")["next"].alias("next"))
    inside = F.col("next").isNotNull() & ((F.col("node") == "") | (F.col("next.path") == F.col("node")) | F.col("next.path").startswith(F.concat("node", F.lit("/"))))
    return runs.groupBy("node").agg(F.min_by(F.struct("next"), F.when(~inside, F.col("group")))["next"].alias("next"))
