"""Scans that keep what did not change: versions of a snapshot in a folder, each made from the one before."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators import tree
from marginalia.sources import directory
from marginalia.storage import written

#: Gives (files, blocks) of loaded files: files with path, mtime, size, hash and what else is kept, blocks with path.
Process = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


@dataclass(frozen=True)
class Snapshot:
    files: DataFrame
    blocks: DataFrame
    nodes: DataFrame


def scanned(listing: DataFrame, load: Callable[[DataFrame], DataFrame], process: Process) -> Snapshot:
    """A snapshot of everything listed."""
    files, blocks = process(load(listing))
    return Snapshot(files, blocks, tree.nodes(files.select("path", "hash")))


def updated(old: Snapshot, listing: DataFrame, load: Callable[[DataFrame], DataFrame], process: Process) -> Snapshot:
    """The snapshot of a listing (path, mtime, size) from an older one.

    Files whose time and size are known keep their rows, unread; the others are
    loaded and processed; those no longer listed go. Hashes are renewed only
    for directories above a path whose hash came, went or changed.
    """
    touched = written(directory.stale(listing, old.files), "stale")
    kept = old.files.join(listing.select("path"), "path", "left_semi").join(touched, "path", "left_anti")
    fresh, fresh_blocks = process(load(listing.join(touched, "path", "left_semi")))
    fresh = written(fresh, "fresh")
    files = kept.select(*old.files.columns).unionByName(fresh.select(*old.files.columns))
    blocks = old.blocks.join(kept.select("path"), "path", "left_semi").select(*old.blocks.columns).unionByName(fresh_blocks.select(*old.blocks.columns))
    gone = old.files.join(kept.select("path"), "path", "left_anti").select("path", F.col("hash").alias("was"))
    changed = gone.join(fresh.select("path", "hash"), "path", "full_outer").where(~F.col("was").eqNullSafe(F.col("hash"))).select("path")
    return Snapshot(files, blocks, tree.renewed(old.nodes, files.select("path", "hash"), written(changed, "changed")))


def save(snapshot: Snapshot, folder: str) -> None:
    """Adds a version; it counts once its last table is complete, so a failed write leaves the version before."""
    version = f"{folder.rstrip('/')}/t{time.time_ns():020d}-{uuid.uuid4().hex}"
    for name in ("files", "blocks", "nodes"):
        getattr(snapshot, name).write.parquet(f"{version}/{name}")


def load(spark: SparkSession, folder: str) -> Snapshot | None:
    """The latest complete version."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(root):
        return None
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    whole = [v for v in sorted(s.getPath().toString() for s in system.listStatus(root)) if system.exists(path_of(f"{v}/nodes/_SUCCESS"))]
    return Snapshot(*(spark.read.parquet(f"{whole[-1]}/{name}") for name in ("files", "blocks", "nodes"))) if whole else None


def scan_tree(spark: SparkSession, root: str, folder: str) -> Snapshot:
    """The snapshot of a work tree, from the one in ``folder`` if there is one; kept there as the next version."""

    def process(found: DataFrame) -> tuple[DataFrame, DataFrame]:
        found = written(found, "found")
        blocks = directory.blocks(found)
        return found.select("path", "mtime", "size", "language").join(directory.file_hashes(found, blocks), "path"), blocks

    listed = written(directory.listing(spark, root), "listing")
    old = load(spark, folder)
    read = lambda rows: directory.read_files(rows, root)
    save(scanned(listed, read, process) if old is None else updated(old, listed, read, process), folder)
    return load(spark, folder)
