"""Reviews of a work tree from Python: scan, review, feedback, inspect, mark, sync, diff, check, verify."""

from __future__ import annotations

import os
import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.kinds import language
from marginalia.functions.text import content_hash
from marginalia.operators import actions, diff, feedback, review, subsplit, tree, verdicts
from marginalia.operators.review import Filters
from marginalia.plans import incremental
from marginalia.sources import directory, git, log

LOG_FOLDER = ".marginalia"
CONFIG = "marginalia.toml"


class Session:
    """One work tree and its log. Results are DataFrames; only paths and settings are handled on the driver."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, os.path.abspath(root)
        self.repository = git.Repository(self.root)
        self.log_path = os.path.join(log.root(self.root, LOG_FOLDER), LOG_FOLDER, "records")

    def config(self, section: str) -> Filters:
        """``only`` and ``exclude`` of a section of the nearest settings file above."""
        folder = self.root
        while not os.path.exists(os.path.join(folder, CONFIG)):
            if folder == os.path.dirname(folder):
                return Filters()
            folder = os.path.dirname(folder)
        with open(os.path.join(folder, CONFIG), "rb") as file:
            own = tomllib.load(file).get(section, {})
        return Filters.of(own.get("only", []), own.get("exclude", []))

    def records(self) -> DataFrame:
        return log.read(self.spark, self.log_path)

    def scan(self) -> tuple[DataFrame, DataFrame]:
        """Files with hashes, and their blocks."""
        found = directory.files(self.spark, self.root)
        blocks = directory.blocks(found)
        hashes = directory.file_hashes(found, blocks)
        return found.select("path", "language").join(hashes, "path"), blocks.join(found.select("path", "language"), "path")

    def rescan(self) -> tuple[DataFrame, DataFrame]:
        """As ``scan``, reading only files that changed since the last rescan, which is kept beside the log."""
        found = incremental.scan_tree(self.spark, self.root, os.path.join(os.path.dirname(self.log_path), "scan"))
        return found.files.select("path", "language", "hash"), found.blocks.join(found.files.select("path", "language"), "path")

    def _subs(self, blocks: DataFrame) -> DataFrame:
        return subsplit.sub_blocks(blocks.withColumn("complexity", F.lit(0)))

    def _covered(self, files: DataFrame, approved: DataFrame) -> DataFrame:
        return tree.covered(files.select("path", "hash"), tree.nodes(files.select("path", "hash")), approved)

    def review(self, targets: list[str] = ("all",), only: list[str] = (), exclude: list[str] = ()) -> DataFrame:
        """Blocks left to review, with the keys of their order."""
        filters = Filters.of(only, exclude, self.config("review"))
        files, blocks = self.scan()
        known = verdicts.latest(self.records())
        approved = verdicts.approved(known)
        chosen = review.targeted(blocks, git.target_paths(self.spark, self.repository, git.targets(list(targets))))
        left = review.unreviewed(chosen, known, self._covered(files, approved), self._subs, approved, filters)
        return review.ranked(left)

    def feedback(self, include_approved: bool = False, only: list[str] = (), exclude: list[str] = ()) -> DataFrame:
        """Blocks that have records, with all of them."""
        filters = Filters.of(only, exclude, self.config("feedback"))
        files, blocks = self.scan()
        records = self.records()
        shown = blocks.where(filters.blocks(F.col("kind")) & filters.imports(F.col("path"), F.col("kind")))
        if not include_approved:
            approved = verdicts.latest_in_log(records).where("verdict = 'approved'").select(F.col("fingerprint").alias("hash"))
            shown = shown.join(self._covered(files, approved), "path", "left_anti")
        return feedback.with_reviews(shown, records, include_approved)

    def inspect(self, prefix: str, split: bool = False) -> DataFrame:
        """The one block or sub-block of a hash prefix, or its sub-blocks."""
        _, blocks = self.scan()
        found = actions.by_prefix(blocks, self._subs, prefix)
        return self._subs(found.withColumn("ord", F.lit(0)).withColumn("language", F.coalesce("language", F.lit("Text")))) if split else found

    def mark(self, fingerprint: str, verdict: str, check: str = "review", path: str | None = None, line: int | None = None, note: str | None = None) -> None:
        """Adds one record to the log."""
        head = self.repository.head()
        log.append(log.record(self.spark, fingerprint, verdict, self.repository.email(), check, head or "unknown", self._state(path, fingerprint), path, line, note), self.log_path)

    def blocks_at(self, revision: str = "HEAD", paths: list[str] | None = None) -> DataFrame:
        """Blocks of a revision's text blobs, or of those at ``paths``; code that can't be parsed is cut as plain text."""
        held = self.repository.files_at(self.spark, revision, paths)
        rows = held.select("path", F.coalesce(language(F.col("path")), F.lit("Text")).alias("language"), "content", F.lit("Text").alias("type"))
        return directory.blocks(rows, as_text=True)

    def _state(self, path: str | None, fingerprint: str) -> str:
        """Whether HEAD holds the block, the path has changed, or neither is known."""
        if path is None or self.repository.head() is None:
            return "unknown"
        if not self.blocks_at("HEAD", [path]).where(F.col("hash") == fingerprint).isEmpty():
            return "committed"
        return "uncommitted" if not self.repository.dirty_files(self.spark).where(F.col("path") == path).isEmpty() else "unknown"

    def diff(self) -> DataFrame:
        """Unreviewed hunks between the merge base and HEAD, each with its reviews; files that an approved hash covers go."""
        revisions = (self.repository.base(), "HEAD")
        changed = [r["path"] for r in self.repository.changed_in_range(self.spark, *revisions).collect()]
        sides = [self.repository.files_at(self.spark, r, changed).withColumn("hash", content_hash(F.col("content"))) for r in revisions]
        files, _ = self.scan()
        records = self.records()
        known = verdicts.latest(records)
        return diff.hunk_changes(diff.file_hunks(*sides), known, self._covered(files, verdicts.approved(known)), verdicts.reviews(records))

    def check(self) -> None:
        if not self.diff().isEmpty():
            raise RuntimeError("unreviewed changes")

    def sync(self, remote: DataFrame) -> None:
        """Merges another log into this one; its records win."""
        columns = [c for c in remote.columns if c not in ("ts", "email")]
        log.rewrite(verdicts.synced(remote.select(columns), self.records().select(columns)).orderBy("timestamp", "side", "seq").drop("side", "seq"), self.log_path)

    def verify(self, record_id: str | None = None) -> DataFrame:
        chosen = self.records() if record_id is None else self.records().where(F.col("id") == record_id)
        return verdicts.verify_counts(chosen).fillna(0)
