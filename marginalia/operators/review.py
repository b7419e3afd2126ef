"""What is left to review, in which order."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import kinds
from marginalia.operators import order
from marginalia.schema import IMPORT_LIKE, SPELLINGS, normalized


@dataclass(frozen=True)
class Filters:
    """Kinds to show. ``exclude`` wins over ``only``; an empty ``only`` shows all."""

    only: frozenset[str] = field(default_factory=frozenset)
    exclude: frozenset[str] = field(default_factory=frozenset)

    @classmethod
    def of(cls, only: list[str] = (), exclude: list[str] = (), config: Filters | None = None) -> Filters:
        """Spellings are taken in any case; unknown ones are ignored. A given list replaces the configured one."""
        known = lambda names: frozenset(SPELLINGS[normalized(x)] for x in names if normalized(x) in SPELLINGS)
        base = config or cls()
        return cls(known(only) if only else base.only, known(exclude) if exclude else base.exclude)

    def blocks(self, kind: Column) -> Column:
        shown = ~kind.isin(sorted(self.exclude)) if self.exclude else F.lit(True)
        return shown & kind.isin(sorted(self.only)) if self.only else shown

    def sub_blocks(self, kind: Column) -> Column:
        return ~kind.isin(sorted(self.exclude)) if self.exclude else F.lit(True)

    def imports(self, path: Column, kind: Column) -> Column:
        """Imports are shown only in library roots or if asked for."""
        asked = kind.isin(sorted(self.only)) if self.only else F.lit(False)
        return ~kind.isin(IMPORT_LIKE) | path.rlike(r"(^|/)lib\.rs$") | asked

    def impls(self, kind: Column) -> Column:
        asked = kind.isin(sorted(self.only)) if self.only else F.lit(False)
        return ~kind.isin("impl", "interface") | asked


def reviewable(blocks: DataFrame, filters: Filters) -> DataFrame:
    kind = F.col("kind")
    return blocks.where(filters.blocks(kind) & filters.imports(F.col("path"), kind) & filters.impls(kind))


def targeted(blocks: DataFrame, paths: DataFrame | None, prefix: str = "") -> DataFrame:
    """Blocks of target paths, given relative to the root or to ``prefix``; None means all, an empty set none."""
    if paths is None:
        return blocks
    full = F.concat(F.lit(f"{prefix}/"), F.col("path")) if prefix else F.col("path")
    wanted = paths.select(F.col("path").alias("wanted")).distinct()
    return blocks.join(wanted, (F.col("path") == F.col("wanted")), "left_semi") if not prefix else blocks.withColumn("_full", full).join(wanted, F.col("_full") == F.col("wanted"), "left_semi").drop("_full").unionByName(blocks.join(wanted, F.col("path") == F.col("wanted"), "left_semi")).distinct()


def implicitly_approved(subs: DataFrame, approved: DataFrame, filters: Filters) -> DataFrame:
    """(path, parent_ord) of blocks all of whose sub-blocks are excluded or approved."""
    good = approved.select("hash", F.lit(True).alias("good")).distinct()
    marked = subs.join(good, "hash", "left")
    fine = ~filters.sub_blocks(F.col("kind")) | F.coalesce("good", F.lit(False))
    return marked.groupBy("path", "parent_ord").agg(F.bool_and(fine).alias("fine")).where("fine").select("path", F.col("parent_ord").alias("ord"))


def unreviewed(blocks: DataFrame, verdicts: DataFrame, covered_paths: DataFrame, sub_split, sub_approved: DataFrame, filters: Filters) -> DataFrame:
    """Blocks that are left: shown, of no covered file, not approved, and not approved through all their sub-blocks.

    Only blocks without any verdict are split further, so the costly step sees
    what the cheap joins have left.
    """
    shown = reviewable(blocks, filters).join(covered_paths, "path", "left_anti")
    known = shown.join(verdicts.select(F.col("fingerprint").alias("hash"), "verdict"), "hash", "left")
    left = known.where(F.col("verdict").isNull() | (F.col("verdict") != "approved"))
    done = implicitly_approved(sub_split(left.where(F.col("verdict").isNull())), sub_approved, filters)
    return left.join(done, ["path", "ord"], "left_anti")


def ranked(blocks: DataFrame) -> DataFrame:
    """Adds rank, place (in its file) and file_rank: files order by (file_rank, path), blocks by place."""
    rank = kinds.rank(F.col("kind"), F.col("tags"))
    own = Window.partitionBy("path")
    return blocks.withColumn("rank", rank).withColumn("place", F.row_number().over(own.orderBy("rank", "start_line", "ord"))).withColumn("file_rank", F.min("rank").over(own))


def session_order(blocks: DataFrame) -> DataFrame:
    """Adds the keys of an interactive session's order: group, band, priority; test tags move the group only."""
    keyed = blocks.withColumn("group", kinds.review_group(F.col("path"), F.col("tags"))).withColumn("band", kinds.band(F.col("kind"))).withColumn("priority", kinds.priority(F.col("kind")))
    return keyed.withColumn("place", F.row_number().over(Window.partitionBy("path").orderBy("group", "band", "priority", "start_line", "ord")))


#: The order of a session over all files: places within equals follow a block's own number.
SESSION = ["group", "path", "band", "priority", "start_line", "ord"]


def session_ranks(blocks: DataFrame) -> DataFrame:
    """Blocks in session order with ``rank``, their place over all files from 0."""
    keyed = session_order(blocks).withColumn("_all", F.lit(0))
    return order.ranked(keyed, "_all", SESSION).drop("_all")
