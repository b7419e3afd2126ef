"""Merging of adjacent blocks: imports, modules and code paragraphs, as folds over a file's blocks in order.

A fold is a table function over the rows of one path in order, so SQL can call
it as well: ``SELECT * FROM optimize_blocks(TABLE(blocks) PARTITION BY path
ORDER BY ord)``. It holds the run it is in and nothing else of the file.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.text import content_hash

UNLIMITED = 2**31 - 1


class Block(NamedTuple):
    kind: str
    content: str
    tags: list[str]
    start_line: int
    end_line: int


@dataclass(frozen=True)
class Rule:
    """Runs of ``target`` become ``into``, from the first target to the last, with what they absorb between them.

    A target that would stretch its run over more lines than ``limit`` starts
    the next run. A run of one target stays as it is; a merged block loses its
    tags. Targets that follow one another directly are parted by ``separator``.
    """

    target: str
    into: str
    absorbed: tuple[str, ...]
    limit: int = UNLIMITED
    separator: str = ""


IMPORTS = Rule("import", "Imports", ("gap",), separator="\n")
MODULES = Rule("module", "Modules", ("gap", "comment"), 48)
PARAGRAPHS = Rule("CodeParagraph", "CodeParagraph", ("gap",), 8)


@dataclass
class Fold:
    """One rule's run: its targets' pieces so far and what may yet be absorbed."""

    rule: Rule
    first: Block | None = None
    pieces: list[str] = field(default_factory=list)
    targets: int = 0
    start: int = 0
    end: int = 0
    waiting: list[Block] = field(default_factory=list)

    def push(self, block: Block) -> Iterator[Block]:
        if block.kind == self.rule.target:
            if self.first is not None and block.end_line - self.first.start_line > self.rule.limit:
                yield from self.flush()
            if self.first is None:
                self.first, self.pieces, self.start = block, [block.content], block.start_line
            else:
                self.pieces += [b.content for b in self.waiting] or [self.rule.separator]
                self.pieces.append(block.content)
                self.start = min(self.start, block.start_line, *(b.start_line for b in self.waiting))
                self.waiting = []
            self.targets, self.end = self.targets + 1, block.end_line
        elif self.first is not None and block.kind in self.rule.absorbed:
            self.waiting.append(block)
        else:
            yield from self.flush()
            yield block

    def flush(self) -> Iterator[Block]:
        """The run's end: one block if it has several targets, and what it didn't absorb."""
        if self.first is not None:
            yield self.first if self.targets == 1 else Block(self.rule.into, "".join(self.pieces), [], self.start, self.end)
            yield from self.waiting
        self.first, self.pieces, self.targets, self.waiting = None, [], 0, []


class Chain:
    """Folds one after another: what one lets go is the next one's input."""

    def __init__(self, *rules: Rule):
        self.folds = [Fold(r) for r in rules]

    def push(self, block: Block, at: int = 0) -> Iterator[Block]:
        if at == len(self.folds):
            yield block
            return
        for out in self.folds[at].push(block):
            yield from self.push(out, at + 1)

    def flush(self) -> Iterator[Block]:
        for at, fold in enumerate(self.folds):
            for out in fold.flush():
                yield from self.push(out, at + 1)


MERGED = "path string, ord int, kind string, content string, tags array<string>, start_line int, end_line int"


def _table_function(*rules: Rule):
    """A table function over (path, ord, kind, content, tags, start_line, end_line) that numbers its blocks anew."""

    class Merge:
        def __init__(self):
            self.chain, self.path, self.n = Chain(*rules), None, 0

        def _numbered(self, blocks):
            for b in blocks:
                self.n += 1
                yield self.path, self.n - 1, *b

        def eval(self, row):
            self.path = row["path"]
            yield from self._numbered(self.chain.push(Block(row["kind"], row["content"], row["tags"], row["start_line"], row["end_line"])))

        def terminate(self):
            yield from self._numbered(self.chain.flush())

    return F.udtf(Merge, returnType=MERGED)


#: What ``register`` makes known to SQL.
FUNCTIONS = {"merge_imports": (IMPORTS,), "merge_modules": (MODULES,), "merge_code_paragraphs": (PARAGRAPHS,), "optimize_blocks": (IMPORTS, MODULES, PARAGRAPHS)}


def register(spark: SparkSession) -> None:
    """Makes the folds known to SQL as table functions."""
    for name, rules in FUNCTIONS.items():
        spark.udtf.register(name, _table_function(*rules))


def merged(blocks: DataFrame, *rules: Rule) -> DataFrame:
    """Blocks after the rules, in one pass over each file."""
    rows = blocks.select("path", F.col("ord").cast("int").alias("ord"), "kind", "content", "tags", F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"))
    return _table_function(*rules)(rows.asTable().partitionBy("path").orderBy("ord"))


def merged_imports(blocks: DataFrame) -> DataFrame:
    return merged(blocks, IMPORTS)


def merged_modules(blocks: DataFrame) -> DataFrame:
    return merged(blocks, MODULES)


def merged_paragraphs(blocks: DataFrame) -> DataFrame:
    return merged(blocks, PARAGRAPHS)


def optimized(blocks: DataFrame) -> DataFrame:
    """Imports, then modules, then code paragraphs; hashes are of the merged contents."""
    return merged(blocks, IMPORTS, MODULES, PARAGRAPHS).withColumn("hash", content_hash(F.col("content")))
