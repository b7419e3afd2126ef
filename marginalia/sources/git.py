"""What version control knows, as DataFrames. The driver asks git; only its answers become rows."""

from __future__ import annotations

import subprocess

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

BLOBS_A_TASK = 500


class Repository:
    def __init__(self, root: str):
        self.root = root

    def _git(self, *arguments: str, check: bool = True) -> str:
        done = subprocess.run(["git", "-C", self.root, *arguments], capture_output=True, text=True)
        if check and done.returncode:
            raise RuntimeError(done.stderr.strip())
        return done.stdout if not done.returncode else ""

    def head(self) -> str | None:
        return self._git("rev-parse", "--verify", "-q", "HEAD", check=False).strip() or None

    def email(self) -> str:
        return self._git("config", "user.email", check=False).strip() or "unknown@localhost"

    def signing_key(self) -> str | None:
        return self._git("config", "user.signingkey", check=False).strip() or None

    def dirty_files(self, spark: SparkSession) -> DataFrame:
        """Paths that differ between index and work tree, untracked files included."""
        changed = self._git("diff", "--name-only", "-z").split("\0") + self._git("ls-files", "--others", "--exclude-standard", "-z").split("\0")
        return _paths(spark, changed)

    def changed_in_revision(self, spark: SparkSession, revision: str) -> DataFrame:
        """Paths that a commit changes against its first parent, or holds if it has none."""
        parent = self._git("rev-parse", "--verify", "-q", f"{revision}^1", check=False).strip()
        against = parent or self._git("hash-object", "-t", "tree", "/dev/null").strip()
        return self.changed_in_range(spark, against, revision)

    def changed_in_range(self, spark: SparkSession, start: str, end: str) -> DataFrame:
        """Paths that differ between two trees; a rename gives its new path."""
        return _paths(spark, self._git("diff", "--name-only", "-M", "-z", start, end).split("\0"))

    def base(self) -> str:
        """The merge base of HEAD and main or master, or that branch's tip if there is none."""
        for branch in ("main", "master"):
            if tip := self._git("rev-parse", "--verify", "-q", branch, check=False).strip():
                return self._git("merge-base", "HEAD", tip, check=False).strip() or tip
        raise RuntimeError("neither main nor master exists")

    def files_at(self, spark: SparkSession, revision: str, paths: list[str] | None = None) -> DataFrame:
        """(path, content) of the blobs of a revision that are text, or of those at ``paths``.

        The driver lists names only. Tasks read BLOBS_A_TASK blobs each through
        one process; the repository has to be readable on all executors.
        """
        # Links to other repositories are no blobs.
        listed = (entry.partition("\t") for entry in self._git("ls-tree", "-r", "-z", revision).split("\0") if entry)
        blobs = [(name, head.split()[2]) for head, _, name in listed if head.split()[1] == "blob"]
        if paths is not None:
            blobs = [x for x in blobs if x[0] in set(paths)]
        if not blobs:
            return spark.createDataFrame([], "path string, content string")
        root, tasks = self.root, max(1, len(blobs) // BLOBS_A_TASK)

        def read(batches):
            for batch in batches:
                out = []
                asked = "".join(f"{x}\n" for x in batch["blob"])
                answer = subprocess.run(["git", "-C", root, "cat-file", "--batch"], input=asked.encode(), capture_output=True, check=True).stdout
                at = 0
                for name in batch["path"]:
                    end = answer.index(b"\n", at)
                    size = int(answer[at:end].split()[2])
                    data, at = answer[end + 1 : end + 1 + size], end + size + 2
                    try:
                        if b"\0" not in data:
                            out.append((name, data.decode()))
                    except UnicodeDecodeError:
                        continue
                yield pd.DataFrame(out, columns=["path", "content"])

        return spark.createDataFrame(blobs, "path string, blob string").repartition(tasks).mapInPandas(read, "path string, content string")

    def recent(self, spark: SparkSession, limit: int) -> DataFrame:
        """(step, id, summary) along first parents from HEAD."""
        if limit <= 0 or self.head() is None:
            return spark.createDataFrame([], "step int, id string, summary string")
        lines = self._git("log", "--first-parent", f"-{limit}", "--format=%H %s").splitlines()
        return spark.createDataFrame([(i, *line.split(" ", 1)) if " " in line else (i, line, "") for i, line in enumerate(lines)], "step int, id string, summary string")


def _paths(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.createDataFrame([(p,) for p in sorted(set(paths)) if p], "path string")


def targets(expressions: list[str]) -> list[tuple[str, ...]]:
    """Review targets: ``all``, ``dirty``, ``main``, ``file:<path>``, ``rev:<id>`` or ``rev:<a>..<b>``."""
    out: list[tuple[str, ...]] = []
    for text in expressions:
        kind, _, rest = text.partition(":")
        if text in ("all", "dirty", "main"):
            out.append((text,))
        elif kind == "file" and rest:
            out.append(("file", rest))
        elif kind == "rev" and rest:
            start, dots, end = rest.partition("..")
            if dots and not (start and end):
                raise ValueError(f"incomplete range: {text}")
            out.append(("range", start, end) if dots else ("revision", rest))
        else:
            raise ValueError(f"unknown review target: {text}")
    return out


def target_paths(spark: SparkSession, repository: Repository, chosen: list[tuple[str, ...]]) -> DataFrame | None:
    """The union of the targets' paths; None stands for everything."""
    found = None
    for kind, *rest in chosen or [("dirty",)]:
        if kind == "all":
            return None
        if kind == "dirty":
            own = repository.dirty_files(spark)
        elif kind == "main":
            own = repository.changed_in_range(spark, repository.base(), "HEAD")
        elif kind == "file":
            own = _paths(spark, [rest[0].removeprefix("./").replace("\\", "/")])
        elif kind == "revision":
            own = repository.changed_in_revision(spark, rest[0])
        else:
            own = repository.changed_in_range(spark, *rest)
        found = own if found is None else found.unionByName(own).distinct()
    return found
