"""Changes: snapshots, renames, hunks, histories."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.text import fingerprint
from marginalia.operators import order
from marginalia.storage import written

#: Of two files that differ, how much of the larger one's bytes must stand in lines that both have, in percent, for a rename.
LIKENESS = 50


def changed_paths(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, status) of paths whose hash differs between two snapshots."""
    a, b = before.select("path", F.col("hash").alias("was")), after.select("path", F.col("hash").alias("is"))
    joined = a.join(b, "path", "full_outer")
    status = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("was") != F.col("is"), "modified")
    return joined.select("path", status.alias("status")).where("status is not null")


def _lines_of(files: DataFrame) -> DataFrame:
    """(path, line, bytes, total): the distinct lines of files by hash, with the bytes that each takes in its file, and the file's."""
    each = files.select("path", F.explode(F.split("content", "\n")).alias("text")).select("path", F.xxhash64("text").alias("line"), (F.octet_length("text") + 1).cast("bigint").alias("bytes"))
    held = each.groupBy("path", "line").agg(F.sum("bytes").alias("bytes"))
    return held.join(held.groupBy("path").agg(F.sum("bytes").alias("total")), "path")


def likenesses(gone: DataFrame, new: DataFrame, percent: int = LIKENESS) -> DataFrame:
    """(source, path, like) of all pairs of a gone and a new file whose likeness reaches ``percent``.

    Likeness is the percentage of the larger file's bytes in lines that both
    have. Candidates come from an inverted index of rare lines: with lines
    ordered from rare to frequent, the first line that two such files share
    leaves at least ``percent`` of either file's bytes from it on, so only
    those lines of a file are indexed. Frequent lines are indexed only for
    files that hold little else.
    """
    a, b = written(_lines_of(gone), "gone"), written(_lines_of(new), "new")
    often = a.select("line").unionByName(b.select("line")).groupBy("line").agg(F.count("*").alias("often"))
    before = Window.partitionBy("path").orderBy("often", "line").rowsBetween(Window.unboundedPreceding, -1)
    upto = F.coalesce(F.sum("bytes").over(before), F.lit(0))

    def rare(lines: DataFrame) -> DataFrame:
        met = lines.join(often, "line").withColumn("ahead", upto)
        return met.where((F.col("total") - F.col("ahead")) * 100 >= F.col("total") * percent).select("path", "line")

    candidates = rare(a).withColumnRenamed("path", "source").join(rare(b), "line").select("source", "path").distinct()
    ours = a.select(F.col("path").alias("source"), "line", F.col("bytes").alias("x"), F.col("total").alias("tx"))
    theirs = b.select("path", "line", F.col("bytes").alias("y"), F.col("total").alias("ty"))
    both = candidates.join(ours, "source").join(theirs, ["path", "line"])
    shared = both.groupBy("source", "path").agg((F.sum(F.least("x", "y")) * 100).alias("shared"), F.max(F.greatest("tx", "ty")).alias("most"))
    return shared.where(F.col("shared") >= F.col("most") * percent).select("source", "path", (F.col("shared") / F.col("most")).alias("like"))


def one_to_one(pairs: DataFrame) -> DataFrame:
    """The pairs (source, path, like) that a greedy choice keeps: the likest first, equal ones by source and path, each file once.

    In each round all pairs that are the best of both their files are chosen at
    once, which is what choosing one by one comes to; the best pair of all is
    among them, so the rounds end.
    """
    left, chosen = written(pairs, "pairs"), None
    while not left.isEmpty():
        by_source = left.groupBy("source").agg(F.min(F.struct(-F.col("like"), "path"))["path"].alias("path"))
        by_path = left.groupBy("path").agg(F.min(F.struct(-F.col("like"), "source"))["source"].alias("source"))
        best = written(left.join(by_source, ["source", "path"]).join(by_path, ["source", "path"]).select("source", "path", "like"), "best")
        chosen = best if chosen is None else chosen.unionByName(best)
        left = written(left.join(best.select("source"), "source", "left_anti").join(best.select("path"), "path", "left_anti").select("source", "path", "like"), "pairs")
    return left if chosen is None else chosen


def renames(before: DataFrame, after: DataFrame, percent: int = LIKENESS) -> DataFrame:
    """(source, path, like) of files (path, hash, content) that changed their path: equal contents first, paired by the order of their paths, then the likest of the others, each file once."""
    gone = before.join(after.select("path"), "path", "left_anti").select("path", "hash", "content")
    new = after.join(before.select("path"), "path", "left_anti").select("path", "hash", "content")
    # Copies are numbered, not multiplied: the first of one side goes with the first of the other.
    a = order.ranked(gone.select("hash", F.col("path").alias("source")), "hash", ["source"])
    b = order.ranked(new.select("hash", "path"), "hash", ["path"])
    moved = written(a.join(b, ["hash", "rank"]).select("source", "path", F.lit(100.0).alias("like")), "moved")
    rest_gone = gone.join(moved.select(F.col("source").alias("path")), "path", "left_anti")
    rest_new = new.join(moved.select("path"), "path", "left_anti")
    return moved.unionByName(one_to_one(likenesses(rest_gone, rest_new, percent)))


def changes(before: DataFrame, after: DataFrame, percent: int = LIKENESS) -> DataFrame:
    """(path, status, source) of changed paths; a renamed file is one row, under its new path."""
    moved = written(renames(before, after, percent), "renames")
    own = changed_paths(before, after).join(moved.select(F.col("source").alias("path")), "path", "left_anti")
    met = own.join(moved.select("path", "source"), "path", "left")
    return met.select("path", F.when(F.col("source").isNotNull(), "renamed").otherwise(F.col("status")).alias("status"), "source")


def block_states(asked: DataFrame, committed: DataFrame, dirty: DataFrame) -> DataFrame:
    """Each asked (path, hash) with its state: committed if its path holds it, else uncommitted if the path changed, else unknown."""
    held = committed.select("path", "hash", F.lit(True).alias("held")).distinct()
    touched = dirty.select("path", F.lit(True).alias("touched")).distinct()
    joined = asked.join(held, ["path", "hash"], "left").join(touched, "path", "left")
    return joined.select("path", "hash", F.when(F.col("held"), "committed").when(F.col("touched"), "uncommitted").otherwise("unknown").alias("state"))


def _picked(lines: Column, signs: str) -> Column:
    return F.filter(lines, lambda line: F.substring(line, 1, 1).isin(*signs))


def hunk_parts(lines: Column) -> dict[str, Column]:
    """What a hunk's lines hold: its changed lines, its context and the text after the change."""
    stripped = F.transform(_picked(lines, " +"), lambda line: F.substring(line, 2, 2**31 - 1))
    return {"diff_content": F.array_join(_picked(lines, "+-"), ""), "context": F.array_join(_picked(lines, " "), ""), "new_content": F.array_join(stripped, "")}


def hunk_changes(hunks: DataFrame, verdicts: DataFrame, covered: DataFrame | None = None, reviews: DataFrame | None = None) -> DataFrame:
    """Hunks (path, new_start, lines) with fingerprint and status; approved ones and those of covered files go.

    ``reviews`` (fingerprint, n, reviews) are added to the hunks they are of.
    """
    if covered is not None:
        hunks = hunks.join(covered.select("path"), "path", "left_anti")
    parts = hunk_parts(F.col("lines"))
    rows = hunks.select("path", "new_start", *(c.alias(n) for n, c in parts.items()))
    rows = rows.withColumn("fingerprint", fingerprint(F.col("diff_content"), F.col("context")))
    known = rows.join(verdicts, "fingerprint", "left").withColumn("status", F.coalesce("verdict", F.lit("unreviewed"))).drop("verdict")
    left = known.where(F.col("status") != "approved")
    return left if reviews is None else left.join(reviews.select("fingerprint", "reviews"), "fingerprint", "left")


def hunk_ids(lines: DataFrame) -> DataFrame:
    """Lines (path, at, line) of diffs with the number of the hunk they stand in; each header starts one."""
    upto = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("hunk", F.sum(F.col("line").startswith("@@").cast("int")).over(upto))


def header_start(line: Column) -> Column:
    return F.regexp_extract(line, r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,\d+)? @@", 1).try_cast("int")


def first_parents(commits: DataFrame, head: int, limit: int) -> DataFrame:
    """Up to ``limit`` commits from ``head`` along first parents."""
    view = f"_commits_{abs(hash((head, limit)))}"
    commits.createOrReplaceTempView(view)
    return commits.sparkSession.sql(f"WITH RECURSIVE walk(n, step) AS (SELECT n, 1 FROM {view} WHERE n = {head} UNION ALL SELECT c.first_parent, w.step + 1 FROM walk w JOIN {view} c ON c.n = w.n WHERE c.first_parent IS NOT NULL AND w.step < {limit}) SELECT w.step, c.n, c.summary FROM walk w JOIN {view} c ON c.n = w.n")


def merge_base(commits: DataFrame, a: int, b: int, step: int = 20_000) -> DataFrame:
    """The latest commit that both histories hold, null if there is none.

    Commits are numbered after their parents, so both histories are walked
    together from the latest commit down, ``step`` numbers at a time: the
    first one that both reach is the base.
    """
    held = written(commits.select("n", "first_parent", "second_parent"), "edges")
    # For each commit that is reached but not yet visited, by which tips.
    open_: dict[int, set[int]] = {}
    for side, tip in enumerate((a, b)):
        open_.setdefault(tip, set()).add(side)
    base = None
    while open_ and base is None:
        top = max(open_)
        rows = {r["n"]: (r["first_parent"], r["second_parent"]) for r in held.where(F.col("n").between(top - step + 1, top)).collect()}
        for n in range(top, top - step, -1):
            sides = open_.pop(n, set())
            if n not in rows or not sides:
                continue
            if len(sides) == 2:
                base = n
                break
            for parent in rows[n]:
                if parent is not None:
                    if parent >= n:
                        raise ValueError(f"commit {n} is not numbered after its parent {parent}")
                    open_.setdefault(parent, set()).update(sides)
    return commits.sparkSession.createDataFrame([(base,)], "base bigint")


#: Equal pairs of lines that are kept at once; above, a pair of files is cut in two first.
PAIRS = 1_000_000
#: Lines that occur as often in a file keep their mask; those of rarer ones are made when they are met.
FREQUENT = 64


def myers(before: list[str], after: list[str]) -> list[tuple[str, str]]:
    """A shortest edit script of two lists of lines as (sign, line), deletions first."""
    out, i, j = [], 0, 0
    for x, y in [*common_lines(before, after), (len(before), len(after))]:
        out += [("-", line) for line in before[i:x]]
        out += [("+", line) for line in after[j:y]]
        if x < len(before):
            out.append((" ", before[x]))
        i, j = x + 1, y + 1
    return out


def common_lines(before: list[str], after: list[str]) -> list[tuple[int, int]]:
    """The places (in the one, in the other) of a longest common subsequence, ascending.

    Equal ends and lines that only one side has are put aside first. What is
    left is solved from its equal pairs while these are few, and otherwise cut
    in two where the lengths of both halves' subsequences add up best, by rows
    of one bit a line, so memory grows with the lines and not with the changes.
    """
    ids: dict[str, int] = {}
    a, b = [[ids.setdefault(x, len(ids)) for x in lines] for lines in (before, after)]
    out, work = [], [(list(range(len(a))), list(range(len(b))))]
    while work:
        x, y = work.pop()
        lead, most = 0, min(len(x), len(y))
        while lead < most and a[x[lead]] == b[y[lead]]:
            lead += 1
        tail = 0
        while tail < most - lead and a[x[-1 - tail]] == b[y[-1 - tail]]:
            tail += 1
        out += zip(x[:lead], y[:lead])
        out += zip(x[len(x) - tail :], y[len(y) - tail :])
        x, y = x[lead : len(x) - tail], y[lead : len(y) - tail]
        known, asked = Counter(a[i] for i in x), Counter(b[j] for j in y)
        x, y = [i for i in x if a[i] in asked], [j for j in y if b[j] in known]
        if not x:
            continue
        if len(y) == 1 or sum(n * asked[v] for v, n in known.items()) <= PAIRS:
            out += [(x[i], y[j]) for i, j in _from_pairs([a[i] for i in x], [b[j] for j in y])]
            continue
        half = len(y) // 2
        cut = _cut([a[i] for i in x], [b[j] for j in y], half)
        work += [(x[:cut], y[:half]), (x[cut:], y[half:])]
    return sorted(out)


def _from_pairs(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """A longest chain of equal pairs: for every length the chain that ends earliest."""
    at = defaultdict(list)
    for j, value in enumerate(b):
        at[value].append(j)
    ends: list[int] = []
    chains: list[tuple] = []
    for i, value in enumerate(a):
        for j in reversed(at[value]):
            k = bisect_left(ends, j)
            chain = (i, j, chains[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                chains.append(chain)
            elif ends[k] != j:
                ends[k], chains[k] = j, chain
    out, chain = [], chains[-1] if chains else None
    while chain:
        out.append(chain[:2])
        chain = chain[2]
    return out[::-1]


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """For every prefix of ``a`` the length of its longest common subsequence with ``b``.

    A bit for each line of ``a`` is 0 where the length grows by one; a line of
    ``b`` updates all of them by one addition.
    """
    at = defaultdict(list)
    for i, value in enumerate(a):
        at[value].append(i)
    masks: dict[int, int] = {}

    def mask(value: int) -> int:
        if value not in masks:
            bits = np.zeros(len(a), np.uint8)
            bits[at.get(value, [])] = 1
            made = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
            if len(at.get(value, [])) < FREQUENT:
                return made
            masks[value] = made
        return masks[value]

    full = (1 << len(a)) - 1
    row = full
    for value in b:
        met = row & mask(value)
        row = ((row + met) | (row - met)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(-(-len(a) // 8), "little"), np.uint8), bitorder="little")[: len(a)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _cut(a: list[int], b: list[int], half: int) -> int:
    """Where ``a`` has to be cut so that its parts and the halves of ``b`` keep a longest common subsequence."""
    return int(np.argmax(_lengths(a, b[:half]) + _lengths(a[::-1], b[half:][::-1])[::-1]))


def unified(before: list[str], after: list[str], context: int = 3) -> Iterator[tuple[int, list[str]]]:
    """Hunks (first line after the change, lines with signs) with ``context`` lines around; those that touch are one."""
    script = myers(before, after)
    changed = [i for i, (sign, _) in enumerate(script) if sign != " "]
    i, seen, line = 0, 0, 1
    while i < len(changed):
        j = i
        while j + 1 < len(changed) and changed[j + 1] - changed[j] <= 2 * context + 1:
            j += 1
        lo, hi = max(0, changed[i] - context), min(len(script), changed[j] + context + 1)
        line += sum(sign != "-" for sign, _ in script[seen:lo])
        seen = lo
        yield line, [sign + text + "\n" for sign, text in script[lo:hi]]
        i = j + 1


def file_hunks(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, new_start, lines) of the changed files of two snapshots (path, hash, content); one file pair is the unit of work."""
    import pandas as pd

    a = before.select("path", F.col("hash").alias("h0"), F.col("content").alias("old"))
    b = after.select("path", F.col("hash").alias("h1"), F.col("content").alias("new"))
    pairs = a.join(b, "path", "full_outer").where(~F.col("h0").eqNullSafe(F.col("h1"))).select("path", "old", "new")

    def lines(text: str | None) -> list[str]:
        return [] if not text else text.removesuffix("\n").split("\n")

    def run(batches):
        for batch in batches:
            out = [(p, start, hunk) for p, old, new in zip(batch["path"], batch["old"], batch["new"]) for start, hunk in unified(lines(old), lines(new))]
            yield pd.DataFrame(out, columns=["path", "new_start", "lines"])

    return pairs.mapInPandas(run, "path string, new_start int, lines array<string>")
