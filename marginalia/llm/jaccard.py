"""Exact n-gram Jaccard self-join as a metric-space join.

Jaccard distance is a metric, and pivots part the space into regions. At the
top level pivots are one-shingle sets: a document is at distance 1 - 1/n from
the pivot of each of its own n shingles and at 1 from all others, so with ties
broken by one global order its nearest pivot is its first shingle. A document
within the limit of it can have another nearest pivot, but not beyond its
first n - ceil(similarity * n) + 1 shingles: that window is where boundary
documents are replicated to. (Document pivots can't take this place: unrelated
texts all lie at distance 1 from all of them, so windows would replicate
everything everywhere.) The order puts shingles that many documents hold last,
by counts over the whole table, so what many share parts no region; any order
gives the same result.

These regions only route documents to families. Within a region of at most
REGION documents, two belong together only if their sizes and then the counts
of their shingles in slots, a projection that does not increase the distance,
allow a link; documents connected that way are a family. Larger regions that
reach one another are a family as a whole. Every family is joined recursively
on the whole sets: pivot documents part it into Voronoi cells, a document is a
guest in each later cell whose pivot is within twice the limit of its nearest
one, and cells of more than LEAF documents are parted again. Documents that
pivots connect are a group; cells of one group end, since all their links are
implied, so a large group of near copies costs its size times its pivots.
Leaves are compared by pivots as well, whose distances exclude pairs by the
triangle inequality. What no window parts (cells whose documents are all
about as far from all pivots) is compared in blocks, again by pivots, distance
bounds and groups; there the work is the cell's size times the number of its
documents outside the largest group. Links form components, found by label
propagation with pointer jumping.

Equal sets are one node from the first step on, so groups of exact copies
cost as much as one document.

Defined cases: null and blank texts have an empty set and link with nothing;
texts of fewer words than the width are one shingle; null doc_ids count as
larger than all others. Repeated rows are rows of one node; rows that share a
doc_id, or have none, are told apart by the hash of their text. Only doc_id
and text are read. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.llm.common import WORD, WordHashes, documents, shingle_hashes, text_of, words_of, written

SLOTS = 64
REGION = 64
#: A cell of more nodes is parted by pivots; smaller ones are compared at once, by pivots too.
LEAF = 4
#: A cell of more nodes is dealt to several tasks; HALF is what each side of a comparison of blocks aims at.
BLOCK = 512
HALF = 256
#: Pivots of a cell in each round at most (the root of its size before), the rounds, and the most rows for one node that windows may make of a cell before it stays whole.
PIVOTS = 32
ROUNDS = 4
SPREAD = 2
SALTS = 32
#: A shingle met more than this often, counting tasks that meet it twice or more, is put last; at most so many are.
OFTEN = 48
LAST_AT_MOST = 1_000_000
#: Nodes of small cells that are joined together in one group.
PART = 400
#: Nodes that a task remembers to have emitted; forgetting one only repeats rows that are made distinct later.
REMEMBERED = 500_000


def need(n: int, percent: int) -> int:
    """The least overlap of a set of ``n`` with any set it links with."""
    return -(-percent * n // 100)


def names_of(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set, as two signed numbers: the first names it, the second tells sets of one first apart."""
    if not len(shingles):
        return 0, 0
    digest = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def node_of(shingles: np.ndarray, clashes: frozenset[int] = frozenset()) -> int:
    """The name of a set: the first of its two numbers, or the second where different sets share the first."""
    first, second = names_of(shingles)
    return second if first in clashes else first


def ordered(shingles: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Ascending hashes with those in ``last`` (ascending) moved to the end."""
    if not len(last):
        return shingles
    at = np.searchsorted(last, shingles)
    at[at == len(last)] = 0
    often = last[at] == shingles
    return np.concatenate([shingles[~often], shingles[often]]) if often.any() else shingles


def _texts(batches):
    for batch in batches:
        *keys, texts = batch.columns
        for key, text in zip(zip(*(x.to_pylist() for x in keys)), texts):
            yield key, text.as_py()


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, h, text): the rows by what they are told apart by."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text_of()).alias("h"), text_of().alias("text"))


def _least():
    """The least (doc_id, h) of a group, null doc_ids last."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h"))


def surveyed(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Rows (doc_id, h, n, node, check, null, slots) for documents and (null, null, count, null, null, shingle, null) for shingles.

    Counts are of the different sets of a task, for every shingle that a task
    meets twice or that stands in a window of hash order; so what crowds the
    regions is counted over the whole table. Slot counts come with the first
    document of a node in each task.
    """
    names = ["doc_id", "h", "n", "node", "check", "shingle", "slots"]

    def run(batches):
        hashes, seen, held, windows, size = WordHashes(), set(), [], [], 0
        out: list[tuple] = []

        def tally():
            if held:
                value, count = np.unique(np.concatenate(held), return_counts=True)
                keep = count > 1
                if windows:
                    keep[np.searchsorted(value, np.unique(np.concatenate(windows)))] = True
                none = pa.nulls(int(keep.sum()), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, pa.array(count[keep].astype(np.int64)), none, none, pa.array(value[keep].view(np.int64)), pa.nulls(len(none), pa.binary())], names)

        def flush():
            doc, h, n, node, check, slots = zip(*out)
            return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (doc, h, n, node, check)), pa.nulls(len(doc), pa.int64()), pa.array(slots, pa.binary())], names)

        for (doc, h), text in _texts(batches):
            shingles = shingle_hashes(words_of(text), width, hashes)
            node, check = names_of(shingles)
            new = node not in seen and len(shingles) > 0
            out.append((doc, h, len(shingles), node, check, slots_of(shingles) if new else None))
            if new:
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(node)
                held.append(shingles)
                if can_link(len(shingles), percent):
                    windows.append(shingles[: len(shingles) - need(len(shingles), percent) + 1])
                size += len(shingles)
            if len(out) >= 5000:
                yield flush()
                out = []
            if size >= 5_000_000:
                yield from tally()
                held, windows, size = [], [], 0
        if out:
            yield flush()
        yield from tally()

    return written(_keyed(docs).mapInArrow(run, "doc_id bigint, h bigint, n bigint, node bigint, check bigint, shingle bigint, slots binary"), "survey")


def can_link(n: int, percent: int) -> bool:
    """Whether a set of ``n`` can link with another one: n / (n + 1) has to reach the limit."""
    return 100 * n >= percent * (n + 1)


def regions(docs: DataFrame, width: int, percent: int, last: np.ndarray, clashes: frozenset[int]) -> DataFrame:
    """(shingle, node, n): every set in the region of each shingle in its window."""
    sent = docs.sparkSession.sparkContext.broadcast(last)

    def run(batches):
        hashes, seen, shingle, node, n, rows = WordHashes(), set(), [], [], [], 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(shingle).view(np.int64)), pa.array(np.repeat(node, list(map(len, shingle)))), pa.array(np.repeat(n, list(map(len, shingle))))], ["shingle", "node", "n"])

        for _, text in _texts(batches):
            own = shingle_hashes(words_of(text), width, hashes)
            if not can_link(len(own), percent):
                continue
            name = node_of(own, clashes)
            if name in seen:
                continue
            if len(seen) >= REMEMBERED:
                seen.clear()
            seen.add(name)
            shingle.append(ordered(own, sent.value)[: len(own) - need(len(own), percent) + 1])
            node.append(name)
            n.append(len(own))
            rows += len(shingle[-1])
            if rows >= 200_000:
                yield flush()
                shingle, node, n, rows = [], [], [], 0
        if rows:
            yield flush()

    rows = docs.select(F.lit(0).alias("x"), text_of().alias("text"))
    return rows.mapInArrow(run, "shingle bigint, node bigint, n bigint").repartition("shingle").dropDuplicates(["shingle", "node"])


def sets_of(texts: DataFrame, width: int, clashes: frozenset[int]) -> DataFrame:
    """(node, shingles) of rows (node, text) whose text has that node: hashes as bytes."""

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                made = [(node, shingle_hashes(words_of(t.as_py()), width, hashes)) for node, t in zip(part.column(0).to_pylist(), part.column(1))]
                made = [(node, x) for node, x in made if node == node_of(x, clashes)]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in made], pa.int64()), pa.array([x.tobytes() for _, x in made], pa.binary())], ["node", "shingles"])

    return texts.mapInArrow(run, "node bigint, shingles binary")


def slots_of(shingles: np.ndarray) -> bytes:
    """Counts of the hashes in 64 slots or, in large sets, in enough slots for 16 or fewer in each; 255 stands for more."""
    slots = SLOTS
    while slots * 16 < len(shingles):
        slots *= 2
    return np.minimum(np.bincount((shingles & np.uint64(slots - 1)).astype(np.int64), minlength=slots), 255).astype(np.uint8).tobytes()


def overlap_bound(s: bytes, t: bytes) -> int:
    """No less than the overlap of two sets with these slot counts; the finer counts are folded to the coarser ones."""
    x, y = (np.frombuffer(v, np.uint8).astype(np.int64) for v in sorted((s, t), key=len))
    if (x == 255).any() or (y == 255).any():
        return 2**62
    return int(np.minimum(x, y.reshape(-1, len(x)).sum(0)).sum())


def near(pairs: DataFrame, percent: int) -> DataFrame:
    """Keeps (a, b) of (a, b, n, m, s, t) whose slot counts allow the overlap."""

    def run(batches):
        for batch in batches:
            n, m, s, t = (batch.column(i).to_pylist() for i in (2, 3, 4, 5))
            keep = pa.array([(100 + percent) * overlap_bound(w, x) >= percent * (u + v) for u, v, w, x in zip(n, m, s, t)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return pairs.mapInArrow(run, "a bigint, b bigint")


def sized_pairs(shared: DataFrame, percent: int) -> DataFrame:
    """Distinct (a, b, na, nb), a < b, of (shingle, node, n) that share a region and whose sizes allow a link."""
    a = shared.select("shingle", F.col("node").alias("a"), F.col("n").alias("na"))
    b = shared.select("shingle", F.col("node").alias("b"), F.col("n").alias("nb"))
    met = a.join(b, "shingle").where((F.col("a") < F.col("b")) & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")))
    return met.select("a", "b", "na", "nb").distinct()


def families(crowded: DataFrame) -> DataFrame:
    """(node, root): the nodes of large regions by the regions they reach through one another."""
    # A region of very many nodes is dealt to SALTS tasks.
    hubs = crowded.groupBy("shingle").agg(F.min("node").alias("hub")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = crowded.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    return components(dealt.join(hubs, ["shingle", "salt"]).select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct())


class Forest:
    """Disjoint sets over 0 to n-1."""

    def __init__(self, n: int):
        self.above = np.arange(n)

    def root(self, x: int) -> int:
        above = self.above
        while above[x] != x:
            above[x] = above[above[x]]
            x = above[x]
        return int(x)

    def roots(self) -> np.ndarray:
        """The root of every element at once."""
        while (nearer := self.above[self.above]).tobytes() != self.above.tobytes():
            self.above = nearer
        return self.above


def overlaps(sets: list[np.ndarray]):
    """A function from a set's place to its overlaps with all sets."""
    code = np.unique(np.concatenate(sets), return_inverse=True)[1].reshape(-1)
    start = np.concatenate([[0], np.cumsum([len(x) for x in sets])[:-1]])
    mark = np.zeros(int(code.max()) + 1, bool)

    def of(p: int) -> np.ndarray:
        own = code[start[p] : start[p] + len(sets[p])]
        mark[own] = True
        shared = np.add.reduceat(mark[code], start)
        mark[own] = False
        return shared

    return of


def pivot_links(sets: list[np.ndarray], side: np.ndarray, percent: int, group: np.ndarray | None = None, kept: int = 8) -> list[tuple[int, int]]:
    """Links that connect the same sets as all links between the two sides do (or within one, if there is but one).

    Sets of the same ``group`` (0 or more) are connected already. Each set in
    turn is a pivot. Its distance to earlier pivots bounds that to any other
    set from below, by the triangle inequality; only sets that no bound
    excludes and that are not connected with it yet are compared.
    """
    size = np.array([len(x) for x in sets])
    shared_with = overlaps(sets)
    limit = 1 - percent / 100 + 1e-9
    cross = len(np.unique(side)) > 1
    forest, known, out = Forest(len(sets)), [], []
    if group is not None:
        for g in np.unique(group[group >= 0]):
            own = np.nonzero(group == g)[0]
            forest.above[own] = own[0]
    for p in range(len(sets)):
        if cross and side[p] != side.min():
            continue
        root = forest.roots()
        open_ = (root != root[p]) & (100 * np.minimum(size, size[p]) >= percent * np.maximum(size, size[p]))
        if cross:
            open_ &= side != side[p]
        else:
            open_[:p] = False
        for distance in known:
            open_ &= np.abs(distance - distance[p]) <= limit
        if not open_.any() and len(known) >= kept:
            continue
        shared = shared_with(p)
        union = size + size[p] - shared
        if len(known) < kept:
            known.append(1 - shared / union)
        for x in np.nonzero(open_ & (100 * shared >= percent * union))[0]:
            a, b = forest.root(p), forest.root(int(x))
            if a != b:
                forest.above[max(a, b)] = min(a, b)
                out.append((p, int(x)))
    return out


def pivots_of(cells: DataFrame, turn: int) -> DataFrame:
    """The cells' rows that become pivots, numbered by ``q``."""
    # Nodes that no pivot has reached yet come first; the least by a hash are as good as random ones.
    order = Window.partitionBy("cell").orderBy(F.col("grp") != 0, F.xxhash64("node", F.lit(turn)), "node")
    # With a fixed limit of its own each task hands on PIVOTS rows of a cell at most, however large the cell is.
    return cells.where("own").withColumn("r", F.row_number().over(order)).where((F.col("r") <= PIVOTS) & (F.col("r") <= F.ceil(F.sqrt("size")) + 1)).withColumn("q", F.col("r") - 1)


def parted(cells: DataFrame, sets: DataFrame, percent: int, turn: int) -> DataFrame:
    """One round over large cells (node, cell, own, grp, size), grp 0 for no group: rows of what its pivots tell.

    ``link`` rows (node, other) are links to pivots; ``join`` rows (node,
    other) are pivots of ``cell`` found connected; ``place`` rows put a node
    into the regions ``at`` of pivots, ``home`` its nearest one, with the pivot
    it links with, if any, as ``other``. A node of the cell goes to its nearest
    pivot and, as a guest, to each later one that is no farther than twice the
    limit beyond: by the triangle inequality two linked nodes of different
    regions meet in the later one. Guests go to all such regions. One row
    holds the home and one all other regions: of near copies these are many.
    """
    parts = F.ceil(F.col("size") / BLOCK).cast("int")
    sent = pivots_of(cells, turn).select("cell", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "node", "own", F.lit(0).cast("bigint").alias("grp"), "q")
    own = cells.select("cell", F.pmod(F.xxhash64("node"), parts).cast("int").alias("part"), "node", "own", "grp", F.lit(-1).alias("q"))
    rows = own.unionByName(sent).join(sets, "node")
    window = 2 * (1 - percent / 100) + 1e-9
    columns = ["kind", "cell", "node", "other", "home", "own", "grp", "at"]

    def run(unit: pd.DataFrame) -> pd.DataFrame:
        unit = unit.sort_values(["q", "node"]).reset_index(drop=True)
        cell = int(unit["cell"].iat[0])
        is_pivot = unit["q"].to_numpy() >= 0
        pivot, rest = np.nonzero(is_pivot)[0], np.nonzero(~is_pivot)[0]
        node = unit["node"].to_numpy()
        held = [np.frombuffer(x, np.uint64) for x in unit["shingles"]]
        size = np.array([len(x) for x in held])
        shared_with = overlaps(held)
        distance, linked = np.empty((len(pivot), len(held))), np.empty((len(pivot), len(held)), bool)
        for k, p in enumerate(pivot):
            shared = shared_with(p)
            union = size + size[p] - shared
            distance[k], linked[k] = 1 - shared / union, 100 * shared >= percent * union
        forest, out = Forest(len(held)), []

        def united(a: int, b: int) -> bool:
            x, y = forest.root(a), forest.root(b)
            forest.above[max(x, y)] = min(x, y)
            return x != y

        for x in range(len(held)):
            for k in np.nonzero(linked[:, x])[0]:
                if pivot[k] != x and node[pivot[k]] != node[x] and united(int(pivot[k]), x):
                    out.append(("link", cell, node[x], node[pivot[k]], -1, False, 0, []))
        root = forest.roots()
        for k in range(1, len(pivot)):
            for j in range(k):
                if root[pivot[k]] == root[pivot[j]]:
                    out.append(("join", cell, node[pivot[k]], node[pivot[j]], -1, False, 0, []))
                    break
        number, done = unit["q"].to_numpy(), set(node[pivot].tolist())
        own, grp = unit["own"].to_numpy(), unit["grp"].to_numpy()
        for x in rest:
            # A pivot has been compared with its whole cell.
            if int(node[x]) in done:
                continue
            d = distance[:, x]
            home = int(np.argmin(d))
            near = next((int(node[pivot[k]]) for k in np.nonzero(linked[:, x])[0]), None)
            placed = ("place", cell, int(node[x]), near, int(number[pivot[home]]))
            out.append((*placed, bool(own[x]), int(grp[x]), [int(number[pivot[home]])]))
            at = [int(number[pivot[k]]) for k in np.nonzero(d <= d[home] + window)[0] if k > home or (k != home and not own[x])]
            if at:
                out.append((*placed, False, int(grp[x]), at))
        # Column by column: rows with and without a number together would make doubles of it, which don't hold 64 bits.
        kinds = ("int64", "int64", "Int64", "int32", "bool", "int64", object)
        values = list(zip(*out)) or [()] * len(columns)
        return pd.DataFrame({"kind": pd.Series(values[0], dtype=object)} | {c: pd.Series(list(v), dtype=t) for c, v, t in zip(columns[1:], values[1:], kinds)})

    return rows.groupBy("cell", "part").applyInPandas(run, "kind string, cell bigint, node bigint, other bigint, home int, own boolean, grp bigint, at array<int>")


def named_alike(joins: DataFrame) -> DataFrame:
    """(cell, other, grp): for pivots of a cell the least of those they are connected with; a cell has few pivots."""

    def run(cell: pd.DataFrame) -> pd.DataFrame:
        names, at = np.unique(np.concatenate([cell["node"], cell["other"]]), return_inverse=True)
        forest, n = Forest(len(names)), len(cell)
        for a, b in zip(at[:n], at[n:]):
            x, y = forest.root(int(a)), forest.root(int(b))
            forest.above[max(x, y)] = min(x, y)
        return pd.DataFrame({"cell": cell["cell"].iat[0], "other": names, "name": names[forest.roots()]})

    return joins.select("cell", "node", "other").distinct().groupBy("cell").applyInPandas(run, "cell bigint, other bigint, name bigint")


def mixed_cells(cells: DataFrame) -> DataFrame:
    """The cells (with ``size``) that hold nodes not yet known to be connected, not all of them guests."""
    kept = cells.groupBy("cell").agg(F.count("*").alias("size"), F.bool_or(F.col("grp") == 0).alias("open"), F.min("grp").alias("low"), F.max("grp").alias("high"), F.bool_or("own").alias("any"))
    kept = kept.where((F.col("size") > 1) & F.col("any") & (F.col("open") | (F.col("low") != F.col("high")))).select("cell", "size")
    return cells.select("node", "cell", "own", "grp").join(kept, "cell")


def family_links(family: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) links that connect each family as all its links do.

    A family is a cell. While a cell has more than LEAF nodes, pivots part it into Voronoi
    regions, which are cells in turn; where the windows would repeat its nodes
    too often, it stays whole and only loses its pivots. Nodes that pivots
    connect form groups, and cells of one group end. What is left after
    ROUNDS is joined in blocks, all nodes against those outside the cell's
    largest group.
    """
    cells = written(mixed_cells(family.select("node", F.xxhash64("root").alias("cell"), F.lit(True).alias("own"), F.lit(0).cast("bigint").alias("grp"))), "cells")
    found, leaves = [], [cells.where(F.col("size") <= LEAF)]
    for turn in range(ROUNDS):
        large = cells.where(F.col("size") > LEAF)
        if large.isEmpty():
            break
        told = written(parted(large, sets, percent, turn), "parted")
        found.append(told.where("kind = 'link'").select(F.col("node").alias("a"), F.col("other").alias("b")))
        names = named_alike(told.where("kind = 'join'"))
        place = told.where("kind = 'place'").withColumn("stays", F.array_contains("at", F.col("home")))
        spread = place.groupBy("cell").agg((F.sum(F.size("at")) <= SPREAD * F.count_if("stays")).alias("split"))
        # Only cells that are split get a row for each region: at most SPREAD for a node on average.
        placed = place.join(spread, "cell").where("split OR stays").join(names, ["cell", "other"], "left")
        placed = placed.withColumn("grp", F.coalesce("name", "other", "grp")).withColumn("q", F.explode("at"))
        region = F.when(F.col("split"), F.xxhash64("cell", "q", F.lit(turn))).otherwise(F.col("cell"))
        # In a cell that stays whole, what was a guest stays one.
        cells = written(mixed_cells(placed.select("node", region.alias("cell"), "own", "grp")), "cells")
        leaves.append(cells.where(F.col("size") <= LEAF))
    else:
        leaves.append(cells.where(F.col("size") > LEAF))
    every = leaves[0]
    for x in leaves[1:]:
        every = every.unionByName(x)
    found.append(block_links(every, sets, percent))
    links = found[0]
    for x in found[1:]:
        links = links.unionByName(x)
    return links


def block_links(cells: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) links that connect each cell as all its links do: blocks of all nodes against blocks of those outside the largest group."""
    main = cells.groupBy("cell").agg(F.mode(F.when(F.col("grp") != 0, F.col("grp"))).alias("main"))
    rows = cells.join(main, "cell").withColumn("odd", ~F.col("grp").eqNullSafe(F.col("main")))
    count = rows.where("odd").groupBy("cell").agg(F.count("*").alias("odds"))
    rows = rows.join(count, "cell")
    whole = F.col("size") <= BLOCK
    across = F.when(whole, 1).otherwise(F.ceil(F.col("odds") / HALF)).cast("int")
    down = F.when(whole, 1).otherwise(F.ceil(F.col("size") / HALF)).cast("int")
    deal = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    each = rows.select("cell", "node", "grp", whole.alias("whole"), F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), across - 1)).alias("i"), deal(down).alias("j"))
    odd = rows.where(F.col("odd") & ~whole).select("cell", "node", "grp", whole.alias("whole"), F.lit(0).alias("side"), deal(across).alias("i"), F.explode(F.sequence(F.lit(0), down - 1)).alias("j"))
    # Small cells share a group, so there are no more groups than the rows ask for.
    packs = max(1, cells.where(whole).count() // PART)
    pack = F.when(F.col("whole"), F.pmod(F.xxhash64("cell"), F.lit(packs))).otherwise(F.col("cell"))
    units = each.unionByName(odd).withColumn("pack", pack).join(sets, "node")

    def run(units: pd.DataFrame) -> pd.DataFrame:
        found = [links_of(unit) for _, unit in units.groupby("cell", sort=False)]
        return pd.concat(found) if found else pd.DataFrame({"a": [], "b": []}).astype("int64")

    def links_of(unit: pd.DataFrame) -> pd.DataFrame:
        unit = unit.drop_duplicates(["node", "side"]).sort_values(["side", "node"]).reset_index(drop=True)
        side, node = unit["side"].to_numpy(), unit["node"].to_numpy()
        if side.all() and not unit["whole"].iat[0]:
            return pd.DataFrame({"a": [], "b": []}).astype("int64")
        grp = unit["grp"].to_numpy()
        group = np.where(grp == 0, -1, np.unique(grp, return_inverse=True)[1].reshape(-1))
        links = pivot_links([np.frombuffer(x, np.uint64) for x in unit["shingles"]], side, percent, group)
        links = [(node[x], node[y]) for x, y in links if node[x] != node[y]]
        return pd.DataFrame({"a": [x for x, _ in links], "b": [y for _, y in links]}).astype("int64")

    return units.groupBy("whole", "pack", "i", "j").applyInPandas(run, "a bigint, b bigint")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): for every node of a link the smallest node it can reach.

    Labels move to the least neighbour's label, then to their label's label,
    until nothing changes; each round is written, so a lost executor costs one.
    """
    both = written(links.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(links.select(F.col(b).alias("u"), F.col(a).alias("v"))).distinct(), "links")
    label = written(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("root")), "labels")
    while True:
        heard = both.join(label.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("root").alias("least"))
        moved = label.join(heard, "node").select("node", F.col("root").alias("was"), F.least("root", "least").alias("root"))
        jump = label.select(F.col("node").alias("root"), F.col("root").alias("on"))
        fresh = written(moved.join(jump, "root", "left").select("node", "was", F.least("root", F.coalesce("on", "root")).alias("root")), "labels")
        label = fresh.select("node", "root")
        if not fresh.where("was <> root").limit(1).count():
            return label


def named(rows: DataFrame) -> tuple[DataFrame, frozenset[int]]:
    """Rows of documents with their nodes' final names, and the first numbers that different sets share.

    Of n sets some n * n / 2**65 pairs share a number: a few in ten thousand
    million, so the driver holds few.
    """
    shared = rows.groupBy("node").agg(F.min("check").alias("low"), F.max("check").alias("high")).where("low <> high")
    clashes = frozenset(x["node"] for x in shared.select("node").collect())
    if not clashes:
        return rows, clashes
    return rows.withColumn("node", F.when(F.col("node").isin(*clashes), F.col("check")).otherwise(F.col("node"))), clashes


def joined(docs: DataFrame, width: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Membership (doc_id, h, n, node), links (a, b) between nodes and components (node, root) of the whole table."""
    survey = surveyed(docs, width, percent)
    members, clashes = named(survey.where("node is not null"))
    often = survey.where("shingle is not null").groupBy("shingle").agg(F.sum("n").alias("c")).where(F.col("c") > OFTEN)
    # At most LAST_AT_MOST values of 8 bytes pass the driver; which ones are put last never changes the result.
    last = np.sort(np.array([x["shingle"] for x in often.orderBy(F.desc("c"), "shingle").limit(LAST_AT_MOST).select("shingle").collect()], np.int64).view(np.uint64))
    together = F.count("*").over(Window.partitionBy("shingle"))
    shared = written(regions(docs, width, percent, last, clashes).withColumn("c", together).where("c > 1"), "regions")
    pairs = written(sized_pairs(shared.where(F.col("c") <= REGION), percent), "pairs")
    family = written(families(shared.where(F.col("c") > REGION)), "families")
    slots = members.where("slots is not null").groupBy("node").agg(F.first("slots").alias("slots"))
    each = pairs.join(slots.select(F.col("node").alias("a"), F.col("slots").alias("sa")), "a").join(slots.select(F.col("node").alias("b"), F.col("slots").alias("sb")), "b")
    close = written(near(each.select("a", "b", "na", "nb", "sa", "sb"), percent), "close")
    # What small regions leave as near is a family as well: its cells, not its pairs, are compared in whole.
    family = written(family.unionByName(components(close).select("node", F.xxhash64("root", F.lit("close")).alias("root"))), "cells")
    # The text of one document of each node that has to be compared in whole.
    asked = family.select("node").distinct()
    kept = asked.join(members.groupBy("node").agg(_least().alias("first")), "node").select("node", F.col("first.doc_id").alias("kept_id"), F.col("first.h").alias("kept_h"))
    # Merged at every size: these nodes grow with the documents, so they are not broadcast while they are few.
    texts = _keyed(docs).join(kept.hint("merge"), F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("h") == F.col("kept_h"))).select("node", "text")
    sets = written(sets_of(texts, width, clashes), "sets")
    links = written(family_links(family, sets, percent), "links")
    return members.select("doc_id", "h", "n", "node"), links, components(links)


def grouped(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, h, n, node, key) of the whole table and (key, first): the least (doc_id, h) of each component."""
    members, _, label = joined(docs, width, percent)
    keyed = members.join(label, "node", "left").select("doc_id", "h", "n", "node", F.coalesce("root", "node").alias("key"))
    return keyed, keyed.where("n > 0").groupBy("key").agg(_least().alias("first"))


def classes(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, node) of every row; component_id is the least doc_id that links reach."""
    keyed, firsts = grouped(docs, width, percent)
    own = F.when(F.col("n") > 0, F.col("first.doc_id")).otherwise(F.col("doc_id"))
    return keyed.join(firsts, "key", "left").select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), "node")


def representatives(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each component does: the least by (doc_id, hash of the text), null doc_ids last.

    Documents without a component of others stay; rows that repeat the staying
    doc_id and text stay with it. Rows of equal texts without a doc_id are
    copies, not repeats: one of them stays.
    """
    keyed, firsts = grouped(docs, width, percent)
    other = ~F.col("doc_id").eqNullSafe(F.col("first.doc_id")) | (F.col("h") != F.col("first.h"))
    gone = written(keyed.where("n > 0").join(firsts, "key").where(other).select(F.col("doc_id").alias("_gone"), F.col("h").alias("_h")).distinct(), "gone")

    def left(rows: DataFrame) -> DataFrame:
        return rows.join(gone, F.col("doc_id").cast("bigint").eqNullSafe(F.col("_gone")) & (F.xxhash64(text_of()) == F.col("_h")), "left_anti")

    unnamed = F.col("doc_id").isNull() & F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    copies = left(docs.where(unnamed)).groupBy(F.col("text").alias("_text")).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("_row")).select("_row.*")
    return left(docs.where(~unnamed)).unionByName(copies)


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(documents(spark, sf_dir).select("doc_id", "text"), 4, 85).drop("node")


OP8_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(generate_series(1, len(w) - 3), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS g
  FROM w
),
n AS (SELECT doc_id, len(g) AS n FROM s),
e AS (SELECT doc_id, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
ways AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, b.y FROM reach r JOIN ways b ON b.x = r.other)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, min(other)::BIGINT AS component_id FROM n JOIN reach USING (doc_id) GROUP BY n.doc_id, n.n
"""
