"""Vector code compression: product codes, their nearest entries found by vantage-point trees.

A vector's components become integers (floor of 1024 times the component) and
the vector is cut into PARTS consecutive parts; each part position has a
codebook of ENTRIES entries, and a part's code is its nearest entry's index.
Codebooks start as the parts of the vectors of least vec_id; ROUNDS times all
parts are assigned and entries become their parts' floored means.

Nearest entries come from a vantage-point tree over each codebook: a node
parts its entries by their distance from one of them, a child knows the least
and the greatest of these distances, rounded outwards to integers, and by the
triangle inequality is visited unless it lies farther than the best entry so
far. A child that could hold an equally near entry is visited as well, since
ties go to the lower index. Distances are compared squared, as integers, so
no rounding decides. Many parts go down a tree together.

A round moves one row for each part position and entry from every task: count
and componentwise sum. Codebooks (PARTS * ENTRIES entries) pass the driver.

Defined cases: rows whose vector is null or holds null or non-finite
components are dropped; so are vectors that are not as long as most kept ones
(of equally many the longer), which can't be compared. A part is empty if
there are more parts than components, and lengths that PARTS doesn't divide
give parts whose lengths differ by one. Rows of one vec_id are ordered by
their vector, null ids come last; equal rows count each. Null labels are one
label. Fewer vectors than ENTRIES give fewer entries. Components too large for
squared distances in 64 bits (for parts of 16: above 2^28 after scaling) are
an error. Only vec_id, label and embedding are read. An empty table gives an
empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import written

SCALE = 1024
PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Entries that a leaf of a tree holds at most, unless they are equally far from one of them.
LEAF = 10
#: Labels whose sums go to every task; of more, they are joined.
BROADCAST_LABELS = 100_000


@dataclass
class Node:
    """Entries (indices, ascending) of a leaf; or a vantage entry, the squared distance that parts its children, and each child with its range of distances."""

    entries: np.ndarray
    split: int = 0
    children: tuple = ()


class Tree:
    """A vantage-point tree over integer vectors; ``compared`` counts the distances it has taken."""

    def __init__(self, entries: np.ndarray):
        self.entries, self.compared = entries, 0
        self._most = int(np.abs(entries).max(initial=0))
        # Of equal entries only the first can be an answer.
        first = {row.tobytes(): i for i, row in reversed(list(enumerate(entries)))}
        self.root = self._built(np.array(sorted(first.values()), np.int64))

    def _built(self, own: np.ndarray) -> Node:
        if len(own) <= LEAF:
            return Node(own)
        # A vantage at the rim spreads the distances: the entry farthest from the first.
        vantage = own[np.argmax(_squares(self.entries[own], self.entries[own[:1]])[:, 0])]
        rest = own[own != vantage]
        far = _squares(self.entries[rest], self.entries[vantage : vantage + 1])[:, 0]
        split = int(np.sort(far)[(len(far) - 1) // 2])
        near = far <= split
        if near.all():
            return Node(own)
        children = tuple((isqrt(int(far[m].min())), _ceil_root(int(far[m].max())), self._built(rest[m])) for m in (near, ~near))
        return Node(np.array([vantage]), split, children)

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query the index of its nearest entry, the lowest of equally near ones, and the squared distance."""
        # Integers all the same: while no sum passes 2**52, doubles hold them exactly and multiply faster.
        most = max(self._most, int(np.abs(queries).max(initial=0)))
        kind = np.float64 if 4 * most * most * queries.shape[1] < 2**52 else np.int64
        self._queries, self._held = queries.astype(kind), self.entries.astype(kind)
        self._norms, self._held_norms = (self._queries**2).sum(axis=1), (self._held**2).sum(axis=1)
        self._best = np.full(len(queries), 2**62, kind)
        self._index = np.full(len(queries), len(self.entries), np.int64)
        every = np.arange(len(queries))
        self._descend(self.root, every)
        self._visit(self.root, every)
        return self._index, self._best.astype(np.int64)

    def _verify(self, entries: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Distances of the queries ``at`` to ``entries``; better ones become the best."""
        found = self._norms[at][:, None] + self._held_norms[entries] - 2 * (self._queries[at] @ self._held[entries].T)
        self.compared += found.size
        column = found.argmin(axis=1)
        least, index = found[np.arange(len(at)), column], entries[column]
        better = (least < self._best[at]) | ((least == self._best[at]) & (index < self._index[at]))
        self._best[at[better]], self._index[at[better]] = least[better], index[better]
        return found

    def _descend(self, node: Node, at: np.ndarray) -> None:
        """Every query down to one leaf, on the side where it lies: a first bound."""
        if not len(at):
            return
        found = self._verify(node.entries, at)
        if node.children:
            near = found[:, 0] <= node.split
            for side, (_, _, child) in zip((near, ~near), node.children):
                self._descend(child, at[side])

    def _visit(self, node: Node, at: np.ndarray) -> None:
        """All that could hold an entry as near as the best."""
        if not len(at):
            return
        found = self._verify(node.entries, at)
        if node.children:
            low, high = _roots(found[:, 0])
            for least, greatest, child in node.children:
                gap = np.maximum(low - greatest, least - high)
                self._visit(child, at[(gap <= 0) | (gap * gap <= self._best[at])])


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of every row of ``a`` to every row of ``b``."""
    return (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)


def _ceil_root(square: int) -> int:
    root = isqrt(square)
    return root + (root * root < square)


def _roots(squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Integer square roots, rounded down and up."""
    squares = squares.astype(np.int64)
    low = np.sqrt(squares).astype(np.int64)
    low -= low * low > squares
    low += (low + 1) * (low + 1) <= squares
    return low, low + (low * low < squares)


def bounds(width: int, parts: int = PARTS) -> list[tuple[int, int]]:
    return [(width * p // parts, width * (p + 1) // parts) for p in range(parts)]


def integers(batch: pa.RecordBatch, column: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a batch are kept, and their vectors as integers."""
    vectors = batch.column(column)
    sizes = np.diff(np.asarray(vectors.offsets))
    fit = np.asarray(vectors.is_valid()) & (sizes == width)
    values = vectors.filter(pa.array(fit)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(int(fit.sum()), width)
    finite = np.isfinite(values).all(axis=1)
    fit[fit] = finite
    scaled = np.floor(values[finite] * SCALE)
    # So that no squared distance passes 62 bits.
    if scaled.size and np.abs(scaled).max() > isqrt(2**60 // max(1, -(-width // PARTS))):
        raise ValueError("a component is too large for squared distances in 64 bits")
    return fit, scaled.astype(np.int64)


def usable() -> Column:
    """Whether a vector has finite components only."""
    return F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def vectors_of(table: DataFrame) -> DataFrame:
    return table.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))


def width_of(vectors: DataFrame) -> int | None:
    """The length that most vectors have; None without any."""
    most = vectors.where(usable()).groupBy(F.size("embedding").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).first()
    return None if most is None else most["w"]


def first_codebooks(vectors: DataFrame, width: int, entries: int = ENTRIES) -> list[np.ndarray]:
    """The parts of the vectors of least vec_id."""
    least = vectors.where(usable() & (F.size("embedding") == width)).orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).select("embedding").toArrow().combine_chunks()
    found = [integers(b, 0, width)[1] for b in least.to_batches()]
    whole = np.concatenate(found) if found else np.empty((0, width), np.int64)
    return [whole[:, a:b] for a, b in bounds(width)]


def refined(vectors: DataFrame, width: int, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round; entries without parts stay."""
    longest = max(b - a for a, b in bounds(width))

    def run(batches: Iterator[pa.RecordBatch]):
        trees = [Tree(b) for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        sums = [np.zeros(b.shape, np.int64) for b in books]
        for batch in batches:
            _, rows = integers(batch, 0, width)
            for p, (a, b) in enumerate(bounds(width)):
                part = np.ascontiguousarray(rows[:, a:b])
                index, _ = trees[p].nearest(part)
                np.add.at(counts[p], index, 1)
                np.add.at(sums[p], index, part)
        rows = [(p, i, int(n), [*map(int, s), *[0] * (longest - len(s))]) for p in range(len(books)) for i, (n, s) in enumerate(zip(counts[p], sums[p])) if n]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())))], ["part", "entry", "n", "s"])

    each = vectors.select("embedding").mapInArrow(run, "part int, entry int, n bigint, s array<bigint>")
    total = F.array(*(F.sum(F.get("s", F.lit(i)).cast("decimal(38,0)")) for i in range(longest))) if longest else F.array().cast("array<decimal(38,0)>")
    out = [b.copy() for b in books]
    # PARTS * ENTRIES rows at most.
    for row in each.groupBy("part", "entry").agg(F.sum("n").alias("n"), total.alias("s")).collect():
        book = out[row["part"]]
        book[row["entry"]] = [int(x) // row["n"] for x in row["s"][: book.shape[1]]]
    return out


def codebooks(vectors: DataFrame, width: int, rounds: int = ROUNDS, entries: int = ENTRIES) -> list[np.ndarray]:
    books = first_codebooks(vectors, width, entries)
    for _ in range(rounds if len(books[0]) else 0):
        books = refined(vectors, width, books)
    return books


def encoded(vectors: DataFrame, width: int, books: list[np.ndarray]) -> DataFrame:
    """(vec_id, label, code, error) of every kept vector."""
    kinds = dict(vectors.dtypes)
    ids = vectors.select("vec_id", "label", "embedding")

    def run(batches: Iterator[pa.RecordBatch]):
        trees = [Tree(b) for b in books]
        for batch in batches:
            fit, rows = integers(batch, 2, width)
            codes, errors = [], np.zeros(len(rows), np.int64)
            for p, (a, b) in enumerate(bounds(width)):
                index, square = trees[p].nearest(np.ascontiguousarray(rows[:, a:b]))
                codes.append(index)
                errors += square
            names = ["".join(f"{i:02x}" for i in code) for code in zip(*(c.tolist() for c in codes))]
            kept = pa.array(fit)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept), pa.array(names, pa.string()), pa.array(errors)], ["vec_id", "label", "code", "error"])

    return ids.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error bigint")


def decoded(code: str, books: list[np.ndarray]) -> np.ndarray:
    """The integer vector that a code stands for."""
    return np.concatenate([book[int(code[2 * p : 2 * p + 2], 16)] for p, book in enumerate(books)])


def books_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()


def compressed(table: DataFrame) -> DataFrame:
    """Every kept vector with its code, its error, its label's error and the digest of the codebooks."""
    vectors = vectors_of(table)
    kinds = dict(vectors.dtypes)
    width = width_of(vectors)
    if width is None:
        return table.sparkSession.createDataFrame([], f"vec_id {kinds['vec_id']}, code string, error bigint, label_error bigint, codebooks_sha256 string")
    books = codebooks(vectors, width)
    # Written: read for the sums as well as for the rows.
    codes = written(encoded(vectors, width, books), "codes")
    sums = codes.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error"))
    if sums.count() <= BROADCAST_LABELS:
        sums = F.broadcast(sums)
    met = codes.join(sums, F.col("label").eqNullSafe(F.col("l")))
    return met.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _assigned(book: str) -> str:
    near = "list_inner_product(v, v) + list_inner_product(c, c) - 2 * list_inner_product(v, c)"
    return f"SELECT vec_id, label, p, v, arg_min(e, d * {ENTRIES} + e) AS e, min(d) AS d FROM (SELECT *, {near} AS d FROM parts JOIN {book} USING (p)) GROUP BY vec_id, label, p, v"


def _sql() -> str:
    made = [
        f"kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"parts AS (SELECT vec_id, label, p, v[len(v) * p // {PARTS} + 1:len(v) * (p + 1) // {PARTS}] AS v FROM kept, generate_series(0, {PARTS - 1}) t(p))",
        f"book0 AS (SELECT p, rank - 1 AS e, v AS c FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY vec_id) AS rank FROM parts) WHERE rank <= {ENTRIES})",
    ]
    for k in range(ROUNDS):
        made.append(f"round{k} AS ({_assigned(f'book{k}')})")
        made.append(f"means{k} AS (SELECT p, e, list(m ORDER BY i) AS c FROM (SELECT p, e, i, floor(sum(x::HUGEINT) / count(*)) AS m FROM (SELECT p, e, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM round{k}) GROUP BY p, e, i) GROUP BY p, e)")
        made.append(f"book{k + 1} AS (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN means{k} m USING (p, e))")
    made.append(f"last AS ({_assigned(f'book{ROUNDS}')})")
    made.append("coded AS (SELECT vec_id, label, string_agg(lower(lpad(to_hex(e::BIGINT), 2, '0')), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM last GROUP BY vec_id, label)")
    made.append(f"digest AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: x::BIGINT), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{ROUNDS})")
    return "WITH " + ",\n".join(made) + "\nSELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM coded, digest"


OP11_SQL = _sql()
