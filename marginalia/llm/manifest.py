"""Merkle manifest of a dataset: a digest for every row, subtree, source and the whole, with a proof for each row.

Every row is a leaf. Leaves of a source ascend by doc_id; FAN consecutive
nodes become one until a source has one node, its subroot; subroots, ordered
by source, become the root likewise. A block is FAN ** HEIGHT aligned leaves.
One traversal visits a block in postorder: the recursion returns a subtree's
digest and, unwinding, appends the digests of its siblings to the proofs of
the leaves it contains. Block roots are the leaves of the next, much smaller
traversal. Then proofs are handed down: what lies above a block is appended to
all its leaves. So neither a hot source nor a long table meets in one task: a
group is one block with the path above it.

Ranks within a source come from a range sort of (source, doc_id, digest): each
range counts its own rows, and what earlier ranges hold of its first source is
carried over, one row a range.

Defined cases: a null field is ``-``; null sources come first and are a source
of their own; within a source null doc_ids come first, rows of one doc_id are
ordered by their digest, and equal rows are leaves each. A null doc_id has no
checksum, so the query doesn't tamper with such rows. Only the five columns of
a leaf are read, whatever else there is. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import documents, written

#: Nodes that become one.
FAN = 16
#: Levels of one traversal; a block has FAN ** HEIGHT leaves.
HEIGHT = 2
SPAN = FAN**HEIGHT
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value: Column) -> Column:
    """A value with its length ahead, so that fields can't run into one another."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column) -> Column:
    return F.sha2(F.concat(*(field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")), field(text)), 256)


def traversed(digests: list[str], span: int, proofs: list[list[str]], at: int = 0) -> str:
    """The digest of the subtree over up to ``span`` leaves from ``at``; what lies beside a leaf's ancestors in it is appended to its proof.

    A level of a proof is ``place:digests``: the siblings' digests, and how many of them stand to the left.
    """
    if span == 1:
        return digests[at]
    step = span // FAN
    starts = range(at, min(at + span, len(digests)), step)
    children = [traversed(digests, step, proofs, x) for x in starts]
    for i, start in enumerate(starts):
        level = f"{i}:{''.join(children[:i] + children[i + 1 :])}"
        for x in range(start, min(start + step, len(digests))):
            proofs[x].append(level)
    return digest(*children)


def height(block: int, leaves: int) -> int:
    """The span of a block's tree. The first block is lower when it is the only one; any other has full height."""
    if block:
        return SPAN
    span = 1
    while span < leaves:
        span *= FAN
    return span


def folded(own: str, proof: list[str]) -> str:
    """The root that a leaf and its proof lead to."""
    for level in proof:
        place, _, others = level.partition(":")
        left = 64 * int(place)
        own = digest(others[:left], own, others[left:])
    return own


def siblings(proof: list[str]) -> str:
    return "".join(level.partition(":")[2] for level in proof)


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of equal leading columns in sorted rows, one at a time."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:keys] != key:
                if rows:
                    yield key, rows
                key, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield key, rows


def gathered(rows: Iterator[tuple], schema: pa.Schema, size: int = 2_000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def ranked(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``rows`` with ``rank``, the place of each in its key from 0, by ``order``, nulls first; written.

    Only one row for each range of the sort passes the driver.
    """
    spark, names = rows.sparkSession, rows.columns
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(ranges, key, *order).sortWithinPartitions(key, *order)
    dealt = dealt.select(F.spark_partition_id().cast("bigint").alias("_range"), F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_key"), *names)
    at = dealt.columns.index("_key")

    def count(batches):
        held, n = (), 0
        for batch in batches:
            within = []
            for value in batch.column(at).to_pylist():
                held, n = ((value,), 0) if (value,) != held else (held, n + 1)
                within.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(within, pa.int64())], [*batch.schema.names, "_within"])

    schema = ", ".join(f"`{n}` {t}" for n, t in dealt.dtypes) + ", _within bigint"
    # Written, so that ranges and rows stay what they are, whatever is lost later.
    counted = written(dealt.mapInArrow(count, schema), "ranked")
    edges = counted.groupBy("_range").agg(F.min_by(F.struct("_key"), "_row").alias("head"), F.max_by(F.struct("_key", "_within"), "_row").alias("tail")).orderBy("_range").collect()
    carried, before, last = [], 0, ()
    for edge in edges:
        head, tail = edge["head"]["_key"], edge["tail"]["_key"]
        carry = before if (head,) == last else 0
        if carry:
            carried.append((edge["_range"], head, carry))
        before, last = edge["tail"]["_within"] + 1 + (carry if head == tail else 0), (tail,)
    kind = dict(rows.dtypes)[key]
    carries = spark.createDataFrame(carried, f"_r bigint, _head {kind}, _carry bigint")
    met = counted.join(F.broadcast(carries), (F.col("_range") == F.col("_r")) & F.col("_key").eqNullSafe(F.col("_head")), "left")
    return met.select(*names, (F.col("_within") + F.coalesce("_carry", F.lit(0))).alias("rank"))


def climbed(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The nodes (key, rank, digest) of every traversal, lowest first, and the one node each key ends with."""
    schema = pa.schema([("key", pa.string()), ("rank", pa.int64()), ("digest", pa.string())])

    def run(batches):
        def roots():
            for (key, block), rows in groups(batches, 2):
                own = [d for (d,) in rows]
                yield key, block, traversed(own, height(block, len(own)), [[] for _ in own])

        yield from gathered(roots(), schema)

    levels = [nodes]
    while True:
        dealt = levels[-1].select("key", F.floor(F.col("rank") / SPAN).alias("block"), "rank", "digest").repartition("key", "block").sortWithinPartitions("key", "block", "rank")
        above = written(dealt.select("key", "block", "digest").mapInArrow(run, "key string, rank bigint, digest string"), "blocks")
        if above.where("rank > 0").isEmpty():
            return levels, above
        levels.append(above)


#: What every node is told of all that lies above it.
ABOVE = "path array<string>, subroot string, root string"


def handed_down(nodes: DataFrame, above: DataFrame, payload: list[str], emit, schema: str) -> DataFrame:
    """``emit(key, rank, digest, payload, path, subroot, root)`` of each node, its path completed by its block's (``above``: key, block and ABOVE)."""
    fields = nodes.select("digest", *payload).dtypes
    own = nodes.select("key", F.floor(F.col("rank") / SPAN).alias("block"), "rank", "digest", *payload, *(F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in ABOVE.split(", ")))
    paths = above.select("key", "block", F.lit(-1).cast("bigint").alias("rank"), *(F.lit(None).cast(t).alias(n) for n, t in fields), "path", "subroot", "root")
    # A block's path comes first in its group.
    dealt = own.unionByName(paths).repartition("key", "block").sortWithinPartitions("key", "block", "rank")
    names = [c for c in schema.split(", ")]
    kinds = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    arrow = pa.schema([(n.split()[0], kinds[n.split()[1]]) for n in names])

    def run(batches):
        def rows():
            for (key, block), (first, *members) in groups(batches, 2):
                path, subroot, root = first[-3:]
                digests = [x[1] for x in members]
                proofs = [[] for _ in digests]
                traversed(digests, height(block, len(digests)), proofs)
                for x, proof in zip(members, proofs):
                    yield emit(key, x[0], x[1], x[2:-3], proof + path, subroot, root)

        yield from gathered(rows(), arrow)

    return dealt.mapInArrow(run, schema)


def manifest(leaves: DataFrame, with_proof: bool = True) -> DataFrame:
    """For each leaf (doc_id, source, leaf, and ``shown``, the digest to be verified if it isn't the leaf's own) its subroot, the root, its proof and what ``shown`` folds to.

    ``proof`` is a level for each entry, lowest first (see ``traversed``); ``proof_sha256`` is the digest of the siblings alone.
    """
    fixed = written(leaves.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), "leaf", "shown", F.monotonically_increasing_id().alias("_n")), "leaves")
    # Equal rows part by their number, so copies of one row don't meet in one range.
    placed = ranked(fixed, "source", ["doc_id", "leaf", "_n"])
    levels, subroots = climbed(placed.select(F.col("source").alias("key"), "rank", F.col("leaf").alias("digest"), "doc_id", "shown"))
    tops = ranked(subroots.select(F.lit("").alias("key"), F.col("key").alias("source"), "digest"), "key", ["source"])
    upper, root = climbed(tops)
    above = root.select("key", F.col("rank").alias("block"), F.array().cast("array<string>").alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    passed = f"key string, block bigint, {ABOVE}"

    def inner(key, rank, own, payload, path, subroot, root):
        return key, rank, path, subroot, root

    def of_source(key, rank, own, payload, path, subroot, root):
        return payload[0], 0, path, own, root

    for nodes in reversed(upper[1:]):
        above = handed_down(nodes, above, [], inner, passed)
    above = handed_down(upper[0], above, ["source"], of_source, passed)
    for nodes in reversed(levels[1:]):
        above = handed_down(nodes, above, [], inner, passed)

    def proven(key, rank, own, payload, path, subroot, root):
        doc_id, shown = payload
        ends = folded(own if shown is None else shown, path)
        row = doc_id, own, subroot, root, digest(siblings(path)), ends, ends == root, key, rank
        return (*row, path) if with_proof else row

    schema = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, source string, rank bigint" + ", proof array<string>" * with_proof
    return handed_down(levels[0], above, ["doc_id", "shown"], proven, schema)


def tampered(docs: DataFrame) -> DataFrame:
    """Leaves of all documents; where 5 divides the checksum of doc_id, ``shown`` is the leaf of the text with A-Z lower-cased."""
    picked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return docs.select("doc_id", "source", leaf(F.col("text")).alias("leaf"), F.when(picked, leaf(F.translate("text", UPPER, LOWER))).alias("shown"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(tampered(documents(spark, sf_dir)), with_proof=False).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _field(c: str) -> str:
    return f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')"


def _tree(base: str, name: str, depth: int) -> str:
    """Tables ``{name}0`` to ``{name}{depth}`` of the nodes (key, i, h, n) over ``base`` (key, i, h), and of what stands beside each."""
    made = [f"{name}0 AS (SELECT key, i, h, count(*) OVER (PARTITION BY key) AS n FROM {base})"]
    for k in range(depth):
        made.append(f"""{name}{k}_beside AS (
  SELECT key, i, n, CASE WHEN n > 1 THEN coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') ELSE '' END AS l,
         CASE WHEN n > 1 THEN coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') ELSE '' END AS r
  FROM {name}{k} WINDOW w AS (PARTITION BY key, i // {FAN} ORDER BY i)
)""")
        made.append(f"""{name}{k + 1} AS (SELECT *, count(*) OVER (PARTITION BY key) AS n FROM (
  SELECT key, i // {FAN} AS i, CASE WHEN max(n) = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {name}{k} GROUP BY key, i // {FAN}
))""")
    return ",\n".join(made)


def _fold(start: str, name: str, tree: str, depth: int, key: str, at: str) -> str:
    made, last = [], start
    for k in range(depth):
        made.append(f"""{name}{k} AS (
  SELECT f.* REPLACE (CASE WHEN b.n = 1 THEN f.x ELSE sha256(b.l || f.x || b.r) END AS x, f.proof || b.l || b.r AS proof)
  FROM {last} f JOIN {tree}{k}_beside b ON b.key IS NOT DISTINCT FROM f.{key} AND b.i = f.{at} // {FAN**k}
)""")
        last = f"{name}{k}"
    return ",\n".join(made)


_CRC = "xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: [ord(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda c, e: xor(xor(c, e) >> 1, 3988292384 * (xor(c, e) & 1))), 4294967295)"
#: Levels that the SQL follows: sources of up to a million rows, four thousand sources.
_DEPTH, _TOPS = 5, 3

OP13_SQL = f"""
WITH leaves AS (
  SELECT doc_id, source, {" || ".join(map(_field, ("doc_id", "source", "lang", "n_chars")))} AS head, text, {_CRC} % 5 = 0 AS picked FROM documents
),
shown AS (
  SELECT doc_id, source, sha256(head || {_field("text")}) AS leaf,
         CASE WHEN picked THEN sha256(head || {_field(f"translate(text, '{UPPER}', '{LOWER}')")}) ELSE sha256(head || {_field("text")}) END AS x
  FROM leaves
),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM shown),
base AS (SELECT source AS key, i, leaf AS h FROM placed),
{_tree("base", "s", _DEPTH)},
subroots AS (SELECT key AS source, h AS subroot, row_number() OVER (ORDER BY key NULLS FIRST) - 1 AS j FROM s{_DEPTH}),
upper_base AS (SELECT 0 AS key, j AS i, subroot AS h FROM subroots),
{_tree("upper_base", "t", _TOPS)},
first AS (SELECT doc_id, p.source, leaf, i, x, '' AS proof, subroot, j, 0 AS zero FROM placed p JOIN subroots q ON q.source IS NOT DISTINCT FROM p.source),
{_fold("first", "f", "s", _DEPTH, "source", "i")},
{_fold(f"f{_DEPTH - 1}", "g", "t", _TOPS, "zero", "j")}
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, x AS folded_root, x = h AS verified FROM g{_TOPS - 1}, (SELECT h FROM t{_TOPS})
"""
