"""Substring dedup by hashing of lines, paragraphs and passages.

A text is cut without loss after every run of full stops, question and
exclamation marks and line ends. A unit is normalised (A-Z lower-cased, white
space at its ends dropped and between words made one space). Hashed are runs of
units: every line and every paragraph (lines up to a blank one) of LEAST words
or more, and every passage, a shortest run of units with PASSAGE words or more,
from each of its units on and up to each of its units. Lines and paragraphs of
PASSAGE words or more are made of passages, so only shorter ones are hashed
apart. A text of fewer than PASSAGE words is one passage as well. So a repeated
passage goes wherever it stands in a line, short units inside it included,
while lines of fewer words, which clean texts share, are left to line dedup.

Runs are hashed to 128 bits and grouped by digest over the whole table. The
earliest occurrence stays: by doc_id, rows of one doc_id by their text's hash,
equal rows one after another, then by place. The units of all others are
removed, and the spans of their runs in the original text (code points, end
exclusive) are reported. Occurrences may overlap. Every removed unit has an
equal one earlier.

A digest's rows are sorted within one task, as a stream. Digests that many
texts of a bounded sample hold are dealt to SALTS tasks each, which pass one
row on; the sample decides who works, never what is found.

Defined cases: a null text has no units and stays null; null doc_ids rank
after all others (2**63 - 1 ranks with them). Of equal rows one is treated as
the first, of the others every hashed run is removed. Other columns play no
part. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.llm.common import LOWER_AZ, SPACE, WORD, documents, written

#: Fixed value: the pattern of a unit; matches follow one another without a gap.
UNIT = r"[^.!?\n]*[.!?\n]+|[^.!?\n]+"
#: Words of a passage: half of the 50 that a repeat should have to be worth removing, since its ends run into sentences around it.
PASSAGE = 25
#: Words of a line or paragraph that is hashed as a whole.
LEAST = 15
LAST_ID = 2**63 - 1
#: Texts of the sample that looks for frequent digests, in how many of them one is frequent, and how many of these are dealt to several tasks.
SAMPLE, FREQUENT, HOT = 2_000, 20, 10_000
SALTS = 64


def units_of(text: str) -> tuple[list[tuple[int, int]], list[list[bytes]], list[str]]:
    """The spans of the units, their normalised words, and the units."""
    found = list(re.finditer(UNIT, text))
    units = [m.group() for m in found]
    return [m.span() for m in found], [u.encode("utf-8", "surrogatepass").translate(LOWER_AZ).split() for u in units], units


def runs(units: list[str], words: list[list[bytes]], least: int = PASSAGE, whole: int = LEAST) -> set[tuple[int, int]]:
    """(first unit, last unit) of every run that is hashed."""
    upto = list(accumulate(map(len, words)))
    total = upto[-1] if upto else 0
    if not total:
        return set()
    before = [0, *upto[:-1]]
    own = [i for i, w in enumerate(words) if w]
    if total < least:
        found = {(own[0], own[-1])}
    else:
        found = {(i, bisect_left(upto, before[i] + least)) for i in own if total - before[i] >= least}
        found |= {(bisect_right(before, upto[j] - least) - 1, j) for j in own if upto[j] >= least}
    line = paragraph = 0
    for i, unit in enumerate(units):
        ends = unit.count("\n")
        last = i == len(units) - 1
        if ends or last:
            if whole <= upto[i] - before[line] < least:
                found.add((line, i))
            line = i + 1
        if ends > 1 or (ends and not words[i]) or last:
            if whole <= upto[i] - before[paragraph] < least:
                found.add((paragraph, i))
            paragraph = i + 1
    return found


def passages(units: list[str], words: list[list[bytes]], least: int = PASSAGE, whole: int = LEAST) -> list[tuple[int, int, bytes]]:
    """(first unit, last unit, digest) of every hashed run, in order."""
    found = sorted(runs(units, words, least, whole))
    if not found:
        return []
    upto = [0, *accumulate(map(len, words))]
    every = [x for w in words for x in w]
    ends = [0, *accumulate(len(x) + 1 for x in every)]
    joined = b" ".join(every)
    return [(i, j, hashlib.blake2b(joined[ends[upto[i]] : ends[upto[j + 1]] - 1], digest_size=16).digest()) for i, j in found]


def _halves(digest: bytes) -> tuple[int, int]:
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def later_occurrences(docs: DataFrame, least: int = PASSAGE, whole: int = LEAST) -> DataFrame:
    """(a, b, doc_id, h) of every row that holds a digest which an earlier row holds."""
    def digests(rows: DataFrame, hot: frozenset[int]) -> DataFrame:
        def run(batches):
            for batch in batches:
                a, b, salts, ids, keys = [], [], [], [], []
                for doc, h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                    _, words, units = units_of(text.as_py())
                    for digest in {x for *_, x in passages(units, words, least, whole)}:
                        first, second = _halves(digest)
                        a.append(first)
                        b.append(second)
                        salts.append(h % SALTS if first in hot else -1)
                        ids.append(doc)
                        keys.append(h)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(salts, pa.int32()), pa.array(ids, pa.int64()), pa.array(keys, pa.int64())], ["a", "b", "salt", "doc_id", "h"])

        return rows.mapInArrow(run, "a bigint, b bigint, salt int, doc_id bigint, h bigint")

    def repeated(batches):
        """All rows of a digest and salt but its first; of salted ones that as well, marked."""
        held = None
        for batch in batches:
            columns = [np.asarray(c) for c in batch.columns]
            if not len(columns[0]):
                continue
            # The group that the batch before ended in begins this one, by its first row.
            if held is not None:
                columns = [np.concatenate([[x], c]) for x, c in zip(held, columns)]
            n = len(columns[0])
            new = np.ones(n, bool)
            new[1:] = np.any([c[1:] != c[:-1] for c in columns[:3]], axis=0)
            first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            later = (columns[3] != columns[3][first]) | (columns[4] != columns[4][first])
            begins = new & (columns[2] >= 0)
            if held is not None:
                begins[0] = False
            chosen = later | begins
            held = [c[first[-1]] for c in columns]
            out = [c[chosen] for c in (columns[0], columns[1], columns[3], columns[4])]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out), pa.array(begins[chosen])], ["a", "b", "doc_id", "h", "first"])

    rows = docs.where("text is not null").select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST_ID)).alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    sample = rows.sample(min(1.0, SAMPLE / max(1, docs.count())), seed=1)
    often = digests(sample, frozenset()).groupBy("a").count().where(F.col("count") >= FREQUENT).orderBy(F.desc("count"), "a").limit(HOT)
    hot = frozenset(r["a"] for r in often.collect())
    dealt = digests(rows, hot).repartition("a", "b", "salt").sortWithinPartitions("a", "b", "salt", "doc_id", "h")
    every = written(dealt.mapInArrow(repeated, "a bigint, b bigint, doc_id bigint, h bigint, first boolean"), "later")
    # SALTS rows of a frequent digest at most; all but the first of them are later than that.
    order = F.row_number().over(Window.partitionBy("a", "b").orderBy("doc_id", "h"))
    firsts = every.where("first").withColumn("_n", order).where("_n > 1")
    return every.where("not first").drop("first").unionByName(firsts.select("a", "b", "doc_id", "h"))


def runs_of(units: list[int], spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans of consecutive units, joined."""
    out: list[tuple[int, int]] = []
    for i in units:
        if out and out[-1][1] == spans[i][0]:
            out[-1] = (out[-1][0], spans[i][1])
        else:
            out.append(spans[i])
    return out


def removed(docs: DataFrame, least: int = PASSAGE, whole: int = LEAST) -> DataFrame:
    """(doc_id, text, n_units, n_removed, removed, kept): every row with its removed spans and the text that is left."""
    later = later_occurrences(docs, least, whole)
    gone = later.groupBy(F.col("doc_id").alias("d"), F.col("h").alias("k")).agg(F.collect_set(F.struct("a", "b")).alias("gone"))
    # Equal rows are one with their number, counted before they move.
    rows = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST_ID)).alias("d1"), F.xxhash64("text").alias("k1"))
    one = rows.groupBy("d1", "k1").agg(F.first(F.struct("doc_id", "text")).alias("r"), F.count("*").alias("copies"))
    met = one.join(gone, (F.col("d1") == F.col("d")) & (F.col("k1") == F.col("k")), "left").select("r.doc_id", "r.text", "gone", "copies")
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, text string, n_units bigint, n_removed bigint, removed string, kept string"

    def cut(text: str, spans: list, found: list, bad: set | None) -> tuple:
        own, units = set(), set()
        for i, j, digest in found:
            if bad is None or digest in bad or digest in own:
                units.update(range(i, j + 1))
            own.add(digest)
        joined = runs_of(sorted(units), spans)
        kept, at = [], 0
        for start, end in joined:
            kept.append(text[at:start])
            at = end
        return len(spans), len(units), ",".join(f"{s}:{e}" for s, e in joined), "".join([*kept, text[at:]])

    def run(batches):
        for batch in batches:
            out, size = [], 0
            for doc, text, gone, copies in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3).to_pylist()):
                text = text.as_py()
                if text is None:
                    first = again = (0, 0, "", None)
                else:
                    bad = {x["a"].to_bytes(8, "little", signed=True) + x["b"].to_bytes(8, "little", signed=True) for x in gone.as_py() or ()}
                    spans, words, units = units_of(text)
                    found = passages(units, words, least, whole)
                    first = cut(text, spans, found, bad)
                    again = cut(text, spans, found, None) if copies > 1 else first
                for n in range(copies):
                    out.append((doc, text, *(again if n else first)))
                    size += len(text or "")
                    if len(out) >= 5_000 or size > 16_000_000:
                        yield pa.RecordBatch.from_pylist([dict(zip(NAMES, x)) for x in out], schema=arrow)
                        out, size = [], 0
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(NAMES, x)) for x in out], schema=arrow)

    arrow = pa.schema([("doc_id", {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]), ("text", pa.string()), ("n_units", pa.int64()), ("n_removed", pa.int64()), ("removed", pa.string()), ("kept", pa.string())])
    return met.mapInArrow(run, schema)


NAMES = ["doc_id", "text", "n_units", "n_removed", "removed", "kept"]


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_units", "n_removed", "removed", F.length("kept").cast("bigint").alias("n_kept"), F.sha2("kept", 256).alias("kept_sha256"))


OP5_SQL = rf"""
WITH cut AS (SELECT doc_id, text, regexp_extract_all(text, '{UNIT}') AS u FROM documents),
units AS (SELECT doc_id, i, u[i] AS unit FROM (SELECT doc_id, u, unnest(generate_series(1, len(u))) AS i FROM cut)),
placed AS (
  SELECT doc_id, i, unit, len(regexp_extract_all(unit, '{WORD}')) AS w,
         coalesce(sum(length(unit)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s,
         translate(trim(regexp_replace(unit, '[{SPACE}]+', ' ', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM units
),
summed AS (
  SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS c, length(unit) - length(replace(unit, chr(10), '')) AS ends FROM placed
),
cuts AS (
  SELECT doc_id, i, w, coalesce(sum((ends > 0)::INT) OVER before, 0) AS line, coalesce(sum((ends > 1 OR (ends > 0 AND w = 0))::INT) OVER before, 0) AS paragraph
  FROM summed WINDOW before AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
whole AS (
  SELECT doc_id, list(c ORDER BY i) AS cs, list(c - w ORDER BY i) AS bs, list(norm ORDER BY i) AS norms, sum(w) AS total,
         min(i) FILTER (w > 0) AS head, max(i) FILTER (w > 0) AS tail
  FROM summed GROUP BY doc_id
),
runs AS (
  SELECT doc_id, i, list_position(list_transform(cs, lambda x: x >= c - w + {PASSAGE}), true) AS j FROM summed JOIN whole USING (doc_id) WHERE w > 0 AND total - c + w >= {PASSAGE}
  UNION SELECT doc_id, len(list_filter(bs, lambda x: x <= c - {PASSAGE})) AS i, i AS j FROM summed JOIN whole USING (doc_id) WHERE w > 0 AND c >= {PASSAGE}
  UNION SELECT doc_id, head, tail FROM whole WHERE total BETWEEN 1 AND {PASSAGE} - 1
  UNION SELECT doc_id, min(i), max(i) FROM cuts GROUP BY doc_id, line HAVING sum(w) BETWEEN {LEAST} AND {PASSAGE} - 1
  UNION SELECT doc_id, min(i), max(i) FROM cuts GROUP BY doc_id, paragraph HAVING sum(w) BETWEEN {LEAST} AND {PASSAGE} - 1
),
named AS (SELECT doc_id, i, j, array_to_string(list_filter(norms[i:j], lambda x: x <> ''), ' ') AS passage FROM runs JOIN whole USING (doc_id)),
later AS (SELECT doc_id, i, j FROM (SELECT *, row_number() OVER (PARTITION BY passage ORDER BY doc_id, i) AS n FROM named) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i FROM (SELECT doc_id, unnest(generate_series(i, j)) AS i FROM later)),
islands AS (SELECT doc_id, min(s) AS a, max(s + length(unit)) AS b FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island FROM gone JOIN placed USING (doc_id, i)) GROUP BY doc_id, island),
put AS (
  SELECT doc_id, count(*) AS n_units, count(g.i) AS n_removed, coalesce(string_agg(CASE WHEN g.i IS NULL THEN unit ELSE '' END, '' ORDER BY p.i), '') AS kept
  FROM placed p LEFT JOIN gone g USING (doc_id, i) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_units, 0)::BIGINT AS n_units, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(r.removed, '') AS removed,
       length(coalesce(kept, text))::BIGINT AS n_kept, sha256(coalesce(kept, text)) AS kept_sha256
FROM documents d LEFT JOIN put USING (doc_id) LEFT JOIN (SELECT doc_id, string_agg(a || ':' || b, ',' ORDER BY a) AS removed FROM islands GROUP BY doc_id) r USING (doc_id)
"""
