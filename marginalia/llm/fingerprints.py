"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch holds the ``k`` smallest distinct 64-bit hashes of a text's five-word
shingles (A-Z lower-cased, words parted by ASCII white space; a text of fewer
words is one shingle, a text without words has none). Sketches of parts merge
by union. From sketches follow the number of distinct shingles, the
resemblance of two texts and the containment of one in another.

Defined cases: null texts count as empty; two empty sketches are alike (1), an
empty and another are not (0). Rows with a null doc_id come after the others
in descending order; equal doc_ids are ordered by their text's hash, so
repeated rows follow one another. The last document's next is the first; a
table of one row has itself as next. Columns other than doc_id and text are
not read, whatever their names. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import WordHashes, documents, shingle_hashes, text_of, words_of

K = 64
WIDTH = 5
#: Ranges of doc_ids for each shuffle partition; more of them even out what hashing deals unevenly.
RANGES_A_PARTITION = 4


@dataclass(frozen=True)
class Sketch:
    """The smallest ``k`` hashes of a set, ascending; all of them if it has no more."""

    values: np.ndarray
    k: int = K

    @classmethod
    def of(cls, hashes: np.ndarray, k: int = K) -> Sketch:
        return cls(hashes[:k], k)

    @classmethod
    def parse(cls, fingerprint: str, k: int = K) -> Sketch:
        return cls(np.frombuffer(bytes.fromhex(fingerprint), ">u8").astype(np.uint64), k)

    def merge(self, other: Sketch) -> Sketch:
        k = min(self.k, other.k)
        return Sketch(np.union1d(self.values, other.values)[:k], k)

    def distinct(self) -> float:
        """The estimated number of distinct shingles; exact below ``k``."""
        if len(self.values) < self.k:
            return float(len(self.values))
        return (self.k - 1) / (float(self.values[self.k - 1]) / 2**64)

    def resemblance(self, other: Sketch) -> float:
        union = self.merge(other).values
        if not len(union):
            return 1.0
        both = np.intersect1d(self.values, other.values, assume_unique=True)
        return float(np.isin(union, both, assume_unique=True).sum() / len(union))

    def containment(self, other: Sketch) -> float:
        """The estimated share of this set that ``other`` holds as well."""
        own = self.distinct()
        if not own:
            return 1.0
        like = self.resemblance(other)
        return min(1.0, like * self.merge(other).distinct() / own)

    def text(self) -> str:
        return self.values.astype(">u8").tobytes().hex()


class Fingerprinter:
    def __init__(self, k: int = K, width: int = WIDTH):
        self.k, self.width, self.hashes = k, width, WordHashes(500_000)

    def sketch(self, text: str | None) -> Sketch:
        return Sketch.of(shingle_hashes(words_of(text), self.width, self.hashes), self.k)


def fingerprints(docs: DataFrame, k: int = K, width: int = WIDTH) -> DataFrame:
    """``doc_id``, ``fingerprint`` (hex of ascending big-endian hashes) and the estimated ``n_shingles``."""

    def run(batches):
        tool = Fingerprinter(k, width)
        for batch in batches:
            found = [tool.sketch(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.text() for x in found], pa.string()), pa.array([x.distinct() for x in found], pa.float64())], ["doc_id", "fingerprint", "n_shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, fingerprint string, n_shingles double")


def merged(parts: DataFrame, key: str, k: int = K) -> DataFrame:
    """Fingerprints of wholes from those of their parts (columns ``key`` and ``fingerprint``).

    The hashes are exploded, made distinct per key and cut at the k-th by a
    partial aggregation, so a key with many parts needs no more than k values.
    """
    each = parts.select(key, F.explode(F.regexp_extract_all("fingerprint", F.lit("([0-9a-f]{16})"), F.lit(1))).alias("h")).distinct()
    from pyspark.sql import Window

    order = Window.partitionBy(key).orderBy("h")
    least = each.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    return least.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list("h")), "").alias("fingerprint"))


def _ranged(rows: DataFrame) -> tuple[DataFrame, bool]:
    """``rows`` with the text's hash ``h`` and the number ``slot`` of a range of descending doc_id (nulls last) and, where a doc_id has several ranges, of h; whether one has."""
    ranges = RANGES_A_PARTITION * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = [i / ranges for i in range(1, ranges)]
    seen = rows.agg(F.percentile_approx("doc_id", at, max(10_000, 100 * ranges)).alias("at"), F.count("doc_id").alias("known"), F.count("*").alias("n")).first()
    found = Counter(seen["at"] or [])
    borders = sorted(found)
    parts_of_null = max(1, round(ranges * (seen["n"] - seen["known"]) / max(1, seen["n"])))
    split = parts_of_null > 1 or any(found[b] > 1 for b in borders)
    doc, below, parts = F.col("doc_id"), F.lit(0), F.lit(1)
    if borders:
        # Borders below a doc_id, by binary search in one literal, so neither plan nor rows pay for each border.
        held = _literal(borders)
        strides = F.array(*(F.lit(1 << i) for i in reversed(range(len(borders).bit_length()))))
        below = F.aggregate(strides, F.lit(0), lambda low, stride: F.when(F.get(held, low + stride - 1) < doc, low + stride).otherwise(low))
        placed = rows.withColumn("below", below)
        if split:
            parts = F.when(F.get(held, F.col("below")) == doc, F.get(_literal([found[b] for b in borders]), F.col("below"))).otherwise(1)
    else:
        placed = rows.withColumn("below", below)
    parts = F.when(doc.isNull(), parts_of_null).otherwise(parts) if split else parts
    placed = placed.withColumn("h", F.xxhash64("text"))
    # What shares a range with a doc_id that has several comes after all of them.
    part = F.when(parts > 1, F.least(F.floor((F.col("h").cast("double") / 2.0**64 + 0.5) * parts), parts - 1)).otherwise(ranges) if split else F.lit(0)
    own = F.when(doc.isNull(), len(borders) + 1).otherwise(len(borders) - F.col("below"))
    return placed.select("doc_id", "text", "h", (own.cast("bigint") * (ranges + 1) + part).cast("bigint").alias("slot")), split


def _literal(numbers: list[int]) -> Column:
    """Numbers as one constant array."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<bigint>")


def edited_fingerprints(docs: DataFrame, k: int = K, width: int = WIDTH) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likenesses.

    One shuffle moves the texts: ranges of descending doc_id, sorted within and
    read as a stream; the first document of a range travels to the end of the
    range before as well, so every next document is at hand. A doc_id that
    fills several ranges, and the rows without one, are parted further by
    ranges of the text's hash. Only the ranges' borders and first keys, a few
    for each shuffle partition, pass the driver.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    placed, split = _ranged(rows)
    # The first key of each range: the greatest doc_id, and among its rows the least hash where ranges part by it.
    back = F.bitwise_not("h") if split else F.lit(0).cast("bigint")
    tops = sorted((r["slot"], r["top"]["doc_id"], r["top"]["back"]) for r in placed.groupBy("slot").agg(F.max(F.struct("doc_id", back.alias("back"))).alias("top")).collect())
    # The first range's top follows the last range.
    firsts = docs.sparkSession.createDataFrame([(slot, tops[i - 1][0], doc, back) for i, (slot, doc, back) in enumerate(tops)], "s bigint, sent_to bigint, d bigint, b bigint")
    met = placed.join(F.broadcast(firsts), (F.col("slot") == F.col("s")) & F.col("doc_id").eqNullSafe(F.col("d")) & (back == F.col("b")))
    guests = met.groupBy("sent_to").agg(F.min_by(F.struct("doc_id", "text", "h"), "h").alias("g")).select(F.col("sent_to").alias("slot"), F.lit(1).alias("guest"), "g.*")
    every = placed.select("slot", F.lit(0).alias("guest"), "doc_id", "text", "h").unionByName(guests)
    dealt = every.repartition("slot").sortWithinPartitions("slot", "guest", F.col("doc_id").desc_nulls_last(), "h")
    names, kinds = [n for n, _ in OUTPUT], [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 4]

    def run(batches):
        tool = Fingerprinter(k, width)
        held, made = None, []
        for batch in batches:
            for slot, guest, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                text = text.as_py()
                own = tool.sketch(text)
                if held is not None and held[0] == slot:
                    made.append(compared(tool, *held[1:], text, own))
                held = None if guest else (slot, doc, text, own)
                if len(made) >= 500:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), kinds)], names)
                    made = []
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), kinds)], names)

    return dealt.select("slot", "guest", "doc_id", "text").mapInArrow(run, ", ".join(f"{n} {t}" for n, t in OUTPUT))


OUTPUT = [("doc_id", "bigint"), ("n_chars", "bigint"), ("edited_sha256", "string"), ("fingerprint", "string"), ("edited_fingerprint", "string"), ("near_edited", "double"), ("near_next", "double"), ("contained_in_edited", "double"), ("n_shingles", "double")]


def compared(tool: Fingerprinter, doc, text: str, own: Sketch, after: str, other: Sketch) -> tuple:
    half = len(text) // 2
    edited = text[: len(text) - half] + after[:half]
    changed = tool.sketch(edited)
    return (doc, len(text), hashlib.sha256(edited.encode("utf-8")).hexdigest(), own.text(), changed.text(), own.resemblance(changed), own.resemblance(other), own.containment(changed), own.distinct())


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir))
