"""Sharding by a Feistel permutation of global row numbers, with cycle walking.

Rows get numbers 0 to n-1 without gaps; a keyed permutation of these numbers
is a reproducible shuffle, and from the permuted number follow the shard
(its remainder) and the slot in it (its quotient), so shard sizes differ by
one row at most and both can be computed for any row number.

Row numbers follow hash buckets and, within them, doc_id, checksum and size.
Equal rows are counted before they move, so a hot row is one record; rows of
one doc_id with different texts part by their checksum.

Defined cases: a null text has size 1 and checksum 0; null doc_ids are a value
of their own; repeated rows get a number each. Only doc_id and text are read.
An empty table gives an empty table.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.llm.common import documents, text_of

ROUNDS = 6
#: Rows aimed at for one bucket of row numbers.
BUCKET_ROWS = 20_000
#: Copies of one row that are numbered together; more are dealt to several tasks.
COPIES = 10_000


def permuted(number: Column, n: int, seed: int = 0) -> Column:
    """The place of ``number`` in a permutation of 0 to n-1.

    The domain is a grid of a by b cells with fewer than a cells beyond n.
    Each round adds a keyed hash of one coordinate to the other one, so it can
    be undone. A result beyond n is permuted again until it lies within; as
    the numbers on that walk are distinct, it takes no more steps than there
    are cells beyond n, and the walks of all rows take fewer than n steps.
    """
    a = isqrt(max(n - 1, 0)) + 1
    b = -(-max(n, 1) // a)

    def once(x: Column) -> Column:
        start = F.struct((x / F.lit(b)).cast("bigint").alias("l"), F.pmod(x, F.lit(b)).alias("r"))

        def step(pair: Column, i: Column) -> Column:
            left = F.pmod(pair["l"] + F.pmod(F.xxhash64(F.lit(seed), i, pair["r"]), F.lit(a)), F.lit(a))
            return F.struct(left.alias("l"), F.pmod(pair["r"] + F.pmod(F.xxhash64(F.lit(~seed), i, left), F.lit(b)), F.lit(b)).alias("r"))

        rounds = F.array(*(F.lit(i) for i in range(ROUNDS)))
        return F.aggregate(rounds, start, step, lambda pair: pair["l"] * F.lit(b) + pair["r"])

    first = once(number.cast("bigint"))
    if (beyond := a * b - n) <= 0:
        return first
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(beyond)), first, lambda x, _: F.when(x < n, x).otherwise(once(x)))
    return F.when(first < n, first).otherwise(walk)


def row_numbers(docs: DataFrame) -> tuple[DataFrame, int]:
    """(doc_id, size, text_crc32, number) with numbers 0 to n-1, and n."""
    text = text_of()
    size = F.octet_length(text).cast("bigint") + F.lit(1).cast("bigint")
    rows = docs.select("doc_id", size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    counted = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    n = rows.count()
    buckets = max(1, -(-n // BUCKET_ROWS))
    bucketed = counted.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(buckets)))
    sums = bucketed.groupBy("bucket").agg(F.sum("copies").alias("rows"))
    # One record a bucket, BUCKET_ROWS rows each: this window's single task gets n / BUCKET_ROWS records.
    starts = sums.select("bucket", (F.sum("rows").over(Window.orderBy("bucket")) - F.col("rows")).alias("start"))
    within = Window.partitionBy("bucket").orderBy("doc_id", "text_crc32", "size")
    placed = bucketed.withColumn("upto", F.sum("copies").over(within)).join(starts, "bucket")
    last = F.col("start") + F.col("upto") - 1
    spans = placed.select("doc_id", "size", "text_crc32", "copies", (last - F.col("copies") + 1).alias("first"), last.alias("last"))
    few, many = spans.where(F.col("copies") <= COPIES), spans.where(F.col("copies") > COPIES)
    many = many.withColumn("first", F.explode(F.sequence("first", "last", F.lit(COPIES).cast("bigint"))))
    many = many.withColumn("last", F.least(F.col("first") + COPIES - 1, F.col("last"))).repartition("first")
    numbered = few.unionByName(many).select("doc_id", "size", "text_crc32", F.explode(F.sequence("first", "last")).alias("number"))
    return numbered, n


def shards(docs: DataFrame, count: int = 16, seed: int = 0) -> DataFrame:
    """Every row's number, its permuted place, and the shard and slot that follow."""
    numbered, n = row_numbers(docs)
    placed = numbered.withColumn("place", permuted(F.col("number"), n, seed))
    return placed.withColumn("shard", F.pmod("place", F.lit(count)).cast("int")).withColumn("slot", (F.col("place") / count).cast("bigint"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards(documents(spark, sf_dir))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("number").alias("row_number"))
