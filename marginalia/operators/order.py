"""Places in a global order without a task that sees all rows: range sorts, with what one range leaves to the next carried over."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.storage import written

#: Ranks that one bucket of a running maximum holds.
BUCKET = 65_536


def ranged(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` sorted by ``order`` (nulls first) in ranges: adds ``_range``, its number, and ``_row``, which ascends over all ranges. Lazy: write it, so that both stay."""
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    return dealt.select(*rows.columns, F.spark_partition_id().cast("bigint").alias("_range"), F.monotonically_increasing_id().alias("_row"))


def ranked(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``rows`` with ``rank``, the place of each in its key from 0, by ``order``, nulls first.

    Each range counts its own rows; what earlier ranges hold of its first key
    is carried over, so a hot key is as many ranges as it fills. Only one row
    for each range passes the driver.
    """
    spark, names = rows.sparkSession, rows.columns
    dealt = ranged(rows.withColumn("_key", F.col(key)), [key, *order])
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


def following(rows: DataFrame, order: list[str], wanted: Column, shown: list[str]) -> DataFrame:
    """``rows`` with ``at``, which ascends with ``order``, and ``next``, the ``shown`` columns of the first wanted row after each in the order of all rows, null if there is none.

    A range looks at its own rows, and beyond them at the first wanted row of
    the ranges after it, one row for each range.
    """
    spark = rows.sparkSession
    held = written(ranged(rows, order), "ordered").withColumn("_wanted", F.when(wanted, F.struct(*shown)))
    back = Window.partitionBy("_range").orderBy(F.desc("_row")).rowsBetween(Window.unboundedPreceding, -1)
    own = held.withColumn("_own", F.last("_wanted", ignorenulls=True).over(back))
    firsts = held.groupBy("_range").agg(F.min_by("_wanted", F.when(F.col("_wanted").isNotNull(), F.col("_row"))).alias("f")).orderBy(F.desc("_range")).collect()
    later, seen = [], None
    for row in firsts:
        later.append((row["_range"], seen))
        seen = row["f"] if row["f"] is not None else seen
    kind = dict(held.dtypes)["_wanted"]
    carried = spark.createDataFrame(later, f"_r bigint, _later {kind}")
    met = own.join(F.broadcast(carried), F.col("_range") == F.col("_r"), "left")
    return met.select(*rows.columns, F.col("_row").alias("at"), F.coalesce("_own", "_later").alias("next"))


def neighbours(rows: DataFrame, value: str) -> DataFrame:
    """Ranked rows (``rank``, without gaps) with ``before`` and ``after``, the ``value`` of the ranks beside each."""
    bucket = F.floor(F.col("rank") / BUCKET)
    own = rows.withColumn("_bucket", bucket).withColumn("_guest", F.lit(False))
    # A bucket's first and last row are guests of the buckets beside it.
    edge = F.col("rank") % BUCKET
    guests = own.where(edge == BUCKET - 1).withColumn("_bucket", bucket + 1).unionByName(own.where(edge == 0).withColumn("_bucket", bucket - 1)).withColumn("_guest", F.lit(True))
    beside = Window.partitionBy("_bucket").orderBy("rank")
    every = own.unionByName(guests)
    return every.withColumn("before", F.lag(value).over(beside)).withColumn("after", F.lead(value).over(beside)).where(~F.col("_guest")).drop("_bucket", "_guest")


def running_max(rows: DataFrame, at: str, tie: Column, value: str) -> DataFrame:
    """``rows`` with ``reach``, the greatest ``value`` up to each row by (``at``, ``tie``), ``at`` a number from 0.

    Buckets of ``at`` carry their maxima on: a record for BUCKET numbers passes the window that is not partitioned.
    """
    held = rows.withColumn("_bucket", F.floor(F.col(at) / BUCKET)).withColumn("_tie", tie)
    tops = held.groupBy("_bucket").agg(F.max(value).alias("top")).select(F.col("_bucket").alias("_b"), F.max("top").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    upto = Window.partitionBy("_bucket").orderBy(at, "_tie").rowsBetween(Window.unboundedPreceding, 0)
    met = held.withColumn("_own", F.max(value).over(upto)).join(tops, F.col("_bucket") == F.col("_b"))
    return met.select(*rows.columns, F.greatest("_own", "_carry").alias("reach"))
