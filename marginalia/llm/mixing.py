"""Mixing sources to target weights by entropy balancing.

Every document gets a rate between 0 and ``most`` copies. Among all rates
that give each source its target of words, those are taken that are nearest
to one half of ``most`` each in relative entropy (of a share and its
complement). Their dual has one multiplier a source: the odds of a rate are
exp(multiplier * size / mean size), an exponential tilt. It is convex; safeguarded
Newton steps solve it for all sources at once, each step one aggregation over
counts of documents by source and size, until every gap is below TOLERANCE.

Rates are rounded into copies from the largest size down: the copies of one
source and size are the whole number that brings the words taken so far
nearest to the words due so far. Who among equals gets the extra copy follows
a hash of doc_id and text, counted within salted parts of the group.

Defined cases: null and blank texts have size 0 and are taken 0 words; a null
source is a source of its own, last in order; repeated rows each count. A
source without words has target 0. A multiplier that STEPS steps don't bring
within TOLERANCE is an error. An empty table gives an empty table.
Only doc_id, text and source are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.llm.common import WORD, documents, text_of, written

#: The weights that sources take in turn, and the share of all words to be mixed.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
TOLERANCE = 1e-5
STEPS = 120
#: Decimals of a multiplier. Sums in another order differ far below them, so reruns agree.
DECIMALS = 9
#: Rows aimed at for one salted part of a group of equal source and size.
PART_ROWS = 20_000


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    What is above ``most`` times a source's size is dealt to the others by
    weight until none is above. In closed form: with sources ordered by
    most * size / weight, the capped ones are the longest prefix in which each
    one's even share of what is left reaches its cap. Sources number few
    beside documents; their order is one window of as many rows.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    listed = sources.withColumn("turn", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("turn") % len(weights) + 1).cast("int")).cast("double")
    listed = listed.withColumn("weight", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    whole = Window.partitionBy()
    listed = listed.withColumn("goal", F.lit(share) * F.sum("source_size").over(whole))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("turn"))
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("goal") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weights_left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = left / weights_left
    listed = listed.withColumn("level", level).withColumn("capped", F.col("level") * F.col("weight") >= F.col("cap"))
    # The level rises along the order for as long as sources are capped; the first free one holds it for the rest.
    free = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), F.col("turn"), F.col("level").alias("level")))).over(whole)
    target = F.least(F.col("cap"), F.coalesce(free["level"], F.lit(float("inf"))) * F.col("weight"))
    return listed.select("source", "source_size", target.alias("target"))


def rate(tilt, x, most: int = MOST):
    """The rate that a multiplier gives to a scaled size: ``most`` times a logistic of their product."""
    z = tilt * x
    return F.lit(float(most)) / (1 + F.exp(-F.least(F.greatest(z, F.lit(-700.0)), F.lit(700.0))))


def multipliers(counts: DataFrame, goals: DataFrame, most: int = MOST, tolerance: float = TOLERANCE) -> DataFrame:
    """(source, source_size, target, mean, tilt) for counts of (source, size, n), by Newton steps on the dual.

    A bracket around each root makes every step safe: a Newton step that
    leaves it is replaced by its middle. Sources whose target is 0 or the
    whole of ``most`` times their size have their root at infinity and get
    a multiplier of that sign at once.
    """
    means = counts.where("size > 0").groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    state = goals.join(means, goals["source"].eqNullSafe(means["source"]), "left").drop(means["source"])
    edge = F.when(F.col("target") <= 0, F.lit(float("-inf"))).when(F.col("target") >= F.col("source_size") * most, F.lit(float("inf")))
    none = F.lit(None).cast("double")
    state = written(state.withColumn("edge", edge).withColumn("tilt", F.lit(0.0)).withColumn("low", none).withColumn("high", none).withColumn("open", edge.isNull()), "duals")
    own, tilt = counts.withColumnRenamed("source", "s"), F.col("tilt")
    x = F.col("size") / F.col("mean")
    for turn in range(STEPS):
        met = own.join(state.where("open").select("source", "mean", "tilt"), F.col("s").eqNullSafe(F.col("source")))
        at, words = rate(tilt, x, most), F.col("size") * F.col("n")
        sums = met.groupBy("s").agg(F.sum(words * at).alias("taken"), F.sum(words * x * at * (1 - at / most)).alias("slope"))
        off = F.col("target") - F.col("taken")
        joined = state.join(sums, F.col("source").eqNullSafe(F.col("s")), "left").withColumn("still", F.col("open") & F.coalesce(F.abs(off) > tolerance * F.greatest(F.col("target"), F.lit(1.0)), F.lit(False)))
        joined = joined.withColumn("low", F.when(F.col("still") & (off > 0), tilt).otherwise(F.col("low"))).withColumn("high", F.when(F.col("still") & (off < 0), tilt).otherwise(F.col("high")))
        newton = tilt + off / F.greatest(F.col("slope"), F.lit(1e-300))
        # Until a root is bracketed the multiplier doubles at least; then every third step halves the bracket.
        far = F.greatest(F.abs(tilt) * 2, F.lit(1.0))
        within = (newton > F.col("low")) & (newton < F.col("high"))
        step = F.when(F.col("high").isNull(), F.least(F.greatest(newton, far), far * 4)).when(F.col("low").isNull(), F.greatest(F.least(newton, -far), -far * 4)).when(within & F.lit(turn % 3 != 2), newton).otherwise((F.col("low") + F.col("high")) / 2)
        state = written(joined.select("source", "source_size", "target", "mean", "edge", F.when(F.col("still"), F.round(step, DECIMALS)).otherwise(tilt).alias("tilt"), "low", "high", F.col("still").alias("open")), "duals")
        if not state.where("open").limit(1).count():
            break
    else:
        raise RuntimeError(f"{state.where('open').count()} sources miss their targets after {STEPS} steps")
    return state.select("source", "source_size", "target", F.coalesce("mean", F.lit(1.0)).alias("mean"), F.coalesce("edge", "tilt").alias("tilt"))


def rounded(rated: DataFrame, most: int = MOST) -> DataFrame:
    """(source, size, n, copies): whole numbers of copies from (source, size, n, due).

    A source's distinct sizes are met in one task, largest first. k distinct
    sizes need k * k / 2 words of text, so their number stays under the root
    of twice the source's words, whatever the number of documents.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size", ascending=False, kind="stable")
        due, got, copies = 0.0, 0, []
        rows = list(zip(group["size"].tolist(), group["n"].tolist(), group["rate"].tolist()))
        for size, n, rate_ in rows:
            due += size * n * rate_
            want = min(most * n, max(0, int(np.floor((due - got) / size + 0.5)))) if size else 0
            got += want * size
            copies.append(want)
        # What the smallest sizes had no room to make up is made up from the largest down.
        for i, (size, n, _) in enumerate(rows):
            if size and (more := int(np.floor((due - got) / size + 0.5))):
                more = min(most * n, max(0, copies[i] + more)) - copies[i]
                copies[i] += more
                got += more * size
        return group.assign(copies=np.array(copies, np.int64))[["source", "size", "n", "copies"]]

    return rated.groupBy("source").applyInPandas(run, "source string, size bigint, n bigint, copies bigint")


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``docs`` with size, source_size, target, rate and copies; columns of these names are replaced."""
    named = ("size", "source_size", "target", "rate", "copies")
    size = F.regexp_count(text_of(), F.lit(WORD)).cast("bigint")
    kept = docs.drop(*named)
    keyed = kept.withColumn("_mix_words", size).withColumn("_mix_hash", F.xxhash64("doc_id", "text"))
    small = keyed.select(F.col("source").cast("string").alias("source"), F.col("_mix_words").alias("size"), F.col("_mix_hash").alias("_hash"))
    total = docs.count()
    parts = max(1, -(-total // PART_ROWS))
    salted = small.groupBy("source", "size", F.pmod("_hash", F.lit(parts)).alias("part")).agg(F.count("*").alias("n"))
    salted = written(salted, "sizes")
    counts = written(salted.groupBy("source", "size").agg(F.sum("n").alias("n")), "counts")
    goals = targets(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, most)
    duals = multipliers(counts, goals, most)
    d = duals.withColumnRenamed("source", "s")
    rated = counts.join(d, F.col("source").eqNullSafe(F.col("s"))).select("source", "size", "n", F.when(F.col("tilt") == float("inf"), float(most)).when(F.col("tilt") == float("-inf"), 0.0).otherwise(rate(F.col("tilt"), F.col("size") / F.col("mean"), most)).alias("rate"))
    given = rounded(rated, most)
    # Each salted part gets its share of the extra copies: those left when the parts before it are full.
    c = given.join(rated.select(F.col("source").alias("s"), F.col("size").alias("z"), "rate"), F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))).join(d.select(F.col("s").alias("t"), "source_size", "target"), F.col("source").eqNullSafe(F.col("t")))
    c = c.select("source", "size", "source_size", "target", "rate", F.floor(F.col("copies") / F.col("n")).alias("base"), F.pmod("copies", "n").alias("extra"))
    upto = Window.partitionBy("source", "size").orderBy("part")
    p = salted.select(F.col("source").alias("s"), F.col("size").alias("z"), "part", (F.sum("n").over(upto) - F.col("n")).alias("before"))
    plan = p.join(c, F.col("s").eqNullSafe(F.col("source")) & (F.col("z") == F.col("size"))).select("s", "z", "part", "source_size", "target", "rate", "base", F.greatest(F.col("extra") - F.col("before"), F.lit(0)).alias("extra"))
    plan = written(plan, "plan")
    # One key column with a mark for null, so that join and window need one and the same exchange.
    mark = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    asked = keyed.withColumn("_mix_part", F.pmod("_mix_hash", F.lit(parts))).withColumn("_mix_source", mark("source"))
    plan = plan.select(mark("s").alias("_mix_s"), F.col("z").alias("_mix_z"), F.col("part").alias("_mix_p"), *(F.col(c).alias(f"_mix_{c}") for c in ("source_size", "target", "rate", "base", "extra")))
    joined = asked.join(plan, (F.col("_mix_source") == F.col("_mix_s")) & (F.col("_mix_words") == F.col("_mix_z")) & (F.col("_mix_part") == F.col("_mix_p")))
    turn = F.row_number().over(Window.partitionBy("_mix_source", "_mix_words", "_mix_part").orderBy("_mix_hash", "doc_id"))
    copies = (F.col("_mix_base") + (turn <= F.col("_mix_extra")).cast("bigint")).cast("bigint")
    return joined.select(*kept.columns, F.col("_mix_words").alias("size"), *(F.col(f"_mix_{c}").alias(c) for c in ("source_size", "target", "rate")), copies.alias("copies"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Only what the digest needs is carried: the text is reduced to its size and hash before any shuffle.
    mixed = mixture(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "rate", "copies")
