"""Line dedup by spread over distinct sites.

A line (trimmed of white space) that stands at MIN_SITES distinct sites or
more is boilerplate: all its occurrences but the first one, by doc_id and
position, go. HyperLogLog sketches of the sites, one for each line's digest,
merge by aggregation; where the estimate is within a factor BAND of the
limit, the sites are counted exactly, so a sketch's error decides nothing.

Defined cases: lines without a word stay; a null site is a site of its own; a
null text has no lines and stays null; null doc_ids come last; repeated rows
share the fate of their lines, the first occurrence staying in each of them.
Other columns are kept as they are. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import SPACE, WORD, documents, written

MIN_SITES = 10
BAND = 2.0
LOG2_SLOTS = 12
#: Digests that are handed to every task, some 100 bytes each.
LISTED = 200_000
#: Of a longer list only those digests are that make up more than one of HOT of its lines, which are fewer than HOT.
HOT = 10_000
#: Fixed value: the white space that parts words, as characters.
BLANKS = " \t\n\x0b\x0c\r"


def digest(line: Column) -> Column:
    """128 bits of a line without the white space at its ends."""
    return F.unhex(F.md5(F.btrim(line, F.lit(BLANKS)).cast("binary")))


def sited(docs: DataFrame, site: str) -> DataFrame:
    """A row for each line with a word: doc_id, the text's hash, place, digest and site."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), F.coalesce(F.concat(F.lit("="), F.col(site).cast("string")), F.lit("")).alias("site"), F.posexplode(F.split("text", "\n")).alias("place", "line"))
    return rows.where(F.btrim("line", F.lit(BLANKS)) != "").select("doc_id", "h", "place", digest(F.col("line")).alias("digest"), "site")


def met(lines: DataFrame, listed: DataFrame, how: str) -> DataFrame:
    """``lines`` joined with ``listed`` (digest, n and others) by digest; ``n`` counts a digest's lines and is dropped.

    Boilerplate is frequent by nature: the lines of a hot digest are joined
    where they are, only those of the others are dealt by digest.
    """
    if listed.count() <= LISTED:
        return lines.join(F.broadcast(listed.drop("n")), "digest", how)
    hot = F.col("n") * HOT > (listed.agg(F.sum("n")).first()[0] or 0)
    near, far = listed.where(hot).drop("n"), listed.where(~hot).drop("n")
    return lines.join(F.broadcast(near), "digest", how).unionByName(lines.join(far, "digest", how))


def boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, band: float = BAND) -> DataFrame:
    """(digest, first, n_sites, n): the lines at ``min_sites`` sites or more, each with its first occurrence and their number."""
    lines = sited(docs, site)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "h", "place"))
    # A line stands at no more sites than it occurs, so plain counts tell which lines need a sketch at all.
    frequent = written(lines.groupBy("digest").agg(F.count("*").alias("n")).where(F.col("n") >= min_sites), "frequent")
    sketched = met(lines, frequent, "left_semi").groupBy("digest").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LOG2_SLOTS))).alias("about"), first.alias("first"), F.count("*").alias("n"))
    likely = written(sketched.where(F.col("about") * band >= min_sites), "spread")
    near = likely.where(F.col("about") <= min_sites * band).select("digest", "n")
    exact = met(lines, near, "left_semi").select("digest", "site").distinct().groupBy("digest").agg(F.count("*").alias("exact"))
    known = likely.join(exact, "digest", "left")
    sites = F.coalesce("exact", "about")
    return known.where(sites >= min_sites).select("digest", "first", sites.alias("n_sites"), "n")


def without_boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``, and ``_lines`` and ``_removed``, their numbers."""
    spread = written(boilerplate(docs, site, min_sites), "boilerplate")
    lines = sited(docs, site).drop("site")
    own = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "h", "place")
    hits = met(lines, spread.drop("n_sites"), "inner").where(~own.eqNullSafe(F.col("first")))
    gone = hits.groupBy(F.col("doc_id").alias("_d"), F.col("h").alias("_h")).agg(F.collect_set("place").alias("_gone"))
    keyed = docs.withColumn("_key", F.xxhash64("text"))
    joined = keyed.join(gone, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_h")), "left")
    parts = F.split("text", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "_gone")
    joined = joined.withColumn("_parts", F.when(F.col("_gone").isNotNull(), parts))
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.element_at("_parts", i + 1)), "\n"))
    counts = (F.coalesce(F.regexp_count("text", F.lit("\n")) + 1, F.lit(0)).cast("bigint").alias("_lines"), F.coalesce(F.array_size("_gone"), F.lit(0)).cast("bigint").alias("_removed"))
    return joined.select(*(text.alias(c) if c == "text" else F.col(c) for c in docs.columns), *counts)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_boilerplate(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return found.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_removed").alias("n_removed"), F.length("text").cast("bigint").alias("n_kept"), F.sha2("text", 256).alias("kept_sha256"))


OP7_SQL = rf"""
WITH docs AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS parts FROM documents),
lines AS (
  SELECT doc_id, source, i, regexp_replace(parts[i], '^[{SPACE}]+|[{SPACE}]+$', '', 'g') AS line
  FROM (SELECT doc_id, source, parts, unnest(generate_series(1, len(parts))) AS i FROM docs)
  WHERE regexp_matches(parts[i], '{WORD}')
),
spread AS (
  SELECT line, min(struct_pack(d := doc_id, i := i)) AS first
  FROM lines GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}
),
gone AS (
  SELECT doc_id, list(l.i) AS places FROM lines l JOIN spread s ON l.line = s.line
  WHERE NOT (l.doc_id = s.first.d AND l.i = s.first.i) GROUP BY doc_id
),
kept AS (
  SELECT d.doc_id, len(d.parts) AS n_lines, coalesce(len(g.places), 0) AS n_removed,
         CASE WHEN g.places IS NULL THEN d.text
              ELSE coalesce(array_to_string(list_transform(list_filter(generate_series(1, len(d.parts)), lambda k: NOT list_contains(g.places, k)), lambda k: d.parts[k]), chr(10)), '') END AS text
  FROM docs d LEFT JOIN gone g USING (doc_id)
)
SELECT doc_id, n_lines::BIGINT AS n_lines, n_removed::BIGINT AS n_removed, length(text)::BIGINT AS n_kept, sha256(text) AS kept_sha256 FROM kept
"""
