"""Quality rules by divergence from language references.

Base rules fail texts of fewer than MIN_WORDS words and texts in which more
than 30 % of the words stand in repeated eight-word windows. The others are
compared with references of their language, counted over all its documents of
at least MIN_WORDS words that lie within TRIM of the language's characters as a
whole: the shares of seven character classes, and those of
the COMMON most frequent short words and all the rest. A document is kept if
the Jensen-Shannon distance (base 2, its square root) of each histogram is
within its limit; a histogram of too few characters or words is not judged.

Defined cases: a null text has no words and fails the base rule; documents of
a null language form a language; ties among common words go by code point.
Repeated rows each count. Only doc_id, text and lang are read; an empty table
gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.llm.common import SPACE, WORD, documents, text_of, written

MIN_WORDS = 20
WINDOW = 8
COMMON = 20
#: Limits of the Jensen-Shannon distances, and the least characters and words judged.
CHAR_LIMIT, CHAR_LEAST = 0.2, 100
WORD_LIMIT, WORD_LEAST = 0.33, 50
#: Documents this far from all characters of their language don't enter its reference.
TRIM = 0.25
#: Character classes in the order in which they are taken out after small letters; what is in none of them is the last.
TAKEN = {"space": "[\\x09-\\x0D]", "upper": "[A-Z]", "mark": r"[.,;:!?'\"()\-]", "symbol": "[#*$%&|<>]", "digit": "[0-9]"}
NAMES = ["lower", *TAKEN, "other"]
LETTERS = 5
#: Small letters of any script, letters of scripts without case, and the marks on them.
SHORT = rf"^[\p{{Ll}}\p{{Lo}}\p{{M}}]{{1,{LETTERS}}}$"


def featured(docs: DataFrame) -> DataFrame:
    """One pass over the texts: the base counts, class counts and short words of each row, without the text.

    Classes are counted by taking them out one after the other, so later
    patterns meet only what is left; spaces go together with small letters,
    which leaves few and long matches, and are counted apart.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), F.col("lang").cast("string").alias("lang"), text_of().alias("t"))
    rows = rows.select("*", F.filter(F.split("t", f"[{SPACE}]+"), lambda w: w != "").alias("words"), F.filter(F.split("t", "\n"), lambda line: line.rlike(WORD)).alias("lines"), F.regexp_replace("t", "[a-z ]+", "").alias("left_lower"))
    before = "left_lower"
    for name, pattern in TAKEN.items():
        rows = rows.withColumn(f"left_{name}", F.regexp_replace(before, f"{pattern}+", ""))
        before = f"left_{name}"
    rows = with_repeats(rows)
    blanks = F.length("t") - F.length(F.replace("t", F.lit(" "), F.lit("")))
    counts = {"lower": F.length("t") - F.length("left_lower") - blanks}
    before = "left_lower"
    for name in TAKEN:
        counts[name] = F.length(before) - F.length(f"left_{name}")
        before = f"left_{name}"
    counts["space"] = counts["space"] + blanks
    counts["other"] = F.length(before)
    return rows.select(
        "doc_id",
        "h",
        "lang",
        F.size("words").cast("bigint").alias("n_words"),
        F.length("t").cast("bigint").alias("n_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        "n_repeat_words",
        F.array(*(counts[n].cast("bigint") for n in NAMES)).alias("classes"),
        F.filter("words", lambda w: F.length(w) <= LETTERS).alias("short"),
    )


def with_repeats(rows: DataFrame) -> DataFrame:
    """Adds n_repeat_words: the words in windows whose hash occurs twice or more in the row.

    Two equal windows of w words share, at one of any three successive places,
    runs of w - 2 words that both start at places 0 or 1 modulo 3. So where
    those runs are all distinct no window repeats, and only the other rows
    have all their windows hashed.
    """
    n, run = F.size("words"), WINDOW - 2

    def hashed(at: Column) -> Column:
        return F.xxhash64(*(F.get("words", at + k) for k in range(run)))

    runs = F.when(n >= WINDOW, F.concat(F.transform(F.sequence(F.lit(0), n - run, F.lit(3)), hashed), F.transform(F.sequence(F.lit(1), n - run, F.lit(3)), hashed)))
    rows = rows.withColumn("runs", runs)
    rows = rows.withColumn("again", F.coalesce(F.size(F.array_distinct("runs")) < F.size("runs"), F.lit(False)))
    rows = rows.withColumn("sorted", F.when(F.col("again"), F.array_sort(F.transform(F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.struct(F.xxhash64(F.slice("words", i, WINDOW)).alias("h"), i.alias("i"))))))
    # Sorted by hash, a repeated window has a neighbour of the same hash.
    previous = F.concat(F.array(F.lit(None).cast("bigint")), F.slice("sorted.h", 1, F.size("sorted") - 1))
    following = F.concat(F.slice("sorted.h", 2, F.size("sorted") - 1), F.array(F.lit(None).cast("bigint")))
    zipped = F.arrays_zip(F.col("sorted.h").alias("h"), F.col("sorted.i").alias("i"), previous.alias("p"), following.alias("f"))
    rows = rows.withColumn("at", F.when(F.col("again"), F.array_sort(F.transform(F.filter(zipped, lambda x: x["h"].eqNullSafe(x["p"]) | x["h"].eqNullSafe(x["f"])), lambda x: x["i"]))))
    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    covered = F.aggregate("at", start, lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("bigint")).drop("runs", "again", "sorted", "at")


def pooled(rows: DataFrame) -> DataFrame:
    """The class shares of each language as a whole."""
    sums = rows.groupBy("lang").agg(*(F.sum(F.get("classes", F.lit(i))).alias(n) for i, n in enumerate(NAMES)), F.sum("n_words").alias("n_words"))
    whole = sum((F.col(n) for n in NAMES), F.lit(0))
    return sums.select(F.col("lang").alias("ref_lang"), F.array(*(F.col(n) / whole for n in NAMES)).alias("ref_chars"), F.col("n_words").alias("ref_words_total"))


def own_chars() -> Column:
    # A text without characters has shares of 0; dividing by its length would be an error.
    return F.transform("classes", lambda c: c / F.greatest(F.col("n_chars"), F.lit(1)))


def references(rows: DataFrame) -> DataFrame:
    """A row for each language: its class shares and its common words with their shares."""
    judged_rows = rows.where(F.col("n_words") >= MIN_WORDS)
    first = written(pooled(judged_rows), "pooled")
    near = judged_rows.join(first, F.col("lang").eqNullSafe(F.col("ref_lang"))).where(divergence(own_chars(), F.col("ref_chars")) <= TRIM).drop("ref_lang", "ref_chars", "ref_words_total")
    chars = pooled(near)
    # Counted first and matched after, so the pattern meets each distinct word once.
    short = near.select("lang", F.explode("short").alias("w")).groupBy("lang", "w").agg(F.count("*").alias("n")).where(F.col("w").rlike(SHORT))
    best = short.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "w"))).where(F.col("r") <= COMMON)
    listed = best.groupBy(F.col("lang").alias("l")).agg(F.array_sort(F.collect_list(F.struct("r", "w", "n"))).alias("top"))
    joined = chars.join(listed, F.col("ref_lang").eqNullSafe(F.col("l")), "left")
    shares = F.transform("top", lambda x: x["n"] / F.col("ref_words_total"))
    rest = 1 - F.aggregate("top", F.lit(0).cast("bigint"), lambda a, x: a + x["n"]) / F.col("ref_words_total")
    return joined.select("ref_lang", "ref_chars", F.col("top.w").alias("ref_words"), F.concat(shares, F.array(rest)).alias("ref_shares"))


def divergence(own: Column, reference: Column) -> Column:
    """The Jensen-Shannon distance of two arrays of shares."""

    def term(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    each = F.zip_with(own, reference, lambda p, q: (term(p, (p + q) / 2) + term(q, (p + q) / 2)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(each, F.lit(0.0), lambda a, x: a + x)))


def _equals(k: int):
    return lambda x: x == F.get("ref_words", F.lit(k))


def judged(docs: DataFrame) -> DataFrame:
    """Base counts, both distances and the verdict for each row.

    The texts are read once: their features are written, and references and
    verdicts are made from those.
    """
    rows = written(featured(docs), "features")
    refs = written(references(rows), "references")
    rows = rows.join(refs, F.col("lang").eqNullSafe(F.col("ref_lang")), "left")
    rows = rows.withColumn("common", F.when(F.col("ref_words").isNotNull(), F.filter("short", lambda w: F.array_contains("ref_words", w))))
    # Spelled out word by word: within a lambda the optimizer would filter the row's words anew for each of them.
    hits = F.array(*(F.size(F.filter("common", _equals(k))).cast("double") / F.greatest(F.col("n_words"), F.lit(1)) for k in range(COMMON)))
    rows = rows.withColumn("hits", F.slice(hits, 1, F.size("ref_words")))
    own_words = F.concat("hits", F.array(1 - F.aggregate("hits", F.lit(0.0), lambda a, x: a + x)))
    rows = rows.withColumn("char_distance", F.when((F.col("n_chars") >= CHAR_LEAST) & F.col("ref_chars").isNotNull(), divergence(own_chars(), F.col("ref_chars"))))
    rows = rows.withColumn("word_distance", F.when((F.col("n_words") >= WORD_LEAST) & F.col("ref_shares").isNotNull(), divergence(own_words, F.col("ref_shares"))))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    near = (F.coalesce("char_distance", F.lit(0.0)) <= CHAR_LIMIT) & (F.coalesce("word_distance", F.lit(0.0)) <= WORD_LIMIT)
    return rows.select(
        "doc_id",
        "n_words",
        (F.col("n_chars") - F.get("classes", F.lit(NAMES.index("space")))).alias("word_chars"),
        F.get("classes", F.lit(NAMES.index("symbol"))).alias("n_symbols"),
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & near).alias("kept"),
        "char_distance",
        "word_distance",
        "h",
    )


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(documents(spark, sf_dir)).drop("char_distance", "word_distance", "h")


def _shares_sql() -> str:
    """SQL for the class counts of a text ``t``: small letters, the classes taken out and the rest."""
    counted = {"lower": "[a-z]", **TAKEN, "space": f"[{SPACE}]"}
    each = [f"len(regexp_extract_all(t, '{counted[n].replace(chr(39), chr(39) * 2)}'))" for n in NAMES[:-1]]
    return f"[{', '.join(each)}, length(t) - ({' + '.join(each)})]"


def _distance_sql(p: str, q: str) -> str:
    half = "list_transform(list_zip({0}, {1}), lambda z: CASE WHEN z[1] > 0 THEN z[1] * log2(z[1] / ((z[1] + z[2]) / 2)) ELSE 0.0 END)"
    return f"sqrt(greatest(0.0, (list_sum({half.format(p, q)}) + list_sum({half.format(q, p)})) / 2))"


OP4_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, lang, coalesce(text, '') AS t FROM documents),
f AS (SELECT k, doc_id, lang, t, regexp_extract_all(t, '{WORD}') AS w, {_shares_sql()} AS c, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM d),
g AS (SELECT k, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g FROM (SELECT k, w, unnest(generate_series(1, len(w) - {WINDOW - 1})) AS i FROM f WHERE len(w) >= {WINDOW})),
twice AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS n FROM g) WHERE n > 1),
again AS (SELECT k, sum(least({WINDOW}, i - coalesce(p, -{WINDOW})))::BIGINT AS n FROM (SELECT k, i, lag(i) OVER (PARTITION BY k ORDER BY i) AS p FROM twice) GROUP BY k),
base AS (SELECT f.*, len(w)::BIGINT AS n_words, coalesce(again.n, 0) AS n_repeat_words, list_transform(c, lambda x: x / length(t)) AS own FROM f LEFT JOIN again USING (k)),
ok AS (SELECT * FROM base WHERE n_words >= {MIN_WORDS}),
sums AS (SELECT lang, i, sum(c[i]) AS s FROM (SELECT lang, c, unnest(generate_series(1, {len(NAMES)})) AS i FROM ok) GROUP BY lang, i),
pooled AS (SELECT lang, list(s / total ORDER BY i) AS q FROM (SELECT *, sum(s) OVER (PARTITION BY lang) AS total FROM sums) GROUP BY lang),
near AS (SELECT ok.* FROM ok JOIN pooled ON ok.lang IS NOT DISTINCT FROM pooled.lang WHERE {_distance_sql('own', 'q')} <= {TRIM}),
sums2 AS (SELECT lang, i, sum(c[i]) AS s FROM (SELECT lang, c, unnest(generate_series(1, {len(NAMES)})) AS i FROM near) GROUP BY lang, i),
chars AS (SELECT lang, list(s / total ORDER BY i) AS rc FROM (SELECT *, sum(s) OVER (PARTITION BY lang) AS total FROM sums2) GROUP BY lang),
totals AS (SELECT lang, sum(n_words) AS total FROM near GROUP BY lang),
short AS (SELECT lang, w, count(*) AS n FROM (SELECT lang, unnest(w) AS w FROM near) WHERE regexp_matches(w, '{SHORT}') GROUP BY lang, w),
best AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, w) AS r FROM short QUALIFY r <= {COMMON}),
refs AS (SELECT chars.lang, rc, rw, list_append(list_transform(rn, lambda x: x / total), 1 - list_sum(rn) / total) AS rs FROM chars JOIN totals ON chars.lang IS NOT DISTINCT FROM totals.lang
  LEFT JOIN (SELECT lang, list(w ORDER BY r) AS rw, list(n ORDER BY r) AS rn FROM best GROUP BY lang) b ON b.lang IS NOT DISTINCT FROM chars.lang),
hits AS (SELECT base.*, rc, rs, list_transform(rw, lambda x: len(list_filter(w, lambda y: y = x)) / n_words) AS h FROM base LEFT JOIN refs ON base.lang IS NOT DISTINCT FROM refs.lang),
far AS (SELECT *, CASE WHEN length(t) >= {CHAR_LEAST} AND rc IS NOT NULL THEN {_distance_sql('own', 'rc')} END AS cd,
  CASE WHEN n_words >= {WORD_LEAST} AND rs IS NOT NULL THEN {_distance_sql('list_append(h, 1 - list_sum(h))', 'rs')} END AS wd,
  n_words < {MIN_WORDS} OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM hits)
SELECT doc_id, n_words, (length(t) - c[{NAMES.index('space') + 1}])::BIGINT AS word_chars, c[{NAMES.index('symbol') + 1}]::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  base_failed, NOT base_failed AND coalesce(cd, 0) <= {CHAR_LIMIT} AND coalesce(wd, 0) <= {WORD_LIMIT} AS kept FROM far
"""
