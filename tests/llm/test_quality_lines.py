import re
from collections import Counter

from pyspark.sql import functions as F

from marginalia.llm import lines, quality

WORD = r"[^\x20\x09-\x0D]+"


def counts(text):
    words = re.findall(WORD, text or "")
    n = len(words)
    seen = Counter(tuple(words[i : i + 8]) for i in range(n - 7))
    covered = {j for i in range(n - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    own = [x for x in (text or "").split("\n") if re.search(WORD, x)]
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(own) - len(set(own)), len(covered), n < 20 or 100 * len(covered) > 30 * n)


def test_base_counts(spark, docs, edge):
    odd = spark.createDataFrame([(1, "a b c d e f g h i a b c d e f g h"), (2, "a " * 50), (3, "x\n\nx\n \nx #$"), (4, " ".join(f"q{i}" for i in range(30)) + " " + " ".join(f"q{i}" for i in range(2, 12)))], "doc_id bigint, text string").withColumn("lang", F.lit("en"))
    # Odd rows beside plain ones: null and empty texts of languages that have references.
    both = docs.withColumn("doc_id", F.col("doc_id") + 1000).unionByName(edge, allowMissingColumns=True)
    for frame in (docs, edge, odd, both):
        texts = {}
        for r in frame.collect():
            texts.setdefault(r["doc_id"], r["text"])
        rows = quality.judged(frame).collect()
        assert len(rows) == frame.count()
        for r in rows:
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == counts(texts[r["doc_id"]])
            assert not (r["base_failed"] and r["kept"])


def test_verdicts_follow_labels(spark):
    big = "/root/testdata/sf0.01"
    judged = quality.judged(spark.read.parquet(f"{big}/documents.parquet"))
    marked = judged.join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").where("n_words >= 20")
    n = {(r["quality"], r["kept"]): r["count"] for r in marked.groupBy("quality", "kept").count().collect()}
    assert n[1, True] / (n[1, True] + n.get((1, False), 0)) > 0.98
    assert n[0, False] / (n[0, False] + n.get((0, True), 0)) > 0.85


def test_same_text_gives_distance_zero(spark):
    assert spark.range(1).select(quality.divergence(F.array(F.lit(0.5), F.lit(0.5)), F.array(F.lit(0.5), F.lit(0.5)))).first()[0] == 0
    assert spark.range(1).select(quality.divergence(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0)))).first()[0] == 1


def line_brute(rows, least):
    place = lambda r, i: (r["doc_id"] is None, r["doc_id"] or 0, i)
    spread, first = {}, {}
    for r in rows:
        for i, line in enumerate((r["text"] or "").split("\n")):
            key = line.strip(" \t\n\x0b\x0c\r")
            if key:
                spread.setdefault(key, set()).add(r["source"])
                first[key] = min(first.get(key, place(r, i)), place(r, i))
    out = []
    for r in rows:
        if r["text"] is None:
            out.append((r["doc_id"], None))
            continue
        kept = [x for i, x in enumerate(r["text"].split("\n")) if not (len(spread.get(k := x.strip(" \t\n\x0b\x0c\r"), ())) >= least and first[k] != place(r, i))]
        out.append((r["doc_id"], "\n".join(kept)))
    return sorted(out, key=str)


def test_lines(spark, docs, edge, empty):
    many = spark.createDataFrame([(i, f"common line\nown {i}\n  common line ", f"s{i % 12}") for i in range(40)] + [(99, "rare\nrare", "z"), (100, "rare", "y")], "doc_id bigint, text string, source string")
    for frame, least in ((many, 10), (many, 2), (docs, 10), (docs, 3), (edge, 2)):
        got = lines.without_boilerplate(frame, min_sites=least)
        assert got.columns == [*frame.columns, "_lines", "_removed"]
        assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == line_brute(frame.collect(), least)
    assert lines.without_boilerplate(empty).count() == 0


def test_long_lists_of_lines_give_the_same(spark, docs, edge, empty, monkeypatch):
    """Beyond LISTED digests only hot ones are handed to every task."""
    monkeypatch.setattr(lines, "LISTED", -1)
    for hot in (10_000, 3):
        monkeypatch.setattr(lines, "HOT", hot)
        for frame, least in ((docs, 3), (edge, 2)):
            got = lines.without_boilerplate(frame, min_sites=least)
            assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == line_brute(frame.collect(), least)
        assert lines.without_boilerplate(empty).count() == 0


def test_common_words_of_other_scripts(spark):
    """Short words of any script make a reference, so texts of other words are far from it."""
    common, rare = "и в не на что с по как это все".split(), [f"{a}{b}{c}дежда" for a in "абвгде" for b in "жзиклм" for c in "нопр"]
    rows = [(i, " ".join(w for k in range(40) for w in (common[(i + k * 7) % 10], rare[(i * 13 + k) % 144])), "ru") for i in range(60)]
    rows.append((60, " ".join(rare[k % 144] for k in range(80)), "ru"))
    found = {r["doc_id"]: r for r in quality.judged(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert all(found[i]["word_distance"] < quality.WORD_LIMIT and found[i]["kept"] for i in range(60))
    assert found[60]["word_distance"] > quality.WORD_LIMIT and not found[60]["kept"]
