import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import fingerprints, mixing, sharding
from marginalia.llm.common import WordHashes, shingle_hashes, words_of


def water(sizes, weights=(3, 1, 2)):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    goal, target, free = 1.5 * sum(sizes.values()), {}, set(order)
    while free:
        left = goal - sum(target.values())
        over = [s for s in free if left * w[s] / sum(w[x] for x in free) >= 2 * sizes[s]]
        if not over:
            total = sum(w[x] for x in free)
            target |= {s: left * w[s] / total for s in free}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            free.discard(s)
    return target


@pytest.mark.parametrize("name", ["docs", "edge"])
def test_mixture(request, name):
    frame = request.getfixturevalue(name)
    rows = mixing.mixture(frame).collect()
    assert len(rows) == frame.count()
    sizes, taken, most = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        assert r["size"] == len(words_of(r["text"])) and r["copies"] in (0, 1, 2)
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["copies"] * r["size"]
        most[r["source"]] = max(most[r["source"]], r["size"])
    want = water(dict(sizes))
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
    if name == "docs":
        for s in sizes:
            assert abs(taken[s] - want[s]) <= max(0.03 * want[s], 25)
    again = mixing.mixture(frame.repartition(3)).collect()
    key = lambda r: (str(r["doc_id"]), str(r["source"]), r["size"], r["copies"])
    assert sorted(map(key, rows)) == sorted(map(key, again))


def test_mixture_of_nothing(empty):
    assert mixing.mixture(empty).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 16, 17, 99, 1000])
def test_permutation(spark, n):
    assert sorted(r[0] for r in spark.range(n).select(sharding.permuted(F.col("id"), n)).collect()) == list(range(n))


@pytest.mark.parametrize("name", ["docs", "edge", "empty"])
def test_shards(request, name):
    frame = request.getfixturevalue(name)
    rows, source = sharding.shards(frame).collect(), frame.collect()
    assert sorted(r["number"] for r in rows) == list(range(len(source)))
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    if len(source) >= 16:
        assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    want = sorted((str(r["doc_id"]), len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in source)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == want
    assert sorted(map(tuple, rows)) == sorted(map(tuple, sharding.shards(frame.repartition(3)).collect())) if name == "docs" else True


def test_shards_of_many_copies(spark, monkeypatch):
    """Copies beyond COPIES are numbered by several tasks; every number is given once."""
    frame = spark.createDataFrame([(None, "x")] * 95 + [(7, "x")] * 10 + [(i, None) for i in range(5)], "doc_id bigint, text string")
    want = sorted(map(tuple, sharding.shards(frame, 4).collect()), key=str)
    monkeypatch.setattr(sharding, "COPIES", 10)
    assert sorted(map(tuple, sharding.shards(frame, 4).collect()), key=str) == want
    assert sorted(r[3] for r in want) == list(range(110))


@pytest.mark.parametrize("name", ["docs", "edge", "empty"])
def test_edited_fingerprints(request, name):
    frame = request.getfixturevalue(name)
    source = [(r["doc_id"], r["text"] or "") for r in frame.collect()]
    # Nulls last; rows of one doc_id have one text here, so their order is no matter.
    source.sort(key=lambda x: (x[0] is None, -(x[0] or 0)))
    want = []
    for i, (doc, text) in enumerate(source):
        half = len(text) // 2
        want.append((str(doc), len(text), hashlib.sha256((text[: len(text) - half] + source[(i + 1) % len(source)][1][:half]).encode()).hexdigest()))
    rows = fingerprints.edited_fingerprints(frame).collect()
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in rows) == sorted(want)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)


def test_sketches_estimate_and_merge(spark):
    hashes = WordHashes()
    a = shingle_hashes([b"w%d" % i for i in range(3000)], 5, hashes)
    b = shingle_hashes([b"w%d" % i for i in range(1000, 4000)], 5, hashes)
    x, y = fingerprints.Sketch.of(a, 512), fingerprints.Sketch.of(b, 512)
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs(x.resemblance(y) - true) < 0.08
    assert abs(x.distinct() / len(a) - 1) < 0.15
    assert abs(x.containment(y) - len(np.intersect1d(a, b)) / len(a)) < 0.15
    assert x.merge(y).text() == fingerprints.Sketch.of(np.union1d(a, b), 512).text()
    assert fingerprints.Sketch.parse(x.text(), 512).text() == x.text()
    k = 64
    parts = spark.createDataFrame([("d", fingerprints.Sketch.of(a, k).text()), ("d", fingerprints.Sketch.of(b, k).text())], "key string, fingerprint string")
    assert fingerprints.merged(parts, "key", k).first()["fingerprint"] == fingerprints.Sketch.of(np.union1d(a, b), k).text()


def test_edited_fingerprints_of_hot_ids(spark):
    """Half of the rows share an id or have none; nulls come last, rows of an id in order of their text's hash."""
    rows = [(7 if i % 4 == 0 else None if i % 4 == 1 else i, f"text {i} says " + " ".join(f"w{i * j % 50}" for j in range(i % 40))) for i in range(400)]
    rows += [(7, "the same row"), (7, "the same row"), (None, ""), (None, None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    order = [(r["doc_id"], r["t"], r["h"]) for r in frame.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).withColumn("h", F.xxhash64("t")).collect()]
    order.sort(key=lambda r: (r[0] is None, -(r[0] or 0), r[2]))
    tool, want = fingerprints.Fingerprinter(), []
    for i, (doc, text, _) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own = tool.sketch(text)
        want.append((str(doc), len(text), hashlib.sha256(edited.encode()).hexdigest(), own.text(), own.resemblance(tool.sketch(edited)), own.resemblance(tool.sketch(after))))
    names = ("n_chars", "edited_sha256", "fingerprint", "near_edited", "near_next")
    rows = fingerprints.edited_fingerprints(frame).collect()
    assert sorted((str(r["doc_id"]), *(r[n] for n in names)) for r in rows) == sorted(want)
    placed, split = fingerprints._ranged(frame.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    assert split and max(r["count"] for r in placed.groupBy("slot").count().collect()) < 60


def test_likeness_against_sets(spark, docs):
    """near_edited and near_next are the resemblance of bottom-k sketches made from whole shingle sets."""
    source = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), reverse=True)
    hashes, k = WordHashes(), fingerprints.K
    least = lambda t: set(shingle_hashes(words_of(t), fingerprints.WIDTH, hashes)[:k].tolist())

    def like(x, y):
        union = sorted(x | y)[:k]
        return sum(v in x and v in y for v in union) / len(union) if union else 1.0

    want = {}
    for i, (doc, text) in enumerate(source):
        after, half = source[(i + 1) % len(source)][1], len(text) // 2
        want[doc] = (like(least(text), least(text[: len(text) - half] + after[:half])), like(least(text), least(after)))
    for r in fingerprints.edited_fingerprints(docs).collect():
        assert (r["near_edited"], r["near_next"]) == pytest.approx(want[r["doc_id"]])


def test_multipliers_of_uneven_sizes(spark, monkeypatch):
    """Targets at either end of what a source of very uneven sizes can give are met; no convergence is an error."""
    sizes = [1, 2, 3, 50, 1_000, 400_000]
    counts = spark.createDataFrame([(s, z, 10) for s in ("low", "high", "mid") for z in sizes], "source string, size bigint, n bigint")
    whole = 10 * sum(sizes)
    goals = spark.createDataFrame([("low", whole, whole * 1e-4), ("high", whole, whole * 1.9999), ("mid", whole, whole * 1.2)], "source string, source_size bigint, target double")
    for r in mixing.multipliers(counts, goals).collect():
        got = sum(10 * z * 2 / (1 + np.exp(-np.clip(r["tilt"] * z / r["mean"], -700, 700))) for z in sizes)
        assert got == pytest.approx(r["target"], rel=1e-4)
    monkeypatch.setattr(mixing, "STEPS", 2)
    with pytest.raises(RuntimeError):
        mixing.multipliers(counts, goals)
