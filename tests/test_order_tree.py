"""Global orders, sweeps and interval labels against brute force."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from marginalia.operators import order, review, tree

BLOCK = "path string, ord int, kind string, content string, hash string, start_line int, end_line int"


@pytest.fixture
def small_buckets(monkeypatch):
    monkeypatch.setattr(order, "BUCKET", 7)


def paths(rng, n):
    """Distinct file paths in which no directory is a file, with names around the slash in byte order."""
    found = set()
    while len(found) < n:
        found.add("/".join(rng.choice(["a", "a-b", "a.b", "b", "a0"]) + "d" for _ in range(rng.randrange(4))) + f"/f{rng.randrange(60)}.rs")
    return sorted(p.lstrip("/") for p in found)


def above(path):
    parts = path.split("/")
    return ["/".join(parts[:i]) for i in range(len(parts))]


def test_ranks_of_hot_keys_and_nulls(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "hot", None, "x", "y"]), rng.randrange(5), i) for i in range(500)]
    got = order.ranked(spark.createDataFrame(rows, "k string, v int, i int").repartition(3), "k", ["v", "i"]).collect()
    by = {}
    for k, v, i in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2])):
        by.setdefault(k, []).append(i)
    assert {(r["k"], r["i"]): r["rank"] for r in got} == {(k, i): n for k, own in by.items() for n, i in enumerate(own)}
    assert order.ranked(spark.createDataFrame([], "k string, v int"), "k", ["v"]).count() == 0


def test_neighbours_and_running_maxima_over_buckets(spark, small_buckets):
    n = 50
    rows = spark.createDataFrame([(i, f"v{i}") for i in range(n)], "rank bigint, v string").repartition(5)
    got = {r["rank"]: (r["before"], r["after"]) for r in order.neighbours(rows, "v").collect()}
    assert got == {i: (f"v{i - 1}" if i else None, f"v{i + 1}" if i < n - 1 else None) for i in range(n)}
    rng = random.Random(2)
    values = [(rng.randrange(60), rng.randrange(3), rng.choice([None, rng.randrange(100)])) for _ in range(200)]
    values = sorted(set(values), key=lambda r: (r[0], r[1], r[2] or 0))
    got = order.running_max(spark.createDataFrame(values, "at bigint, tie int, v bigint"), "at", F.struct("tie", F.coalesce("v", F.lit(0))), "v").collect()
    most, expected = None, {}
    for row in values:
        most = row[2] if most is None else most if row[2] is None else max(most, row[2])
        expected[row] = most
    assert {(r["at"], r["tie"], r["v"]): r["reach"] for r in got} == expected


def test_labels_counts_and_coverage(spark, small_buckets):
    rng = random.Random(4)
    names = paths(rng, 120)
    files = spark.createDataFrame([(p, hashlib.sha256(p.encode()).hexdigest()) for p in names], "path string, hash string").repartition(6)
    ordered = sorted(names, key=lambda p: p.split("/"))
    expected = {p: (i, i) for i, p in enumerate(ordered)}
    for i, p in enumerate(ordered):
        for d in above(p):
            first, _ = expected.get(d, (i, i))
            expected[d] = (first, i)
    numbered, labelled = tree.labels(files)
    assert {r["path"]: (r["first"], r["last"]) for r in labelled.collect()} == expected
    assert {r["path"]: r["rank"] for r in numbered.collect()} == {p: i for i, p in enumerate(ordered)}
    assert {r["ancestor"]: r["n_files"] for r in tree.subtree_counts(files).collect()} == {d: b - a + 1 for d, (a, b) in expected.items() if d not in names}
    nodes = tree.nodes(files)
    held = {r["path"]: r["hash"] for r in nodes.collect()}
    for good in [[], [""], ["ad"], rng.sample(sorted(held), 9)]:
        approved = spark.createDataFrame([(held[g],) for g in good if g in held], "hash string").distinct()
        hashes = {held[g] for g in good if g in held}
        want = sorted(p for p in names if any(held[x] in hashes for x in [p, *above(p)]))
        assert sorted(r["path"] for r in tree.covered(files, nodes, approved).collect()) == want
    some = next(d for d in expected if d and d not in names)
    assert sorted(r["path"] for r in tree.below(labelled, numbered, some).collect()) == [p for p in names if p.startswith(some + "/")]
    none = files.limit(0)
    assert [x.count() for x in tree.labels(none)] == [0, 0] and tree.covered(none, nodes, nodes.select("hash")).count() == 0


def test_directory_digest_is_that_of_the_whole_string(spark):
    # Blanks before line feeds within names are trimmed as in the joined text.
    files = [("d/a \n b", "1"), ("d/b\t", "2"), ("d/c　\n", "3"), ("e", "4")]
    got = {r["path"]: r["hash"] for r in tree.nodes(spark.createDataFrame(files, "path string, hash string")).collect()}
    assert got["d"] == hashlib.sha256("file:a\n b:1|file:b\t:2|file:c\n:3|\n".encode()).hexdigest()
    many = spark.range(200_000).select(F.concat(F.lit("big/f"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("path"), F.sha2(F.col("id").cast("string"), 256).alias("hash"))
    state = hashlib.sha256()
    for i in range(200_000):
        state.update(f"file:f{i:06d}:{hashlib.sha256(str(i).encode()).hexdigest()}|".encode())
    state.update(b"\n")
    assert tree.nodes(many).where("path = 'big'").first()["hash"] == state.hexdigest()


def test_five_impls_deep(spark):
    rows = [("p", i, "impl", f"impl A{i} {{\n", f"h{i}", i, 40 - i) for i in range(5)]
    rows += [("p", 5, "method", "fn m(x) {}\n", "h5", 10, 11), ("p", 6, "method", "fn n() {}\n", "h6", 38, 39), ("p", 7, "function", "fn o() {}\n", "h7", 50, 51)]
    blocks = spark.createDataFrame(rows, BLOCK)
    nodes = {r["ord"]: (r["depth"], r["parent_ord"]) for r in tree.block_nodes(blocks).collect()}
    assert [nodes[i] for i in range(8)] == [(2, None), (3, 0), (4, 1), (5, 2), (6, 3), (7, 4), (4, 1), (2, None)]
    crumbs = {r["ord"]: r["crumbs"] for r in tree.breadcrumbs(blocks).collect()}
    assert crumbs[5] == "File (p) -> impl A0 -> impl A1 -> impl A2 -> impl A3 -> impl A4 -> fn m"
    assert crumbs[2] == "File (p) -> impl A0 -> impl A1 -> impl A2 -> impl A2"
    assert crumbs[7] == "File (p) -> fn o"


def test_sweeps_equal_brute_force(spark):
    rng = random.Random(7)
    rows = []
    for p in "ab":
        for i in range(120):
            start = rng.randrange(80)
            rows.append((p, i, rng.choice(["impl", "interface", "method", "function"]), "x\n", "h", start, start + rng.randrange(30)))
    blocks = spark.createDataFrame(rows, BLOCK)
    got = {(r["path"], r["ord"]): r["impl_ord"] for r in tree.enclosing(blocks).collect()}
    for p, i, _, _, _, s, e in rows:
        outer = [(s2, e2, j) for q, j, k, _, _, s2, e2 in rows if q == p and k in tree.ENCLOSING and (s2, e2, j) < (s, e, i) and s >= s2 and e <= e2]
        assert got[p, i] == (max(outer)[2] if outer else None)
    spans = [(rng.choice("abc"), s, s + rng.randrange(4)) for s in (rng.randrange(80) for _ in range(12))]
    found = {(r["path"], r["ord"]) for r in tree.overlapping(blocks, spark.createDataFrame(spans, "path string, s int, e int")).collect()}
    assert found == {(r[0], r[1]) for r in rows if any(q == r[0] and r[5] < e and r[6] > s for q, s, e in spans)}


def test_a_file_of_many_blocks(spark):
    n = 100_000
    blocks = spark.range(n).select(F.lit("p").alias("path"), F.col("id").cast("int").alias("ord"), F.when(F.col("id") % 10 == 0, "impl").otherwise("method").alias("kind"), F.lit("x").alias("content"), (F.col("id") * 2).cast("int").alias("start_line"), (F.col("id") * 2 + F.when(F.col("id") % 10 == 0, 19).otherwise(1)).cast("int").alias("end_line"))
    assert tree.enclosing(blocks).where(~F.col("impl_ord").eqNullSafe(F.when(F.col("ord") % 10 > 0, F.col("ord") - F.col("ord") % 10))).count() == 0
    spans = blocks.where("ord % 1000 = 5").select("path", F.col("start_line").alias("s"), F.col("end_line").alias("e"))
    # The block itself and the impl around it.
    assert tree.overlapping(blocks, spans).count() == 2 * (n // 1000)


def session(rng):
    rows = []
    for p in ["src/lib.rs", "src/a/b.rs", "src/a/c.rs", "tests/a.rs", "a/x.rs", "a/y/z.rs", "a-b/q.rs", "z.rs", "src/main.rs"]:
        for i in range(rng.randrange(1, 7)):
            rows.append((p, i, rng.choice(["function", "import", "struct", "gap"]), ["test"] if rng.random() < 0.2 else [], i * 3, rng.random() < 0.25))
    return rows


def test_next_over_all_files_and_after_subtrees(spark):
    for seed in range(3):
        rows = session(random.Random(seed))
        frame = spark.createDataFrame(rows, "path string, ord int, kind string, tags array<string>, start_line int, remains boolean").repartition(5)
        blocks = review.session_order(frame)
        ordered = sorted(blocks.collect(), key=lambda r: (r["group"], r["path"], r["band"], r["priority"], r["start_line"], r["ord"]))

        def first(after, outside=None):
            for r in ordered[after + 1 :]:
                inside = outside is not None and (outside == "" or r["path"] == outside or r["path"].startswith(outside + "/"))
                if r["remains"] and not inside:
                    return r["path"], r["ord"]
            return None

        got = {(r["path"], r["ord"]): r["next"] and tuple(r["next"]) for r in tree.next_remaining(blocks, F.col("remains")).collect()}
        assert got == {(r["path"], r["ord"]): first(i) for i, r in enumerate(ordered)}
        nodes = {x for r in rows for x in [r[0], *above(r[0])]}
        starts = {d: next(i for i, r in enumerate(ordered) if d == "" or r["path"] == d or r["path"].startswith(d + "/")) for d in nodes}
        found = {r["node"]: r["next"] and tuple(r["next"]) for r in tree.next_after_subtree(blocks, F.col("remains")).collect()}
        assert found == {d: first(i, d) for d, i in starts.items()}
    ranks = {(r["path"], r["ord"]): r["rank"] for r in review.session_ranks(frame).collect()}
    assert ranks == {(r["path"], r["ord"]): i for i, r in enumerate(ordered)}
