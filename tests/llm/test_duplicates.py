import hashlib
import random
import re

import numpy as np
import pytest

from marginalia.llm import jaccard, suffixes, units
from marginalia.llm.common import words_of

from .conftest import LONG, ROWS


def shingles(text, width):
    w = words_of(text)
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def components(rows, width, percent):
    sets = [shingles(t, width) for _, t in rows]
    above = list(range(len(rows)))

    def find(x):
        while above[x] != x:
            x = above[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                above[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    least = {k: min((d for d in v if d is not None), default=None) for k, v in groups.items()}
    return sorted((str(rows[i][0]), len(sets[i]), str(least[find(i)] if sets[i] else rows[i][0])) for i in range(len(rows)))


def near_copies(seed=1):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}"
    rows = []
    for _ in range(12):
        base = [word() for _ in range(rng.randrange(6, 120))]
        for _ in range(rng.randrange(1, 12)):
            copy = list(base)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
    common = " ".join(f"c{i}" for i in range(30))
    rows += [f"{common} {' '.join(word() for _ in range(60))}" for _ in range(25)]
    rows += [None, "", " ", "a b", "A b", "a b c d", "a b c d"]
    return [(i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize(("region", "leaf", "block", "often"), [(64, 4, 1000, 48), (3, 2, 4, 2)])
def test_jaccard_equals_brute_force(spark, monkeypatch, region, leaf, block, often):
    for name, value in (("REGION", region), ("LEAF", leaf), ("BLOCK", block), ("OFTEN", often), ("PART", 5)):
        monkeypatch.setattr(jaccard, name, value)
    rows = near_copies()
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = jaccard.classes(frame, 4, 85).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == components(rows, 4, 85)


def test_documents_are_pivots_of_cells_in_the_given_tables(spark, monkeypatch):
    """Pivots, Voronoi cells and guests of windows on the main path, at every size of table."""
    from collections import Counter

    from marginalia.llm.common import written

    met, parted = Counter(), jaccard.parted

    def counted(*given):
        told = written(parted(*given), "counted")
        for r in told.groupBy("kind", "own").count().collect():
            met[r["kind"], r["own"]] += r["count"]
        return told

    monkeypatch.setattr(jaccard, "parted", counted)
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    assert jaccard.classes(docs, 4, 85).count() == docs.count()
    print(met)
    assert met["link", False] > 0 and met["place", True] > 0 and met["place", False] > 0


def test_jaccard_edges(edge, empty):
    rows = [(r["doc_id"], r["text"]) for r in edge.select("doc_id", "text").collect()]
    got = jaccard.classes(edge, 5, 80).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == components(rows, 5, 80)
    kept = jaccard.representatives(edge, 5, 80)
    assert kept.columns == edge.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "4", "5", "6", "8", "9"]
    assert jaccard.classes(empty).count() == 0


def test_pivots_connect_what_links_connect():
    rng = np.random.default_rng(4)
    for _ in range(20):
        base = rng.choice(5000, 60, replace=False)
        sets = [np.unique(np.concatenate([base[rng.random(60) > 0.08], rng.choice(5000, 3)])).astype(np.uint64) for _ in range(40)]
        for side in (np.zeros(40, int), (np.arange(40) % 2)):
            forest = jaccard.Forest(40)
            for a, b in jaccard.pivot_links(sets, side, 85):
                forest.above[max(forest.root(a), forest.root(b))] = min(forest.root(a), forest.root(b))
            true = jaccard.Forest(40)
            for a in range(40):
                for b in range(a):
                    both = len(np.intersect1d(sets[a], sets[b]))
                    if (side.max() == 0 or side[a] != side[b]) and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                        x, y = true.root(a), true.root(b)
                        true.above[max(x, y)] = min(x, y)
            assert [forest.root(i) for i in range(40)] == [true.root(i) for i in range(40)]


def family_sets(kind, n=90):
    rng = np.random.default_rng(6)
    if kind == "dense":  # edited copies of one text, most of them linked
        base = rng.choice(9000, 80, replace=False)
        return [np.unique(np.concatenate([base[rng.random(80) > rng.choice([0.02, 0.06, 0.15])], rng.choice(9000, 2)])) for _ in range(n)]
    if kind == "chain":  # each links with its neighbours only
        return [np.arange(5 * i, 5 * i + 80) for i in range(n)]
    if kind == "bases":  # several groups of copies
        bases = [rng.choice(9000, 60, replace=False) for _ in range(7)]
        return [np.unique(np.concatenate([bases[i % 7][rng.random(60) > 0.05], rng.choice(9000, 2)])) for i in range(n)]
    return [np.unique(np.concatenate([np.arange(9000, 9020), rng.choice(9000, 60)])) for _ in range(n)]  # unrelated but for a common part


@pytest.mark.parametrize(("kind", "pivots", "spread"), [("dense", 3, 2), ("dense", 8, 100), ("chain", 4, 2), ("chain", 8, 100), ("bases", 3, 100), ("bases", 9, 2), ("unrelated", 4, 2)])
def test_families_equal_brute_force(spark, monkeypatch, kind, pivots, spread):
    for name, value in (("BLOCK", 12), ("HALF", 6), ("PIVOTS", pivots), ("ROUNDS", 2), ("SPREAD", spread)):
        monkeypatch.setattr(jaccard, name, value)
    sets = [x.astype(np.uint64) for x in family_sets(kind)]
    n = len(sets)
    family = spark.createDataFrame([(1000 + i, 1000, n) for i in range(n)], "node bigint, root bigint, size bigint")
    held = spark.createDataFrame([(1000 + i, x.tobytes()) for i, x in enumerate(sets)], "node bigint, shingles binary")
    found = {(r["a"] - 1000, r["b"] - 1000) for r in jaccard.family_links(family, held, 85).collect()}
    links = {(a, b) for a in range(n) for b in range(a) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 85 * len(np.union1d(sets[a], sets[b]))}
    assert all((max(x), min(x)) in links for x in found)
    roots = []
    for every in (found, links):
        forest = jaccard.Forest(n)
        for a, b in every:
            x, y = forest.root(a), forest.root(b)
            forest.above[max(x, y)] = min(x, y)
        roots.append([forest.root(i) for i in range(n)])
    assert roots[0] == roots[1]


def test_guests_of_near_copies_make_no_rows_until_their_cell_is_split(spark, monkeypatch):
    """Among near copies each node lies within the window of all pivots, so a row for each region would be pivots times nodes."""
    made, written = {}, jaccard.written

    def counted(df, label):
        out = written(df, label)
        made.setdefault(label, []).append(out.count())
        return out

    monkeypatch.setattr(jaccard, "written", counted)
    monkeypatch.setattr(jaccard, "ROUNDS", 2)
    rng = np.random.default_rng(3)
    sets = [np.unique(np.concatenate([np.arange(80), rng.choice(np.arange(80, 9000), 11, replace=False)])).astype(np.uint64) for _ in range(200)]
    family = spark.createDataFrame([(1000 + i, 1000) for i in range(200)], "node bigint, root bigint")
    held = spark.createDataFrame([(1000 + i, x.tobytes()) for i, x in enumerate(sets)], "node bigint, shingles binary")
    # 80 of 102 shingles are shared: no two link, and all are within twice the limit of all pivots.
    assert jaccard.family_links(family, held, 85).count() == 0
    assert len(made["parted"]) == 2 and max(made["parted"]) <= 2 * 200
    assert made["cells"][0] == 200 and made["cells"][1] == 200 - 16


def test_a_large_cell_is_not_one_task_of_its_pivots(spark, monkeypatch):
    """Each task hands on few candidates of a cell to the one that numbers its pivots."""
    monkeypatch.setattr(jaccard, "PIVOTS", 5)
    cells = spark.range(0, 400, 1, 4).selectExpr("id AS node", "IF(id < 391, 1L, 2L) AS cell", "true AS own", "0L AS grp", "IF(id < 391, 391L, 9L) AS size")
    pivots = jaccard.pivots_of(cells, 0)
    assert "WindowGroupLimit" in pivots._jdf.queryExecution().executedPlan().toString()
    found = [(r["cell"], r["q"], r["node"]) for r in pivots.orderBy("cell", "q").collect()]
    order = {c: [r["node"] for r in cells.where(f"cell = {c}").selectExpr("node", "xxhash64(node, 0) AS h").orderBy("h").collect()] for c in (1, 2)}
    assert found == [(1, q, order[1][q]) for q in range(5)] + [(2, q, order[2][q]) for q in range(4)]


def test_sets_that_share_a_number_get_the_other(spark):
    rows = spark.createDataFrame([(1, 7, 70), (2, 7, 70), (3, 7, 71), (4, 8, 80)], "doc_id bigint, node bigint, check bigint")
    found, clashes = jaccard.named(rows)
    assert clashes == {7}
    assert sorted(tuple(r) for r in found.select("doc_id", "node").collect()) == [(1, 70), (2, 70), (3, 71), (4, 8)]
    x = np.arange(5, dtype=np.uint64)
    first, second = jaccard.names_of(x)
    assert jaccard.node_of(x) == first and jaccard.node_of(x, frozenset([first])) == second


def removed_bytes(rows, length=100):
    seen, out = set(), []
    for doc, text in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0)):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            piece = data[i : i + length]
            if piece in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(piece)
        runs = sum(1 for i in range(len(data)) if gone[i] and not (i and gone[i - 1]))
        out.append((str(doc), len(data), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(data, gone) if not g)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("block", [250_000, 1_000])
def test_suffixes_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(suffixes, "BLOCK", block)
    monkeypatch.setattr(suffixes, "SEGMENT", 10_000)
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("ab cé") for _ in range(n))
    passage, other = text(400), text(150)
    rows = [(i, text(rng.randrange(300)) + passage[rng.randrange(150) : 400 - rng.randrange(150)] + text(rng.randrange(80)) + (other if i % 3 else "")) for i in range(30)]
    rows += [(40, None), (41, ""), (42, "=" * 700), (43, "ab" * 300 + "x" + "ab" * 200), (44, passage[:99]), (None, passage), (45, passage[:100])]
    got = suffixes.without_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in got) == removed_bytes(rows)


def test_suffixes_edges(edge, empty):
    rows = list({(r["doc_id"], r["text"]) for r in edge.select("doc_id", "text").collect()})
    got = suffixes.without_repeats(edge).collect()
    assert len(got) == edge.count()
    want = {x[0]: x for x in removed_bytes(rows)}
    for r in got:
        assert (r["n_bytes"], r["n_removed"]) == want[str(r["doc_id"])][1:3]
    assert suffixes.without_repeats(empty).count() == 0


def test_interval_tree_lists_all_occurrences():
    found = list(suffixes.maximal_repeats([b"abcX", b"abcY", b"abZ"], [b"q", b"q", b"r"], 2))
    assert sorted((left, right, sorted(m)) for left, right, m in found) == [(0, 2, [0, 1, 2]), (1, 2, [0, 1]), (1, 3, [0, 1])]


def removed_units(rows, least, whole):
    """Brute force: every run of units that is shortest with ``least`` words, from its first unit or to its last, every line and paragraph of ``whole`` words, against all earlier ones."""
    seen, out = set(), {}
    for doc, text in rows:
        spans = [m.span() for m in re.finditer(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+", text)]
        words = [words_of(text[s:e]) for s, e in spans]
        count = lambda i, j: sum(map(len, words[i : j + 1]))
        gone, n = set(), len(spans)
        at = lambda pattern: {k for k, (s, e) in enumerate(spans) if re.search(pattern, text[s:e]) or k == n - 1}
        line_ends = at("\n")
        block_ends = at("\n\n") | {k for k in line_ends if not words[k]}
        is_run = lambda i, j, ends: j in ends and (i == 0 or i - 1 in ends) and not any(k in ends for k in range(i, j))
        for i in range(n):
            for j in range(i, n):
                line = whole <= count(i, j) < least and (is_run(i, j, line_ends) or is_run(i, j, block_ends))
                if not line and (not words[i] or not words[j]):
                    continue
                enough = count(i, j) >= least and (count(i, j - 1) < least or count(i + 1, j) < least)
                all_of_it = count(0, n - 1) < least and count(i, j) == count(0, n - 1) and words[i] and words[j]
                if enough or all_of_it or line:
                    name = tuple(w for u in words[i : j + 1] for w in u)
                    if name in seen:
                        gone.update(range(i, j + 1))
                    seen.add(name)
        out[doc] = "".join(text[s:e] for i, (s, e) in enumerate(spans) if i not in gone)
    return out


@pytest.mark.parametrize("least, whole", [(5, 15), (12, 4), (40, 3)])
def test_passages_equal_brute_force(spark, least, whole):
    rng = random.Random(8)
    sentence = lambda: " ".join(rng.choice("abcd") + rng.choice(["", "é"]) for _ in range(rng.randrange(0, 6))) + rng.choice([". ", "\n", "\n\n", "\n \n", "!? ", "... "])
    pool = [sentence() for _ in range(30)]
    rows = []
    for i in range(40):
        text = "".join(rng.choice(pool) if rng.random() < 0.4 else sentence() for _ in range(rng.randrange(0, 25)))
        if rows and rng.random() < 0.4:
            other = rng.choice(rows)[1]
            text = text + other[rng.randrange(len(other) + 1) :]
        rows.append((i, text))
    got = {r["doc_id"]: r["kept"] for r in units.removed(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), least, whole).collect()}
    assert got == removed_units(rows, least, whole)


def test_units_of_shared_and_null_ids(spark):
    text = " ".join(f"a{i}" for i in range(30)) + "."
    line = " ".join(f"l{i}" for i in range(20))
    rows = [(None, text)] * 3 + [(5, text + " b.")] * 2 + [(5, "other. " + text)] + [(i, f"Own start {i}.\n{line}\nOwn end {i}.") for i in range(10, 15)]
    got = [(r["doc_id"], r["kept"]) for r in units.removed(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()]
    assert len(got) == len(rows) and sorted(k for d, k in got if d is None) == ["", "", ""]
    # Of the rows of id 5 one keeps the passage.
    assert sum("a0 a1" in k for d, k in got if d == 5) == 1
    assert [line in k for d, k in sorted((d, k) for d, k in got if d and d >= 10)] == [True, *[False] * 4]
    alone = [(r["doc_id"], r["kept"]) for r in units.removed(spark.createDataFrame([(None, text)] * 3, "doc_id bigint, text string").repartition(3)).collect()]
    assert sorted(k for _, k in alone) == ["", "", text]


def test_a_frequent_passage_is_dealt_to_several_tasks(spark):
    common = " ".join(f"c{i}" for i in range(26)) + ". "
    rows = [(i, f"Own {i}. " + common + f"End {i}.") for i in range(200)] + [(None, common.strip())] * 40
    got = {}
    for r in units.removed(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect():
        got.setdefault(r["doc_id"], []).append(r["kept"])
    assert got[0] == [rows[0][1]] and all(got[i] == [f"Own {i}. End {i}."] for i in range(1, 200)) and got[None] == [""] * 40


def test_units(spark, edge, empty):
    passage = "One two three four five. " * 2 + "Six. Seven eight! " + " ".join(f"w{i}" for i in range(16)) + ". "
    short = "".join(f"ab{i} cd{i}. " for i in range(30))
    rows = [
        (1, "Start here. " + passage + "End."), (2, "x. " + passage.upper() + "Tail."), (3, "Other words. Six. One two three four five. Tail."),
        (4, None), (5, "a b c d"), (6, "a  B c d"), (7, short), (8, "New. " + short + "Old."), (9, ""),
    ]
    got = {r["doc_id"]: (r["n_units"], r["n_removed"], r["removed"], r["kept"]) for r in units.removed(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {
        1: (7, 0, "", rows[0][1]), 2: got[2], 3: (4, 0, "", rows[2][1]),
        4: (0, 0, "", None), 5: (1, 0, "", "a b c d"), 6: (1, 1, "0:8", ""), 7: (31, 0, "", short), 8: got[8], 9: (0, 0, "", ""),
    }
    assert got[2][3].split() == ["x.", "Tail."] and got[8][3].split() == ["New.", "Old."]
    found = {(r["doc_id"], r["text"]): (r["n_removed"], r["kept"]) for r in units.removed(edge).collect()}
    assert len(found) == edge.select("doc_id", "text").distinct().count() and units.removed(edge).count() == edge.count()
    assert found[(1, ROWS[0][1])] == (0, ROWS[0][1]) and found[(2, ROWS[0][1])][1] == "" and found[(3, None)] == (0, None) and found[(4, "")] == (0, "")
    assert found[(6, LONG)] == (0, LONG) and found[(None, ROWS[7][1])][1] == "" and found[(8, ROWS[7][1])][0] == 0
    assert units.removed(empty).count() == 0


def test_representatives_tell_rows_of_one_id_apart(spark):
    text = lambda name, odd=None: " ".join(f"{name}{i}" if i != odd else "odd" for i in range(60))
    rows = [
        (1, text("a"), "x"), (None, text("a", 0), "x"), (None, text("b"), "x"),
        (None, text("c"), "x"), (None, text("c"), "y"), (None, text("c", 59), "x"),
        (2, text("d"), "x"), (2, text("a", 59), "x"), (3, text("d", 0), "x"),
        (5, text("e"), "x"), (5, text("e", 0), "x"),
        (None, None, "x"), (None, " ", "x"), (None, " ", "y"),
    ]
    kept = jaccard.representatives(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), 5, 80).collect()
    found = [(r["doc_id"], r["text"]) for r in kept]
    assert sorted(str(x) for x in found if x[1] is None or not x[1].strip()) == sorted([str((None, None)), *[str((None, " "))] * 2])
    worded = [x for x in found if x[1] and x[1].strip()]
    assert (1, text("a")) in worded and (2, text("d")) in worded and (None, text("b")) in worded
    # One each of the texts c and e stays, whichever hash is less.
    assert len(worded) == 5
    assert sum(x in ((None, text("c")), (None, text("c", 59))) for x in worded) == 1
    assert sum(x in ((5, text("e")), (5, text("e", 0))) for x in worded) == 1


@pytest.mark.parametrize("block", [250_000, 1_000])
def test_suffixes_tell_texts_of_one_id_apart(spark, monkeypatch, block):
    monkeypatch.setattr(suffixes, "BLOCK", block)
    monkeypatch.setattr(suffixes, "SEGMENT", 10_000)
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("ab cé") for _ in range(n))
    passage, other = text(300), text(200)
    rows = [(None, passage + text(500)), (None, text(90) + passage + text(200)), (None, text(700)), (7, text(50) + other), (7, other + text(60)), (7, text(400)), (8, other + passage)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = suffixes.without_repeats(frame).collect()
    # Of one id the text of the least hash comes first.
    order = [(r["doc_id"], r["text"]) for r in frame.selectExpr("*", "xxhash64(text) AS h").orderBy("doc_id", "h").collect()]
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in got) == removed_bytes(order)
