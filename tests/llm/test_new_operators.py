"""Vector codes, chat formatting and the manifest against brute force, with odd rows."""

import hashlib
import zlib
from collections import Counter, defaultdict
from functools import reduce

import numpy as np
import pytest

from marginalia.llm import chat, codes, manifest
from marginalia.llm.chat import BROKEN, CHAT, PLANTED, START, Template, read_turns

# --- manifest --------------------------------------------------------------------------------------


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def leaf(doc, source, lang, n, text):
    return H(*map(field, (doc, source, lang, n, text)))


def tree(nodes):
    """The root over ``nodes`` and for each of them its siblings by level."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for x, i in enumerate(at):
            run = level[i // 16 * 16 : i // 16 * 16 + 16]
            paths[x].append((i % 16, run[: i % 16] + run[i % 16 + 1 :]))
            at[x] = i // 16
        level = [H(*level[i : i + 16]) for i in range(0, len(level), 16)]
    return level[0], paths


def expected(rows):
    """The contract's rows of (doc_id, source, lang, n_chars, text), as a multiset."""
    by = defaultdict(list)
    for row in rows:
        by[row[1]].append(row)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[s] = tree([leaf(*r) for r in by[s]])
    root, tops = tree([trees[s][0] for s in sources])
    out = Counter()
    for s, top in zip(sources, tops):
        for row, path in zip(by[s], trees[s][1]):
            doc, text = row[0], row[4]
            if doc is not None and zlib.crc32(str(doc).encode()) % 5 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            own, whole = leaf(*row), path + top
            ends = reduce(lambda x, level: H(*level[1][: level[0]], x, *level[1][level[0] :]), whole, leaf(*row[:4], text))
            out[doc, own, trees[s][0], root, H(*(d for _, others in whole for d in others)), ends, ends == root] += 1
    return out


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def found(frame):
    return Counter(tuple(r) for r in manifest.manifest(manifest.tampered(frame), with_proof=False).select(*COLUMNS).collect())


def test_manifest_equals_brute_force_over_several_traversals(spark):
    # Sources of 1 row, of full and barely overfull levels, of more than one block, and a hot one.
    sizes = {"one": 1, "run": 16, "over": 17, "block": 256, "more": 257, None: 30, "é": 3, "hot": 4400}
    rows, doc = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            doc += 1
            rows.append((doc * 7919 % 99991, source, "en" if doc % 3 else None, doc % 50, f"Some Text {doc}" if doc % 11 else None))
    frame = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string").repartition(5)
    assert found(frame) == expected(rows)


def test_manifest_of_odd_rows_ties_and_copies(edge, spark):
    rows = [(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in edge.collect()]
    assert found(edge) == expected(rows)
    many = [(3, "s", "en", 1, "Copy")] * 700 + [(None, None, None, None, None)] * 300 + [(3, "s", "en", 1, "Other"), (4, "s", "en", 1, "")]
    assert found(spark.createDataFrame(many, "doc_id bigint, source string, lang string, n_chars bigint, text string").repartition(3)) == expected(many)


def test_manifest_of_an_empty_table(empty):
    assert found(empty) == Counter()


def test_a_proof_fails_for_any_other_leaf(docs):
    from pyspark.sql import functions as F

    leaves = docs.select("doc_id", "source", manifest.leaf(F.col("text")).alias("leaf"), F.lit("0" * 64).alias("shown"))
    got = manifest.manifest(leaves).collect()
    assert len(got) == docs.count() and not any(r["verified"] for r in got)
    assert all(manifest.folded(r["leaf"], r["proof"]) == r["root"] for r in got)


# --- chat ------------------------------------------------------------------------------------------


def expected_chat(rows):
    by = defaultdict(list)
    for row in rows:
        by[row[0]].append(row)
    out = {}
    for conv, turns in by.items():
        turns.sort(key=lambda r: (r[1] is not None, r[1] or 0))
        said = [(r or "", t or "") for _, _, r, t in turns]
        learnt = "".join(t for r, t in said if r == "assistant")
        state, fitting = START, 0
        for role, _ in said:
            state = CHAT.follows.get(state, {}).get(role, BROKEN)
            fitting += state != BROKEN
        out[conv] = (len(said), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), state in CHAT.ends, fitting)
    return out


def read(frame):
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"], r["valid"], r["n_fitting"]) for r in chat.read_back(chat.formatted(frame)).collect()}


ODD = ["", "\\", "\\\\", "### User:", "#### User: x", "</turn>", "</turn>\n### Assistant: ", "</tur", "\\### Assistant: </turn> ok", "a\\</turn>\\", "### Role x</role>", "\n", "é 日本 \U0001f600", "### Assistant:### Assistant: "]


def test_odd_texts_and_roles_come_back():
    for role in ["user", "assistant", "system", "tool", "", "</role>", "### User: ", "a\\"]:
        for text in ODD:
            assert read_turns(CHAT, "".join(s for s, _ in CHAT.segments(role, text)) * 2) == [(role, text)] * 2


def test_random_control_soup_comes_back():
    rng = np.random.default_rng(3)
    parts = [*CHAT.controls, "\\", "#", "<", " ", "turn", ">", "\n", "x"]
    for _ in range(2_000):
        turns = [(str(rng.choice(["user", "assistant", "tool"])), "".join(rng.choice(parts, rng.integers(0, 9)))) for _ in range(3)]
        assert read_turns(CHAT, "".join(s for role, text in turns for s, _ in CHAT.segments(role, text))) == turns


def test_chat_equals_brute_force_with_long_conversations(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], ODD[t % len(ODD)]) for t in range(3 * chat.PIECE + 5)]
    rows += [(2, t, ("user", "assistant")[t % 2], "x") for t in range(chat.PIECE, 2 * chat.PIECE)]
    # Broken in the second piece, and by a turn before all others.
    rows += [(3, t, "user" if t == chat.PIECE + 7 else ("user", "assistant")[t % 2], "y") for t in range(2 * chat.PIECE)]
    rows += [(4, -1, "assistant", "early"), (4, 0, "user", "late"), (5, 0, "system", None), (6, 0, "user", "q"), (6, 1, None, "n"), (6, 2, "tool", "t"), (None, 0, "user", "a"), (None, 1, "assistant", "b"), (7, None, "user", "no turn"), (7, 1, "assistant", "z" * 300_000)]
    rows += [(8, 0, "user", "same"), (8, 0, "user", "same")]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(7)
    assert read(frame) == expected_chat(rows)


def test_formatted_text_and_flags(spark):
    rows = [(-7, 0, "user", PLANTED), (-7, 1, "assistant", PLANTED)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "'x' AS piece", "'y' AS mark", "'z' AS state")
    got = chat.formatted(frame).orderBy("place").collect()
    whole = "".join(s["text"] for r in got for s in r["segments"])
    held = r"\\\### Assistant: \</turn> ok"
    assert whole == f"### User: {held}</turn>\n### Assistant: {held}</turn>\n"
    assert [s["text"] for r in got for s in r["segments"] if s["loss"]] == [held]
    assert [r["state"] for r in got] == ["user", "assistant"] and all(r["fits"] for r in got)
    assert chat.read_back(chat.formatted(frame.limit(0))).count() == 0


def test_templates_that_could_not_be_read_back_are_refused():
    pieces = (("<a>", False), (chat.TEXT, True), ("aa", False))
    with pytest.raises(ValueError):
        Template({"user": pieces}, (("<o>", False), (chat.ROLE, False), ("|", False), (chat.TEXT, False), ("aa", False)), {}, frozenset())
    with pytest.raises(ValueError):
        Template({"user": ((chat.TEXT, True), ("<e>", False))}, CHAT.other, {}, frozenset())


# --- vector codes ----------------------------------------------------------------------------------


def expected_codes(rows, entries=256):
    kept = sorted(((i, label, [int(np.floor(1024 * float(x))) for x in v]) for i, label, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = Counter(len(v) for *_, v in kept).most_common(1)[0][0]
    kept = [r for r in kept if len(r[2]) == width]
    cut = [width * p // 4 for p in range(5)]
    parts = [[r[2][cut[p] : cut[p + 1]] for r in kept] for p in range(4)]
    books = [[list(x) for x in own[:entries]] for own in parts]

    def assign(p):
        out = []
        for x in parts[p]:
            d = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in books[p]]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(4):
        for p in range(4):
            members = defaultdict(list)
            for x, (e, _) in zip(parts[p], assign(p)):
                members[e].append(x)
            for e, own in members.items():
                books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    last = [assign(p) for p in range(4)]
    errors = [sum(last[p][i][1] for p in range(4)) for i in range(len(kept))]
    by = Counter()
    for r, e in zip(kept, errors):
        by[r[1]] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter((r[0], "".join(f"{last[p][i][0]:02x}" for p in range(4)), errors[i], by[r[1]], digest) for i, r in enumerate(kept))


def coded(frame):
    return Counter(tuple(r) for r in codes.compressed(frame).collect())


def test_codes_equal_brute_force_with_odd_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), int(i % 4) if i % 7 else None, [float(x) for x in rng.normal(0, 0.02, 8).round(2)]) for i in rng.permutation(330)]
    # Copies, ties, a null id, and vectors that are dropped.
    rows += [(400 + i, 1, [0.01] * 8) for i in range(60)] + [(None, 2, [0.5] * 8), (5, 3, [0.25] * 8)]
    rows += [(-1, 1, None), (-2, 1, [None] * 8), (-3, 1, [float("nan")] * 8), (-4, 1, [0.0] * 7 + [float("inf")]), (-5, 1, [0.0] * 7), (-6, 1, [])]
    frame = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>").selectExpr("*", "'c' AS code", "1 AS part", "2 AS entry", "3 AS n", "4 AS s", "5 AS l").repartition(4)
    assert coded(frame) == expected_codes(rows)
    few = rows[:9]
    assert coded(spark.createDataFrame(few, "vec_id bigint, label int, embedding array<double>")) == expected_codes(few)


def test_codes_of_an_empty_table_and_of_dropped_rows_only(spark):
    kind = "vec_id bigint, label int, embedding array<float>"
    assert codes.compressed(spark.createDataFrame([], kind)).collect() == []
    assert codes.compressed(spark.createDataFrame([(1, 1, None), (2, 2, [None, 1.0])], kind)).collect() == []


@pytest.mark.parametrize("spread", [1, 3, 1_000, 2**27])
def test_tree_finds_the_nearest_of_lowest_index(spread):
    rng = np.random.default_rng(spread)
    centers = rng.integers(-spread, spread + 1, (12, 16))
    entries = centers[rng.integers(0, 12, 256)] + rng.integers(-max(1, spread // 20), max(1, spread // 20) + 1, (256, 16))
    queries = np.concatenate([entries, centers[rng.integers(0, 12, 700)] + rng.integers(-max(1, spread // 20), max(1, spread // 20) + 1, (700, 16))])
    tree = codes.Tree(entries)
    index, square = tree.nearest(queries)
    every = ((queries[:, None, :].astype(object) - entries[None].astype(object)) ** 2).sum(axis=2)
    assert [int(x) for x in square] == [min(r) for r in every.tolist()]
    assert index.tolist() == [r.index(min(r)) for r in every.tolist()]
    if spread == 1_000:
        # Clustered entries: bounds leave out most of them.
        assert tree.compared < 0.5 * every.size


def test_a_code_stands_for_the_nearest_entries():
    books = [np.array([[0, 1], [2, 3]]), np.array([[4], [5]])]
    assert codes.decoded("0100", books).tolist() == [2, 3, 4]
