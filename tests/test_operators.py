import hashlib

from pyspark.sql import functions as F

from marginalia.operators import code, diff, merge, review, split, tree, verdicts
from marginalia.operators.review import Filters

BLOCK = "path string, ord int, kind string, content string, tags array<string>, start_line int, end_line int"


def blocks(spark, *rows):
    return spark.createDataFrame([("f", i, k, c, ["test"], s, e) for i, (k, c, s, e) in enumerate(rows)], BLOCK)


def kinds(df):
    return [(r["kind"], r["content"]) for r in df.orderBy("ord").collect()]


def test_paragraphs_lose_nothing(spark):
    texts = ["Para 1.\n\nPara 2.", "\n\na\n \t\n b", "a", "\n\n", "a\r\n\r\nb", "a\n\u3000\nb"]
    files = spark.createDataFrame([(str(i), "Text", t) for i, t in enumerate(texts)], "path string, language string, content string")
    rows = split.paragraphs(files).orderBy("path", "ord").collect()
    for i, t in enumerate(texts):
        assert "".join(r["content"] for r in rows if r["path"] == str(i)) == t
    assert [r["kind"] for r in rows if r["path"] == "0"] == ["Paragraph", "gap", "Paragraph"]


def test_sentences(spark):
    found = split.sentences(spark.createDataFrame([("p", "Line one. Line two?"), ("q", "  ")], "path string, content string")).orderBy("path", "sub_ord").collect()
    assert [r["content"] for r in found] == ["Line one. ", "Line two?", "  "]


def test_sections(spark):
    text = "\n\n# A\nx\n## B\n### C\n# D\n"
    files = spark.createDataFrame([("a", "Markdown", text), ("b", "Markdown", "no heading"), ("c", "Markdown", "pre\n# A\n```\n# not\n```\n")], "path string, language string, content string")
    rows = split.sections(files).orderBy("path", "ord").collect()
    assert [(r["path"], r["kind"]) for r in rows] == [("a", "Section"), ("a", "Section"), ("b", "Preamble"), ("c", "Preamble"), ("c", "Section")]
    assert rows[0]["content"] == "# A\nx\n## B\n### C\n"


def test_merge_imports(spark):
    out = merge.merged_imports(blocks(spark, ("import", "a", 0, 1), ("import", "b", 1, 2), ("gap", "\n\n", 2, 3), ("import", "c", 3, 4), ("gap", "\n", 4, 5), ("function", "f", 5, 9)))
    assert kinds(out) == [("Imports", "a\nb\n\nc"), ("gap", "\n"), ("function", "f")]


def test_merge_paragraphs_by_budget(spark):
    cp = "CodeParagraph"
    assert len(kinds(merge.merged_paragraphs(blocks(spark, (cp, "a", 0, 2), ("gap", "g", 2, 3), (cp, "b", 3, 5))))) == 1
    assert len(kinds(merge.merged_paragraphs(blocks(spark, (cp, "a", 0, 4), ("gap", "g", 4, 5), (cp, "b", 5, 9))))) == 3
    rows = kinds(merge.merged_paragraphs(blocks(spark, (cp, "a", 0, 1), ("gap", "g", 1, 2), (cp, "b", 2, 3), ("gap", "h", 3, 9), (cp, "c", 9, 10))))
    assert rows == [(cp, "agb"), ("gap", "h"), (cp, "c")]


def test_merge_modules_lose_tags(spark):
    out = merge.merged_modules(blocks(spark, ("module", "a", 0, 1), ("comment", "c", 1, 2), ("module", "b", 2, 3))).collect()
    assert [(r["kind"], r["content"], r["tags"]) for r in out] == [("Modules", "acb", [])]


def test_latest_by_time_and_in_log(spark):
    log = spark.createDataFrame([("f", "approved", "review", 2000, 1), ("f", "rejected", "review", 1000, 2), ("f", "question", "security", 3000, 3), ("g", "approved", "review", 5, 4), ("g", "rejected", "review", 5, 5)], "fingerprint string, verdict string, `check` string, ts bigint, seq bigint")
    assert dict(verdicts.latest(log).collect()) == {"f": "approved", "g": "rejected"}
    assert dict(verdicts.latest_in_log(log).collect()) == {"f": "question", "g": "rejected"}


def test_sync_keeps_the_remote_record(spark):
    make = lambda *rows: spark.createDataFrame(rows, "id string, ts bigint, seq bigint")
    out = verdicts.synced(make(("dup", 1500, 0)), make(("dup", 2000, 0), ("unique", 1000, 1))).orderBy("ts").collect()
    assert [(r["id"], r["ts"]) for r in out] == [("unique", 1000), ("dup", 1500)]


def test_tree_hash_ignores_order(spark):
    files = [("a/x", "h1"), ("a/y", "h2"), ("b", "h3")]
    roots = {tree.nodes(spark.createDataFrame(f, "path string, hash string")).where("kind = 'root'").first()["hash"] for f in (files, files[::-1])}
    inner = hashlib.sha256(b"file:x:h1|file:y:h2|\n").hexdigest()
    assert roots == {hashlib.sha256(f"dir:a:{inner}|file:b:h3|\n".encode()).hexdigest()}


def test_covered_by_directory(spark):
    files = spark.createDataFrame([("a/x", "h1"), ("a/y", "h2"), ("b", "h3")], "path string, hash string")
    nodes = tree.nodes(files)
    good = nodes.where("path = 'a'").select("hash")
    assert sorted(r[0] for r in tree.covered(files, nodes, good).collect()) == ["a/x", "a/y"]


def test_implicit_approval_needs_all(spark):
    subs = spark.createDataFrame([("p", 0, "Sentence", "a"), ("p", 0, "Sentence", "b"), ("p", 1, "Sentence", "a"), ("p", 2, "gap", "z")], "path string, parent_ord int, kind string, hash string")
    good = spark.createDataFrame([("a",)], "hash string")
    assert sorted(r["ord"] for r in review.implicitly_approved(subs, good, Filters.of(exclude=["GAP"])).collect()) == [1, 2]


def test_filters(spark):
    f = Filters.of(only=["Function", "bogus"], exclude=["gap"], config=Filters.of(exclude=["struct"]))
    assert (f.only, f.exclude) == (frozenset(["function"]), frozenset(["gap"]))
    assert Filters.of(only=["bogus"]).only == frozenset()


def test_nearest_impl(spark):
    rows = spark.createDataFrame([("p", 0, "impl", 0, 20), ("p", 1, "impl", 2, 10), ("p", 2, "method", 3, 4), ("p", 3, "method", 12, 13), ("p", 4, "function", 30, 31)], "path string, ord int, kind string, start_line int, end_line int")
    assert [r["impl_ord"] for r in tree.enclosing(rows).orderBy("ord").collect()] == [None, 0, 1, 0, None]


def test_hunk_parts(spark):
    row = spark.createDataFrame([([" context 1\n", "-old\n", "+new\n", " context 2\n"],)], "lines array<string>").select(*(c.alias(n) for n, c in diff.hunk_parts(F.col("lines")).items())).first()
    assert row.asDict() == {"diff_content": "-old\n+new\n", "context": " context 1\n context 2\n", "new_content": "context 1\nnew\ncontext 2\n"}


def test_myers_scripts_apply():
    import random

    rng = random.Random(3)
    for _ in range(300):
        a = [rng.choice("abc") for _ in range(rng.randrange(9))]
        b = [rng.choice("abc") for _ in range(rng.randrange(9))]
        script = diff.myers(a, b)
        assert [x for s, x in script if s != "+"] == a
        assert [x for s, x in script if s != "-"] == b
        # No script is shorter than one by the longest common subsequence.
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert sum(s != " " for s, _ in script) == len(a) + len(b) - 2 * best[-1][-1]


def test_unified_hunks():
    old = [str(i) for i in range(30)]
    new = old[:2] + ["x"] + old[2:20] + old[21:]
    hunks = list(diff.unified(old, new))
    assert [start for start, _ in hunks] == [1, 19]
    assert hunks[0][1] == [" 0\n", " 1\n", "+x\n", " 2\n", " 3\n", " 4\n"]
    assert hunks[1][1] == [" 17\n", " 18\n", " 19\n", "-20\n", " 21\n", " 22\n", " 23\n"]


def test_rust_items():
    text = "use a;\n\n/// doc\n#[test]\nfn t() { let s = \"}\"; }\n\nstruct S { x: u8 }\nimpl S {\n    const A: u8 = 1;\n    fn m(&self) {}\n}\n#[cfg(test)]\nmod tests { }\n"
    found = [(i.kind, i.tags) for i in code.items(text, "Rust")]
    assert found == [("import", []), ("function", ["test"]), ("struct", []), ("impl", []), ("const", []), ("method", []), ("module", ["test"])]


def test_python_and_script_items():
    assert [i.kind for i in code.items("import a\n\n@d\ndef f():\n    pass\n\nclass C:\n    pass\nx = 1\n", "Python")] == ["import", "decorator", "class", "code"]
    assert [i.kind for i in code.items("import x from 'y';\nexport function f() { return '}'; }\nconst a = 1;\nfunction g() {}\nclass C {}\n", "JavaScript")] == ["import", "export", "variable", "function", "class"]
    assert [i.kind for i in code.items("test_a() {\n  echo hi\n}\nls -l\nX=1\n", "Shell")] == ["function", "command", "code"]


def test_complexity():
    assert code.complexity("if a:\n    for b in c:\n        pass\n", "Python") == 3
    assert code.complexity("fn f() { if a && b { while c {} } }", "Rust") == 4
    assert code.complexity("text", "Text") == 0


def test_function_parts():
    text = "fn f() {\n    let a = 1;\n    for x in y {}\n\n    // note\n    a\n}\n"
    assert [k for k, *_ in code.function_parts(text, "Rust")] == ["FunctionSignature", "CodeParagraph", "comment", "CodeParagraph"]


def test_history_holds_all_orders(spark, sf, monkeypatch):
    from marginalia.operators import diff
    from marginalia.sources import views

    monkeypatch.setattr(views, "KEYS", 100)
    orders = sorted((r["o_orderkey"], r["o_orderpriority"]) for r in views.table(spark, sf, "orders").collect())
    commits = views.commits(spark, sf)
    rows = sorted(tuple(r) for r in commits.collect())
    assert rows == [(n, p, n - 1 if n > 1 else None, n - 5 if n % 10 == 0 else None) for n, (_, p) in enumerate(orders, 1)]
    last = len(rows)
    log = diff.first_parents(commits, last, 8).collect()
    assert sorted((r["step"], r["n"], r["summary"]) for r in log) == [(i + 1, last - i, rows[last - i - 1][1]) for i in range(8)]
    # A second history leaves the first one after its first commit, so the base lies at the far end.
    side = [(last + i, "s", 1 if i == 1 else last + i - 1, None) for i in range(1, 50)]
    both = spark.createDataFrame([*rows, *side], commits.schema)
    parents = {n: [p for p in (a, b) if p] for n, _, a, b in [*rows, *side]}

    def above(tip):
        seen, todo = set(), [tip]
        while todo:
            if (n := todo.pop()) not in seen:
                seen.add(n)
                todo += parents[n]
        return seen

    for a, b in ((last, last - 3), (last, last + 49), (12, 9), (last + 20, last + 49)):
        assert diff.merge_base(both, a, b, 300).first()["base"] == max(above(a) & above(b))
    assert diff.merge_base(both.where("n <> 1"), last, last + 49, 300).first()["base"] is None
