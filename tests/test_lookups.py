import time

import pytest
from pyspark.sql import functions as F

from marginalia import storage
from marginalia.functions.text import canonical
from marginalia.operators import diff, split, tree
from marginalia.sources import directory

BLOCK = "path string, ord int, kind string, content string, hash string, start_line int, end_line int"


@pytest.fixture(scope="module")
def blocks(spark):
    return spark.createDataFrame(
        [
            ("src/a.rs", 0, "import", "use x;\n", "h0", 0, 1),
            ("src/a.rs", 1, "impl", "impl A {\n  fn m() {}\n}\n", "h1", 1, 4),
            ("src/a.rs", 2, "method", "fn m() {}\n", "h2", 2, 3),
            ("b.txt", 0, "Paragraph", "One.\n", "h3", 0, 1),
            ("b.txt", 1, "Paragraph", "One.\n", "h3", 2, 3),
        ],
        BLOCK,
    )


def test_block_nodes_and_lookups(spark, blocks):
    nodes = tree.block_nodes(blocks)
    got = {(r["path"], r["ord"]): (r["depth"], r["parent_ord"], r["name"]) for r in nodes.collect()}
    assert got[("src/a.rs", 1)] == (3, None, "impl A")
    assert got[("src/a.rs", 2)] == (4, 1, "fn m")
    assert got[("b.txt", 0)] == (2, None, "One.")
    assert tree.by_hash(nodes, "h3").count() == 2
    assert [r["ord"] for r in tree.by_hash(nodes, "h3", "b.txt", 2).collect()] == [1]
    files = tree.nodes(spark.createDataFrame([("src/a.rs", "f1"), ("b.txt", "f2")], "path string, hash string"))
    assert [r["kind"] for r in tree.by_path(files, "src").collect()] == ["directory"]
    assert tree.by_path(files, "none").count() == 0
    assert dict(tree.first_children(files).collect()) == {"": "src", "src": "src/a.rs"}
    assert tree.subtree_blocks(blocks, "src").count() == 3 and tree.subtree_blocks(blocks, "").count() == 5 and tree.subtree_blocks(blocks, "b.txt").count() == 2


def test_breadcrumbs(blocks):
    got = {(r["path"], r["ord"]): r["crumbs"] for r in tree.breadcrumbs(blocks).collect()}
    assert got[("src/a.rs", 2)] == "File (src/a.rs) -> impl A -> fn m"
    assert got[("b.txt", 0)] == "File (b.txt) -> One."


def test_context_lines(spark):
    files = spark.createDataFrame([("p", "\n".join("abcdefgh"))], "path string, content string")
    spans = spark.createDataFrame([("p", 0, 3, 5), ("p", 1, 0, 1)], "path string, ord int, start_line int, end_line int")
    got = sorted((r["ord"], r["line"], r["text"], r["inside"]) for r in tree.context_lines(files, spans, 1).collect())
    assert got == [(0, 2, "c", False), (0, 3, "d", True), (0, 4, "e", True), (0, 5, "f", False), (1, 0, "a", True), (1, 1, "b", False)]


def test_paragraphs_keep_every_character(spark):
    texts = ["a\x01b", "\x01\n\n\x02a", "\x02b\x02\x01", "x\n\ny", "\x01\x01"]
    files = spark.createDataFrame([(str(i), "Text", t) for i, t in enumerate(texts)], "path string, language string, content string")
    got = {}
    for r in split.paragraphs(files).orderBy("path", "ord").collect():
        got.setdefault(r["path"], []).append(r["content"])
    assert ["".join(got[str(i)]) for i in range(len(texts))] == texts
    assert [len(got[str(i)]) for i in range(len(texts))] == [1, 3, 1, 3, 1]


def test_long_blanks_take_linear_time(spark):
    text = "a" + " " * 400_000 + "b  \n" + "\t" * 400_000 + "\n"
    start = time.time()
    row = spark.createDataFrame([(text,)], "t string").select(canonical(F.col("t")).alias("c")).first()
    assert row["c"] == "a" + " " * 400_000 + "b\n\n"
    assert time.time() - start < 30


def test_covered_files_lose_their_hunks_and_reviews_come_along(spark):
    hunks = spark.createDataFrame([("a", 1, ["+x\n", " y\n"]), ("b", 1, ["+x\n", " y\n"]), ("c", 4, ["-q\n"])], "path string, new_start int, lines array<string>")
    plain = diff.hunk_changes(hunks, spark.createDataFrame([], "fingerprint string, verdict string"))
    first = plain.where("path = 'a'").first()["fingerprint"]
    reviews = spark.createDataFrame([(first, 1, [(1, "rejected")])], "fingerprint string, n int, reviews array<struct<seq:int,verdict:string>>")
    known = spark.createDataFrame([(first, "rejected")], "fingerprint string, verdict string")
    covered = spark.createDataFrame([("b",)], "path string")
    got = {r["path"]: (r["status"], r["reviews"]) for r in diff.hunk_changes(hunks, known, covered, reviews).collect()}
    assert got["a"][0] == "rejected" and [x["verdict"] for x in got["a"][1]] == ["rejected"]
    assert got["c"] == ("unreviewed", None) and set(got) == {"a", "c"}


def test_a_file_that_does_not_parse_keeps_its_blocks(spark, tmp_path):
    (tmp_path / "a.py").write_text("def (:\n\n# note\n\nx = 1\n")
    (tmp_path / "b.py").write_text("import os\n")
    (tmp_path / "c.py").write_text("")
    found = directory.files(spark, str(tmp_path))
    got = {}
    for r in directory.blocks(found).orderBy("path", "ord").collect():
        got.setdefault(r["path"], []).append((r["kind"], r["content"]))
    assert got == {"a.py": [("CodeParagraph", "def (:"), ("gap", "\n\n"), ("comment", "# note"), ("gap", "\n\n"), ("CodeParagraph", "x = 1\n")], "b.py": got["b.py"]}
    assert [k for k, _ in got["b.py"]] == ["import"]


def test_no_local_folder_on_a_cluster():
    class Conf:
        def get(self, name, default=None):
            return default

    class Held:
        def isDefined(self):
            return False

    class Context:
        master = "spark://host:7077"

        class _jsc:
            @staticmethod
            def sc():
                return type("S", (), {"getCheckpointDir": staticmethod(lambda: Held())})

    session = type("Session", (), {"conf": Conf(), "sparkContext": Context()})()
    with pytest.raises(RuntimeError):
        storage.shared_folder(session)
