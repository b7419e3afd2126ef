import json

import pytest

from marginalia.operators import actions, split, tree


def test_nested_view(spark):
    files = spark.createDataFrame([("b/x", "h1"), ("a/y/z", "h2"), ("c", "h3")], "path string, hash string")
    view = json.loads(actions.nested_json(tree.nodes(files)).first()["view"])
    names = lambda n: (n["name"], n["type"], [names(c) for c in n["children"]])
    assert names(view) == ("", "root", [("a", "directory", [("y", "directory", [("z", "file", [])])]), ("b", "directory", [("x", "file", [])]), ("c", "file", [])])


def test_the_view_in_pieces(spark, tmp_path):
    """Names that need escapes, that start alike, of files beside directories; the joined files equal the view in one row."""
    paths = ["b/x", "a/y/z", "c", "a/~", "a-b/q", 'a/"quote"', "a/y.txt", "ab/é/ü/deep", "~"] + [f"many/f{i}" for i in range(300)]
    nodes = tree.nodes(spark.createDataFrame([(p, f"h{i}") for i, p in enumerate(paths)], "path string, hash string"))
    folder = tmp_path / "view"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        actions.write_view(nodes.repartition(5), str(folder))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted(folder.glob("part-*"))
    assert len(files) > 1
    assert json.loads("".join(f.read_text() for f in files)) == json.loads(actions.nested_json(nodes).first()["view"])


def test_the_view_of_an_empty_tree(spark):
    assert actions.view_pieces(tree.nodes(spark.createDataFrame([], "path string, hash string"))).count() == 0


def test_lookups(spark):
    blocks = spark.createDataFrame([("p", 0, "function", "fn alpha() {}", "aa1"), ("p", 1, "code", "alpha beta. gamma", "ab2"), ("p", 2, "code", "beta", "ac3")], "path string, ord int, kind string, content string, hash string")
    assert actions.by_prefix(blocks, split.sentences, "ab").first()["ord"] == 1
    for prefix, words in (("a", "several"), ("zz", "nothing")):
        with pytest.raises(LookupError, match=words):
            actions.by_prefix(blocks, split.sentences, prefix)
    inner = split.sentences(blocks).where("content = 'gamma'").first()["hash"]
    assert actions.by_prefix(blocks, split.sentences, inner).first()["content"] == "gamma"
    assert actions.by_content(blocks, "alpha").first()["ord"] == 0
    with pytest.raises(LookupError):
        actions.by_content(blocks, "beta")


def test_comments_leave_the_session_as_it_is(spark):
    shown = spark.createDataFrame([("a/x",), ("ab/y",)], "path string")
    assert actions.applied(shown, "a", "comment").count() == 2
    assert [r[0] for r in actions.applied(shown, "a", "approved").collect()] == ["ab/y"]
    assert actions.applied(shown, "", "rejected").count() == 0
