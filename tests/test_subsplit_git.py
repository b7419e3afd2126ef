import subprocess

import pytest

from marginalia.operators import subsplit
from marginalia.sources import git


def kinds(text, language, kind):
    return [k for k, *_ in subsplit.parts(text, language, kind)]


def test_markdown_elements_lose_nothing():
    text = "# A\n\npara one.\nmore\n\n## B\ntext\n- x\n- y\n```\n# no\n```\n> q\n"
    found = subsplit.elements(text)
    assert "".join(text[s:e] for _, s, e in found) == text
    assert [k for k, *_ in found if k != "gap"] == ["Header", "Paragraph", "Header", "Paragraph", "ListItem", "ListItem", "CodeBlock", "Quote"]


def test_dispatch():
    assert kinds("One. Two?", "Text", "Paragraph") == ["Sentence", "Sentence"]
    assert kinds("a\n\nb", "Toml", "Paragraph") == ["Paragraph", "gap", "Paragraph"]
    assert kinds("impl A {\n    const X: u8 = 1;\n    fn m() {}\n}", "Rust", "impl") == ["const", "method"]
    assert kinds("x = 1\n\n}\n", "Rust", "code") == ["CodeParagraph", "gap", "gap"]


def test_repository(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), *a], check=True, capture_output=True)
    run("init", "-q", "-b", "main")
    run("config", "user.email", "a@b")
    run("config", "user.name", "a")
    run("config", "commit.gpgsign", "false")
    (tmp_path / "a.txt").write_text("a\n")
    run("add", "-A")
    run("commit", "-qm", "one")
    (tmp_path / "b.txt").write_text("b\n")
    run("add", "-A")
    run("commit", "-qm", "two")
    (tmp_path / "a.txt").write_text("changed\n")
    (tmp_path / "c.txt").write_text("new\n")
    repo = git.Repository(str(tmp_path))
    paths = lambda df: sorted(r["path"] for r in df.collect())
    assert repo.email() == "a@b"
    assert paths(repo.dirty_files(spark)) == ["a.txt", "c.txt"]
    assert paths(repo.changed_in_revision(spark, "HEAD")) == ["b.txt"]
    assert paths(repo.changed_in_revision(spark, "HEAD~1")) == ["a.txt"]
    assert paths(git.target_paths(spark, repo, git.targets(["file:./z", "rev:HEAD~1..HEAD"]))) == ["b.txt", "z"]
    assert git.target_paths(spark, repo, git.targets(["all"])) is None
    assert [r["summary"] for r in repo.recent(spark, 5).orderBy("step").collect()] == ["two", "one"]
    assert repo.recent(spark, 0).count() == 0
    assert sorted(map(tuple, repo.files_at(spark, "HEAD").collect())) == [("a.txt", "a\n"), ("b.txt", "b\n")]
    with pytest.raises(ValueError):
        git.targets(["bogus"])
