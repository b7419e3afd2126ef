import subprocess

import pytest

from marginalia.plans.session import Session


@pytest.fixture
def session(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), *a], check=True, capture_output=True)
    run("init", "-q", "-b", "main")
    run("config", "user.email", "a@b")
    run("config", "user.name", "a")
    run("config", "commit.gpgsign", "false")
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "lib.py").write_text("import os\n\n\ndef f():\n    return 1\n")
    (tmp_path / "notes.txt").write_text("One. Two.\n\nThree.\n")
    run("add", "-A")
    run("commit", "-qm", "one")
    run("checkout", "-qb", "work")
    (tmp_path / "notes.txt").write_text("One. Two.\n\nThree.\nFour.\n")
    run("commit", "-qam", "two")
    return Session(spark, str(tmp_path))


def left(session, **options):
    return {(r["path"], r["kind"]): r["hash"] for r in session.review(exclude=["gap"], **options).collect()}


def test_a_review(session):
    blocks = left(session)
    assert set(blocks) == {("src/lib.py", "function"), ("notes.txt", "Paragraph")}
    session.mark(blocks["src/lib.py", "function"], "approved", path="src/lib.py", line=3)
    assert set(left(session)) == {("notes.txt", "Paragraph")}
    record = session.records().first()
    assert (record["block_state"], record["email"], record["verdict"]) == ("committed", "a@b", "approved")
    session.mark(blocks["src/lib.py", "function"], "rejected", note="why")
    assert ("src/lib.py", "function") in left(session)
    assert [r["latest_verdict"] for r in session.feedback().collect()] == ["rejected"]
    assert session.verify().first().asDict() == {"attested": 0, "unattested": 2, "invalid": 0}
    assert set(left(session, targets=["file:notes.txt"])) == {("notes.txt", "Paragraph")}
    assert session.inspect(blocks["src/lib.py", "function"][:12]).first()["kind"] == "function"
    kinds = [r["kind"] for r in session.inspect(blocks["src/lib.py", "function"][:12], split=True).orderBy("sub_ord").collect()]
    assert kinds == ["FunctionSignature", "CodeParagraph"]


def test_blocks_of_a_revision(session, tmp_path):
    """Code that can't be parsed, and code without a parser, is plain text at HEAD; in the work tree it is not."""
    (tmp_path / "src" / "bad.py").write_text("def (:\n\n# why\n\nx = 1\n")
    (tmp_path / "src" / "a.el").write_text(";; say\n\n(setq a 1)\n")
    subprocess.run(["git", "-C", str(tmp_path), "add", "-A"], check=True)
    subprocess.run(["git", "-C", str(tmp_path), "commit", "-qm", "three"], check=True)
    kinds = lambda rows: {p: [r["kind"] for r in sorted(rows, key=lambda r: r["ord"]) if r["path"] == p and r["kind"] != "gap"] for p in ("src/bad.py", "src/a.el", "src/lib.py")}
    held = kinds(session.blocks_at().collect())
    assert held["src/bad.py"] == ["Paragraph"] * 3
    assert set(held["src/a.el"]) == {"Paragraph"}
    scanned = kinds(session.scan()[1].collect())
    assert scanned["src/bad.py"] == ["CodeParagraph", "comment", "CodeParagraph"]
    assert held["src/lib.py"] == scanned["src/lib.py"]
    assert session.blocks_at(paths=["none"]).count() == 0


def test_changes(session):
    hunks = session.diff().collect()
    assert [(r["path"], r["diff_content"]) for r in hunks] == [("notes.txt", "+Four.\n")]
    with pytest.raises(RuntimeError):
        session.check()
    session.mark(hunks[0]["fingerprint"], "approved")
    session.check()


def test_file_hash_covers(session):
    files, _ = session.scan()
    session.mark(files.where("path = 'src/lib.py'").first()["hash"], "approved")
    assert set(left(session)) == {("notes.txt", "Paragraph")}
