from marginalia.operators import verdicts
from marginalia.sources import directory, log


def test_directory(spark, tmp_path):
    for name, data in {"a.rs": b"use x;\nuse y;\nfn f() {}\n", "_private.py": b"x = 1\n", ".hidden/a.rs": b"x", "target/b.rs": b"x", "bin.dat": b"a\x00b", "bad.txt": b"\xff\xfe\xfd", "empty.rs": b"", "n.md": b"# A\nx\n", "t.txt": b"a\n\nb"}.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(data)
    found = directory.files(spark, str(tmp_path))
    assert {r["path"]: r["language"] for r in found.collect()} == {"a.rs": "Rust", "_private.py": "Python", "bin.dat": "Unknown", "empty.rs": "Rust", "n.md": "Markdown", "t.txt": "Text"}
    split = directory.blocks(found)
    kinds = {}
    for r in split.orderBy("path", "ord").collect():
        kinds.setdefault(r["path"], []).append(r["kind"])
    assert kinds == {"a.rs": ["Imports", "function"], "_private.py": ["code"], "n.md": ["Section"], "t.txt": ["Paragraph", "gap", "Paragraph"]}
    hashes = dict(directory.file_hashes(found, split).collect())
    assert hashes["bin.dat"] == "binary_skipped"
    assert hashes["empty.rs"] == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert directory.stale(found, found).count() == 0


def test_log(spark, tmp_path):
    path = str(tmp_path / "log")
    assert log.read(spark, path).count() == 0
    log.append(log.record(spark, "f", " Approved ", "a@b", at=10), path)
    (tmp_path / "log" / "more.json").write_text("not-json\n\n")
    log.append(log.record(spark, "f", "rejected", "a@b", at=5), path)
    read = log.read(spark, path)
    assert read.count() == 2
    assert verdicts.latest(read).first()["verdict"] == "approved"
    log.rewrite(read.drop("ts", "seq", "email"), path)
    assert log.read(spark, path).count() == 2
