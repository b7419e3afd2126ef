import datetime
import json

import pytest

from marginalia.__main__ import main
from marginalia.sources import log

from .test_session import session  # noqa: F401


def test_commands(session, capsys, tmp_path_factory):  # noqa: F811
    def run(*arguments, code=0):
        assert main(["--root", session.root, *arguments], session.spark) == code
        return capsys.readouterr().out

    blocks = json.loads(run("review", "--json", "--exclude", "gap"))
    assert {(b["path"], b["kind"]) for b in blocks} == {("notes.txt", "Paragraph"), ("src/lib.py", "function")}
    function = next(b["hash"] for b in blocks if b["kind"] == "function")
    assert f"(Hash: {function}) Kind: function\n    > def f():" in run("review", "--all")
    assert run("review", "--json", "--only", "function", "--target", "file:notes.txt") == "[\n]\n"
    assert "File: src/lib.py" in run("scan") and len(json.loads(run("scan", "--json"))) == 2
    assert {n["kind"] for n in json.loads(run("scan", "--tree"))} == {"file", "directory", "root"}
    assert [p["kind"] for p in json.loads(run("inspect", "--split", "--fingerprint", function[:12]))] == ["FunctionSignature", "CodeParagraph"]
    hunk = json.loads(run("diff", "--json"))[0]
    assert "+Four." in run("diff")
    run("check", code=1)
    assert run("mark", "--quiet", "--fingerprint", hunk["fingerprint"]) == ""
    run("check")
    run("mark", "--fingerprint", function, "--verdict", "rejected", "--note", "why")
    run("mark", "--fingerprint", function, "--verdict", "maybe", code=1)
    assert f'hash="{function}"' in run("feedback") and run("feedback").startswith("<feedback>\n  <file path=")
    assert [b["latest_verdict"] for b in json.loads(run("feedback", "--format", "json"))] == ["rejected"]
    other = str(tmp_path_factory.mktemp("other") / "records")
    log.append(log.record(session.spark, function, "approved", "c@d", at=2**33), other)
    run("sync", "--from", other)
    assert "function" not in run("review", "--all")
    assert run("verify", "--all") == "Attested: 0\nUnattested: 3\nInvalid: 0\n"
    with pytest.raises(SystemExit):
        main(["nothing"])
    with open(f"{session.root}/.marginalia/logs/{datetime.date.today().isoformat()}.log") as held:
        assert "unreviewed changes" in held.read()


def test_ties_of_time_go_by_place(spark, tmp_path):
    """Records of one time: the one written last counts, also after the log is rewritten."""
    from marginalia.operators import verdicts

    path = str(tmp_path / "log")
    for verdict in ("approved", "rejected", "comment", "question", "approved", "rejected"):
        log.append(log.record(spark, "f", verdict, "a@b", at=7), path)
        assert verdicts.latest(log.read(spark, path)).first()["verdict"] == verdict
    log.rewrite(log.read(spark, path).orderBy("seq").drop("ts", "seq", "email"), path)
    assert verdicts.latest(log.read(spark, path)).first()["verdict"] == "rejected"
    log.append(log.record(spark, "f", "comment", "a@b", at=7), path)
    assert verdicts.latest(log.read(spark, path)).first()["verdict"] == "comment"
