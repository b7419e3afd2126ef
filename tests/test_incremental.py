"""Incremental scans, table functions, the stream's changes, the hash index and the log's writes."""

import os
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from marginalia.operators import actions, feedback, merge, tree, verdicts
from marginalia.plans import incremental
from marginalia.sources import directory, log
from marginalia.streaming import verdicts as stream


def state(snapshot):
    return (
        sorted((r["path"], r["hash"]) for r in snapshot.files.collect()),
        sorted((r["path"], r["ord"], r["hash"]) for r in snapshot.blocks.collect()),
        sorted((r["path"], r["kind"], r["depth"], r["hash"]) for r in snapshot.nodes.collect()),
    )


def put(root, path, text, mtime):
    full = root / path
    full.parent.mkdir(parents=True, exist_ok=True)
    full.write_text(text)
    os.utime(full, (mtime, mtime))


def test_rescans_equal_full_scans(spark, tmp_path, monkeypatch):
    root, kept = tmp_path / "tree", str(tmp_path / "kept")
    for i in range(12):
        put(root, f"a{i % 3}/b{i % 2}/f{i}.md", f"# T{i}\n\ntext {i}\n", 1000)
    put(root, "top.txt", "One.\n\nTwo.\n", 1000)
    first = incremental.scan_tree(spark, str(root), kept)
    again = incremental.scan_tree(spark, str(root), str(tmp_path / "fresh"))
    assert state(first) == state(again)
    # Edited, touched without a change, added in a new folder, deleted with its folder.
    put(root, "a0/b0/f0.md", "# T0\n\nother\n", 2000)
    put(root, "a1/b1/f1.md", "# T1\n\ntext 1\n", 2000)
    put(root, "new/deep/er/x.txt", "X.\n", 2000)
    for f in ("a2/b0/f2.md", "a2/b0/f8.md"):
        (root / f).unlink()
    read = []
    load = directory.read_files
    monkeypatch.setattr(directory, "read_files", lambda rows, at: read.extend(r["path"] for r in rows.collect()) or load(rows, at))
    second = incremental.scan_tree(spark, str(root), kept)
    assert sorted(read) == ["a0/b0/f0.md", "a1/b1/f1.md", "new/deep/er/x.txt"]
    assert state(second) == state(incremental.scan_tree(spark, str(root), str(tmp_path / "fresh2")))
    third = incremental.scan_tree(spark, str(root), kept)
    assert state(third) == state(second) and len(read) == 3 + 12
    # A version without its last table doesn't count.
    (tmp_path / "kept" / "t99999999999999999999-x").mkdir()
    assert state(incremental.load(spark, kept)) == state(third)
    assert incremental.load(spark, str(tmp_path / "none")) is None


def test_renewed_trees_of_random_edits(spark):
    rng = random.Random(3)
    files = {f"{rng.choice('ab')}/{rng.choice('cd')}/{rng.choice('ef')}{i}": str(i) for i in range(30)} | {"z": "z"}
    frame = lambda x: spark.createDataFrame(sorted(x.items()), "path string, hash string")
    rows = lambda nodes: sorted(tuple(r) for r in nodes.select("path", "kind", "name", "parent", "depth", "hash").collect())
    nodes = tree.nodes(frame(files))
    for _ in range(3):
        later = {p: h if rng.random() < 0.8 else h + "x" for p, h in files.items() if rng.random() < 0.9} | {f"new{rng.randrange(9)}/n": "1"}
        changed = [p for p in {*files, *later} if files.get(p) != later.get(p)]
        nodes = tree.renewed(nodes, frame(later), spark.createDataFrame([(p,) for p in changed], "path string"))
        assert rows(nodes) == rows(tree.nodes(frame(later)))
        files = later
    assert rows(tree.renewed(nodes, frame(files), spark.createDataFrame([], "path string"))) == rows(nodes)


def brute(blocks, rule):
    """The rule applied to a list of (kind, content, tags, start, end), by looking at whole runs."""
    runs, since = [[]], None
    for b in blocks:
        if b[0] not in (rule.target, *rule.absorbed):
            runs += [[b], []]
            since = None
            continue
        if b[0] == rule.target:
            if since is not None and b[4] - since > rule.limit:
                runs.append([])
                since = None
            since = b[3] if since is None else since
        runs[-1].append(b)
    out = []
    for run in runs:
        at = [i for i, b in enumerate(run) if b[0] == rule.target]
        if len(at) < 2:
            out += run
            continue
        part, text = run[at[0] : at[-1] + 1], ""
        for i, b in enumerate(part):
            text += (rule.separator if i and part[i - 1][0] == b[0] == rule.target else "") + b[1]
        out += [*run[: at[0]], (rule.into, text, [], min(b[3] for b in part), part[-1][4]), *run[at[-1] + 1 :]]
    return out


def test_folds_equal_whole_runs(spark):
    rng = random.Random(11)
    for n in range(300):
        line, blocks = 0, []
        for i in range(rng.randrange(25)):
            end = line + rng.randrange(1, 9)
            blocks.append((rng.choice(["import", "module", "CodeParagraph", "gap", "gap", "comment", "function"]), f"<{i}>", ["t"], line, end))
            line = end
        for rules in [(merge.IMPORTS,), (merge.MODULES,), (merge.PARAGRAPHS,), (merge.IMPORTS, merge.MODULES, merge.PARAGRAPHS)]:
            chain, got, want = merge.Chain(*rules), [], blocks
            for b in blocks:
                got += chain.push(merge.Block(*b))
            got += chain.flush()
            for rule in rules:
                want = brute(want, rule)
            assert [tuple(b) for b in got] == want


def test_a_large_file_is_folded_from_sql(spark):
    n = 60_000
    i = F.col("id").cast("int")
    kind = F.when(i % 4 == 0, "import").when(i % 4 == 1, "gap").when(i % 4 == 2, "import").otherwise("function")
    spark.range(n).select(F.lit("p").alias("path"), i.alias("ord"), kind.alias("kind"), F.lit("x").alias("content"), F.array().cast("array<string>").alias("tags"), i.alias("start_line"), (i + 1).alias("end_line")).createOrReplaceTempView("large_blocks")
    merge.register(spark)
    got = spark.sql("SELECT kind, count(*) AS n, max(ord) AS last FROM merge_imports(TABLE(large_blocks) PARTITION BY path ORDER BY ord) GROUP BY kind").collect()
    assert {r["kind"]: r["n"] for r in got} == {"Imports": n // 4, "function": n // 4} and max(r["last"] for r in got) == n // 2 - 1


def test_a_trigger_writes_what_it_changed(spark, tmp_path):
    schema = "id string, fingerprint string, check string, verdict string, ts bigint, seq bigint"
    folder, source = str(tmp_path / "state"), str(tmp_path / "in")

    def add(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(source)
        state_ = stream.latest(spark.readStream.schema(schema).json(source))
        stream.follow(state_, folder)
        return {r["fingerprint"]: r["last"]["verdict"] for r in stream.merged(spark, folder, state_).collect()}

    assert add(("1", "f", "review", "approved", 5, 1), ("2", "g", "review", "rejected", 5, 2)) == {"f": "approved", "g": "rejected"}
    # Late, twice, and of another check: nothing of that changes f.
    got = add(("3", "f", "review", "comment", 4, 3), ("1", "f", "review", "approved", 5, 1), ("4", "f", "security", "rejected", 9, 4), ("5", "g", "review", "question", 5, 3))
    assert got == {"f": "approved", "g": "question"}
    assert add(("6", "h", "review", "approved", 1, 1)) == {"f": "approved", "g": "question", "h": "approved"}
    written = {t: spark.read.schema("fingerprint string, last struct<ts:bigint,seq:bigint,verdict:string>").parquet(f"{folder}/changes/{t}").count() for t in os.listdir(f"{folder}/changes")}
    assert written["2"] == 1


def test_a_lookup_reads_one_folder_of_the_index(spark, tmp_path):
    blocks = spark.range(3_000).select(F.sha2(F.col("id").cast("string"), 256).alias("hash"), F.col("id").cast("string").alias("content"), F.lit("p").alias("path"))
    actions.indexed(blocks, str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    one = blocks.first()
    found = actions.with_prefix(index, one["hash"][:9])
    assert [r["content"] for r in found.collect()] == [one["content"]]
    files = {os.path.dirname(f) for f in found.inputFiles()}
    assert len(files) <= 256
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and f"= {one['hash'][:2]}" in plan
    assert actions.with_prefix(index, one["hash"][:1]).count() == blocks.where(F.col("hash").startswith(one["hash"][:1])).count()
    split = lambda rows: rows.limit(0)
    assert actions.by_prefix(index, split, one["hash"][:12]).count() == 1
    with pytest.raises(LookupError):
        actions.by_prefix(index, split, "")
    with pytest.raises(LookupError):
        actions.by_prefix(index, split, "zz")


def test_a_failed_write_leaves_the_log_as_it_was(spark, tmp_path):
    path = str(tmp_path / "log")
    for i in range(3):
        log.append(log.record(spark, f"f{i}", "approved", "a@b", at=i), path)
    before = sorted(r["fingerprint"] for r in log.read(spark, path).collect())
    many = spark.range(200).repartition(8).join(log.record(spark, "bad", "approved", "a@b", at=9).drop("id"))
    failing = many.select(F.when(F.col("id") == 150, F.raise_error(F.lit("lost"))).otherwise(F.col("id").cast("string")).cast("string").alias("id"), "fingerprint")
    for write in (log.append, log.rewrite):
        with pytest.raises(PySparkException):
            write(failing, path)
        assert sorted(r["fingerprint"] for r in log.read(spark, path).collect()) == before


def test_comments_of_reviews_are_in_the_xml(spark):
    records = spark.createDataFrame([("f", "rejected", "review", 1, 1, "a@b", "x < y"), ("f", "comment", "review", 2, 2, "c@d", None)], "fingerprint string, verdict string, check string, ts int, seq int, email string, note string")
    blocks = spark.createDataFrame([("p", 3, "Paragraph", "text\n", "f")], "path string, start_line int, kind string, content string, hash string")
    xml = feedback.with_reviews(blocks, records).select(feedback.as_xml().alias("x")).first()["x"]
    assert '<review verdict="rejected" author="a@b">\n          <comment>x &lt; y</comment>\n        </review>\n' in xml
    assert '<review verdict="comment" author="c@d">\n        </review>\n      </reviews>' in xml
    assert "]]></context>\n      <reviews>\n" in xml
    assert verdicts.reviews(records.drop("note")).count() == 1
