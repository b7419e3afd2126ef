import duckdb
import numpy as np
import pytest

import corpus_pipeline
from marginalia.llm.catalogue import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    got, want = QUERIES[name](spark, sf).toPandas(), con.execute(ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(map(str, got[columns].values.tolist())) == sorted(map(str, want[columns].values.tolist()))


def test_stages(spark, docs, sf, tmp_path):
    from tests.llm.test_duplicates import components
    from tests.llm.test_quality_lines import counts, line_brute

    columns, held = docs.columns, [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, held[-1], sf).write.parquet(f"{tmp_path}/{i}")
        held.append(spark.read.parquet(f"{tmp_path}/{i}"))
    assert all(d.columns == columns for d in held[:-1])
    start, good, clean, single, mixed, coded = (d.collect() for d in held)
    kept = {r["doc_id"] for r in good}
    assert all(not counts(r["text"])[5] for r in good)
    assert all(r["doc_id"] in kept or counts(r["text"])[5] or len(r["text"]) >= 100 for r in start)
    assert sorted(((r["doc_id"], r["text"]) for r in clean), key=str) == line_brute(good, 10)
    assert all(r["n_chars"] == len(r["text"]) for r in clean)
    groups = components([(r["doc_id"], r["text"]) for r in clean], 5, 80)
    assert {str(r["doc_id"]) for r in single} == {c for _, _, c in groups}
    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in single}
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    tool = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r["doc_id"]: r["text"] for r in single}
    assert len(coded) == len(mixed)
    for r in coded:
        assert list(r["ids"]) == tool.encode(texts[r["doc_id"]], add_special_tokens=False).ids


def test_run_equals_stages(spark, sf):
    rows = corpus_pipeline.run(spark, sf).select("doc_id", "n_tokens").collect()
    assert len(rows) > 100 and np.sum([r["n_tokens"] for r in rows]) > 10_000


def test_odd_rows_and_no_rows(spark, docs, edge, empty, tmp_path):
    """Nulls in every column, repeated rows, long texts, clashing names and an empty table, through each stage and through all."""
    for name, frame in (("edge", edge), ("empty", empty)):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            got = stage(spark, frame, "")
            assert i + 1 == len(corpus_pipeline.STAGES) or got.columns == frame.columns
            # All odd texts are too short or repeat themselves, so the quality rules keep none of them.
            assert bool(got.collect()) == (name == "edge" and i > 0)
    rows = {(r["doc_id"], r["text"]) for r in edge.collect()}
    single = corpus_pipeline.STAGES[2][1](spark, edge, "").collect()
    # Of the documents 1 and 2, and of 8 and the one without an id, the first stays.
    assert {(r["doc_id"], r["text"]) for r in single} == {(d, t) for d, t in rows if d not in (2, None)}
    docs.unionByName(edge, allowMissingColumns=True).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 100
