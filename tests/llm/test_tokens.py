import hashlib
import random

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from marginalia.llm import bpe  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def odd_texts():
    rng = random.Random(5)
    pools = [lambda: rng.randrange(32, 127), lambda: rng.randrange(0, 0x250), lambda: rng.randrange(0x300, 0x3000), lambda: rng.randrange(0x3000, 0xD000), lambda: rng.randrange(0x10000, 0x1F000)]
    made = ["".join(chr(rng.choice(pools)()) for _ in range(rng.randrange(60))) for _ in range(300)]
    return [*made, "", "a" * 4000, "don't I'LL ''s", "a<|endoftext|>b <|startoftext|>", "İ ΣΑΣ\x1cx\x85y z", "é Å"]


def test_ids_equal_the_library(library, docs):
    encoder = bpe.Encoder(bpe.vocabulary(PATH))
    texts = [*odd_texts(), *(r["text"] for r in docs.collect())]
    for text, ids in zip(texts, encoder.encode_batch(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
        assert encoder.vocabulary.decode(np.frombuffer(ids, "<u4").tolist()) == library.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)


def test_small_cache_gives_the_same(monkeypatch, docs):
    texts = [r["text"] for r in docs.limit(20).collect()]
    whole = bpe.Encoder(bpe.vocabulary(PATH)).encode_batch(texts)
    monkeypatch.setattr(bpe, "KEPT_BYTES", 1_000)
    monkeypatch.setattr(bpe, "BLOCK_SYMBOLS", 50)
    encoder = bpe.Encoder(bpe.vocabulary(PATH))
    assert encoder.encode_batch(texts) == whole
    # Caches are emptied between batches.
    assert [encoder.encode_batch([t])[0] for t in texts] == whole
    assert encoder.kept_bytes <= max(1_000, 400 * max(map(len, texts)))


def test_edge_rows(edge, empty, library):
    rows = bpe.token_digests(edge, PATH, ["doc_id", "extra"]).collect()
    want = sorted((-1 if r["doc_id"] is None else r["doc_id"], hashlib.sha256(np.array(library.encode(r["text"] or "", add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()) for r in edge.collect())
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["ids_sha256"]) for r in rows) == want
    assert bpe.token_digests(empty, PATH, ["doc_id"]).count() == 0


def test_encode_and_decode_columns(edge):
    coded = bpe.encode(edge, PATH)
    assert coded.columns.count("ids") == 1
    back = bpe.decode(coded, PATH).collect()
    assert all(r["decoded"] == bpe.vocabulary(PATH).decode(r["ids"]) for r in back)


def test_unordered_merges_are_refused():
    import json

    held = json.loads(bpe.vocabulary(PATH).source)
    held["model"]["merges"] = held["model"]["merges"][::-1]
    with pytest.raises(ValueError):
        bpe.Vocabulary("", json.dumps(held))
