"""BPE encoding and decoding by a pair occurrence index.

The distinct words of a block are laid out as one linked list of symbols. An
index maps each adjacent pair that has a rank to all its positions in the
block; ranks are taken in ascending order, each merges at all its positions at
once, and the lists of the pairs that this creates are extended. A vocabulary
in which a merge yields pairs of a lower rank than its own is refused, since
for it this order would differ from merging word by word.

Nulls and empty texts give no ids. Words of any length are handled whole.
Rows are independent, so repeated rows repeat their result and other columns
play no part. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from dataclasses import dataclass, field
from struct import pack
from sys import getsizeof

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from marginalia.llm.common import documents

#: White space as Unicode has it; Python's own class also holds U+001C to U+001F.
GAP = re.compile("[\t-\r \x85\xa0  -     　]+")
ASCII_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
CONTROL = re.compile("[\x1c-\x1f]")
#: Bytes of memory for pieces of text and for words kept with their ids, per Python worker, and symbols laid out in one
#: index. Workers outlive their tasks, so this memory stays beside that of the next stage. In scripts without spaces a
#: piece can be a paragraph, so sizes count, not numbers.
KEPT_BYTES = 80_000_000
ENTRY_BYTES = 100
BLOCK_SYMBOLS = 2_000_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shown = dict.fromkeys(plain)
    others = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(others)) for b in range(256)]


@dataclass
class Vocabulary:
    """Merge ranks, symbols and special tokens of a word-level BPE with word ends."""

    path: str
    source: str
    tokens: list[str] = field(init=False)
    ranks: dict = field(init=False)

    def __post_init__(self) -> None:
        held = json.loads(self.source)
        model = held["model"]
        vocab, self.suffix = model["vocab"], model["end_of_word_suffix"]
        self.special = {x["content"]: x["id"] for x in held["added_tokens"]}
        self.tokens = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        shown = byte_symbols()
        self.inner = [vocab[x] for x in shown]
        self.last = [vocab[x + self.suffix] for x in shown]
        self.ranks = {}
        made: dict[int, int] = {}
        for rank, (left, right) in enumerate(tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]):
            a, b, c = vocab[left], vocab[right], vocab[left + right]
            made.setdefault(c, rank)
            self.ranks[a, b] = (rank, c)
        for (a, b), (rank, c) in self.ranks.items():
            if max(made.get(a, -1), made.get(b, -1)) >= rank or made[c] != rank:
                raise ValueError("merges of this vocabulary are not in creation order")
        self.by_rank = [None] * len(self.ranks)
        for pair, (rank, c) in self.ranks.items():
            self.by_rank[rank] = (*pair, c)

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word (bytes, not empty), through one pair occurrence index."""
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        size = int(ends[-1]) if words else 0
        letters = np.frombuffer(b"".join(words), np.uint8)
        start = np.array(self.inner)[letters]
        start[ends - 1] = np.array(self.last)[letters[ends - 1]]
        after, before = np.arange(1, size + 1), np.arange(-1, size - 1)
        after[ends - 1] = -1
        first = np.concatenate([[0], ends[:-1]]) if words else ends
        before[first] = -1
        symbol, after, before, first = start.tolist(), after.tolist(), before.tolist(), first.tolist()
        index: dict[int, list[int]] = {}
        ranks = self.ranks
        for at, pair in enumerate(zip(symbol, symbol[1:])):
            if (found := ranks.get(pair)) and after[at] >= 0:
                if (places := index.get(found[0])) is None:
                    index[found[0]] = [at]
                else:
                    places.append(at)
        active = list(index)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            a, b, c = self.by_rank[rank]
            for at in sorted(index.pop(rank)):
                right = after[at]
                if right < 0 or symbol[at] != a or symbol[right] != b:
                    continue
                symbol[at], symbol[right] = c, -1
                after[at] = beyond = after[right]
                if beyond >= 0:
                    before[beyond] = at
                    if found := ranks.get((c, symbol[beyond])):
                        places = index.get(found[0])
                        if places is None:
                            index[found[0]] = places = []
                            heapq.heappush(active, found[0])
                        places.append(at)
                left = before[at]
                if left >= 0 and (found := ranks.get((symbol[left], c))):
                    places = index.get(found[0])
                    if places is None:
                        index[found[0]] = places = []
                        heapq.heappush(active, found[0])
                    places.append(left)
        out = []
        for at in first:
            ids = []
            while at >= 0:
                ids.append(symbol[at])
                at = after[at]
            out.append(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by a space, special ones kept: the rule of a vocabulary without a decoder."""
        return " ".join(map(self.tokens.__getitem__, ids))


class Encoder:
    """Whole texts to ids; keeps the ids of pieces and of words it has met, up to KEPT_BYTES each."""

    def __init__(self, vocabulary: Vocabulary):
        from tokenizers import Tokenizer

        self.vocabulary = vocabulary
        tool = Tokenizer.from_str(vocabulary.source)
        self.normalize, self.parts = tool.normalizer.normalize_str, tool.pre_tokenizer.pre_tokenize_str
        self.special = re.compile("(" + "|".join(map(re.escape, vocabulary.special)) + ")") if vocabulary.special else None
        # The ids of pieces of text between white space, and of the words they are made of.
        self.kept: dict[str, bytes] = {}
        self.known: dict[bytes, bytes] = {}
        self.kept_bytes = self.known_bytes = 0
        self.byte_of = {x: i for i, x in enumerate(byte_symbols())}

    def words(self, piece: str) -> list[bytes]:
        """The words of a piece without white space, as the model's UTF-8 bytes."""
        if piece.isascii() and (piece.isalpha() or not CONTROL.search(piece)):
            piece = piece.lower()
            return [piece.encode()] if piece.isalpha() else [x.encode() for x in ASCII_PARTS.findall(piece)]
        return [bytes(map(self.byte_of.__getitem__, x)) for x, _ in self.parts(self.normalize(piece))]

    def learn(self, pieces: set[str]) -> None:
        """Give every piece its ids, block by block."""
        block, size = {}, 0
        for piece in pieces:
            block[piece] = words = self.words(piece)
            size += sum(map(len, words))
            if size > BLOCK_SYMBOLS:
                self.index(block)
                block, size = {}, 0
        self.index(block)

    def index(self, block: dict[str, list[bytes]]) -> None:
        if self.known_bytes > KEPT_BYTES:
            self.known.clear()
            self.known_bytes = 0
        known = self.known
        distinct = [w for w in {w for words in block.values() for w in words} if w not in known]
        for w, x in zip(distinct, self.vocabulary.encode_words(distinct)):
            known[w] = ids = pack(f"<{len(x)}I", *x)
            self.known_bytes += getsizeof(w) + getsizeof(ids) + ENTRY_BYTES
        for piece, words in block.items():
            self.kept[piece] = ids = known[words[0]] if len(words) == 1 else b"".join([known[w] for w in words])
            self.kept_bytes += getsizeof(piece) + getsizeof(ids) + ENTRY_BYTES

    def segments(self, text: str) -> list[tuple[bytes, list[str]]]:
        """Special tokens found in the text, each before the pieces that follow it."""
        if self.special is None or "<|" not in text:
            return [(b"", GAP.split(text))]
        found = self.special.split(text)
        ids = [b"", *(np.array([self.vocabulary.special[x]], "<u4").tobytes() for x in found[1::2])]
        return [(i, GAP.split(x)) for i, x in zip(ids, found[::2])]

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        held: list = []
        size = 0

        def flush() -> None:
            new = {x for parts in held for _, pieces in parts for x in pieces}
            if self.kept_bytes > KEPT_BYTES:
                self.kept.clear()
                self.kept_bytes = 0
            self.learn(new.difference(self.kept))
            get = self.kept.__getitem__
            out.extend(b"".join(i + b"".join(map(get, pieces)) for i, pieces in parts) for parts in held)
            held.clear()

        for text in texts:
            held.append(self.segments(text or ""))
            size += len(text or "")
            if size > 4_000_000:
                flush()
                size = 0
        flush()
        return out


def vocabulary(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as file:
        return Vocabulary(path, file.read())


_encoders: dict[str, Encoder] = {}


def _encoder(source: str) -> Encoder:
    key = hashlib.sha256(source.encode()).hexdigest()
    if key not in _encoders:
        _encoders[key] = Encoder(Vocabulary("", source))
    return _encoders[key]


def encode(docs: DataFrame, tokenizer_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with a column of token ids (array of int); a column of that name is replaced."""
    source = docs.sparkSession.sparkContext.broadcast(vocabulary(tokenizer_path).source)
    place = docs.columns.index(text)
    kept = docs.drop(ids)
    schema = kept.limit(0).withColumn(ids, _ints()).schema

    def run(batches):
        tool = _encoder(source.value)
        for batch in batches:
            found = tool.encode_batch(batch.column(place).to_pylist())
            lists = [np.frombuffer(x, "<u4").astype(np.int32) for x in found]
            columns = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != ids]
            names = [n for n in batch.schema.names if n != ids]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lists, pa.list_(pa.int32()))], [*names, ids])

    return docs.mapInArrow(run, schema)


def decode(docs: DataFrame, tokenizer_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``docs`` with the text of a column of ids; null ids give null."""
    source = docs.sparkSession.sparkContext.broadcast(vocabulary(tokenizer_path).source)
    kept = docs.drop(text)
    schema = kept.limit(0).withColumn(text, _null_string()).schema
    names = kept.columns

    def run(batches):
        tool = _encoder(source.value).vocabulary
        for batch in batches:
            found = [None if x is None else tool.decode(x) for x in batch.column(batch.schema.names.index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.names.index(n)) for n in names), pa.array(found, pa.string())], [*names, text])

    return docs.mapInArrow(run, schema)


def _ints():
    from pyspark.sql import functions as F

    return F.array().cast("array<int>")


def _null_string():
    from pyspark.sql import functions as F

    return F.lit(None).cast("string")


def token_digests(docs: DataFrame, tokenizer_path: str, columns: list[str], with_ids: bool = False) -> DataFrame:
    """``columns`` of ``docs`` with n_tokens, ids_sha256 and decoded_sha256 of each whole text, and the ids themselves if asked.

    Ids and decoded texts are made as in ``encode`` and ``decode`` and hashed in
    the same task, so the decoded text need not leave it.
    """
    source = docs.sparkSession.sparkContext.broadcast(vocabulary(tokenizer_path).source)
    rows = docs.select(*columns, "text")
    added = ["n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])]
    schema = ", ".join([*(f"`{n}` {k}" for n, k in rows.dtypes[:-1]), "n_tokens bigint, ids_sha256 string, decoded_sha256 string", *(["ids array<int>"] if with_ids else [])])

    def run(batches):
        tool = _encoder(source.value)
        for whole in batches:
            for at in range(0, len(whole), 1000):
                batch = whole.slice(at, 1000)
                count, hashed, back, lists = [], [], [], []
                for ids in tool.encode_batch(batch.column(batch.num_columns - 1).to_pylist()):
                    count.append(len(ids) // 4)
                    hashed.append(hashlib.sha256(ids).hexdigest())
                    numbers = np.frombuffer(ids, "<u4")
                    back.append(hashlib.sha256(tool.vocabulary.decode(numbers.tolist()).encode("utf-8")).hexdigest())
                    if with_ids:
                        lists.append(numbers.astype(np.int32))
                made = [pa.array(count, pa.int64()), pa.array(hashed, pa.string()), pa.array(back, pa.string()), *([pa.array(lists, pa.list_(pa.int32()))] if with_ids else [])]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(columns))), *made], [*columns, *added])

    return rows.mapInArrow(run, schema)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_digests(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), ["doc_id"])
