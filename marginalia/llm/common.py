"""What several corpus operators share: word rules, shared storage, stable hashes."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.storage import shared_folder, written

__all__ = ["LOWER_AZ", "SPACE", "WORD", "WordHashes", "documents", "mixed", "shared_folder", "shingle_hashes", "text_of", "words_of", "written"]

#: White space that parts words, as a regular-expression class body.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"

LOWER_AZ = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


class WordHashes(dict):
    """64-bit hash of each word in bytes, kept for reuse up to ``limit`` words."""

    def __init__(self, limit: int = 1_000_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        self[word] = value
        return value


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit values (the splitmix64 finalizer)."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(words: list[bytes], width: int, hashes: WordHashes) -> np.ndarray:
    """Distinct 64-bit hashes of the ``width``-word shingles, ascending; fewer words: one shingle; none: empty."""
    if not words:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    span = min(width, len(words))
    total = np.full(len(words) - span + 1, np.uint64(span), np.uint64)
    for step in range(span):
        total = mixed(total + _GOLDEN + each[step : step + len(total)])
    return np.unique(total)


def words_of(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased, as UTF-8 bytes; bytes.split parts at exactly SPACE."""
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER_AZ).split()
