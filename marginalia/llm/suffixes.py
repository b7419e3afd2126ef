"""Removal of repeated substrings with common-prefix interval trees.

A byte goes if it is covered by a LENGTH-byte string that also starts earlier
(in a document of a smaller doc_id and text hash, or earlier in the same one). Suffixes are
sampled: in every LENGTH-byte string the GRAM-byte string of the least hash is
an anchor, so equal strings have equal anchors at equal places, and suffixes
that start at equal anchors meet in one group wherever they come from.

Of a group's occurrences those with the same whole context (all that a
LENGTH-byte string with this anchor can touch) form a class; all but a class's
first occurrence are covered by it at once. The firsts of a group's classes
are sorted by what follows the anchor: an enhanced suffix array. A stack scan
of its common-prefix lengths gives the tree of intervals, and for each
interval the same scan over what precedes the anchor parts its suffixes by
left extension. Every pair of nodes whose lengths add up to LENGTH is a
maximal repeat, output with all its occurrences; all but the earliest are
removed.

Defined cases: a null text counts as empty; texts below LENGTH bytes lose
nothing; null doc_ids come after all others; texts that share a doc_id, or
have none, are documents of their own, in order of their hash; rows that repeat
a document (doc_id and text) count as that one and share its result. Runs of one
byte give one anchor for all their places. Only doc_id and text are read. An
empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import documents, mixed, text_of, written

LENGTH = 100
GRAM = 24
LAST_ID = 2**63 - 1
#: Bytes of text whose hashes are made at once, and bytes of input aimed at for one group task.
BLOCK = 250_000
#: Anchors that a task gathers before it hands on the first of each class.
HELD = 500_000
SEGMENT = 8_000_000

_LETTERS = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _joined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    z = x * np.uint64(0xD6E8FEB86659FD93) + y * np.uint64(0xA3B195354A39B70D)
    z ^= z >> np.uint64(32)
    return z


def _extreme(values: np.ndarray, width: int, pick) -> np.ndarray:
    """The least or greatest of every ``width`` successive values, by doubling."""
    span = 1
    while span * 2 <= width:
        values = pick(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return pick(values[:-rest], values[rest:]) if rest else values


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the anchors of all strings of ``length`` bytes, the hashes of their grams, and the hashes of all 16-byte strings."""
    h = _LETTERS[data]
    for span in (1, 2, 4):
        h = _joined(h[:-span], h[span:])
    sixteen = _joined(h[:-8], h[8:])
    grams = mixed(_joined(sixteen[: len(h) - 16], h[16:]))
    width = length - gram + 1
    least = _extreme(grams, width, np.minimum)
    # A gram is an anchor if it is the least of some window, so if the greatest of its windows' least is its own.
    edge = np.zeros(width - 1, np.uint64)
    reach = _extreme(np.concatenate([edge, least, edge]), width, np.maximum)
    at = np.nonzero(reach == grams)[0]
    return at, grams[at], sixteen


def document_anchors(block: list[tuple[int, int, bytes]]):
    """For each document of at least LENGTH bytes: its anchors as (doc, h, key, context, place) and spans (doc, h, start, end) that repeat within it.

    ``place`` packs the position and the context's extents to the left and right.
    """
    before = LENGTH - GRAM
    data = np.frombuffer(b"".join(t for *_, t in block), np.uint8)
    ends = np.cumsum([len(t) for *_, t in block])
    starts = ends - [len(t) for *_, t in block]
    at, key, sixteen = anchors(data)
    own = np.searchsorted(ends, at, side="right")
    keep = at + GRAM <= ends[own]
    at, key, own = at[keep], key[keep], own[keep]
    left = np.minimum(at - starts[own], before)
    right = np.minimum(ends[own] - at, LENGTH)
    keep = left + right >= LENGTH
    at, key, own, left, right = (x[keep] for x in (at, key, own, left, right))
    context = np.zeros(len(at), np.uint64)
    whole = (left == before) & (right == LENGTH)
    if whole.any():
        total = np.full(int(whole.sum()), np.uint64(7))
        # Strings of 16 bytes that overlap at the end cover the whole context.
        offsets = [*range(-before, LENGTH - 15, 16)]
        if offsets[-1] != LENGTH - 16:
            offsets.append(LENGTH - 16)
        for offset in offsets:
            total = _joined(total, sixteen[at[whole] + offset])
        context[whole] = mixed(total)
    for i in np.nonzero(~whole)[0]:
        piece = data[at[i] - left[i] : at[i] + right[i]].tobytes()
        context[i] = int.from_bytes(hashlib.blake2b(piece, digest_size=8, salt=b"%d" % left[i]).digest(), "little")
    ids, hashes = (np.array([x[i] for x in block], np.int64) for i in (0, 1))
    order = np.lexsort((at, context, key, own))
    o, k, c = own[order], key[order], context[order]
    again = np.zeros(len(order), bool)
    if len(order) > 1:
        again[1:] = (o[1:] == o[:-1]) & (k[1:] == k[:-1]) & (c[1:] == c[:-1])
    first, later = order[~again], order[again]
    pos = at - starts[own]
    place = (pos << 16) | (left << 8) | right
    spans = merged_spans(own[later], (pos - left)[later], (pos + right)[later])
    return (ids[own[first]], hashes[own[first]], key[first].view(np.int64), context[first].view(np.int64), place[first]), (ids[spans[0]], hashes[spans[0]], spans[1], spans[2])


def numbered(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each (doc, h)'s place among the distinct ones in order, and the docs and hashes of those."""
    order = np.lexsort((h, doc))
    d, k = doc[order], h[order]
    new = np.append(True, (d[1:] != d[:-1]) | (k[1:] != k[:-1]))[: len(doc)]
    number = np.empty(len(doc), np.int64)
    number[order] = np.cumsum(new) - 1
    return number, d[new], k[new]


def merged_spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each document joined where they touch."""
    if not len(doc):
        return doc.astype(np.int64), start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    new = np.ones(len(doc), bool)
    # Within a document the greatest end so far; documents are kept apart by a step larger than any end.
    step = np.int64(end.max() + 1)
    rank = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]])).astype(np.int64)
    top = np.maximum.accumulate(end + rank * step)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] + rank[1:] * step > top[:-1])
    heads = np.nonzero(new)[0]
    tails = np.append(heads[1:], len(doc)) - 1
    return doc[heads], start[heads], top[tails] - rank[tails] * step


def common(a: bytes, b: bytes) -> int:
    """The length of the common prefix."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def intervals(prefix: list[int], least: int):
    """(length, first, last) of the common-prefix intervals of at least ``least`` of a sorted array of len(prefix) + 1 strings.

    ``prefix[i]`` is the common prefix of strings i and i + 1. The stack holds
    the open intervals, outermost first; each closes at the first shorter one.
    """
    stack: list[tuple[int, int]] = []
    for i, length in enumerate([*prefix, -1]):
        start = i
        while stack and stack[-1][0] > length:
            held, start = stack.pop()
            if held >= least:
                yield held, start, i
        if length >= 0 and (not stack or stack[-1][0] < length):
            stack.append((length, start))


def maximal_repeats(rights: list[bytes], lefts: list[bytes], length: int = LENGTH):
    """(left extent, right extent, members) of every maximal repeat of at least ``length`` bytes around one anchor.

    ``lefts`` are what precedes, read backwards. An interval's members share
    the right extent; among them each interval of the left contexts is a set
    that no longer left extension has in common.
    """
    order = sorted(range(len(rights)), key=rights.__getitem__)
    prefix = [common(rights[a], rights[b]) for a, b in zip(order, order[1:])]
    for right, first, last in intervals(prefix, 0):
        need = max(0, length - right)
        members = sorted(order[first : last + 1], key=lefts.__getitem__)
        shared = [common(lefts[a], lefts[b]) for a, b in zip(members, members[1:])]
        if max(shared) < need:
            continue
        for left, head, tail in intervals(shared, need):
            yield left, right, members[head : tail + 1]


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST_ID)).alias("doc"), F.xxhash64(text_of()).alias("h"), text_of().alias("text"))


def sampled(docs: DataFrame) -> DataFrame:
    """(key, context, doc, h, place) of anchors, one of each class and task; spans that are known to repeat have a null key and (start, end) in context and place."""
    names = ["key", "context", "doc", "h", "place"]

    def run(batches):
        block, size, seen = [], 0, {}
        held: list[tuple] = []
        spans: list[tuple] = []
        waiting = 0

        def sample():
            nonlocal waiting
            found, inner = document_anchors(block)
            held.append(found)
            spans.append(inner)
            waiting += len(found[0])
            block.clear()

        def flush():
            nonlocal waiting
            doc, h, key, context, place = (np.concatenate(x) for x in zip(*held)) if held else (np.empty(0, np.int64),) * 5
            held.clear()
            waiting = 0
            # Of a class that several of these documents share only the first one has to be compared with other tasks'.
            number, docs, hashes = numbered(doc, h)
            order = np.lexsort((number, context, key))
            number, key, context, place = number[order], key[order], context[order], place[order]
            head = np.append(True, (key[1:] != key[:-1]) | (context[1:] != context[:-1]))[: len(number)]
            later = number != number[np.nonzero(head)[0][np.cumsum(head) - 1]] if len(number) else head
            left, right = (place >> 8) & 255, place & 255
            of, s, e = merged_spans(number[later], ((place >> 16) - left)[later], ((place >> 16) + right)[later])
            spans.append((docs[of], hashes[of], s, e))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key[head], context[head], docs[number[head]], hashes[number[head]], place[head])], names)
            d, h, s, e = (np.concatenate(x).astype(np.int64) for x in zip(*spans))
            spans.clear()
            if len(d):
                yield pa.RecordBatch.from_arrays([pa.nulls(len(d), pa.int64()), pa.array(s), pa.array(d), pa.array(h), pa.array(e)], names)

        for batch in batches:
            for doc, h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                data = text.as_py().encode("utf-8", "surrogatepass")
                if len(data) < LENGTH:
                    continue
                name = hashlib.blake2b(data, digest_size=16).digest()
                # A whole copy of a document that this task has met under a smaller id is covered as a whole.
                if (earlier := seen.get(name, doc)) < doc:
                    spans.append(tuple(np.array([x], np.int64) for x in (doc, h, 0, len(data))))
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen[name] = doc
                block.append((doc, h, data))
                size += len(data)
                if size >= BLOCK:
                    sample()
                    size = 0
                    if waiting >= HELD:
                        yield from flush()
        if block:
            sample()
        if held or spans:
            yield from flush()

    return _rows(docs).mapInArrow(run, "key bigint, context bigint, doc bigint, h bigint, place bigint")


def classed(found: DataFrame, segments: int) -> DataFrame:
    """(doc, h, a, b, key): spans [a, b) covered by a class's first occurrence (null key), and the places a of firsts in groups of several classes.

    Spans that are known already pass through, so that anchors are sampled once.
    """

    def run(table: pa.Table) -> pa.Table:
        known, table = table.filter(pc.is_null(table.column("key"))), table.filter(pc.is_valid(table.column("key")))
        key, context, place = (table.column(n).to_numpy() for n in ("key", "context", "place"))
        number, docs, hashes = numbered(table.column("doc").to_numpy(), table.column("h").to_numpy())
        order = np.lexsort((number, context, key))
        key, context, number, place = key[order], context[order], number[order], place[order]
        new_key = np.append(True, key[1:] != key[:-1])
        head = new_key | np.append(True, context[1:] != context[:-1])
        heads = np.nonzero(head)[0]
        first = number[heads[np.cumsum(head) - 1]]
        later = number != first
        pos, left, right = place >> 16, (place >> 8) & 255, place & 255
        spans = merged_spans(number[later], (pos - left)[later], (pos + right)[later])
        classes = np.bincount((np.cumsum(new_key) - 1)[heads])
        several = heads[(classes > 1)[(np.cumsum(new_key) - 1)[heads]]]
        of = np.concatenate([spans[0], number[several]])
        made = pa.table({
            "doc": pa.array(docs[of]),
            "h": pa.array(hashes[of]),
            "a": pa.array(np.concatenate([spans[1], place[several]]).astype(np.int64)),
            "b": pa.array(np.concatenate([spans[2], np.zeros(len(several), np.int64)]).astype(np.int64)),
            "key": pa.concat_arrays([pa.nulls(len(spans[0]), pa.int64()), pa.array(key[several])]),
        })
        return pa.concat_tables([made, known.select(["doc", "h", "context", "place", "key"]).rename_columns(made.column_names)])

    dealt = found.withColumn("segment", F.pmod(F.coalesce("key", F.xxhash64("doc", "context")), F.lit(segments)).cast("int"))
    return dealt.groupBy("segment").applyInArrow(run, "doc bigint, h bigint, a bigint, b bigint, key bigint")


def contexts(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(key, doc, h, pos, left, right) for asked (doc, h, a, key): what precedes the anchor, backwards, and what follows from it on."""
    wanted = asked.groupBy(F.col("doc").alias("d"), F.col("h").alias("k")).agg(F.collect_list(F.struct("a", "key")).alias("asked"))
    met = _rows(docs).join(wanted, (F.col("doc") == F.col("d")) & (F.col("h") == F.col("k"))).select("doc", "h", "text", "asked")

    def run(batches):
        for whole in batches:
            for batch in (whole.slice(i, 200) for i in range(0, len(whole), 200)):
                key, doc, h, at, before, after = [], [], [], [], [], []
                for d, k, text, want in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                    data = text.as_py().encode("utf-8", "surrogatepass")
                    for x in want.as_py():
                        place = x["a"]
                        pos, left, right = place >> 16, (place >> 8) & 255, place & 255
                        key.append(x["key"])
                        doc.append(d)
                        h.append(k)
                        at.append(pos)
                        before.append(data[pos - left : pos][::-1])
                        after.append(data[pos : pos + right])
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(doc, pa.int64()), pa.array(h, pa.int64()), pa.array(at, pa.int64()), pa.array(before, pa.binary()), pa.array(after, pa.binary())], ["key", "doc", "h", "pos", "left", "right"])

    return met.mapInArrow(run, "key bigint, doc bigint, h bigint, pos bigint, left binary, right binary")


def repeated(found: DataFrame, segments: int) -> DataFrame:
    """(doc, h, a, b): the spans of all occurrences but the earliest of every maximal repeat."""

    def run(table: pa.Table) -> pa.Table:
        key = table.column("key").to_numpy()
        number, docs, hashes = numbered(table.column("doc").to_numpy(), table.column("h").to_numpy())
        pos = table.column("pos").to_numpy()
        order = np.lexsort((pos, number, key))
        lefts, rights = table.column("left").to_pylist(), table.column("right").to_pylist()
        cuts = np.nonzero(np.append(True, key[order][1:] != key[order][:-1]))[0].tolist()
        out: list[tuple[int, int, int]] = []
        for head, tail in zip(cuts, [*cuts[1:], len(order)]):
            own = order[head:tail].tolist()
            places = list(zip(number[own].tolist(), pos[own].tolist()))
            # Members are numbered by (doc, h, pos), so the least number is the earliest occurrence. Of a member's
            # spans only the farthest left extent for each right one is kept: no more than LENGTH of them.
            widest: list[dict[int, int]] = [{} for _ in own]
            for left, right, members in maximal_repeats([rights[i] for i in own], [lefts[i] for i in own]):
                first = places[min(members)]
                for i in members:
                    if places[i] != first and widest[i].get(right, -1) < left:
                        widest[i][right] = left
            out.extend((places[i][0], places[i][1] - left, places[i][1] + right) for i, own_spans in enumerate(widest) for right, left in own_spans.items())
        d, s, e = (np.array(x, np.int64) for x in zip(*out)) if out else (np.empty(0, np.int64),) * 3
        d, s, e = merged_spans(d, s, e)
        return pa.table({"doc": pa.array(docs[d]), "h": pa.array(hashes[d]), "a": pa.array(s.astype(np.int64)), "b": pa.array(e.astype(np.int64))})

    return found.withColumn("segment", F.pmod("key", F.lit(segments)).cast("int")).groupBy("segment").applyInArrow(run, "doc bigint, h bigint, a bigint, b bigint")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc, h, a, b): spans of bytes to remove, in UTF-8 of each text; null doc_ids are LAST_ID."""
    size = _rows(docs).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    segments = max(1, size // SEGMENT)
    grouped = written(classed(sampled(docs), segments), "classes")
    asked = grouped.where("key is not null")
    tree = written(repeated(contexts(docs, asked), segments), "repeats")
    return grouped.where("key is null").select("doc", "h", "a", "b").unionByName(tree)


def joined_runs(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, joined where they touch."""
    runs: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if runs and s <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(runs[-1][1], e))
        else:
            runs.append((s, e))
    return runs


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept): every row with its removed runs of bytes and the bytes that are left."""
    spans = repeated_spans(docs).groupBy(F.col("doc").alias("d"), F.col("h").alias("k")).agg(F.collect_list(F.struct("a", "b")).alias("gone"))
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST_ID)).alias("doc"), F.xxhash64(text_of()).alias("h"), text_of().alias("text"))
    met = rows.join(spans, (F.col("doc") == F.col("d")) & (F.col("h") == F.col("k")), "left").select("doc_id", "text", "gone")

    def run(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for whole in batches:
            for batch in (whole.slice(i, 500) for i in range(0, len(whole), 500)):
                size, removed, listed, kept = [], [], [], []
                for text, gone in zip(batch.column(1), batch.column(2)):
                    data = text.as_py().encode("utf-8", "surrogatepass")
                    runs = joined_runs([(x["a"], x["b"]) for x in gone.as_py() or ()])
                    left, at = [], 0
                    for s, e in runs:
                        left.append(data[at:s])
                        at = e
                    left.append(data[at:])
                    size.append(len(data))
                    removed.append(sum(e - s for s, e in runs))
                    listed.append([{"start": s, "end": e} for s, e in runs])
                    kept.append(b"".join(left))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(listed, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    return met.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", F.array_size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
