"""Sub-blocks of blocks: elements, sentences, paragraphs, members and parts of functions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import content_hash
from marginalia.operators import code
from marginalia.operators.split import SENTENCE

_BREAK = re.compile(r"\n\s*\n")
_COMMENT = re.compile(r"\s*(//|#|/\*|\*)")


def paragraphs(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, gap) of texts and the blank lines between them."""
    out, at = [], 0
    for m in _BREAK.finditer(text):
        if m.start() > at:
            out.append((at, m.start(), False))
        out.append((m.start(), m.end(), True))
        at = m.end()
    if at < len(text):
        out.append((at, len(text), False))
    return out


def paragraph_kind(text: str) -> str:
    return "comment" if text.strip() and all(_COMMENT.match(line) for line in text.strip().split("\n")) else "CodeParagraph"


def chunk_kind(text: str) -> str:
    return paragraph_kind(text) if text.strip().strip("};") else "gap"


def elements(text: str) -> list[tuple[str, int, int]]:
    """Markdown's outermost elements with the text between them; nothing is lost."""
    out: list[tuple[str, int, int]] = []
    at, fence = 0, None
    for line in text.splitlines(keepends=True):
        end = at + len(line)
        bare = line.strip()
        if fence is not None:
            kind = "CodeBlock"
            closes = bare.startswith(fence)
        elif m := re.match(r" {0,3}(```|~~~)", line):
            kind, closes = "CodeBlock", False
            fence = m[1]
            out.append((kind, at, end))
            at = end
            continue
        elif not bare:
            kind = "gap"
        elif re.match(r" {0,3}#{1,6}(\s|$)", line):
            kind = "Header"
        elif re.match(r" {0,3}([-*+]|\d+[.)])\s", line):
            kind = "ListItem"
        elif re.match(r" {0,3}>", line):
            kind = "Quote"
        else:
            kind = "Paragraph"
        previous = out[-1][0] if out else None
        joins = kind == previous and kind in ("Paragraph", "Quote", "gap", "CodeBlock") or (kind == "Paragraph" and previous in ("ListItem", "Quote"))
        if joins:
            out[-1] = (previous, out[-1][1], end)
        else:
            out.append((kind, at, end))
        if fence is not None and closes:
            fence = None
        at = end
    return out


def parts(text: str, language: str, kind: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of a block's sub-blocks."""
    found: list[tuple[str, int, int]] = []
    if language == "Markdown" and kind in ("Section", "Preamble"):
        found = elements(text)
    elif language in ("Markdown", "Text"):
        found = [("Sentence", m.start(), m.end()) for m in re.finditer(SENTENCE, text) if m.group().strip()] or [("Sentence", 0, len(text))]
    elif language in ("Toml", "Nix", "Just"):
        found = [("gap" if gap else "Paragraph", s, e) for s, e, gap in paragraphs(text)]
    elif language == "Rust" and kind in ("impl", "interface"):
        found = [(i.kind, i.start, i.end) for i in code.items(text, language)[1:] if i.kind != "gap"] if kind == "impl" else []
    elif (language in ("Rust", "Python") and kind in ("function", "method")) or (language in ("JavaScript", "TypeScript") and kind in ("function", "method", "export")):
        found = code.function_parts(text, language)
    return found or [("gap" if gap else chunk_kind(text[s:e]), s, e) for s, e, gap in paragraphs(text)]


def sub_blocks(blocks: DataFrame) -> DataFrame:
    """Sub-blocks with their lines; they inherit tags and complexity. One block is the unit of work."""
    import pandas as pd

    names = ["path", "parent_ord", "parent_hash", "sub_ord", "kind", "content", "tags", "complexity", "start_line", "end_line"]

    def run(batches):
        for batch in batches:
            out = []
            for b in batch.itertuples():
                for n, (kind, s, e) in enumerate(parts(b.content, b.language, b.kind)):
                    piece = b.content[s:e]
                    line = b.start_line + b.content.count("\n", 0, s)
                    out.append((b.path, b.ord, b.hash, n, kind, piece, b.tags, b.complexity, line, line + piece.count("\n") + (not piece.endswith("\n"))))
            yield pd.DataFrame(out, columns=names)

    asked = blocks.select("path", "language", "ord", "kind", "hash", "content", "tags", "complexity", "start_line")
    made = asked.mapInPandas(run, "path string, parent_ord int, parent_hash string, sub_ord int, kind string, content string, tags array<string>, complexity int, start_line int, end_line int")
    return made.withColumn("hash", content_hash(F.col("content")))
