"""Canonical text, hashes and line arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: Unicode white space but the line feed, valid in Java and RE2 classes alike.
WS = r"\t\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: Stands around gaps while a text is cut; ``masked`` takes it out of the text before, ``unmasked`` puts it back.
MARK, _MASK = "\x01", "\x02"


def canonical(text: Column) -> Column:
    """Lines without trailing white space, each ended by one line feed; the empty text stays empty."""
    # Few texts have anything to trim: looking behind line feeds tells which, without trying every blank.
    loose = text.rlike(rf"\n(?<=[{WS}]\n)") | F.substring(text, -1, 1).rlike(f"[{WS}]")
    trimmed = F.when(loose, F.regexp_replace(text, rf"(?<![{WS}])[{WS}]++(?=\n|\z)", "")).otherwise(text)
    return F.when(text == "", F.lit("")).when(text.endswith("\n"), trimmed).otherwise(F.concat(trimmed, F.lit("\n")))


def masked(text: Column) -> Column:
    """A text without MARK that ``unmasked`` turns back."""
    return F.replace(F.replace(text, F.lit(_MASK), F.lit(_MASK + "b")), F.lit(MARK), F.lit(_MASK + "a"))


def unmasked(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(_MASK + "a"), F.lit(MARK)), F.lit(_MASK + "b"), F.lit(_MASK))


def content_hash(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def fingerprint(body: Column, context: Column) -> Column:
    return F.sha2(F.concat(content_hash(body), content_hash(context)), 256)


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[\n{WS}]+|[\n{WS}]+\z", "")


def newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def line_span(before: Column, chunk: Column) -> tuple[Column, Column]:
    """First line and end (exclusive) of a chunk with ``before`` line feeds ahead of it."""
    return before, before + newlines(chunk) + F.when(chunk.endswith("\n"), 0).otherwise(1)


def comment_only(text: Column) -> Column:
    """Whether all lines start as comments do; a blank line within does not."""
    return F.forall(F.split(stripped(text), "\n"), lambda line: line.rlike(rf"^[{WS}]*(//|#|/[*]|[*])"))


def paragraph_class(text: Column) -> Column:
    return F.when(comment_only(text), "comment").otherwise("CodeParagraph")


def chunk_class(text: Column) -> Column:
    return F.when(stripped(text).rlike(r"^[};]*\z"), "gap").otherwise(paragraph_class(text))


def escaped(text: Column) -> Column:
    """Text with the five XML entities."""
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def cdata(text: Column) -> Column:
    return F.replace(text, F.lit("]]>"), F.lit("]]]]><![CDATA[>"))


def short(value: Column, size: int = 8) -> Column:
    return F.substring(value, 1, size)


def truncated(text: Column, size: int = 72) -> Column:
    return F.when(F.length(text) <= size, text).otherwise(F.concat(F.substring(text, 1, size - 3), F.lit("...")))


def signature(content: Column, kind: Column) -> Column:
    """The first line that is not blank, without a trailing brace and, for callables, without the argument list.

    Parentheses within angle brackets don't start an argument list, so those
    are matched as a whole up to four deep.
    """
    line = F.regexp_extract(content, rf"(?m)^[{WS}]*([^\n]*[^\n{WS}])", 1)
    text = F.regexp_replace(F.regexp_replace(line, r"\{+\z", ""), rf"[{WS}]+\z", "")
    nested = "[^<>]*"
    for _ in range(3):
        nested = f"(?:[^<>]|<{nested}>)*"
    head = F.regexp_extract(text, rf"^((?:[^<>(]|<{nested}>|>)*)", 1)
    named = F.when(kind.isin("function", "method", "FunctionSignature"), F.regexp_replace(head, rf"[{WS}]+\z", "")).otherwise(text)
    return F.when(line == "", kind).otherwise(truncated(named))


def normalized_path(path: Column) -> Column:
    return F.translate(F.regexp_replace(path, r"^(\./)+", ""), "\\", "/")
