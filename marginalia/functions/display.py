"""Names, labels and tokens for showing blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are shown as keywords and as literals.
KEYWORDS = ["fn", "struct", "enum", "impl", "use", "mod", "pub", "let", "mut", "if", "else", "match", "for", "while", "return", "break", "continue", "const", "static", "trait", "type"]
LITERALS = ["true", "false"]
#: By kind, the words whose next word names a block.
NAMED_BY = {"function": ["fn", "def", "function"], "class": ["class", "struct"], "struct": ["struct"], "enum": ["enum"]}


def display_name(kind: Column, content: Column, start: Column, end: Column) -> Column:
    """The name that follows a block's defining word, else its lines."""
    lines = F.concat(F.lit("L"), (start + 1).cast("string"), F.lit("-L"), end.cast("string"))
    out = None
    for k, words in NAMED_BY.items():
        found = F.coalesce(*(F.nullif(F.regexp_extract(content, rf"\b{w}\b\s+([A-Za-z0-9_]+)", 1), F.lit("")) for w in words))
        out = F.when(kind == k, found) if out is None else out.when(kind == k, found)
    return F.coalesce(out, lines)


def elided(labels: Column) -> Column:
    """At most two labels from either end, with the mark of a branch before each."""
    shown = F.when(F.size(labels) > 4, F.concat(F.slice(labels, 1, 2), F.array(F.lit("...")), F.slice(labels, F.size(labels) - 1, 2))).otherwise(labels)
    marked = F.transform(shown, lambda x, i: F.concat(F.when(i == F.size(shown) - 1, "└─ ").otherwise("├─ "), x))
    return F.when(F.size(labels) == 0, F.array(F.lit("└─ (none)"))).otherwise(marked)


def tokens(line: Column) -> Column:
    """Array of (text, kind): words, and every other character for itself."""

    def kind(word: Column) -> Column:
        return F.when(word.isin(KEYWORDS), "keyword").when(word.isin(LITERALS) | word.rlike("^[0-9]+$"), "number").otherwise("base")

    return F.transform(F.regexp_extract_all(line, F.lit(r"[\p{L}\p{N}_]+|(?s:.)"), F.lit(0)), lambda w: F.struct(w.alias("text"), kind(w).alias("kind")))


def listing(start: Column, end: Column, digest: Column, kind: Column, content: Column) -> Column:
    """A block's two lines in a text listing."""
    first = F.trim(F.split_part(content, F.lit("\n"), F.lit(1)))
    return F.concat(F.lit("  [Unreviewed] L"), start.cast("string"), F.lit("-L"), end.cast("string"), F.lit(" (Hash: "), digest, F.lit(") Kind: "), kind, F.lit("\n    > "), first)
