"""Block kinds, languages and review ranks as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.schema import EXTENSIONS, GROUPS, IMPORT_LIKE, OTHER_PRIORITY, PRIORITY, SPELLINGS, TEST_PRIORITY


def lookup(table: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*map(F.lit, chain.from_iterable(table.items()))), key)


def kind_of(name: Column) -> Column:
    """The wire name of a spelling; null if there is none."""
    return lookup(SPELLINGS, F.regexp_replace(F.lower(F.trim(name)), "[_-]", ""))


def import_like(kind: Column) -> Column:
    return kind.isin(IMPORT_LIKE)


def priority(kind: Column) -> Column:
    return F.coalesce(lookup(PRIORITY, kind), F.lit(OTHER_PRIORITY))


def rank(kind: Column, tags: Column) -> Column:
    return F.when(F.array_contains(tags, "test"), TEST_PRIORITY).otherwise(priority(kind))


def group(kind: Column) -> Column:
    return F.coalesce(lookup({k: g for g, kinds in GROUPS.items() for k in kinds}, kind), F.lit("Other"))


def band(kind: Column) -> Column:
    p = priority(kind)
    return F.when(p == 0, 0).when(p == 20, 1).otherwise(2)


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)


def language(path: Column) -> Column:
    """By extension; null if the file has to be looked into."""
    return lookup(EXTENSIONS, extension(path))


def file_type(path: Column, content: Column) -> Column:
    """Code by extension; else binary if the first 1024 bytes hold a zero; else text."""
    zero = F.position(F.unhex(F.lit("00")), F.substring(content, 1, 1024)) > 0
    return F.when(language(path).isNotNull(), "Code").when(zero, "Binary").otherwise("Text")


def ignored(path: Column) -> Column:
    """Whether a component of a relative path is hidden or a build folder."""
    return F.exists(F.split(path, "/"), lambda p: (p.startswith(".") & (p != ".")) | p.isin("target", "node_modules"))


def library_path(path: Column) -> Column:
    return (path == "src/lib.rs") | (path.startswith("src/") & ~path.startswith("src/main.rs") & ~path.startswith("src/bin/"))


def test_path(path: Column) -> Column:
    return path.rlike(r"(^|/)tests(/|$)") | path.rlike(r"(^|/)test_[^/]*$") | path.rlike(r"[^/]*_test\.(rs|py|js|ts)$")


def review_group(path: Column, tags: Column) -> Column:
    return F.when(test_path(path) | F.array_contains(tags, "test"), 0).when(library_path(path), 1).otherwise(2)


def label(kind: Column, start: Column, end: Column) -> Column:
    return F.concat(kind, F.lit(":L"), (start + 1).cast("string"), F.lit("-L"), F.greatest(end, start + 1).cast("string"))
