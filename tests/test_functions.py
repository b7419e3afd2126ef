import pytest
from pyspark.sql import functions as F

from marginalia.functions import kinds as K
from marginalia.functions import text as T


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "c string").select(*columns).first()


@pytest.mark.parametrize(
    ("text", "expected"),
    [("foo", "foo\n"), ("foo\n", "foo\n"), ("foo\r\n", "foo\n"), ("foo  \n", "foo\n"), ("  foo", "  foo\n"), ("", ""), ("a\n   ", "a\n\n"), ("   ", "\n"), ("a\u00a0\nb\u3000", "a\nb\n")],
)
def test_canonical(spark, text, expected):
    assert one(spark, text, T.canonical(F.col("c")))[0] == expected
    assert one(spark, expected, T.canonical(F.col("c")))[0] == expected


def test_pinned_fingerprint(spark):
    row = one(spark, 'fn main() {\n    println!("hello");\n}', T.fingerprint(F.col("c"), F.lit("use std::io;")))
    assert row[0] == "dc1c606ceaac3fe3f3e6c11d170d950e290cbf509cf87b905c08b0f0503178c7"


def test_parts_of_a_fingerprint_do_not_mix(spark):
    a = one(spark, "AB", T.fingerprint(F.col("c"), F.lit("")))[0]
    b = one(spark, "A", T.fingerprint(F.col("c"), F.lit("B")))[0]
    assert a != b


@pytest.mark.parametrize(("text", "paragraph", "chunk"), [("// a\n# b", "comment", "comment"), ("// a\n\n// b", "CodeParagraph", "CodeParagraph"), ("}\n", "CodeParagraph", "gap"), ("}\n;", "CodeParagraph", "CodeParagraph"), ("x = 1", "CodeParagraph", "CodeParagraph")])
def test_classes(spark, text, paragraph, chunk):
    assert tuple(one(spark, text, T.paragraph_class(F.col("c")), T.chunk_class(F.col("c")))) == (paragraph, chunk)


@pytest.mark.parametrize(("name", "kind"), [("Function", "function"), ("code_paragraph", "CodeParagraph"), ("SIGNATURE", "FunctionSignature"), ("bogus", None)])
def test_spellings(spark, name, kind):
    assert one(spark, name, K.kind_of(F.col("c")))[0] == kind


@pytest.mark.parametrize(("path", "language"), [("a/b.rs", "Rust"), (".bashrc", None), (".env.sh", "Shell"), ("A.RS", None), ("x.markdown", "Markdown")])
def test_languages(spark, path, language):
    assert one(spark, path, K.language(F.col("c")))[0] == language


@pytest.mark.parametrize(("path", "hit"), [("src/a.rs", False), (".git/x", True), ("a/target/b", True), ("targets/b", False), ("./a", False), ("_x.py", False)])
def test_ignored(spark, path, hit):
    assert one(spark, path, K.ignored(F.col("c")))[0] is hit


@pytest.mark.parametrize(
    ("content", "kind", "expected"),
    [("\n  fn go(a: u8) {\n}", "function", "fn go"), ("fn f<T: Fn(u8)>(x: T) {", "function", "fn f<T: Fn(u8)>"), ("struct A {", "struct", "struct A"), ("", "gap", "gap"), ("x" * 80, "code", "x" * 69 + "...")],
)
def test_signature(spark, content, kind, expected):
    assert one(spark, content, T.signature(F.col("c"), F.lit(kind)))[0] == expected


def test_escapes(spark):
    assert one(spark, "<a & \"b\" 'c'>", T.escaped(F.col("c")))[0] == "&lt;a &amp; &quot;b&quot; &apos;c&apos;&gt;"
    assert one(spark, "x]]>y", T.cdata(F.col("c")))[0] == "x]]]]><![CDATA[>y"
