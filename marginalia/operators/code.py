"""Splitting of source code into items, sub-blocks and complexity.

No grammar is at hand here: a scanner that knows quotes, comments and brackets
finds the top-level items of Rust, JavaScript, TypeScript and shell; Python's
own parser gives its spans. One file is the unit of work.
"""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import content_hash

LANGUAGES = ["Rust", "Python", "JavaScript", "TypeScript", "Shell"]
#: The kind of an item by the words it starts with.
HEADS = {
    "Rust": [(r"(?:pub(?:\([^)]*\))?\s+)?(?:(?:async|unsafe|const|extern(?:\s+\"[^\"]*\")?)\s+)*fn\b", "function"), (r"(?:pub(?:\([^)]*\))?\s+)?(?:struct|union)\b", "struct"), (r"(?:pub(?:\([^)]*\))?\s+)?enum\b", "enum"), (r"(?:unsafe\s+)?impl\b", "impl"), (r"(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\b", "interface"), (r"(?:pub(?:\([^)]*\))?\s+)?(?:mod\b|extern\s+\"[^\"]*\"\s*\{|extern\s*\{)", "module"), (r"(?:pub(?:\([^)]*\))?\s+)?(?:use\b|extern\s+crate\b)", "import"), (r"(?:pub(?:\([^)]*\))?\s+)?(?:const|static)\b", "const"), (r"(?:macro_rules!|[A-Za-z_][\w:]*!)", "macro"), (r"(?:pub(?:\([^)]*\))?\s+)?type\b", "type")],
    "JavaScript": [(r"(?:async\s+)?function\b", "function"), (r"(?:abstract\s+)?class\b", "class"), (r"import\b(?!\s*\()", "import"), (r"export\b", "export"), (r"(?:var|let|const)\b", "variable")],
    "Shell": [(r"(?:function\s+[\w-]+|[\w-]+\s*\(\))", "function"), (r"(?!(?:if|for|while|case|until|select|\{|\()\b)[^=\s]+(?:\s|$)", "command")],
}
HEADS["TypeScript"] = HEADS["JavaScript"]
METHODS = {"function": "method", "const": "const", "type": "type", "macro": "macro"}


@dataclass
class Item:
    start: int
    end: int
    kind: str
    tags: list[str] = field(default_factory=list)
    head: int = 0


def _skip(text: str, i: int, language: str) -> int | None:
    """The end of a comment or quoted string that starts at ``i``; None if none does."""
    if language == "Shell":
        if text[i] == "#" and (i == 0 or text[i - 1] in " \t\n;"):
            end = text.find("\n", i)
            return len(text) if end < 0 else end
        if text[i] == "'":
            end = text.find("'", i + 1)
            return len(text) if end < 0 else end + 1
        if text[i] == '"':
            return _quoted(text, i, '"')
        return None
    if text.startswith("//", i):
        end = text.find("\n", i)
        return len(text) if end < 0 else end
    if text.startswith("/*", i):
        depth, j = 1, i + 2
        while j < len(text) and depth:
            if text.startswith("*/", j):
                depth, j = depth - 1, j + 2
            elif language == "Rust" and text.startswith("/*", j):
                depth, j = depth + 1, j + 2
            else:
                j += 1
        return j
    if language == "Rust":
        if m := re.compile(r'b?r(#*)"').match(text, i):
            end = text.find('"' + m[1], m.end())
            return len(text) if end < 0 else end + 1 + len(m[1])
        if text[i] == "'":
            m = re.compile(r"'(?:\\.[^']*|[^\\'])'").match(text, i)
            return m.end() if m else None
        return _quoted(text, i, '"') if text[i] == '"' else None
    return _quoted(text, i, text[i]) if text[i] in "\"'`" else None


def _quoted(text: str, i: int, quote: str) -> int:
    j = i + 1
    while j < len(text) and text[j] != quote:
        j += 2 if text[j] == "\\" else 1
    return min(len(text), j + 1)


def _item_end(text: str, i: int, language: str, kind: str) -> int:
    """The end of the item that starts at ``i``: its closing brace, its semicolon or, for lines, its line's end."""
    depth, opened = 0, False
    while i < len(text):
        if (end := _skip(text, i, language)) is not None:
            i = end
            continue
        c = text[i]
        if c in "([{":
            depth += 1
            opened = opened or c == "{"
        elif c in ")]}":
            depth -= 1
            if depth == 0 and c == "}" and kind not in ("import", "const", "type", "variable") and (language != "Shell" or kind == "function"):
                return i + 1
            if depth < 0:
                return i
        elif c == ";" and depth == 0 and language != "Shell":
            return i + 1
        elif c == "\n" and depth == 0:
            if language == "Shell" and (i == 0 or text[i - 1] != "\\") and kind != "function":
                return i
            rest = text[i:].lstrip()
            if language in ("JavaScript", "TypeScript") and kind in ("variable", "import", "code", "export") and not re.match(r"[.?:=+*/&|,)\]}]", rest):
                return i
        i += 1
    return len(text)


def _items(text: str, language: str, base: int = 0) -> list[Item]:
    """Top-level items; in Rust, attributes and comments before an item belong to it."""
    out, i, pending = [], 0, None
    while i < len(text):
        if text[i].isspace():
            i += 1
            continue
        comment = text.startswith("//", i) or text.startswith("/*", i) or (language == "Shell" and text[i] == "#")
        attribute = language == "Rust" and text.startswith("#", i)
        if comment or attribute:
            end = _skip(text, i, language) if comment else _bracketed(text, text.find("[", i), language)
            if language == "Rust":
                pending = i if pending is None else pending
            else:
                out.append(Item(i, end, "code"))
            i = max(end, i + 1)
            continue
        kind = next((k for p, k in HEADS[language] if re.compile(p).match(text, i)), "code")
        if language == "Shell" and kind == "command" and re.match(r"\w+=", text[i:]):
            kind = "code"
        end = max(_item_end(text, i, language, kind), i + 1)
        if kind == "code" and language == "Shell" and re.match(r"(if|for|while|case|until)\b", text[i:]):
            end = _shell_block(text, i)
        out.append(Item(i if pending is None else pending, end, kind, head=i))
        pending, i = None, end
    if pending is not None:
        out.append(Item(pending, len(text.rstrip()), "code", head=len(text)))
    return out


def _shell_block(text: str, i: int) -> int:
    depth = 0
    for m in re.compile(r"(?m)(?:^|[;\s])(if|for|while|until|case|fi|done|esac)\b").finditer(text, max(0, i - 1)):
        depth += 1 if m[1] in ("if", "for", "while", "until", "case") else -1
        if depth == 0:
            return m.end()
    return len(text)


def _bracketed(text: str, i: int, language: str) -> int:
    depth = 0
    while 0 <= i < len(text):
        if (end := _skip(text, i, language)) is not None:
            i = end
            continue
        depth += (text[i] == "[") - (text[i] == "]")
        i += 1
        if depth == 0:
            return i
    return len(text)


def _python_items(text: str) -> list[Item] | None:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return None
    starts = [0]
    for line in text.encode().splitlines(keepends=True):
        starts.append(starts[-1] + len(line))
    data = text.encode()

    def at(line: int, column: int) -> int:
        return len(data[: starts[line - 1] + column].decode())

    out = []
    for node in tree.body:
        decorated = getattr(node, "decorator_list", [])
        start = at(decorated[0].lineno, decorated[0].col_offset - 1) if decorated else at(node.lineno, node.col_offset)
        end = at(node.end_lineno, node.end_col_offset)
        kind = "decorator" if decorated else "function" if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)) else "class" if isinstance(node, ast.ClassDef) else "import" if isinstance(node, (ast.Import, ast.ImportFrom)) else "code"
        item = Item(start, end, kind, head=start)
        tests = [n for n in ast.walk(node) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) and n.name.startswith("test_")]
        if tests or any("test_" in ast.unparse(d) for d in decorated):
            item.tags.append("test")
        out.append(item)
    return out


def items(text: str, language: str) -> list[Item]:
    """The items of a file with gaps that aren't blank; Rust impls and traits are followed by what they hold."""
    found = _python_items(text) if language == "Python" else _items(text, language)
    if found is None:
        return []
    out, last = [], 0
    for item in found:
        if text[last : item.start].strip():
            out.append(Item(last, item.start, "gap"))
        out.append(item)
        piece = text[item.start : item.end]
        if language == "Rust":
            head = text[item.start : item.head]
            if (item.kind == "function" and "#[test]" in head) or (item.kind == "module" and re.search(r"#\[[^\]]*cfg[^\]]*test", head)):
                item.tags.append("test")
            if item.kind in ("impl", "interface") and (open_ := piece.find("{", item.head - item.start)) >= 0:
                for inner in _items(piece[open_ + 1 : piece.rfind("}")], language):
                    if (kind := _member(inner, piece[open_ + 1 :])) is not None:
                        out.append(Item(item.start + open_ + 1 + inner.start, item.start + open_ + 1 + inner.end, kind, list(item.tags)))
        elif language in ("JavaScript", "TypeScript") and re.search(r"\b(describe|it|test)\s*\(", piece):
            item.tags.append("test")
        elif language == "Shell" and item.kind == "function" and re.match(r"(function\s+)?test_", piece):
            item.tags.append("test")
        last = item.end
    if text[last:].strip():
        out.append(Item(last, len(text), "gap"))
    return out


def _member(item: Item, body: str) -> str | None:
    if item.kind == "function" and not body[item.start : item.end].rstrip().endswith("}"):
        return "FunctionSignature"
    if item.kind == "const" and re.match(r"(?:pub(?:\([^)]*\))?\s+)?static\b", body[item.head : item.end]):
        return "static"
    return METHODS.get(item.kind)


#: Words of control flow that add to complexity, by language.
FLOW = {"Rust": r"\b(?:if|for|while|loop|match)\b", "JavaScript": r"\b(?:if|for|while|do|switch|catch)\b", "Shell": r"\b(?:if|for|while|case|until)\b"}
FLOW["TypeScript"] = FLOW["JavaScript"]


def complexity(text: str, language: str) -> int:
    """Control flow counts one and one more for each level it is nested in; logical operators count one, in Python two."""
    if language == "Python":
        try:
            return _python_complexity(ast.parse(text), 0)
        except (SyntaxError, ValueError):
            return 0
    if language not in FLOW:
        return 0
    total, i, depth, open_ = 0, 0, 0, []
    flow = re.compile(FLOW[language])
    while i < len(text):
        if (end := _skip(text, i, language)) is not None:
            i = end
        elif (i == 0 or not (text[i - 1].isalnum() or text[i - 1] == "_")) and (m := flow.match(text, i)):
            total += 1 + len(open_)
            open_.append(depth)
            i = m.end()
        elif text.startswith(("&&", "||"), i):
            total += 1
            i += 2
        else:
            depth += (text[i] == "{") - (text[i] == "}")
            if text[i] == "}":
                while open_ and open_[-1] >= depth:
                    open_.pop()
            i += 1
    return total


def _python_complexity(node: ast.AST, nested: int) -> int:
    own = isinstance(node, (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.IfExp, ast.Match)) and not getattr(node, "_elif", False)
    total = 1 + nested if own else 0
    if isinstance(node, ast.BoolOp):
        total += 2 * (len(node.values) - 1)
    if isinstance(node, ast.If) and len(node.orelse) == 1 and isinstance(node.orelse[0], ast.If):
        node.orelse[0]._elif = True
    return total + sum(_python_complexity(child, nested + own) for child in ast.iter_child_nodes(node))


def function_parts(text: str, language: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of a function: its signature, then runs of statements broken by blank lines and comments."""
    if language == "Python":
        m = re.search(r":[^\S\n]*\n", text)
        head = m.end() if m else len(text)
    else:
        open_ = text.find("{")
        head = len(text) if open_ < 0 else text.find("\n", open_) + 1 or open_ + 1
    out = [("FunctionSignature", 0, head)]
    body, at = text[head:], head
    comment = re.compile(r"\s*(//|/\*|#)")
    start, kind = None, ""
    for line in body.splitlines(keepends=True):
        blank, own = not line.strip(), "comment" if comment.match(line) else "CodeParagraph"
        if blank or (start is not None and own != kind):
            if start is not None:
                out.append((kind, start, at))
            start = None
        if not blank and start is None:
            start, kind = at, own
        at += len(line)
    if start is not None:
        out.append((kind, start, at))
    return out


#: Starts the kinds of blocks that are not to be merged.
LOOSE = "="


def loose_items(text: str) -> list[Item]:
    """The paragraphs of a file that gives no items, comments and gaps told apart; merging leaves them alone."""
    from marginalia.operators import subsplit

    return [Item(start, end, LOOSE + ("gap" if gap else subsplit.paragraph_kind(text[start:end]))) for start, end, gap in subsplit.paragraphs(text)]


def blocks(files: DataFrame, fallback: bool = False) -> DataFrame:
    """Blocks of code files: path, language, ord, kind, content, hash, tags, complexity, lines.

    With ``fallback``, a file that can't be parsed or gives no items is cut
    into paragraphs, whose kinds start with LOOSE.
    """
    import pandas as pd

    names = ["path", "language", "ord", "kind", "content", "tags", "complexity", "start_line", "end_line"]

    def run(batches):
        for batch in batches:
            out = []
            for path, language, text in zip(batch["path"], batch["language"], batch["content"]):
                for n, item in enumerate(items(text, language) or (loose_items(text) if fallback else [])):
                    piece = text[item.start : item.end]
                    line = text.count("\n", 0, item.start)
                    out.append((path, language, n, item.kind, piece, item.tags, 0 if item.kind.startswith(LOOSE) else complexity(piece, language), line, line + piece.count("\n") + (not piece.endswith("\n"))))
            yield pd.DataFrame(out, columns=names)

    made = files.select("path", "language", "content").mapInPandas(run, "path string, language string, ord int, kind string, content string, tags array<string>, complexity int, start_line int, end_line int")
    return made.withColumn("hash", content_hash(F.col("content")))
