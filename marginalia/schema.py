"""Schemas and small fixed tables of the review model."""

from __future__ import annotations

#: The wire schema of one review record, as a line of JSON.
RECORD = (
    "id STRING, version INT, fingerprint STRING, `check` STRING, verdict STRING, identity STRUCT<type:STRING,email:STRING>, "
    "repo_ref STRUCT<type:STRING,system:STRING,revision:STRING>, block_state STRING, timestamp BIGINT, path_hint STRING, line_hint BIGINT, "
    "note STRING, tags ARRAY<STRING>, attestations ARRAY<STRUCT<kind:STRING,canonicalization:STRING,signature:STRING,public_key:STRING>>"
)
BLOCK = "path STRING, language STRING, ord INT, kind STRING, content STRING, hash STRING, tags ARRAY<STRING>, complexity INT, start_line INT, end_line INT"

#: Wire names of block kinds.
KINDS = [
    "TextBlock", "code", "gap", "comment", "Section", "Preamble", "function", "struct", "enum", "impl", "module", "Modules",
    "import", "const", "static", "macro", "class", "export", "variable", "decorator", "interface", "type", "method", "command",
    "CodeParagraph", "Header", "Paragraph", "CodeBlock", "List", "ListItem", "Quote", "Element", "Content", "Sentence",
    "Imports", "FunctionSignature",
]
#: The review priority of kinds; all others have OTHER_PRIORITY.
PRIORITY = {
    "import": 70, "Imports": 70, "module": 70, "Modules": 70, "struct": 0, "enum": 0, "type": 0, "interface": 0, "class": 0,
    "const": 20, "static": 20, "FunctionSignature": 30, "impl": 40, "function": 50, "method": 50, "gap": 95, "comment": 95,
}
OTHER_PRIORITY, TEST_PRIORITY = 60, 10
IMPORT_LIKE = ["import", "Imports", "module", "Modules"]
#: The display group of kinds; all others are "Other".
GROUPS = {
    "Code Logic": ["function", "method", "FunctionSignature", "CodeParagraph"],
    "Definitions": ["struct", "enum", "class", "impl", "macro", "const", "static", "type"],
    "Module Structure": ["module", "Modules", "import", "Imports", "export", "Preamble"],
    "Documentation": ["comment", "TextBlock", "Paragraph", "ListItem", "Header", "Quote", "Section"],
}
#: Languages by file extension.
EXTENSIONS = {
    "rs": "Rust", "el": "Elisp", "js": "JavaScript", "ts": "TypeScript", "py": "Python", "sh": "Shell", "md": "Markdown",
    "markdown": "Markdown", "toml": "Toml", "nix": "Nix", "just": "Just", "org": "Text", "txt": "Text",
}
VERDICTS = ["approved", "rejected", "question", "comment"]
BLOCK_STATES = ["committed", "uncommitted", "unknown"]


def normalized(kind: str) -> str:
    return kind.strip().lower().replace("_", "").replace("-", "")


#: Accepted spellings of kinds: the wire names without case, dashes and underscores, and one alias.
SPELLINGS = {normalized(k): k for k in KINDS} | {"signature": "FunctionSignature"}
