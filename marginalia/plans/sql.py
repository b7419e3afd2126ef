"""Parts that the SQL of several queries shares."""

from marginalia.functions.text import WS
from marginalia.schema import GROUPS, IMPORT_LIKE, OTHER_PRIORITY, PRIORITY

NL = "chr(10)"


def canonical(c: str) -> str:
    return rf"(CASE WHEN {c} = '' THEN '' ELSE regexp_replace({c}, '[{WS}]+(\n|\z)', '\1', 'g') || CASE WHEN suffix({c}, {NL}) THEN '' ELSE {NL} END END)"


def content_hash(c: str) -> str:
    return f"sha256({canonical(c)})"


def stripped(c: str) -> str:
    return rf"regexp_replace({c}, '^[\n{WS}]+|[\n{WS}]+\z', '', 'g')"


def newlines(c: str) -> str:
    return f"(length({c}) - length(replace({c}, {NL}, '')))"


def case_of(table: dict, c: str, other: str) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {v if isinstance(v, int) else repr(v)}" for k, v in table.items()) + f" ELSE {other} END"


def priority(c: str = "kind") -> str:
    return f"({case_of(PRIORITY, c, OTHER_PRIORITY)})"


def group(c: str = "kind") -> str:
    return f"({case_of({k: g for g, kinds in GROUPS.items() for k in kinds}, c, repr('Other'))})"


def in_list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


IMPORTS = in_list(IMPORT_LIKE)

FILES_DOC = "files_doc AS (SELECT doc_id, lang || '/' || source AS dir, lang || '/' || source || '/doc-' || doc_id || '.txt' AS path, text AS content FROM documents)"
FILES_CONV = f"files_conv AS (SELECT 'conv/' || conv_id || '.md' AS path, string_agg(text, {NL} || {NL} ORDER BY turn) AS content FROM conversations GROUP BY conv_id)"
BLOCKS = rf"""cut AS (SELECT path, string_split(regexp_replace(content, '(\n[\n{WS}]*\n)', chr(1) || '\1' || chr(1), 'g'), chr(1)) AS parts FROM files_conv),
chunks AS (SELECT path, pos, parts[pos] AS content FROM (SELECT path, parts, unnest(generate_series(1, len(parts))) AS pos FROM cut) WHERE parts[pos] <> ''),
blocks AS (
  SELECT path, row_number() OVER w - 1 AS ord, CASE WHEN regexp_full_match(content, '\n[\n{WS}]*\n') THEN 'gap' ELSE 'Paragraph' END AS kind, content, {content_hash('content')} AS hash,
         coalesce(sum({newlines('content')}) OVER (PARTITION BY path ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_line
  FROM chunks WINDOW w AS (PARTITION BY path ORDER BY pos)
),
spans AS (SELECT *, start_line + {newlines('content')} + CASE WHEN suffix(content, {NL}) THEN 0 ELSE 1 END AS end_line FROM blocks)"""
SENTENCE = r"[^.!?]*[.!?][ \t\n\x0C\r]*|[^.!?]+"
RECORDS = f"""doc_hashes AS (SELECT doc_id, {content_hash('text')} AS fingerprint FROM documents),
records AS (
  SELECT event_id::VARCHAR AS id, fingerprint, CASE WHEN event_type IN ('purchase', 'signup') THEN 'approved' WHEN event_type = 'error' THEN 'rejected' WHEN event_type = 'click' THEN 'comment' ELSE 'question' END AS verdict,
         CASE WHEN event_type = 'signup' THEN 'security' ELSE 'review' END AS "check", epoch(date_trunc('day', ts))::BIGINT AS ts, event_id AS seq, 'u' || user_id || '@example.com' AS email, CASE WHEN event_type = 'click' THEN 'see <' || event_id || '> & more' END AS note
  FROM events JOIN doc_hashes ON doc_id = event_id % (SELECT count(*) FROM documents)
)"""
LATEST = """latest AS (SELECT fingerprint, verdict FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY ts DESC, seq DESC) AS r FROM records WHERE "check" = 'review') WHERE r = 1)"""
LOGGED = "logged AS (SELECT fingerprint, verdict FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY seq DESC) AS r FROM records) WHERE r = 1)"


def code_blocks(kinds: list[str]) -> str:
    listed = "[" + ", ".join(f"'{k}'" for k in kinds) + "]"
    return f"""code AS (
  SELECT path, ord, kind, content, test, (sum(height) OVER w)::BIGINT AS end_line, (sum(height) OVER w - height)::BIGINT AS start_line
  FROM (SELECT 'src/f' || (p_partkey // 25) || '.rs' AS path, p_partkey % 25 AS ord, {listed}[((p_partkey * 7 + p_size) % {len(kinds)} + 1)::INT] AS kind, p_name || {NL} AS content, p_size % 9 = 0 AS test, p_size % 5 + 1 AS height FROM part)
  WINDOW w AS (PARTITION BY path ORDER BY ord)
)"""


TREE = f"""tree1 AS (SELECT dir, sha256({content_hash('content')}) AS hash, 'doc-' || doc_id || '.txt' AS name, path FROM files_doc),
tree2 AS (SELECT dir AS path, string_split(dir, '/')[1] AS parent, string_split(dir, '/')[2] AS name, sha256(string_agg('file:' || name || ':' || hash || '|', '' ORDER BY 'file:' || name) || {NL}) AS hash FROM tree1 GROUP BY dir),
tree3 AS (SELECT parent AS path, sha256(string_agg('dir:' || name || ':' || hash || '|', '' ORDER BY 'dir:' || name) || {NL}) AS hash FROM tree2 GROUP BY parent),
nodes AS (
  SELECT path, 'file' AS kind, 3 AS depth, hash FROM tree1 UNION ALL SELECT path, 'directory', 2, hash FROM tree2 UNION ALL SELECT path, 'directory', 1, hash FROM tree3
  UNION ALL SELECT '', 'root', 0, sha256(string_agg('dir:' || path || ':' || hash || '|', '' ORDER BY 'dir:' || path) || {NL}) FROM tree3
)"""
