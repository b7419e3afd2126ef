"""Every registered query by name, with its SQL where SQL can express it."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from marginalia.functions import kinds as K
from marginalia.functions import text as T
from marginalia.operators import diff, merge, review, split, tree, verdicts
from marginalia.operators.review import Filters
from marginalia.plans import sql as S
from marginalia.schema import EXTENSIONS, IMPORT_LIKE, SPELLINGS
from marginalia.sources import views as V

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register


def big(*names: str) -> list:
    return [F.col(n).cast("bigint").alias(n) for n in names]


def _conv_blocks(spark, sf):
    return split.paragraphs(V.conversation_files(spark, sf))


def _code(spark, sf):
    return V.code_blocks(spark, sf)


def _flag(hash_column, low: str, high: str):
    """Whether a hash's first digit lies between two digits: a stand-in for recorded verdicts."""
    return F.substring(hash_column, 1, 1).between(low, high)


# --- hashes and identity -------------------------------------------------------------------------


@query(f"SELECT doc_id, {S.content_hash('text')} AS hash FROM documents")
def canonical_hash(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", T.content_hash(F.col("text")).alias("hash"))


_HUNKS = f"""lines AS (SELECT doc_id, i, CASE (i - 1) % 3 WHEN 0 THEN ' ' WHEN 1 THEN '+' ELSE '-' END || parts[i] || {S.NL} AS line FROM (SELECT doc_id, parts, unnest(generate_series(1, len(parts))) AS i FROM (SELECT doc_id, string_split(text, {S.NL}) AS parts FROM documents))),
parts AS (
  SELECT doc_id, coalesce(string_agg(CASE WHEN line[1] IN ('+', '-') THEN line END, '' ORDER BY i), '') AS body, coalesce(string_agg(CASE WHEN line[1] = ' ' THEN line END, '' ORDER BY i), '') AS ctx,
         coalesce(string_agg(CASE WHEN line[1] IN (' ', '+') THEN line[2:] END, '' ORDER BY i), '') AS new_content
  FROM lines GROUP BY doc_id
)"""


def _hunks(spark, sf):
    docs = V.table(spark, sf, "documents")
    signs = F.array(F.lit(" "), F.lit("+"), F.lit("-"))
    lines = F.transform(F.split("text", "\n"), lambda line, i: F.concat(F.element_at(signs, i % 3 + 1), line, F.lit("\n")))
    return docs.select("doc_id", lines.alias("lines"))


@query(f"WITH {_HUNKS} SELECT doc_id, sha256({S.content_hash('body')} || {S.content_hash('ctx')}) AS fingerprint, sha256(body) AS diff_sha256, sha256(new_content) AS new_sha256 FROM parts")
def hunk_fingerprint(spark, sf):
    parts = diff.hunk_parts(F.col("lines"))
    return _hunks(spark, sf).select("doc_id", *(c.alias(n) for n, c in parts.items())).select("doc_id", T.fingerprint(F.col("diff_content"), F.col("context")).alias("fingerprint"), F.sha2("diff_content", 256).alias("diff_sha256"), F.sha2("new_content", 256).alias("new_sha256"))


@query(f"WITH {S.FILES_DOC} SELECT {S.content_hash('content')} AS hash, count(*) AS n, min(path) AS first_path FROM files_doc GROUP BY 1 HAVING count(*) > 1")
def duplicate_blocks(spark, sf):
    return V.document_files(spark, sf).groupBy(T.content_hash(F.col("content")).alias("hash")).agg(F.count("*").alias("n"), F.min("path").alias("first_path")).where("n > 1")


# --- splitting and classes -----------------------------------------------------------------------


@query(f"WITH {S.FILES_CONV}, {S.BLOCKS} SELECT path, ord, kind, hash, start_line, end_line FROM spans")
def paragraph_blocks(spark, sf):
    return _conv_blocks(spark, sf).select("path", *big("ord"), "kind", "hash", *big("start_line", "end_line"))


_SENTENCES = rf"sentences AS (SELECT path, i - 1 AS sub_ord, s[i] AS content FROM (SELECT path, s, unnest(generate_series(1, len(s))) AS i FROM (SELECT path, CASE WHEN len(f) > 0 THEN f ELSE [content] END AS s FROM (SELECT path, content, list_filter(regexp_extract_all(content, '{S.SENTENCE}'), lambda x: regexp_matches(x, '[^\n{T.WS}]')) AS f FROM files_doc))))"


@query(f"WITH {S.FILES_DOC}, {_SENTENCES} SELECT path, sub_ord, {S.content_hash('content')} AS hash FROM sentences")
def sentence_blocks(spark, sf):
    return split.sentences(V.document_files(spark, sf).select("path", "content")).select("path", *big("sub_ord"), "hash")


_CHUNK = "CASE doc_id % 5 WHEN 0 THEN '// ' || replace(text, chr(10), chr(10) || '# ') WHEN 1 THEN '}' || chr(10) || '}' WHEN 2 THEN '};' || chr(10) WHEN 3 THEN '/* a' || chr(10) || chr(10) || '* b' ELSE text END"
_COMMENT = rf"(len(list_filter(string_split({S.stripped('c')}, {S.NL}), lambda x: NOT regexp_matches(x, '^[{T.WS}]*(//|#|/[*]|[*])'))) = 0)"


@query(rf"WITH c AS (SELECT doc_id, {_CHUNK} AS c FROM documents) SELECT doc_id, CASE WHEN {_COMMENT} THEN 'comment' ELSE 'CodeParagraph' END AS paragraph_class, CASE WHEN regexp_full_match({S.stripped('c')}, '[}};]*') THEN 'gap' WHEN {_COMMENT} THEN 'comment' ELSE 'CodeParagraph' END AS chunk_class FROM c")
def classify_chunks(spark, sf):
    c = V.table(spark, sf, "documents").select("doc_id", F.expr(_CHUNK).alias("c"))
    return c.select("doc_id", T.paragraph_class(F.col("c")).alias("paragraph_class"), T.chunk_class(F.col("c")).alias("chunk_class"))


_MD = "md AS (SELECT 'md/' || conv_id || '.md' AS path, string_agg(CASE role WHEN 'user' THEN '# ' WHEN 'assistant' THEN '## ' ELSE '### ' END || 'turn ' || turn || chr(10) || CASE WHEN turn % 4 = 3 THEN '```' || chr(10) || '# not a heading' || chr(10) || '```' || chr(10) ELSE '' END || text, chr(10) ORDER BY turn) AS content FROM conversations GROUP BY conv_id)"


def _markdown(spark, sf):
    head = F.when(F.col("role") == "user", "# ").when(F.col("role") == "assistant", "## ").otherwise("### ")
    fence = F.when(F.col("turn") % 4 == 3, "```\n# not a heading\n```\n").otherwise("")
    text = F.concat(head, F.lit("turn "), F.col("turn").cast("string"), F.lit("\n"), fence, F.col("text"))
    turns = V.table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", text.alias("t")))).alias("t"))
    return turns.select(F.concat(F.lit("md/"), F.col("conv_id").cast("string"), F.lit(".md")).alias("path"), F.lit("Markdown").alias("language"), F.array_join("t.t", "\n").alias("content"))


@query(rf"""WITH {_MD}, l AS (SELECT path, i - 1 AS line, p[i] AS text, len(p) - 1 AS last FROM (SELECT path, p, unnest(generate_series(1, len(p))) AS i FROM (SELECT path, string_split(content, {S.NL}) AS p FROM md))),
f AS (SELECT *, regexp_matches(text, '^ {{0,3}}(```|~~~)') AS fence, sum(regexp_matches(text, '^ {{0,3}}(```|~~~)')::INT) OVER (PARTITION BY path ORDER BY line) AS fences FROM l),
h AS (SELECT *, CASE WHEN NOT fence AND fences % 2 = 0 AND regexp_matches(text, '^ {{0,3}}#{{1,6}}([ \t]|$)') THEN length(regexp_extract(text, '^ {{0,3}}(#{{1,6}})', 1)) END AS level FROM f),
s AS (SELECT *, level IS NOT NULL AND level <= coalesce(min(level) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 7) AS start FROM h),
n AS (SELECT *, sum(start::INT) OVER (PARTITION BY path ORDER BY line) AS section FROM s),
j AS (SELECT path, section, string_agg(text || CASE WHEN line < last THEN {S.NL} ELSE '' END, '' ORDER BY line) AS content, min(line) AS start_line FROM n GROUP BY path, section)
SELECT path, section::BIGINT AS ord, CASE WHEN section = 0 THEN 'Preamble' ELSE 'Section' END AS kind, {S.content_hash('content')} AS hash, start_line::BIGINT AS start_line FROM j WHERE regexp_matches(content, '[^\n{T.WS}]')""")
def md_sections(spark, sf):
    return split.sections(_markdown(spark, sf)).select("path", *big("ord"), "kind", "hash", *big("start_line"))


_NAMES = ["a.rs", "b.el", "c.js", "d.ts", "e.py", "f.sh", "g.md", "h.markdown", "i.toml", "j.nix", "k.just", "l.org", "m.txt", ".bashrc", ".env.sh", "Makefile", "n.RS", "o.tar.gz"]
_NAME_LIST = "[" + ", ".join(f"'{x}'" for x in _NAMES) + "]"


@query(f"WITH p AS (SELECT page_id, 'd' || page_id % 3 || '/' || {_NAME_LIST}[(page_id % {len(_NAMES)} + 1)::INT] AS path FROM pages), e AS (SELECT *, regexp_extract(path, '[^/]\\.([^./]+)$', 1) AS x FROM p) SELECT page_id, path, {S.case_of(EXTENSIONS, 'x', 'NULL')} AS language FROM e")
def language_detect(spark, sf):
    path = F.concat(F.lit("d"), (F.col("page_id") % 3).cast("string"), F.lit("/"), F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("page_id") % len(_NAMES) + 1).cast("int")))
    return V.table(spark, sf, "pages").select("page_id", path.alias("path")).withColumn("language", K.language(F.col("path")))


_PATHS = ["src/a.rs", ".git/config", "target/x", "a/node_modules/b", "a/.hidden/c", "ok/targets/d", "./x.rs", "_private.py", "a/b/target"]
_PATH_LIST = "[" + ", ".join(f"'{x}'" for x in _PATHS) + "]"


@query(f"WITH p AS (SELECT page_id, {_PATH_LIST}[(page_id % {len(_PATHS)} + 1)::INT] AS path FROM pages) SELECT page_id, path, len(list_filter(string_split(path, '/'), lambda x: (starts_with(x, '.') AND x <> '.') OR x IN ('target', 'node_modules'))) > 0 AS ignored FROM p")
def ignore_paths(spark, sf):
    path = F.element_at(F.array(*map(F.lit, _PATHS)), (F.col("page_id") % len(_PATHS) + 1).cast("int"))
    return V.table(spark, sf, "pages").select("page_id", path.alias("path")).withColumn("ignored", K.ignored(F.col("path")))


# --- kinds and ranks -----------------------------------------------------------------------------

_SPELLED = ["Function", " gap ", "code_paragraph", "FUNCTION-SIGNATURE", "signature", "Imports", "mod", "Struct", "list-item", "IMPL", "const", "nonsense"]
_SPELLED_LIST = "[" + ", ".join(f"'{x}'" for x in _SPELLED) + "]"


_SPELLING = "regexp_replace(lower(trim(raw)), '[_-]', '', 'g')"


@query(f"WITH k AS (SELECT p_partkey, {S.case_of(SPELLINGS, _SPELLING, 'NULL')} AS kind FROM (SELECT p_partkey, {_SPELLED_LIST}[(p_partkey % {len(_SPELLED)} + 1)::INT] AS raw FROM part)) SELECT p_partkey, kind, {S.priority()}::BIGINT AS priority, kind IN {S.IMPORTS} AS import_like, {S.group()} AS parent FROM k")
def kind_normalize(spark, sf):
    raw = F.element_at(F.array(*map(F.lit, _SPELLED)), (F.col("p_partkey") % len(_SPELLED) + 1).cast("int"))
    rows = V.table(spark, sf, "part").select("p_partkey", K.kind_of(raw).alias("kind"))
    return rows.select("p_partkey", "kind", K.priority(F.col("kind")).cast("bigint").alias("priority"), K.import_like(F.col("kind")).alias("import_like"), K.group(F.col("kind")).alias("parent"))


_CODE = S.code_blocks(V.CODE_KINDS)


@query(f"WITH {_CODE} SELECT {S.group()} AS parent, kind, count(*) AS n FROM code GROUP BY 1, 2")
def parent_kind_counts(spark, sf):
    return _code(spark, sf).groupBy(K.group(F.col("kind")).alias("parent"), "kind").agg(F.count("*").alias("n"))


@query(f"WITH {_CODE} SELECT path, ord, CASE WHEN test THEN 10 ELSE {S.priority()} END::BIGINT AS rank, (row_number() OVER (PARTITION BY path ORDER BY CASE WHEN test THEN 10 ELSE {S.priority()} END, start_line, ord))::BIGINT AS place, (min(CASE WHEN test THEN 10 ELSE {S.priority()} END) OVER (PARTITION BY path))::BIGINT AS file_rank FROM code")
def review_order(spark, sf):
    return review.ranked(_code(spark, sf)).select("path", *big("ord", "rank", "place", "file_rank"))


_GROUP = "CASE WHEN test THEN 0 WHEN starts_with(path, 'src/') THEN 1 ELSE 2 END"
_BAND = f"CASE {S.priority()} WHEN 0 THEN 0 WHEN 20 THEN 1 ELSE 2 END"


@query(f'WITH {_CODE} SELECT path, ord, {_GROUP}::BIGINT AS "group", ({_BAND})::BIGINT AS band, {S.priority()}::BIGINT AS priority, row_number() OVER (PARTITION BY path ORDER BY {_GROUP}, {_BAND}, {S.priority()}, start_line, ord) AS place, row_number() OVER (ORDER BY {_GROUP}, path, {_BAND}, {S.priority()}, start_line, ord) - 1 AS rank FROM code')
def tui_order(spark, sf):
    """Blocks with their place in their file and their rank in the session, over all files."""
    return review.session_ranks(_code(spark, sf)).select("path", *big("ord", "group", "band", "priority", "place", "rank"))


# --- hierarchy -----------------------------------------------------------------------------------


@query(f"WITH {S.FILES_CONV}, {S.BLOCKS} SELECT path, sha256(string_agg(hash, '' ORDER BY ord)) AS hash FROM blocks GROUP BY path")
def file_hash(spark, sf):
    return tree.file_hashes(_conv_blocks(spark, sf))


def _doc_files(spark, sf):
    return V.document_files(spark, sf).select("path", F.sha2(T.content_hash(F.col("content")), 256).alias("hash"))


@query(f"WITH {S.FILES_DOC}, {S.TREE} SELECT path, kind, depth::BIGINT AS depth, hash FROM nodes WHERE kind <> 'file'")
def dir_merkle(spark, sf):
    return tree.nodes(_doc_files(spark, sf)).where("kind <> 'file'").select("path", "kind", *big("depth"), "hash")


@query(f"WITH {S.FILES_DOC} SELECT path, unnest(['', string_split(path, '/')[1], dir]) AS ancestor FROM files_doc")
def ancestor_closure(spark, sf):
    return tree.closure(_doc_files(spark, sf))


@query(f"WITH {S.FILES_DOC}, c AS (SELECT unnest(['', string_split(path, '/')[1], dir]) AS ancestor FROM files_doc) SELECT ancestor, count(*) AS n_files FROM c GROUP BY ancestor")
def subtree_counts(spark, sf):
    return tree.subtree_counts(_doc_files(spark, sf))


@query(f"WITH {S.FILES_DOC}, {S.TREE}, good AS (SELECT path FROM nodes WHERE hash[1] <= '1') SELECT f.path FROM files_doc f WHERE f.path IN (SELECT path FROM good) OR f.dir IN (SELECT path FROM good) OR string_split(f.dir, '/')[1] IN (SELECT path FROM good) OR '' IN (SELECT path FROM good)")
def covered_by_ancestor(spark, sf):
    files = _doc_files(spark, sf)
    nodes = tree.nodes(files)
    return tree.covered(files, nodes, nodes.where(_flag("hash", "0", "1")).select("hash").distinct())


@query(f"""WITH {S.FILES_DOC}, p AS (SELECT path, string_split(path, '/') AS l, row_number() OVER (ORDER BY string_split(path, '/')) - 1 AS n FROM files_doc),
d AS (SELECT array_to_string(l[1:i], '/') AS path, i, n, i = len(l) AS leaf FROM (SELECT l, n, unnest(generate_series(0, len(l))) AS i FROM p))
SELECT path, CASE WHEN leaf THEN 'file' WHEN i = 0 THEN 'root' ELSE 'directory' END AS kind, i AS depth, min(n) AS first, max(n) AS last FROM d GROUP BY path, i, leaf""")
def tree_labels(spark, sf):
    """The interval of file numbers of every node."""
    return tree.labels(_doc_files(spark, sf))[1].select("path", "kind", *big("depth", "first", "last"))


_NESTED = "nested AS (SELECT path, ord, kind, start_line, CASE WHEN kind = 'impl' THEN end_line + 6 ELSE end_line END AS end_line FROM code)"


@query(f"WITH {_CODE}, {_NESTED}, m AS (SELECT b.path, b.ord, b.kind, o.ord AS impl_ord, row_number() OVER (PARTITION BY b.path, b.ord ORDER BY o.start_line DESC NULLS LAST, o.end_line DESC, o.ord DESC) AS r FROM nested b LEFT JOIN nested o ON o.path = b.path AND o.kind IN ('impl', 'interface') AND (o.start_line, o.end_line, o.ord) < (b.start_line, b.end_line, b.ord) AND b.start_line >= o.start_line AND b.end_line <= o.end_line) SELECT path, ord, kind, impl_ord FROM m WHERE r = 1")
def impl_nesting(spark, sf):
    nested = _code(spark, sf).withColumn("end_line", F.when(F.col("kind") == "impl", F.col("end_line") + 6).otherwise(F.col("end_line")))
    return tree.enclosing(nested).select("path", *big("ord"), "kind", *big("impl_ord"))


@query(f"WITH {_CODE}, spans AS (SELECT path, start_line AS s, end_line + 2 AS e FROM code WHERE test) SELECT path, ord FROM code c WHERE EXISTS (SELECT 1 FROM spans p WHERE p.path = c.path AND c.start_line < p.e AND c.end_line > p.s)")
def test_span_tag(spark, sf):
    code = _code(spark, sf)
    spans = code.where(F.array_contains("tags", "test")).select("path", F.col("start_line").alias("s"), (F.col("end_line") + 2).alias("e"))
    return tree.overlapping(code, spans).select("path", *big("ord"))


@query(f"WITH {_CODE} SELECT path, ord, lag(ord) OVER w AS before, lead(ord) OVER w AS after FROM code WINDOW w AS (PARTITION BY path ORDER BY ord)")
def sibling_nav(spark, sf):
    return tree.siblings(_code(spark, sf)).select("path", *big("ord", "before", "after"))


#: Blocks in three trees, of which one is a library's; those that are left to review are told by their hash.
_SESSION = f"""{_CODE}, moved AS (SELECT CASE regexp_extract(path, '[0-9]+')::INT % 3 WHEN 0 THEN path ELSE 'd' || regexp_extract(path, '[0-9]+')::INT % 3 || '/' || path END AS path, ord, kind, start_line, test, sha256(content)[1] <= '2' AS remains FROM code),
placed AS (SELECT *, row_number() OVER (ORDER BY {_GROUP}, path, {_BAND}, {S.priority()}, start_line, ord) AS n FROM moved)"""


def _session(spark, sf):
    tree_ = F.regexp_extract("path", "[0-9]+", 0).cast("int") % 3
    blocks = _code(spark, sf).withColumn("path", F.when(tree_ == 0, F.col("path")).otherwise(F.concat(F.lit("d"), tree_.cast("string"), F.lit("/"), "path")))
    return review.session_order(blocks), _flag(F.sha2("content", 256), "0", "2")


@query(f"WITH {_SESSION}, f AS (SELECT *, min(CASE WHEN remains THEN n END) OVER (ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS following FROM placed) SELECT f.path, f.ord, p.path AS next_path, p.ord AS next_ord FROM f LEFT JOIN placed p ON p.n = f.following")
def next_to_review(spark, sf):
    """The next block left to review after each, over all files."""
    return tree.next_remaining(*_session(spark, sf)).select("path", *big("ord"), F.col("next.path").alias("next_path"), F.col("next.ord").cast("bigint").alias("next_ord"))


@query(f"""WITH {_SESSION}, parts AS (SELECT path, string_split(path, '/') AS l FROM (SELECT DISTINCT path FROM moved)),
below AS (SELECT path, array_to_string(l[1:i], '/') AS node FROM (SELECT path, l, unnest(generate_series(0, len(l))) AS i FROM parts)),
starts AS (SELECT node, min(n) AS start FROM below JOIN placed USING (path) GROUP BY node),
found AS (SELECT node, min(n) AS n FROM starts s JOIN placed p ON p.n > s.start AND p.remains AND NOT EXISTS (SELECT 1 FROM below b WHERE b.node = s.node AND b.path = p.path) GROUP BY node)
SELECT s.node, p.path AS next_path, p.ord AS next_ord FROM starts s LEFT JOIN found f USING (node) LEFT JOIN placed p ON p.n = f.n""")
def next_after_subtree(spark, sf):
    """The next block left to review outside each file and directory."""
    return tree.next_after_subtree(*_session(spark, sf)).select("node", F.col("next.path").alias("next_path"), F.col("next.ord").cast("bigint").alias("next_ord"))


# --- merging -------------------------------------------------------------------------------------


def _merge_step(source: str, step: str, target: str, into: str, absorbed: list[str], limit: int, separator: str) -> str:
    """Tables of one merging of the blocks in ``source``, the result as ``merged`` with the step's name."""
    member = f"kind IN {S.in_list([target, *absorbed])}"
    made = f"""o AS (SELECT path, ord, kind, content, start_line, end_line, row_number() OVER (PARTITION BY path ORDER BY ord) AS n FROM {source}),
walk AS (
  SELECT path, n, CASE WHEN {member} THEN 0 ELSE 1 END AS run, CASE WHEN {member} THEN 0 ELSE 2 END AS open, CASE WHEN kind = '{target}' THEN start_line END AS since FROM o WHERE n = 1
  UNION ALL
  SELECT o.path, o.n,
         CASE WHEN NOT {member} THEN walk.open + 1 WHEN kind = '{target}' AND end_line - coalesce(walk.since, start_line) > {limit} THEN walk.open + 1 ELSE walk.open END,
         CASE WHEN NOT {member} THEN walk.open + 2 WHEN kind = '{target}' AND end_line - coalesce(walk.since, start_line) > {limit} THEN walk.open + 1 ELSE walk.open END,
         CASE WHEN NOT {member} THEN NULL WHEN kind = '{target}' AND end_line - coalesce(walk.since, start_line) > {limit} THEN start_line WHEN kind = '{target}' THEN coalesce(walk.since, start_line) ELSE walk.since END
  FROM walk JOIN o ON o.path = walk.path AND o.n = walk.n + 1
),
g AS (SELECT o.*, run, count(*) FILTER (kind = '{target}') OVER r AS targets, min(ord) FILTER (kind = '{target}') OVER r AS head, max(ord) FILTER (kind = '{target}') OVER r AS tail FROM o JOIN walk USING (path, n) WINDOW r AS (PARTITION BY path, run)),
k AS (SELECT *, targets >= 2 AND ord BETWEEN head AND tail AS joined FROM g),
p AS (SELECT *, CASE WHEN joined THEN head ELSE ord END AS key FROM k),
q AS (SELECT *, CASE WHEN kind = '{target}' AND lag(kind) OVER (PARTITION BY path, key ORDER BY ord) = '{target}' THEN {separator} ELSE '' END || content AS piece FROM p),
merged AS (
  SELECT path, row_number() OVER (PARTITION BY path ORDER BY key) - 1 AS ord, CASE WHEN bool_or(joined) THEN '{into}' ELSE min(kind) END AS kind,
         string_agg(piece, '' ORDER BY ord) AS content, min(start_line)::BIGINT AS start_line, max(end_line)::BIGINT AS end_line
  FROM q GROUP BY path, key
)"""
    for name in ("o", "walk", "g", "k", "p", "q", "merged"):
        made = re.sub(rf"(?<=FROM ){name}\b(?! [A-Z ]*\bAS \()|(?<=JOIN ){name}\b", f"{name}_{step} {name}", made)
        made = re.sub(rf"(?<![\w.']){name}(?= AS \()", f"{name}_{step}", made)
    return made


def _merge_sql(*rule) -> str:
    return f"WITH RECURSIVE {_CODE}, {_merge_step('code', '1', *rule)} SELECT path, kind, sha256(content) AS content_sha256, start_line, end_line FROM merged_1"


_IMPORTS = ("import", "Imports", ["gap"], merge.UNLIMITED, S.NL)
_MODULES = ("module", "Modules", ["gap", "comment"], 48, "''")
_PARAGRAPHS = ("CodeParagraph", "CodeParagraph", ["gap"], 8, "''")


def _merged(blocks):
    return blocks.select("path", "kind", F.sha2("content", 256).alias("content_sha256"), *big("start_line", "end_line"))


@query(_merge_sql(*_IMPORTS))
def import_merge(spark, sf):
    return _merged(merge.merged_imports(_code(spark, sf)))


@query(_merge_sql(*_MODULES))
def module_merge(spark, sf):
    return _merged(merge.merged_modules(_code(spark, sf)))


@query(_merge_sql(*_PARAGRAPHS))
def paragraph_merge(spark, sf):
    return _merged(merge.merged_paragraphs(_code(spark, sf)))


@query(f"WITH RECURSIVE {_CODE}, {_merge_step('code', '1', *_IMPORTS)}, {_merge_step('merged_1', '2', *_MODULES)}, {_merge_step('merged_2', '3', *_PARAGRAPHS)} SELECT path, ord, kind, {S.content_hash('content')} AS hash, start_line, end_line FROM merged_3")
def optimized_blocks(spark, sf):
    """All three merges, called from SQL."""
    merge.register(spark)
    _code(spark, sf).select("path", "ord", "kind", "content", "tags", "start_line", "end_line").createOrReplaceTempView("_code_blocks")
    found = spark.sql("SELECT * FROM optimize_blocks(TABLE(_code_blocks) PARTITION BY path ORDER BY ord)")
    return found.select("path", *big("ord"), "kind", T.content_hash(F.col("content")).alias("hash"), *big("start_line", "end_line"))


# --- the log -------------------------------------------------------------------------------------


@query(f"WITH {S.RECORDS}, {S.LATEST} SELECT * FROM latest")
def latest_verdict(spark, sf):
    return verdicts.latest(V.records(spark, sf))


@query(f"WITH {S.RECORDS}, {S.LOGGED} SELECT * FROM logged")
def latest_verdict_any_check(spark, sf):
    return verdicts.latest_in_log(V.records(spark, sf))


@query(f"WITH {S.RECORDS}, {S.LATEST} SELECT fingerprint AS hash FROM latest WHERE verdict = 'approved'")
def approved_set(spark, sf):
    return verdicts.approved(verdicts.latest(V.records(spark, sf)))


@query(f"WITH {S.RECORDS} SELECT fingerprint, count(*) AS n, string_agg(seq || ':' || verdict, ',' ORDER BY seq) AS reviews FROM records GROUP BY fingerprint")
def reviews_by_fp(spark, sf):
    listed = F.transform("reviews", lambda r: F.concat(r["seq"].cast("string"), F.lit(":"), r["verdict"]))
    return verdicts.reviews(V.records(spark, sf)).select("fingerprint", "n", F.array_join(listed, ",").alias("reviews"))


@query(f"WITH {S.RECORDS}, remote AS (SELECT id, verdict, ts, seq, 0 AS side FROM records WHERE seq % 3 <> 0), local AS (SELECT id, verdict, ts + 500 AS ts, seq, 1 AS side FROM records WHERE seq % 2 = 0), u AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY side, seq) AS r FROM (SELECT * FROM remote UNION ALL SELECT * FROM local)) SELECT id, side::BIGINT AS side, ts, verdict FROM u WHERE r = 1")
def sync_merge(spark, sf):
    log = V.records(spark, sf).select("id", "verdict", "ts", "seq")
    return verdicts.synced(log.where("seq % 3 <> 0"), log.where("seq % 2 = 0").withColumn("ts", F.col("ts") + 500)).select("id", *big("side"), "ts", "verdict")


@query("SELECT event_id, CASE WHEN event_id % 11 = 0 OR event_id % 7 = 0 OR event_id % 5 = 0 THEN false ELSE true END AS valid, CASE WHEN event_id % 11 = 0 OR event_id % 7 = 0 OR event_id % 5 = 0 OR event_id % 3 = 0 THEN false ELSE true END AS schema_valid FROM events")
def record_validity(spark, sf):
    n = F.col("event_id")
    verdict = F.when(n % 7 == 0, "bogus").otherwise("approved")
    email = F.when(n % 5 != 0, F.lit("a@b"))
    revision = F.when(n % 3 == 0, "unknown").otherwise("deadbeef")
    record = F.struct(n.cast("string").alias("id"), F.lit("f").alias("fingerprint"), F.lit("review").alias("check"), verdict.alias("verdict"), F.struct(F.lit("email").alias("type"), email.alias("email")).alias("identity"), F.struct(F.lit("vcs").alias("type"), F.lit("git").alias("system"), revision.alias("revision")).alias("repo_ref"), F.lit("committed").alias("block_state"), F.lit(5).alias("timestamp"), F.lit(1).alias("extra"))
    line = F.when(n % 11 == 0, "not-json").otherwise(F.to_json(record))
    rows = verdicts.parsed(V.table(spark, sf, "events").select("event_id", line.alias("line")))
    return rows.select("event_id", "valid", F.coalesce(verdicts.schema_valid(F.col("r")), F.lit(False)).alias("schema_valid"))


@query("SELECT count(*) FILTER (event_id % 4 <> 0)::BIGINT AS attested, count(*) FILTER (event_id % 4 = 0)::BIGINT AS unattested, (count(*) FILTER (event_id % 4 = 2) + 2 * count(*) FILTER (event_id % 4 = 3))::BIGINT AS invalid FROM events")
def verify_counts(spark, sf):
    def one(good: bool):
        return F.struct(F.lit("PGP").alias("kind"), F.lit("JCS_V1").alias("canonicalization"), F.lit("-----BEGIN PGP SIGNATURE-----" if good else "forged").alias("signature"), F.lit("k").alias("public_key"))

    n = F.col("event_id") % 4
    listed = F.when(n == 1, F.array(one(True))).when(n == 2, F.array(one(True), one(False))).when(n == 3, F.array(one(False), one(False)))
    return verdicts.verify_counts(V.table(spark, sf, "events").select(listed.alias("attestations")))


@query(f"""WITH {S.RECORDS} SELECT id, '{{"check":"' || "check" || '","email":"' || email || '","fingerprint":"' || fingerprint || '","id":"' || id || '","note":null,"verdict":"' || verdict || '"}}' AS payload FROM records""")
def signing_payload(spark, sf):
    log = V.records(spark, sf).select("id", "fingerprint", "check", "verdict", "email", F.lit(None).cast("string").alias("note"))
    return log.select("id", verdicts.signing_payload(log).alias("payload"))


@query(f"WITH {S.RECORDS}, {S.LATEST} SELECT * FROM latest")
def stream_latest_verdict(spark, sf):
    from marginalia.streaming.verdicts import latest_from_stream

    return latest_from_stream(spark, sf)


# --- review --------------------------------------------------------------------------------------


@query(f"WITH {S.FILES_DOC}, {S.RECORDS}, {S.LATEST}, b AS (SELECT dir, {S.content_hash('content')} AS hash FROM files_doc) SELECT dir, count(*) FILTER (hash NOT IN (SELECT fingerprint FROM latest WHERE verdict = 'approved')) AS n_unreviewed, count(*) AS n_total FROM b GROUP BY dir")
def unreviewed_files(spark, sf):
    files = V.document_files(spark, sf).select("dir", T.content_hash(F.col("content")).alias("hash"))
    good = verdicts.approved(verdicts.latest(V.records(spark, sf))).withColumn("good", F.lit(True))
    return files.join(good, "hash", "left").groupBy("dir").agg(F.count_if(F.col("good").isNull()).alias("n_unreviewed"), F.count("*").alias("n_total"))


_SUBS = rf"""found AS (SELECT path, ord, content, list_filter(regexp_extract_all(content, '{S.SENTENCE}'), lambda x: regexp_matches(x, '[^\n{T.WS}]')) AS f FROM blocks),
subs AS (SELECT path, ord, {S.content_hash('content')} AS hash FROM (SELECT path, ord, unnest(CASE WHEN len(f) > 0 THEN f ELSE [content] END) AS content FROM found))"""


@query(f"WITH {S.FILES_CONV}, {S.BLOCKS}, {_SUBS} SELECT path, ord FROM subs GROUP BY path, ord HAVING bool_and(hash[1] <= 'b')")
def implicit_approval(spark, sf):
    subs = split.sentences(_conv_blocks(spark, sf))
    good = subs.where(_flag("hash", "0", "b")).select("hash").distinct()
    return review.implicitly_approved(subs, good, Filters()).select("path", *big("ord"))


_PSEUDO = "CASE WHEN hash[1] <= '5' THEN 'approved' WHEN hash[1] <= '7' THEN 'rejected' WHEN hash[1] = '8' THEN 'question' END"
_REVIEW = f"""WITH {S.FILES_CONV}, {S.BLOCKS}, {_SUBS}, fh AS (SELECT path, sha256(string_agg(hash, '' ORDER BY ord)) AS hash FROM blocks GROUP BY path),
done AS (SELECT path, ord FROM subs GROUP BY path, ord HAVING bool_and(hash[1] <= 'b')),
kept AS (SELECT path, ord, kind, hash, start_line, {_PSEUDO} AS verdict FROM blocks b WHERE kind <> 'gap' AND path NOT IN (SELECT path FROM fh WHERE hash[1] = '0')),
left_over AS (SELECT * FROM kept k WHERE verdict IS DISTINCT FROM 'approved' AND NOT (verdict IS NULL AND EXISTS (SELECT 1 FROM done d WHERE d.path = k.path AND d.ord = k.ord)))"""


def _review(spark, sf):
    blocks = _conv_blocks(spark, sf).withColumn("tags", F.array().cast("array<string>"))
    first = F.substring("hash", 1, 1)
    known = blocks.select(F.col("hash").alias("fingerprint"), F.when(first <= "5", "approved").when(first <= "7", "rejected").when(first == "8", "question").alias("verdict")).where("verdict is not null").distinct()
    files = tree.file_hashes(blocks)
    good = split.sentences(blocks).where(_flag("hash", "0", "b")).select("hash").distinct()
    return review.unreviewed(blocks, known, files.where(_flag("hash", "0", "0")).select("path"), split.sentences, good, Filters.of(exclude=["gap"]))


@query(f"{_REVIEW} SELECT path, ord, kind, hash, coalesce(verdict, 'unreviewed') AS verdict, row_number() OVER (PARTITION BY path ORDER BY start_line, ord) AS place FROM left_over")
def review_full(spark, sf):
    left = review.ranked(_review(spark, sf))
    return left.select("path", *big("ord"), "kind", "hash", F.coalesce("verdict", F.lit("unreviewed")).alias("verdict"), *big("place"))


@query(f"{_REVIEW} SELECT (SELECT count(*) FROM blocks WHERE kind <> 'gap') AS total_blocks, (SELECT count(*) FROM left_over) AS remaining, (SELECT count(DISTINCT path) FROM left_over) AS files")
def review_total(spark, sf):
    left = _review(spark, sf).agg(F.count("*").alias("remaining"), F.countDistinct("path").alias("files"))
    total = review.reviewable(_conv_blocks(spark, sf), Filters.of(exclude=["gap"])).agg(F.count("*").alias("total_blocks"))
    return total.join(left, F.lit(True)).select("total_blocks", "remaining", "files")


@query(f"WITH {_CODE} SELECT path, ord, kind FROM code WHERE kind IN ('import', 'struct', 'gap') AND kind <> 'gap'")
def filter_only_exclude(spark, sf):
    shown = Filters.of(only=["IMPORT", "struct", "Gap", "unknown-kind"], exclude=["gap"])
    return _code(spark, sf).where(shown.blocks(F.col("kind"))).select("path", *big("ord"), "kind")


@query(f"WITH {_CODE}, p AS (SELECT CASE WHEN ord % 2 = 0 THEN 'src/lib.rs' ELSE path END AS path, ord, kind FROM code) SELECT path, ord, kind FROM p WHERE kind NOT IN {S.IMPORTS} OR path = 'src/lib.rs'")
def import_policy(spark, sf):
    code = _code(spark, sf).withColumn("path", F.when(F.col("ord") % 2 == 0, "src/lib.rs").otherwise(F.col("path")))
    return code.where(Filters().imports(F.col("path"), F.col("kind"))).select("path", *big("ord"), "kind")


@query(f"WITH {_CODE} SELECT path, ord, kind FROM code WHERE kind NOT IN ('impl', 'interface')")
def impl_policy(spark, sf):
    return _code(spark, sf).where(Filters().impls(F.col("kind"))).select("path", *big("ord"), "kind")


@query(f"WITH {S.FILES_DOC} SELECT path FROM files_doc WHERE doc_id % 5 = 0 OR doc_id % 7 = 0")
def target_paths(spark, sf):
    files = V.document_files(spark, sf)
    asked = files.where("doc_id % 5 = 0").select("path").unionByName(files.where("doc_id % 7 = 0").select(F.concat(F.lit("work/"), "path").alias("path")))
    return review.targeted(files.select("path"), asked, "work")


# --- feedback ------------------------------------------------------------------------------------

_FEEDBACK = f"""WITH {S.FILES_DOC}, {S.RECORDS}, {S.LOGGED}, b AS (SELECT path, content, {S.content_hash('content')} AS hash FROM files_doc),
f AS (SELECT path, content, hash, verdict AS latest_verdict FROM b JOIN logged ON fingerprint = hash WHERE verdict <> 'approved')"""


def _feedback(spark, sf):
    from marginalia.operators import feedback

    blocks = V.document_files(spark, sf).select("path", F.lit(0).alias("start_line"), F.lit("Paragraph").alias("kind"), "content", T.content_hash(F.col("content")).alias("hash"))
    return feedback.with_reviews(blocks, V.records(spark, sf))


@query(f"""{_FEEDBACK}, r AS (SELECT fingerprint, '[' || string_agg('{{"verdict":"' || verdict || '","author":"' || email || '","check":"' || "check" || '"}}', ',' ORDER BY seq) || ']' AS reviews FROM records GROUP BY fingerprint) SELECT path, hash, latest_verdict, reviews FROM f JOIN r ON fingerprint = hash""")
def feedback_json(spark, sf):
    from marginalia.operators import feedback

    return _feedback(spark, sf).select("path", "hash", "latest_verdict", feedback.as_json(F.col("reviews")).alias("reviews"))


def _xml(c: str) -> str:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&apos;")):
        c = f"replace({c}, '{char}', '{entity}')"
    return c


@query(f"""{_FEEDBACK}, r AS (SELECT fingerprint, string_agg('        <review verdict="' || {_xml('verdict')} || '" author="' || {_xml('email')} || '">' || {S.NL} || coalesce('          <comment>' || {_xml('note')} || '</comment>' || {S.NL}, '') || '        </review>' || {S.NL}, '' ORDER BY seq) AS reviews FROM records GROUP BY fingerprint)
SELECT path, sha256('    <block start_line="0" end_line="' || ({S.newlines('content')} + CASE WHEN suffix(content, {S.NL}) THEN 0 ELSE 1 END) || '" kind="Paragraph" hash="' || hash || '">' || {S.NL} || '      <context><![CDATA[' || {S.NL} || replace(content, ']]>', ']]]]><![CDATA[>') || {S.NL} || ']]></context>' || {S.NL} || '      <reviews>' || {S.NL} || reviews || '      </reviews>' || {S.NL} || '    </block>' || {S.NL}) AS xml_sha256 FROM f JOIN r ON fingerprint = hash""")
def feedback_xml(spark, sf):
    from marginalia.operators import feedback

    return _feedback(spark, sf).select("path", F.sha2(feedback.as_xml(), 256).alias("xml_sha256"))


# --- lookups -------------------------------------------------------------------------------------


@query(f"WITH {S.FILES_CONV}, {S.BLOCKS}, p AS (SELECT hash[1:3] AS prefix, count(*) AS n, min(path) AS path FROM blocks WHERE kind <> 'gap' GROUP BY 1) SELECT prefix, n, CASE WHEN n = 1 THEN path END AS path FROM p")
def inspect_prefix(spark, sf):
    blocks = _conv_blocks(spark, sf).where("kind <> 'gap'")
    found = blocks.groupBy(F.substring("hash", 1, 3).alias("prefix")).agg(F.count("*").alias("n"), F.min("path").alias("path"))
    return found.select("prefix", "n", F.when(F.col("n") == 1, F.col("path")).alias("path"))


@query(f"WITH {_CODE} SELECT path, ord, kind || ':L' || (start_line + 1) || '-L' || greatest(end_line, start_line + 1) AS label, sha256(content)[1:8] AS short_id FROM code")
def block_labels(spark, sf):
    code = _code(spark, sf)
    return code.select("path", *big("ord"), K.label(F.col("kind"), F.col("start_line"), F.col("end_line")).alias("label"), T.short(F.sha2("content", 256)).alias("short_id"))


_SIGNED = "CASE p_partkey % 4 WHEN 0 THEN chr(10) || '  fn ' || p_name || '(a: u8) -> u8 {' || chr(10) || '}' WHEN 1 THEN 'fn f<T: Fn(u8)>(x: ' || p_type || ')' WHEN 2 THEN 'struct ' || p_name || ' ' || p_type || ' ' || p_brand || ' ' || p_name || ' ' || p_name || ' {{' ELSE '' END"


@query(rf"WITH s AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 2 THEN 'struct' ELSE 'function' END AS kind, CASE p_partkey % 4 WHEN 0 THEN 'fn ' || p_name WHEN 1 THEN 'fn f<T: Fn(u8)>' WHEN 2 THEN 'struct ' || p_name || ' ' || p_type || ' ' || p_brand || ' ' || p_name || ' ' || p_name ELSE 'function' END AS t FROM part) SELECT p_partkey, CASE WHEN length(t) <= 72 THEN t ELSE t[1:69] || '...' END AS signature FROM s")
def block_signature(spark, sf):
    rows = V.table(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 4 == 2, "struct").otherwise("function").alias("kind"), F.expr(_SIGNED).alias("content"))
    return rows.select("p_partkey", T.signature(F.col("content"), F.col("kind")).alias("signature"))


@query(f"SELECT page_id, sha256({_xml('html')}) AS escaped_sha256, sha256(replace(html, ']]>', ']]]]><![CDATA[>')) AS cdata_sha256 FROM pages")
def xml_escape(spark, sf):
    html = F.col("html")
    return V.table(spark, sf, "pages").select("page_id", F.sha2(T.escaped(html), 256).alias("escaped_sha256"), F.sha2(T.cdata(html), 256).alias("cdata_sha256"))


# --- changes -------------------------------------------------------------------------------------

_SNAPS = f"""{S.FILES_DOC}, snap_a AS (SELECT path, {S.content_hash('content')} AS hash FROM files_doc WHERE doc_id % 13 <> 0),
snap_b AS (SELECT path, {S.content_hash('c')} AS hash FROM (SELECT path, doc_id, CASE WHEN doc_id % 7 = 0 THEN content || {S.NL} || 'appended' ELSE content END AS c FROM files_doc) WHERE doc_id % 11 <> 0),
changed AS (SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' WHEN a.hash <> b.hash THEN 'modified' END AS status FROM snap_a a FULL JOIN snap_b b ON a.path = b.path)"""


@query(f"WITH {_SNAPS} SELECT path, status FROM changed WHERE status IS NOT NULL")
def snapshot_changed_paths(spark, sf):
    return diff.changed_paths(*V.snapshots(spark, sf))


_ALTERED = f"files_doc AS (SELECT doc_id, lang || '/' || source AS dir, lang || '/' || source || '/doc-' || doc_id || '.txt' AS path, CASE WHEN doc_id % 7 = 0 THEN text || {S.NL} || 'appended' ELSE text END AS content FROM documents WHERE doc_id % 11 <> 0)"


@query(f"WITH {_ALTERED}, {S.TREE} SELECT path, kind, hash FROM nodes")
def incremental_scan(spark, sf):
    """The tree of the later snapshot, from the earlier one's and the files that changed."""
    from marginalia.plans import incremental

    def files(snapshot):
        return snapshot.select("path", F.lit(0).cast("bigint").alias("mtime"), F.length("content").cast("bigint").alias("size"), "content")

    def process(found):
        done = found.withColumn("hash", F.sha2(T.content_hash(F.col("content")), 256))
        return done.select("path", "mtime", "size", "hash"), done.select("path", T.content_hash(F.col("content")).alias("hash"))

    before, after = (files(x) for x in V.snapshots(spark, sf))
    old = incremental.scanned(before.drop("content"), lambda listed: before, process)
    new = incremental.updated(old, after.drop("content"), lambda listed: after.join(listed.select("path"), "path", "left_semi"), process)
    return new.nodes.select("path", "kind", "hash")


@query()
def renamed_paths(spark, sf):
    """Changed paths, files that moved as one row each; the greedy choice among equals is beyond SQL."""
    return diff.changes(*V.moved_snapshots(spark, sf))


@query(f"WITH {_SNAPS} SELECT b.path, b.hash, CASE WHEN EXISTS (SELECT 1 FROM snap_a a WHERE a.path = b.path AND a.hash = b.hash) THEN 'committed' WHEN b.path IN (SELECT path FROM changed WHERE status IS NOT NULL) THEN 'uncommitted' ELSE 'unknown' END AS state FROM snap_b b")
def block_state(spark, sf):
    before, after = V.snapshots(spark, sf)
    return diff.block_states(after.select("path", "hash"), before, diff.changed_paths(before, after))


_DIFF = f"""WITH {_HUNKS}, h AS (SELECT doc_id, sha256({S.content_hash('body')} || {S.content_hash('ctx')}) AS fingerprint, new_content FROM parts),
s AS (SELECT 'doc-' || doc_id AS path, fingerprint, CASE WHEN fingerprint[1] <= '5' THEN 'approved' WHEN fingerprint[1] = '6' THEN 'rejected' ELSE 'unreviewed' END AS status, sha256(new_content) AS new_sha256 FROM h)"""


def _diff(spark, sf, covered=None):
    hunks = _hunks(spark, sf).select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("path"), F.lit(1).alias("new_start"), "lines")
    parts = diff.hunk_parts(F.col("lines"))
    prints = hunks.select(T.fingerprint(parts["diff_content"], parts["context"]).alias("fingerprint")).distinct()
    first = F.substring("fingerprint", 1, 1)
    known = prints.withColumn("verdict", F.when(first <= "5", "approved").when(first == "6", "rejected")).where("verdict is not null")
    return diff.hunk_changes(hunks, known, covered)


@query(f"{_DIFF} SELECT path, fingerprint, status, new_sha256 FROM s WHERE status <> 'approved'")
def diff_unreviewed(spark, sf):
    return _diff(spark, sf).select("path", "fingerprint", "status", F.sha2("new_content", 256).alias("new_sha256"))


@query(f"{_DIFF} SELECT count(*) AS n_changes, count(*) = 0 AS passes FROM s WHERE status <> 'approved'")
def check_gate(spark, sf):
    return _diff(spark, sf).agg(F.count("*").alias("n_changes"), (F.count("*") == 0).alias("passes"))


@query(f"{_DIFF} SELECT path, fingerprint, status FROM s WHERE status <> 'approved' AND right(path, 1) NOT IN ('0', '5')")
def diff_covered(spark, sf):
    """Unreviewed hunks of files that are not covered; documents with a number that five divides stand for covered ones."""
    return _diff(spark, sf, V.table(spark, sf, "documents").where("doc_id % 5 = 0").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("path"))).select("path", "fingerprint", "status")


_SIGNED_LINES = "array_to_string(list_transform({lines}, lambda x: '{sign}' || x || chr(10)), '')"


@query(rf"""WITH {S.FILES_DOC}, d AS (SELECT path, content, CASE WHEN doc_id % 7 = 0 THEN content || chr(10) || 'appended' ELSE content END AS altered, doc_id % 13 <> 0 AS was, doc_id % 11 <> 0 AS stays FROM files_doc),
b AS (SELECT *, CASE WHEN content = '' THEN [] ELSE string_split(regexp_replace(content, '\n\z', ''), chr(10)) END AS old, CASE WHEN altered = '' THEN [] ELSE string_split(regexp_replace(altered, '\n\z', ''), chr(10)) END AS new FROM d),
h AS (
  SELECT path, 1 AS new_start, {_SIGNED_LINES.format(lines='old', sign='-')} AS body, '' AS ctx FROM b WHERE was AND NOT stays AND len(old) > 0
  UNION ALL SELECT path, 1, {_SIGNED_LINES.format(lines='new', sign='+')}, '' FROM b WHERE stays AND NOT was AND len(new) > 0
  UNION ALL SELECT path, greatest(len(old) - 3, 0) + 1, {_SIGNED_LINES.format(lines='new[len(old) + 1:]', sign='+')}, {_SIGNED_LINES.format(lines='old[greatest(len(old) - 2, 1):]', sign=' ')} FROM b WHERE was AND stays AND content <> altered
)
SELECT path, new_start::BIGINT AS new_start, sha256({S.content_hash('body')} || {S.content_hash('ctx')}) AS fingerprint FROM h""")
def myers_diff(spark, sf):
    hunks = diff.file_hunks(*V.snapshots(spark, sf))
    parts = diff.hunk_parts(F.col("lines"))
    return hunks.select("path", *big("new_start"), T.fingerprint(parts["diff_content"], parts["context"]).alias("fingerprint"))


@query(r"""WITH l AS (SELECT 'c' || o_custkey AS path, o_orderkey AS pos, CASE WHEN o_orderkey % 3 = 0 THEN '@@ -' || o_orderkey || ',2 +' || (o_orderkey + 2) || ' @@ fn' ELSE '+' || o_orderkey END AS line FROM orders),
h AS (SELECT *, sum(starts_with(line, '@@')::INT) OVER (PARTITION BY path ORDER BY pos) AS hunk FROM l)
SELECT path, hunk::BIGINT AS hunk, max(try_cast(nullif(regexp_extract(line, '^@@ -\d+(?:,\d+)? \+(\d+)(?:,\d+)? @@', 1), '') AS INT))::BIGINT AS new_start, count(*) FILTER (NOT starts_with(line, '@@')) AS n_lines FROM h WHERE hunk > 0 GROUP BY path, hunk""")
def hunk_header_parse(spark, sf):
    n = F.col("o_orderkey").cast("string")
    line = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("@@ -"), n, F.lit(",2 +"), (F.col("o_orderkey") + 2).cast("string"), F.lit(" @@ fn"))).otherwise(F.concat(F.lit("+"), n))
    lines = V.table(spark, sf, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("path"), F.col("o_orderkey").alias("at"), line.alias("line"))
    found = diff.hunk_ids(lines).where("hunk > 0")
    return found.groupBy("path", "hunk").agg(F.max(diff.header_start(F.col("line"))).cast("bigint").alias("new_start"), F.count_if(~F.col("line").startswith("@@")).alias("n_lines")).select("path", *big("hunk"), "new_start", "n_lines")


_COMMITS = "c0 AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS n, o_orderpriority AS summary FROM orders), commits AS (SELECT n, summary, CASE WHEN n > 1 THEN n - 1 END AS p1, CASE WHEN n % 10 = 0 AND n > 5 THEN n - 5 END AS p2 FROM c0)"


@query(f"WITH RECURSIVE {_COMMITS}, walk AS (SELECT n, p1, summary, 1 AS step FROM commits WHERE n = (SELECT max(n) FROM commits) UNION ALL SELECT c.n, c.p1, c.summary, w.step + 1 FROM walk w JOIN commits c ON c.n = w.p1 WHERE w.step < 8) SELECT step::BIGINT AS step, n, summary FROM walk")
def first_parent_log(spark, sf):
    commits = V.commits(spark, sf)
    return diff.first_parents(commits, V.last_commit(commits), 8).select(*big("step"), "n", "summary")


@query(f"WITH RECURSIVE {_COMMITS}, e AS (SELECT n, p1 AS p FROM commits WHERE p1 IS NOT NULL UNION ALL SELECT n, p2 FROM commits WHERE p2 IS NOT NULL), a AS (SELECT max(n) AS n FROM commits UNION SELECT p FROM a JOIN e ON e.n = a.n), b AS (SELECT max(n) - 3 AS n FROM commits UNION SELECT p FROM b JOIN e ON e.n = b.n) SELECT max(a.n)::BIGINT AS base FROM a JOIN b ON a.n = b.n")
def merge_base(spark, sf):
    commits = V.commits(spark, sf)
    last = V.last_commit(commits)
    return diff.merge_base(commits, last, last - 3)


# --- code ----------------------------------------------------------------------------------------


def _sources(spark, sf):
    """``part`` rows rendered as small source files in turn of language."""
    n = F.col("p_partkey")
    name = F.regexp_replace(F.lower("p_name"), "[^a-z]", "_")
    rust = F.concat(F.lit("use std::io;\nuse std::fs;\n\n/// doc\n#[test]\nfn t_"), name, F.lit("() {\n    if a && b { return; }\n}\n\nimpl S {\n    const A: u8 = 1;\n    fn m(&self) {}\n}\n"))
    python = F.concat(F.lit("import os\n\n\ndef f_"), name, F.lit("(x):\n    for i in x:\n        if i and x:\n            return i\n\n    # note\n    return None\n"))
    script = F.concat(F.lit("import x from 'y';\nexport function f_"), name, F.lit("(a) { while (a) { a--; } }\nconst b = 1;\n"))
    shell = F.concat(F.lit("#!/bin/sh\nf_"), name, F.lit("() {\n  echo hi\n}\nls -l\n"))
    made = [("rs", "Rust", rust), ("py", "Python", python), ("js", "JavaScript", script), ("sh", "Shell", shell)]
    rows = F.element_at(F.array(*(F.struct(F.lit(x).alias("x"), F.lit(language).alias("language"), text.alias("content")) for x, language, text in made)), (n % 4 + 1).cast("int"))
    return V.table(spark, sf, "part").select(n.alias("n"), rows.alias("r")).select(F.concat(F.lit("src/p"), F.col("n").cast("string"), F.lit("."), F.col("r.x")).alias("path"), "r.language", "r.content")


@query()
def code_split(spark, sf):
    from marginalia.operators import code

    return code.blocks(_sources(spark, sf)).select("path", *big("ord"), "kind", "hash", F.array_join("tags", ",").alias("tags"), *big("start_line", "end_line"))


@query()
def complexity(spark, sf):
    from marginalia.operators import code

    return code.blocks(_sources(spark, sf)).groupBy("language").agg(F.sum("complexity").alias("complexity"), F.max("complexity").cast("bigint").alias("most"))


_BROKEN = f"""WITH n AS (SELECT 'src/b' || p_partkey || '.py' AS path, regexp_replace(lower(p_name), '[^a-z]', '_', 'g') AS name FROM part),
b AS (SELECT path, unnest([{{'ord': 0, 'kind': 'CodeParagraph', 'c': 'def (' || name || ':', 's': 0, 'e': 1}}, {{'ord': 1, 'kind': 'gap', 'c': {S.NL} || {S.NL}, 's': 0, 'e': 2}},
  {{'ord': 2, 'kind': 'comment', 'c': '# ' || name, 's': 2, 'e': 3}}, {{'ord': 3, 'kind': 'gap', 'c': {S.NL} || {S.NL}, 's': 2, 'e': 4}}, {{'ord': 4, 'kind': 'CodeParagraph', 'c': 'x = 1' || {S.NL}, 's': 4, 'e': 5}}]) AS x FROM n)
SELECT path, x.ord::BIGINT AS ord, x.kind AS kind, {S.content_hash('x.c')} AS hash, x.s::BIGINT AS start_line, x.e::BIGINT AS end_line FROM b"""


def _broken_blocks(spark, sf, as_text):
    from marginalia.sources import directory

    name = F.regexp_replace(F.lower("p_name"), "[^a-z]", "_")
    text = F.concat(F.lit("def ("), name, F.lit(":\n\n# "), name, F.lit("\n\nx = 1\n"))
    files = V.table(spark, sf, "part").select(F.concat(F.lit("src/b"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"), F.lit("Python").alias("language"), F.lit("Text").alias("type"), text.alias("content"))
    return directory.blocks(files, as_text).select("path", *big("ord"), "kind", "hash", *big("start_line", "end_line"))


@query(_BROKEN)
def code_fallback(spark, sf):
    """``part`` rows as Python files that no parser takes: they keep their paragraphs."""
    return _broken_blocks(spark, sf, False)


@query(_BROKEN.replace("CodeParagraph", "Paragraph").replace("'comment'", "'Paragraph'"))
def head_fallback(spark, sf):
    """The same files as the blobs of a revision: their paragraphs are plain text."""
    return _broken_blocks(spark, sf, True)


#: Impls of several lengths, so that some enclose others.
_DEEP = "deep AS (SELECT path, ord, kind, rtrim(content, chr(10)) AS label, start_line, CASE WHEN kind = 'impl' THEN end_line + 10 + 30 * (ord % 4) ELSE end_line END AS end_line FROM code)"


@query(f"""WITH RECURSIVE {_CODE}, {_DEEP}, up AS (
  SELECT b.path, b.ord, b.kind, b.label, o.ord AS above, row_number() OVER (PARTITION BY b.path, b.ord ORDER BY o.start_line DESC NULLS LAST, o.end_line DESC, o.ord DESC) AS r
  FROM deep b LEFT JOIN deep o ON o.path = b.path AND o.kind IN ('impl', 'interface') AND (o.start_line, o.end_line, o.ord) < (b.start_line, b.end_line, b.ord) AND b.start_line >= o.start_line AND b.end_line <= o.end_line
),
near AS (SELECT * FROM up WHERE r = 1),
walk AS (
  SELECT path, ord, above, CASE WHEN kind IN ('impl', 'interface') THEN label || ' -> ' ELSE '' END || label AS crumbs, 0 AS depth FROM near
  UNION ALL SELECT w.path, w.ord, n.above, n.label || ' -> ' || w.crumbs, w.depth + 1 FROM walk w JOIN near n ON n.path = w.path AND n.ord = w.above
)
SELECT path, ord, 'File (' || path || ') -> ' || crumbs AS crumbs, depth FROM walk WHERE above IS NULL""")
def breadcrumbs(spark, sf):
    """The chain of enclosing blocks, and how many they are."""
    blocks = _code(spark, sf).withColumn("end_line", F.when(F.col("kind") == "impl", F.col("end_line") + 10 + 30 * (F.col("ord") % 4)).otherwise(F.col("end_line"))).withColumn("hash", F.sha2("content", 256))
    depths = tree.block_nodes(blocks).select(F.col("path").alias("p"), F.col("ord").alias("o"), (F.col("depth") - F.size(F.split("path", "/")) - 1).cast("bigint").alias("depth"))
    return tree.breadcrumbs(blocks).join(depths, (F.col("path") == F.col("p")) & (F.col("ord") == F.col("o"))).select("path", *big("ord"), "crumbs", "depth")


@query(f"WITH {S.FILES_DOC}, {S.TREE}, c AS (SELECT path, CASE WHEN kind = 'file' THEN 'file:' ELSE 'dir:' END || string_split(path, '/')[-1] AS key, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS parent FROM nodes WHERE path <> '') SELECT parent, arg_min(path, key) AS path FROM c GROUP BY parent")
def first_children(spark, sf):
    return tree.first_children(tree.nodes(_doc_files(spark, sf)))


_SOURCE_LINES = "SELECT path, line - 1 AS line, parts[line] AS text FROM (SELECT path, parts, unnest(generate_series(1, len(parts))) AS line FROM (SELECT path, string_split(content, chr(10)) AS parts FROM files_conv))"


@query(rf"WITH {S.FILES_CONV}, {S.BLOCKS}, lines AS ({_SOURCE_LINES}) SELECT s.path, s.ord::BIGINT AS ord, l.line::BIGINT AS line, sha256(l.text) AS text, l.line >= s.start_line AND l.line < s.end_line AS inside FROM spans s JOIN lines l ON l.path = s.path AND l.line >= s.start_line - 2 AND l.line < s.end_line + 2 WHERE s.kind = 'Paragraph'")
def context_window(spark, sf):
    files = V.conversation_files(spark, sf)
    found = tree.context_lines(files, split.paragraphs(files).where("kind = 'Paragraph'"), 2)
    return found.select("path", *big("ord", "line"), F.sha2("text", 256).alias("text"), "inside")


@query()
def function_subsplit(spark, sf):
    from marginalia.operators import code, subsplit

    functions = code.blocks(_sources(spark, sf)).where(F.col("kind").isin("function", "export"))
    return subsplit.sub_blocks(functions).select("path", *big("parent_ord", "sub_ord"), "kind", "hash")


@query()
def md_elements(spark, sf):
    from marginalia.operators import subsplit

    sections = split.sections(_markdown(spark, sf)).withColumn("tags", F.array().cast("array<string>")).withColumn("complexity", F.lit(0))
    return subsplit.sub_blocks(sections).select("path", *big("parent_ord", "sub_ord"), "kind", "hash")


# --- showing and acting --------------------------------------------------------------------------

_SHOWN = "CASE p_partkey % 3 WHEN 0 THEN 'pub fn ' || replace(p_name, ' ', '_') || '(a)' WHEN 1 THEN 'class  ' || p_type ELSE p_name END"


@query(f"WITH s AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'function' WHEN 1 THEN 'class' ELSE 'code' END AS kind, {_SHOWN} AS c FROM part) SELECT p_partkey, coalesce(CASE kind WHEN 'function' THEN nullif(regexp_extract(c, '\\bfn\\b\\s+([A-Za-z0-9_]+)', 1), '') WHEN 'class' THEN nullif(regexp_extract(c, '\\bclass\\b\\s+([A-Za-z0-9_]+)', 1), '') END, 'L4-L' || (p_partkey % 7 + 4)) AS name FROM s")
def display_names(spark, sf):
    from marginalia.functions import display

    n = F.col("p_partkey")
    rows = V.table(spark, sf, "part").select("p_partkey", F.when(n % 3 == 0, "function").when(n % 3 == 1, "class").otherwise("code").alias("kind"), F.expr(_SHOWN).alias("c"))
    return rows.select("p_partkey", display.display_name(F.col("kind"), F.col("c"), F.lit(3), n % 7 + 4).alias("name"))


@query(f"WITH {_CODE}, k AS (SELECT path, list(kind ORDER BY ord) AS l FROM code GROUP BY path), e AS (SELECT path, CASE WHEN len(l) > 4 THEN l[1:2] || ['...'] || l[len(l) - 1:len(l)] ELSE l END AS l FROM k) SELECT path, array_to_string(list_transform(l, lambda x, i: CASE WHEN i = len(l) THEN '└─ ' ELSE '├─ ' END || x), '|') AS shown FROM e")
def elided_labels(spark, sf):
    from marginalia.functions import display

    files = _code(spark, sf).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("ord", "kind")))["kind"].alias("labels"))
    return files.select("path", F.array_join(display.elided(F.col("labels")), "|").alias("shown"))


@query(r"WITH t AS (SELECT p_partkey, regexp_extract_all('let ' || p_name || ' = ' || p_size || ';', '[\p{L}\p{N}_]+|.') AS w FROM part) SELECT p_partkey, len(w)::BIGINT AS n_tokens, len(list_filter(w, lambda x: x = 'let'))::BIGINT AS n_keywords, len(list_filter(w, lambda x: regexp_full_match(x, '[0-9]+')))::BIGINT AS n_numbers FROM t")
def line_tokens(spark, sf):
    from marginalia.functions import display

    line = F.concat(F.lit("let "), F.col("p_name"), F.lit(" = "), F.col("p_size").cast("string"), F.lit(";"))
    rows = V.table(spark, sf, "part").select("p_partkey", display.tokens(line).alias("t"))
    of = lambda kind: F.size(F.filter("t", lambda x: x["kind"] == kind)).cast("bigint")
    return rows.select("p_partkey", F.size("t").cast("bigint").alias("n_tokens"), of("keyword").alias("n_keywords"), of("number").alias("n_numbers"))


@query(f"{_REVIEW} SELECT path, ord, sha256('  [Unreviewed] L' || k.start_line || '-L' || (k.start_line + {S.newlines('content')} + CASE WHEN suffix(content, {S.NL}) THEN 0 ELSE 1 END) || ' (Hash: ' || k.hash || ') Kind: ' || k.kind || {S.NL} || '    > ' || trim(split_part(content, {S.NL}, 1))) AS listing_sha256 FROM left_over k JOIN blocks USING (path, ord)")
def text_listing(spark, sf):
    from marginalia.functions import display

    row = display.listing(F.col("start_line"), F.col("end_line"), F.col("hash"), F.col("kind"), F.col("content"))
    return _review(spark, sf).select("path", *big("ord"), F.sha2(row, 256).alias("listing_sha256"))


@query(f"{_REVIEW} SELECT path AS file, ord, kind, hash FROM left_over")
def review_queue(spark, sf):
    return _review(spark, sf).select(F.col("path").alias("file"), *big("ord"), "kind", "hash")


@query(f"WITH {_CODE}, h AS (SELECT path, count(*) FILTER (kind IN ('function', 'method') AND contains(content, 'a')) AS own, count(*) FILTER (contains(content, 'a')) AS every FROM code GROUP BY path) SELECT path, CASE WHEN own > 0 THEN own ELSE every END AS n FROM h")
def fuzzy_find(spark, sf):
    from marginalia.operators import actions

    return actions.fuzzy_counts(_code(spark, sf), F.lit("a"))


@query(f"WITH {S.FILES_DOC}, {S.TREE} SELECT CASE WHEN kind = 'root' THEN 'root' ELSE hash END AS fingerprint, 'review' AS \"check\", 'approved' AS verdict, nullif(path, '') AS path_hint FROM nodes WHERE kind <> 'file'")
def session_actions(spark, sf):
    from marginalia.operators import actions

    nodes = tree.nodes(_doc_files(spark, sf)).where("kind <> 'file'")
    return actions.actions(nodes, "approved").select("fingerprint", "check", "verdict", "path_hint")


@query(f"WITH {S.FILES_DOC}, s AS (SELECT path, dir FROM files_doc WHERE NOT starts_with(path, 'en/')) SELECT DISTINCT path FROM (SELECT path FROM s UNION ALL SELECT dir FROM s UNION ALL SELECT string_split(dir, '/')[1] FROM s UNION ALL SELECT '' FROM s)")
def visible_nodes(spark, sf):
    from marginalia.operators import actions

    return actions.visible(actions.applied(_doc_files(spark, sf), "en", "rejected"))


def _view(kind: str, name: str, path: str, digest: str, children: str) -> str:
    return f"""'{{"type":"{kind}","name":"' || {name} || '","path":"' || {path} || '","hash":"' || {digest} || '","children":[' || {children} || ']}}'"""


@query(f"""WITH {S.FILES_DOC}, {S.TREE},
leaf AS (SELECT dir AS parent, 'file:' || name AS key, {_view('file', 'name', 'path', 'hash', "''")} AS view FROM tree1),
inner_ AS (SELECT t.parent, 'dir:' || t.name AS key, {_view('directory', 't.name', 't.path', 't.hash', "string_agg(f.view, ',' ORDER BY f.key)")} AS view FROM tree2 t JOIN leaf f ON f.parent = t.path GROUP BY t.parent, t.name, t.path, t.hash),
outer_ AS (SELECT 'dir:' || t.path AS key, {_view('directory', 't.path', 't.path', 't.hash', "string_agg(f.view, ',' ORDER BY f.key)")} AS view FROM tree3 t JOIN inner_ f ON f.parent = t.path GROUP BY t.path, t.hash)
SELECT '' AS path, sha256({_view('root', "''", "''", 'n.hash', "string_agg(f.view, ',' ORDER BY f.key)")}) AS view_sha256 FROM outer_ f, nodes n WHERE n.kind = 'root' GROUP BY n.hash""")
def tree_json(spark, sf):
    from marginalia.operators import actions

    return actions.nested_json(tree.nodes(_doc_files(spark, sf))).select("path", F.sha2("view", 256).alias("view_sha256"))


@query(f"""WITH {S.FILES_DOC}, {S.TREE},
every AS (
  SELECT 'file' AS kind, dir AS parent, name, path, hash, 'dir:' || replace(dir, '/', '/dir:') || '/file:' || name AS key FROM tree1
  UNION ALL SELECT 'directory', parent, name, path, hash, 'dir:' || parent || '/dir:' || name FROM tree2
  UNION ALL SELECT 'directory', '', path, path, hash, 'dir:' || path FROM tree3
  UNION ALL SELECT 'root', NULL, '', '', hash, '' FROM nodes WHERE kind = 'root'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY key) AS place FROM every)
SELECT key, CASE WHEN place = 1 THEN '' ELSE ',' END || {_view("' || kind || '", 'name', 'path', 'hash', "''").removesuffix(" || ']}'")} || CASE WHEN kind = 'file' THEN ']}}' ELSE '' END AS piece FROM ranked
UNION ALL SELECT CASE WHEN key = '' THEN '~' ELSE key || '/~' END, ']}}' FROM ranked WHERE kind <> 'file'""")
def tree_json_pieces(spark, sf):
    from marginalia.operators import actions

    return actions.view_pieces(tree.nodes(_doc_files(spark, sf))).select(F.array_join("key", "/").alias("key"), "piece")
