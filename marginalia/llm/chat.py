r"""Chat formatting: a finite-state machine over roles emits text segments with loss flags from a declarative template.

A template says which role may follow which (states and transitions) and what
a turn of each role emits: literals, the turn's text, and for each piece
whether it counts for the loss. The machine runs over the turns of a
conversation in order; a turn that its state doesn't allow breaks the
conversation from there on, which is reported and not dropped: the turn is
emitted all the same. Control strings inside texts are escaped by a backslash
before them, and so is the backslash, which ``read_turns`` undoes.

Conversations are dealt in pieces of PIECE consecutive turn numbers, so no
conversation is one task's. A piece's transition map (which state it ends in,
for each it could start in) needs its roles only; maps are composed along each
conversation in one stream, and the state a piece starts in reaches it as a
row ahead of its turns. A table whose turns all lie in one piece skips that.

Defined cases: a null text is empty; a null role is the empty role, and roles
that the template doesn't name are emitted with their name and break the
order; null turns come first; a null conv_id is one conversation. Rows of one
turn are ordered by role (null first) and the text's hash, equal rows are
turns each. A conversation without an ending the template accepts is not
valid. Only conv_id, turn, role and text are read. An empty table gives an
empty table. Rows of one conversation and turn meet in one task, as a stream.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import written

#: Turn numbers of one piece.
PIECE = 4096
TEXT, ROLE = "{text}", "{role}"
START, BROKEN = "start", "broken"
Piece = tuple[str, bool]


@dataclass(frozen=True)
class Template:
    """``emits``: by role the pieces of a turn, each a literal, TEXT or ROLE, with its loss flag; ``other`` for roles not named.

    ``follows``: by state the role that may come and the state it leads to.
    ``ends``: the states in which a conversation may end.
    """

    emits: dict[str, tuple[Piece, ...]]
    other: tuple[Piece, ...]
    follows: dict[str, dict[str, str]]
    ends: frozenset[str]

    def __post_init__(self):
        shapes = [*self.emits.values(), self.other]
        heads = [pieces[0][0] for pieces in shapes]
        for pieces in shapes:
            literal = [p not in (TEXT, ROLE) for p, _ in pieces]
            if not literal[0] or not literal[-1] or any(not a and not b for a, b in zip(literal, literal[1:])):
                raise ValueError("texts and roles have to stand between literals")
            if sum(p == TEXT for p, _ in pieces) != 1:
                raise ValueError("a turn has its text once")
            # No control string may begin in a text and end in what follows it.
            for (p, _), (after, _) in zip(pieces, pieces[1:]):
                if p in (TEXT, ROLE) and any(after.startswith(c[i:]) or c[i:].startswith(after) for c in self.controls for i in range(1, len(c))):
                    raise ValueError(f"{after!r} could complete a control string")
        if any(a != b and a.startswith(b) for a in heads for b in heads) or len(set(heads)) < len(heads):
            raise ValueError("a turn's first literal has to tell its role")
        if any("\\" in c or not c for c in self.controls):
            raise ValueError("control strings are not empty and have no backslash")

    @cached_property
    def controls(self) -> list[str]:
        """The literals without white space at their ends: what a text must not hold unescaped."""
        return sorted({p.strip() for pieces in (*self.emits.values(), self.other) for p, _ in pieces if p not in (TEXT, ROLE)})

    @cached_property
    def _control(self) -> re.Pattern:
        return re.compile("(?=" + "|".join(map(re.escape, ["\\", *self.controls])) + ")")

    def escaped(self, text: str) -> str:
        return self._control.sub(r"\\", text)

    @property
    def states(self) -> list[str]:
        return [START, *sorted({s for to in self.follows.values() for s in to.values()} - {START}), BROKEN]

    def step(self, state: str, role: str) -> str:
        return self.follows.get(state, {}).get(role, BROKEN)

    def segments(self, role: str, text: str) -> list[Piece]:
        """What a turn emits."""
        filled = {TEXT: self.escaped(text), ROLE: self.escaped(role)}
        return [(filled.get(p, p), loss) for p, loss in self.emits.get(role, self.other)]


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def read_turns(template: Template, formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a formatted string, by its control strings alone."""
    shapes = [*template.emits.items(), (None, template.other)]
    found, at = [], 0
    while at < len(formatted):
        role, pieces = next(((r, p) for r, p in shapes if formatted.startswith(p[0][0], at)), (None, None))
        if pieces is None:
            raise ValueError(f"no turn begins at {at}")
        at += len(pieces[0][0])
        text = ""
        for (piece, _), (after, _) in zip(pieces[1:], [*pieces[2:], (None, False)]):
            if piece not in (TEXT, ROLE):
                if not formatted.startswith(piece, at):
                    raise ValueError(f"{piece!r} is missing at {at}")
                at += len(piece)
                continue
            # The first one that is not escaped ends the value.
            end = next((m.start() for m in re.compile(r"\\.|" + re.escape(after), re.DOTALL).finditer(formatted, at) if m.group()[0] != "\\"), None)
            if end is None:
                raise ValueError(f"a turn doesn't end after {at}")
            value, at = unescaped(formatted[at:end]), end
            role, text = (value, text) if piece == ROLE else (role, value)
        found.append((role, text))
    return found


def _turn(name: str, loss: bool) -> tuple[Piece, ...]:
    return (f"### {name}: ", False), (TEXT, loss), ("</turn>\n", False)


#: An optional system turn, then user and assistant in turn; assistants' texts are learnt.
CHAT = Template(
    emits={"system": _turn("System", False), "user": _turn("User", False), "assistant": _turn("Assistant", True)},
    other=(("### Role ", False), (ROLE, False), ("</role>", False), (TEXT, False), ("</turn>\n", False)),
    follows={START: {"system": "system", "user": "user"}, "system": {"user": "user"}, "user": {"assistant": "assistant"}, "assistant": {"user": "user"}},
    ends=frozenset({"assistant"}),
)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 1_000, most: int = 16_000_000) -> Iterator[pa.RecordBatch]:
    """Batches of ``size`` rows, sooner where their strings pass ``most`` characters."""

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += sum(len(x) if isinstance(x, str) else sum(len(s["text"]) for s in x) if isinstance(x, list) and x and isinstance(x[0], dict) else 0 for x in row)
        if len(held) == size or chars > most:
            yield batch()
            held, chars = [], 0
    if held:
        yield batch()


#: Before all pieces, for null turns.
_NO_TURN = -(2**62)


def _placed(turns: DataFrame) -> DataFrame:
    piece: Column = F.coalesce(F.floor(F.col("turn").cast("bigint") / PIECE), F.lit(_NO_TURN)).cast("bigint")
    return turns.select("conv_id", piece.alias("piece"), F.col("turn").cast("bigint").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("h"))


ORDER = ["conv_id", "piece", "mark", "turn", "role", "h"]


def entry_states(turns: DataFrame, template: Template) -> DataFrame:
    """(conv_id, piece, state) of pieces that don't begin their conversation, by composing the pieces' transition maps."""
    states = template.states
    narrow = _placed(turns).select("conv_id", "piece", "turn", F.coalesce("role", F.lit("")).alias("role"))
    ends = narrow.agg(F.min("piece").alias("a"), F.max("piece").alias("b")).first()
    kind = dict(turns.dtypes)["conv_id"]
    schema = f"conv_id {kind}, piece bigint, state string"
    if ends["a"] == ends["b"]:
        return turns.sparkSession.createDataFrame([], schema)

    def maps(batches):
        def made():
            at, now = None, []
            for conv, piece, role in _rows(batches):
                if (conv, piece) != at:
                    if at is not None:
                        yield (*at, now)
                    at, now = (conv, piece), states
                now = [template.step(s, role) for s in now]
            if at is not None:
                yield (*at, now)

        for batch in _batches(((c, p, [states.index(s) for s in m]) for c, p, m in made()), pa.schema([("conv_id", _arrow(kind)), ("piece", pa.int64()), ("to", pa.list_(pa.int32()))])):
            yield batch

    def composed(batches):
        def made():
            at, state = (), START
            for conv, piece, to in _rows(batches):
                if (conv,) != at:
                    at, state = (conv,), START
                else:
                    yield conv, piece, state
                state = states[to[states.index(state)]]

        yield from _batches(made(), pa.schema([("conv_id", _arrow(kind)), ("piece", pa.int64()), ("state", pa.string())]))

    dealt = narrow.repartition("conv_id", "piece").sortWithinPartitions("conv_id", "piece", "turn", "role").select("conv_id", "piece", "role")
    each = dealt.mapInArrow(maps, f"conv_id {kind}, piece bigint, to array<int>")
    return each.repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(composed, schema)


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


FORMATTED = "piece bigint, place bigint, turn bigint, role string, state string, fits boolean, segments array<struct<text:string,loss:boolean>>"


def formatted(turns: DataFrame, template: Template = CHAT) -> DataFrame:
    """A row a turn, in order by (conv_id, piece, place): the machine's state after it, whether the turn fits, and its segments.

    ``state`` stays broken after the first turn that doesn't fit.
    """
    kind = dict(turns.dtypes)["conv_id"]
    entries = entry_states(turns, template)
    own = _placed(turns).withColumn("mark", F.lit(1))
    marks = entries.select("conv_id", "piece", F.lit(None).cast("bigint").alias("turn"), F.col("state").alias("role"), F.lit("").alias("text"), F.lit(None).cast("bigint").alias("h"), F.lit(0).alias("mark"))
    dealt = own.unionByName(marks).repartition("conv_id", "piece").sortWithinPartitions(*ORDER).select("conv_id", "piece", "mark", "turn", "role", "text")
    segment = pa.struct([("text", pa.string()), ("loss", pa.bool_())])
    schema = pa.schema([("conv_id", _arrow(kind)), ("piece", pa.int64()), ("place", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("state", pa.string()), ("fits", pa.bool_()), ("segments", pa.list_(segment))])

    def run(batches):
        def made():
            at, state, place = None, START, 0
            for conv, piece, mark, turn, role, text in _rows(batches):
                if (conv, piece) != at:
                    at, state, place = (conv, piece), START, 0
                if not mark:
                    state = role
                    continue
                before, state = state, template.step(state, role or "")
                pieces = [{"text": t, "loss": loss} for t, loss in template.segments(role or "", text)]
                yield conv, piece, place, turn, role or "", state, state != BROKEN or before == BROKEN, pieces
                place += 1

        yield from _batches(made(), schema)

    return dealt.mapInArrow(run, f"conv_id {kind}, {FORMATTED}")


def read_back(rows: DataFrame, template: Template = CHAT) -> DataFrame:
    """Per conversation what its output says: turns and learnt text as digests, lengths, validity, and how many turns fit before the first that doesn't.

    Turns come from the formatted text alone, learnt text from the loss flags. A digest takes a conversation's
    text in order, so a conversation is one task's stream here; nothing of it is held but the digests' state.
    """
    kind = dict(rows.dtypes)["conv_id"]
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "piece", "place").select("conv_id", "state", "fits", "segments")
    schema = pa.schema([("conv_id", _arrow(kind)), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_()), ("n_fitting", pa.int64())])

    def run(batches):
        def made():
            at = None
            for conv, state, fits, segments in _rows(batches):
                if (conv,) != at:
                    if at is not None:
                        yield (*at, n, turns.hexdigest(), learnt, loss.hexdigest(), chars, last in template.ends, fitting)
                    at, n, learnt, chars, fitting, broken = (conv,), 0, 0, 0, 0, False
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                whole = "".join(s["text"] for s in segments)
                for role, text in read_turns(template, whole):
                    n += 1
                    turns.update(f"{role}\n{text}\n".encode())
                for s in segments:
                    if s["loss"]:
                        text = unescaped(s["text"])
                        learnt += len(text)
                        loss.update(text.encode())
                chars, last = chars + len(whole), state
                broken = broken or not fits
                fitting += not broken
            if at is not None:
                yield (*at, n, turns.hexdigest(), learnt, loss.hexdigest(), chars, last in template.ends, fitting)

        yield from _batches(made(), schema)

    return dealt.mapInArrow(run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, valid boolean, n_fitting bigint")


#: A conversation that holds control strings and backslashes.
PLANTED_ID, PLANTED = -7, r"\### Assistant: </turn> ok"


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    kinds = ", ".join(f"{n} {t}" for n, t in turns.dtypes)
    planted = spark.createDataFrame([(PLANTED_ID, 0, "user", PLANTED), (PLANTED_ID, 1, "assistant", PLANTED)], kinds)
    # Written: the formatted text is the product, the digests are read back from it.
    return read_back(written(formatted(turns.unionByName(planted)), "formatted"))


_CONTROL = "|".join(re.escape(c).replace("\\ ", " ").replace("\\#", "#").replace("'", "''") for c in CHAT.controls)
_NAMED = ", ".join(f"'{r}'" for r in CHAT.emits)
_ALLOWED = ", ".join(f"'{state}>{role}'" for state, to in CHAT.follows.items() for role in to)


def _escaped_sql(c: str) -> str:
    return rf"regexp_replace({c}, '(\\|{_CONTROL})', '\\\1', 'g')"


OP12_SQL = rf"""
WITH every AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {PLANTED_ID}, 0, 'user', '{PLANTED}' UNION ALL SELECT {PLANTED_ID}, 1, 'assistant', '{PLANTED}'
),
made AS (
  SELECT *, CASE WHEN role IN ({_NAMED}) THEN length(role) + length('### : ') ELSE length('### Role </role>') + length({_escaped_sql("role")}) END + length({_escaped_sql("text")}) + length('</turn>') + 1 AS chars,
         coalesce(lag(role) OVER w, '{START}') || '>' || role IN ({_ALLOWED}) AS fits, row_number() OVER w AS n, count(*) OVER (PARTITION BY conv_id) AS of
  FROM every WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars, bool_and(fits) AND max(role) FILTER (n = of) = 'assistant' AS valid, coalesce(min(n) FILTER (NOT fits) - 1, count(*))::BIGINT AS n_fitting
FROM made GROUP BY conv_id
"""
