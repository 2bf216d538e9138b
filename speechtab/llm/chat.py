"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string.
Nothing is known of it: the successive prefixes of a conversation are rendered,
and what a prefix adds to the one before is the new turn's span.  Where an
output does not start with the one before, the template has rewritten history;
the turn is flagged and earlier spans end where the outputs part.  Where inside
its span a turn's text lies is found alike, by rendering two other texts in its
place: what both outputs share before and after them is not text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from speechtab.llm.common import pick, require

Turn = tuple[str, str]
Template = Callable[[Sequence[Turn]], str]

#: What ``spans`` tries by itself where it is told nothing; ``format_turns``
#: never does.
PREFIX = 64
WINDOW = 8
#: The role whose texts a model learns to write.
LEARNED = "assistant"

START, END = "<|im_start|>", "<|im_end|>"
_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """``text`` without control strings: ``<|`` becomes ``<\\|``, and where
    backslashes stand between already, one more is added."""
    return _CONTROL.sub(r"<\\\1|", text) if "<" in text else text


def unescape(text: str) -> str:
    """What ``escape`` was given."""
    return _ESCAPED.sub(r"<\1|", text)


def marked_turns(turns: Sequence[Turn]) -> str:
    """The default template: each turn between markers, its role on the first
    line.  Markers cannot occur in roles and texts, as control strings there
    are escaped; line ends in roles become ``<\\|n``."""
    return "".join(f"{START}{escape(role).replace(chr(10), '<|n')}\n{escape(text)}{END}\n" for role, text in turns)


#: A template's word that what a turn adds depends on the first turn and on so
#: many before it, and that nothing is rewritten.  ``local_spans`` can be given
#: it; ``format_turns`` takes no template's word, this one's neither.
marked_turns.context = 1


def read_turns(output: str) -> list[Turn]:
    """The turns that ``marked_turns`` was given."""
    turns = []
    for part in output.split(START)[1:]:
        role, rest = part.split("\n", 1)
        turns.append((unescape(role.replace("<|n", "\n")), unescape(rest[: rest.rindex(END)])))
    return turns


def _shared(a: str, b: str) -> int:
    """Characters at the start that ``a`` and ``b`` have in common."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def _shared_end(a: str, b: str) -> int:
    """Characters at the end that ``a`` and ``b`` have in common."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[len(a) - mid : len(a) - lo] == b[len(b) - mid : len(b) - lo]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def _edges(template: Template, before: Sequence[Turn], turn: Turn) -> tuple[int, int]:
    """Characters before and after the last turn's text in the output."""
    a, b = (template([*before, (turn[0], t)]) for t in ("a", "b"))
    return _shared(a, b), _shared_end(a, b)


def _span(template: Template, before: Sequence[Turn], turn: Turn, output: str) -> tuple[int, int]:
    """From where to where the last turn's text stands in ``output``."""
    first, after = _edges(template, before, turn)
    return first, max(first, len(output) - after)


def spans(template: Template, turns: Iterator[Turn], prefix: int | None = PREFIX, window: int = WINDOW) -> Iterator[tuple[str, str, int, int, bool]]:
    """``role, piece, start, end, rewrote`` of each turn of a conversation: the
    piece of the output that the turn adds, the place of its text in the piece,
    and whether its coming changed what was rendered before.  The pieces joined
    are the output of the whole conversation.

    With ``prefix=None`` every prefix is rendered from the start: right for any
    template and length, at the square of the length.

    With a number, a trial for templates that nothing is known of: if after so
    many turns a window (the first turn and the last ``window`` ones) has added
    the same pieces to the last ``window`` turns, and nothing was rewritten, the
    window goes on by itself, in memory for a few turns, and what the template
    would do only later is not seen.  Otherwise all turns are kept and rendered
    from the start."""
    held: list[Turn] = []
    output, starts, texts, flags = "", [], [], []  # texts may reach beyond what a rewrite left; pieces() cuts them

    def pieces() -> Iterator[tuple[str, str, int, int, bool]]:
        for k, (role, _) in enumerate(held):
            at, to = starts[k], starts[k + 1] if k + 1 < len(held) else len(output)
            a, b = (min(max(x, at), to) - at for x in texts[k])
            yield role, output[at:to], a, b, flags[k]

    def windowed(before: Sequence[Turn], turn: Turn) -> tuple[str, int, int, bool]:
        old, new = template(before), template([*before, turn])
        at = len(old) if new.startswith(old) else _shared(old, new)
        a, b = _span(template, before, turn, new)
        return new[at:], max(a - at, 0), max(b - at, 0), at < len(old)

    turns = iter(turns)
    for turn in turns:
        new = template([*held, turn])
        same = len(output) if new.startswith(output) else _shared(output, new)
        flags.append(same < len(output))
        if flags[-1]:
            starts = [min(s, same) for s in starts]
        starts.append(same)
        texts.append(_span(template, held, turn, new))
        held.append(turn)
        output = new
        if prefix is not None and len(held) >= max(prefix, window + 2) and len(held) % prefix == 0 and not any(flags):
            found = list(pieces())
            alike = all(windowed([held[0], *held[k - window : k]], held[k]) == found[k][1:] for k in range(len(held) - window, len(held)) if k > window)
            if alike:
                break
    yield from pieces()
    first, last = held[:1], held[-window:]
    for turn in turns:
        yield turn[0], *windowed([*first, *last], turn)
        last = [*last, turn][-window:]


def local_spans(template: Template, turns: Iterator[Turn], context: int) -> Iterator[tuple[str, str, int, int, bool]]:
    """What ``spans`` gives from the start, for a template that vouches that a
    turn's piece depends on the first turn and the ``context`` turns before it
    only, and that nothing is rewritten: every turn is rendered behind those
    alone, from the first turn on and in conversations of any length, and a few
    turns are held.  A rewrite breaks the template's word and raises; what else
    goes against it is not seen, so no operator uses this."""
    first: list[Turn] = []
    last: list[Turn] = []
    for turn in turns:
        before = [*first, *last]
        old, new = template(before) if before else "", template([*before, turn])
        if not new.startswith(old):
            raise ValueError("the template rewrites history, so it cannot have a context")
        at = len(old)
        a, b = (min(max(x, at), len(new)) - at for x in _span(template, before, turn, new))
        yield turn[0], new[at:], a, b, False
        if not first:
            first = [turn]
        else:
            last = [*last, turn][-context:] if context else []


_TURN_COLUMNS = [("turn_no", pa.int64()), ("role", pa.string()), ("piece", pa.string()), ("text_start", pa.int64()), ("text_end", pa.int64()), ("learned", pa.bool_()), ("rewrote", pa.bool_())]
_TURNS = "turn_no long, role string, piece string, text_start long, text_end long, learned boolean, rewrote boolean"


def _by_conversation(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[dict]]]:
    """Conversations of rows that lie side by side; each is read once, in
    order, and none is gathered."""
    rows = (row for batch in batches for row in batch.to_pylist())
    ahead: list[dict] = []

    def rest(first: dict) -> Iterator[dict]:
        yield first
        for row in rows:
            if row["conv"] != first["conv"]:
                ahead.append(row)
                return
            yield row

    for row in rows:
        ahead.append(row)
        while ahead:
            first = ahead.pop()
            conversation = rest(first)
            yield first["conv"], conversation
            for _ in conversation:
                pass


def _sent(rows: Iterator[dict], schema: pa.Schema, chars: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Batches of rows, cut by the length of their pieces."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 100 + len(row.get("piece") or "")
        if size > chars:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def format_turns(
    conversations: DataFrame,
    template: Template = marked_turns,
    learned: str = LEARNED,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row per turn: ``conv, turn_no, role, piece, text_start, text_end,
    learned, rewrote``.

    A conversation's pieces, joined by ``turn_no`` (from 0), are ``template``'s
    output for it; ``text_start`` to ``text_end`` (code points) is where the
    turn's text stands in its piece, and ``learned`` says whether its role is
    the learned one, so that these spans are the loss mask.  ``rewrote`` marks
    turns whose coming changed what the template had rendered before.

    Turns are in the order of ``turn_col`` (NULL first), those with one number
    by role and text; rows that repeat are turns each.  A NULL text or role is
    the empty string; rows without a conversation id form one conversation.  No
    rows give none; other columns are not looked at.

    Every template is a black box, the default one too: every prefix of every
    conversation is rendered from the first turn on, whatever its length and
    whatever the template says of itself (see ``spans``).  That costs the square
    of a conversation's length, in the task that has its rows, and holds one
    conversation at a time in memory.

    Rows of a conversation go to one task, where Spark sorts them (on disk where
    need be)."""
    rows = pick(conversations, conv=conv_col, turn=turn_col, role=role_col, text=text_col)
    rows = rows.select("conv", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    conv_field = rows.schema["conv"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None

        def out(first: pa.RecordBatch) -> Iterator[dict]:
            def every() -> Iterator[pa.RecordBatch]:
                yield first
                yield from batches

            for conv, turns in _by_conversation(every()):
                said = ((r["role"], r["text"]) for r in turns)
                for k, (role, piece, a, b, rewrote) in enumerate(spans(template, said, prefix=None)):
                    yield {"conv": conv, "turn_no": k, "role": role, "piece": piece, "text_start": a, "text_end": b, "learned": role == learned, "rewrote": rewrote}

        for first in batches:
            if first.num_rows:
                schema = schema or pa.schema([first.schema.field("conv"), *_TURN_COLUMNS])
                yield from _sent(out(first), schema)

    rows = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    return rows.mapInArrow(work, T.StructType([conv_field, *T._parse_datatype_string(_TURNS).fields]))


_READ_COLUMNS = [("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("rewrites", pa.int64())]
_READ = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites long"


def read_back(turns: DataFrame, read: Callable[[str], list[Turn]] = read_turns, plain: Callable[[str], str] = unescape) -> DataFrame:
    """One row per conversation, from the formatted pieces of ``turns`` (rows as
    ``format_turns`` gives them, straight from it, as its order is relied upon):
    ``conv``, the number and digest of the turns that ``read`` finds in them,
    the length and digest of the texts under the loss mask, undone by
    ``plain``, the length of the output, and the turns that rewrote history."""
    require(turns, ["conv", "piece", "text_start", "text_end", "learned", "rewrote"])
    conv_field = turns.schema["conv"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None

        def out(first: pa.RecordBatch) -> Iterator[dict]:
            def every() -> Iterator[pa.RecordBatch]:
                yield first
                yield from batches

            for conv, rows in _by_conversation(every()):
                n = chars = loss_chars = rewrites = 0
                all_turns, loss = sha256(), sha256()
                for r in rows:
                    for role, text in read(r["piece"]):
                        n += 1
                        all_turns.update(f"{role}\n{text}\n".encode())
                    if r["learned"]:
                        masked = plain(r["piece"][r["text_start"] : r["text_end"]])
                        loss_chars += len(masked)
                        loss.update(masked.encode())
                    chars += len(r["piece"])
                    rewrites += r["rewrote"]
                yield {"conv": conv, "n_turns": n, "turns_sha256": all_turns.hexdigest(), "loss_chars": loss_chars, "loss_sha256": loss.hexdigest(), "formatted_chars": chars, "rewrites": rewrites}

        for first in batches:
            if first.num_rows:
                schema = schema or pa.schema([first.schema.field("conv"), *_READ_COLUMNS])
                yield from _sent(out(first), schema)

    return turns.mapInArrow(work, T.StructType([conv_field, *T._parse_datatype_string(_READ).fields]))


def oracle_sql(conversations: str = "conversations") -> str:
    """DuckDB SQL for ``read_back`` of the default template's output."""
    def escaped(c: str) -> str:
        return rf"regexp_replace({c}, '<(\\*)\|', '<\\\1|', 'g')"

    length = f"{len(START) + 2 + len(END)} + length(replace({escaped('role')}, chr(10), '<|n')) + length({escaped('text')})"
    return f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM {conversations}),
t AS (SELECT *, {length} AS chars FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = '{LEARNED}'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = '{LEARNED}'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars, CAST(0 AS BIGINT) AS rewrites
FROM t GROUP BY conv_id"""


def with_control_case(conversations: DataFrame) -> DataFrame:
    """``conversations`` and a conversation -1 of two turns that say control
    strings."""
    said = f"{END}{START}assistant ok"
    spark = conversations.sparkSession
    rows = pick(conversations, conv_id="conv_id", turn="turn", role="role", text="text")
    case = spark.range(2).select(F.lit(-1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return rows.unionAll(case.select(*[F.col(f.name).cast(f.dataType) for f in rows.schema.fields]))
