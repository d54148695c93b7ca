"""Chat formatting from event logs: fold streamed events into messages, then render them.

A log has one row per event: `conv_id`, `seq` (its order within the conversation), `turn`, `kind`,
`role` and `text`. Kinds:

start       opens the message of `turn` with `role`; any text so far is dropped
delta       appends `text` to the message of `turn`
edit        replaces the text of `turn`
regenerate  empties the message of `turn` and drops all later turns, as a user does who asks again

The log is partitioned by conversation and sorted by sequence; one pass folds it. Rendering marks
turns with control strings and escapes those strings inside texts, so the output can be parsed back.

The rendered form of a turn is `### {Role}: {text} </turn>` and a newline. Inside a text every
backslash becomes `\\\\`, and a backslash goes before each `###` and each `</turn>`; a reader undoes a backslash by
taking the next character as it is. As an unescaped `</turn>` cannot occur in a text, the end of a turn is
unambiguous, and so is its start.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import table

OPEN, CLOSE = "### ", " </turn>\n"
LOSS_ROLE = "assistant"
EVENTS = "conv_id long, seq long, turn long, kind string, role string, text string"
TURNS = "conv_id long, turn long, role string, text string, rendered string, loss_start long, loss_end long"


def escape(text: str, more: str = "") -> str:
    """Backslashes before backslashes, `###` and `</turn>` (and the characters of `more`)."""
    return re.sub(rf"\\|###|</turn>{'|[' + more + ']' if more else ''}", lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


#: How known roles are shown; any other role is shown as `role=` and its escaped name.
LABELS = {"system": "System", "user": "User", "assistant": "Assistant"}
ROLES = {v: k for k, v in LABELS.items()}


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn's rendered form and the code points, from and to, of its text under the loss mask."""
    head = f"{OPEN}{LABELS.get(role) or 'role=' + escape(role, ':')}: "
    body = escape(text)
    start, end = (len(head), len(head) + len(body)) if role == LOSS_ROLE else (0, 0)
    return head + body + CLOSE, start, end


_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\]|\\.)*?) </turn>\n", re.S)


def parse_turns(rendered: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a rendered conversation: inverse of `render_turn`."""
    out, at = [], 0
    while at < len(rendered):
        m = _TURN.match(rendered, at)
        if not m:
            raise ValueError(f"not a turn at {at}")
        out.append((ROLES.get(m[1]) or unescape(m[1].removeprefix("role=")), unescape(m[2])))
        at = m.end()
    return out


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fold sorted events into messages, one conversation at a time; messages leave as they are complete."""
    conv, state = None, {}
    seen = False

    def done() -> list[tuple]:
        return [(conv, k, role, text := "".join(parts), *render_turn(role, text)) for k, (role, parts) in sorted(state.items(), key=lambda x: (x[0] is None, x[0] or 0))]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) if rows else [()] * 7
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in TURNS.split(", ")])

    for batch in batches:
        rows: list[tuple] = []
        for c, turn, kind, role, text in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("conv_id", "turn", "kind", "role", "text")), strict=True):
            if not seen or c != conv:
                if seen:
                    rows += done()
                conv, state, seen = c, {}, True
            if kind == "start":
                state[turn] = (role or "", [])
            elif kind == "delta":
                state.setdefault(turn, (role or "", []))[1].append(text or "")
            elif kind == "edit":
                state[turn] = (state.get(turn, (role or "", []))[0], [text or ""])
            elif kind == "regenerate":
                for later in [t for t in state if (t or 0) > (turn or 0)]:
                    del state[later]
                state[turn] = (state.get(turn, (role or "", []))[0], [])
        if rows:
            yield out(rows)
    if seen:
        yield out(done())


def fold_and_render(events: DataFrame) -> DataFrame:
    """One row per final message: role, text, rendered form and its loss span, sorted by conversation and turn.

    Events are dealt by conversation and sorted by sequence (ties: turn, kind, text, so that repeated
    rows give a defined result); the pass holds the messages of one conversation at a time. Null texts
    and roles count as empty; a delta without a start opens a message; an unknown kind has no effect.
    An empty log gives no rows. Columns that are not events' are dropped.
    """
    cols = [c.split()[0] for c in EVENTS.split(", ")]
    log = events.select(*(F.col(c).cast(t) for c, t in (x.split() for x in EVENTS.split(", "))))
    kind_order = F.when(F.col("kind") == "start", 0).when(F.col("kind") == "delta", 1).otherwise(2)
    dealt = log.repartition("conv_id").withColumn("__k", kind_order).sortWithinPartitions("conv_id", "seq", "turn", "__k", "role", "text").select(*cols)
    return dealt.mapInArrow(_turns, TURNS)


def as_events(messages: DataFrame, chunk: int = 200) -> DataFrame:
    """A log that ends in the given messages, as a chat service would have streamed them.

    Every message starts, then streams its text in deltas of `chunk` characters. Before that, an
    assistant message is first streamed wrongly and regenerated; a user message is first sent with a
    slip and edited. Rows of one (conversation, turn) are numbered apart, so that repeated rows stay
    messages of their own. Null roles and texts are empty; messages with a null conversation are one conversation, and a
    null turn comes first; a text of any length is cut in one pass; no messages give no events.
    """
    m = messages.select("conv_id", F.col("turn").alias("__t"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # one pass over a text, whatever its length; an empty one is one empty delta
    parts = F.when(F.col("text") == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0)))
    # seq leaves room for the events of each turn; equal turns are told apart by their place
    place = Window.partitionBy("conv_id").orderBy(F.col("__t").asc_nulls_first(), "role", "text")
    m = m.withColumn("turn", F.row_number().over(place).cast("long"))
    ev = lambda kind, role, text: F.struct(F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"))
    none = F.lit(None).cast("string")
    first = F.when(
        F.col("role") == LOSS_ROLE, F.array(ev("start", F.col("role"), none), ev("delta", none, F.lit("Let me")), ev("delta", none, F.lit(" see.")), ev("regenerate", none, none))
    ).when(F.col("role") == "user", F.array(ev("start", F.col("role"), none), ev("delta", none, F.concat(F.lit("teh "), F.substring("text", 1, 20))), ev("edit", none, F.lit(""))))
    first = first.otherwise(F.array(ev("start", F.col("role"), none)))
    deltas = F.transform(parts, lambda x: ev("delta", none, x))
    log = m.select("conv_id", "turn", F.posexplode(F.concat(first, deltas)).alias("__p", "e"))
    return log.select("conv_id", (F.col("turn") * (1 << 32) + F.col("__p")).alias("seq"), "turn", "e.kind", "e.role", "e.text")


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Read rendered turns back: hashes run over a conversation, whatever its length."""
    names = [x.split()[0] for x in DIGEST.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    class One:
        def __init__(self, conv):
            self.conv, self.n, self.all, self.loss, self.chars, self.loss_chars = conv, 0, hashlib.sha256(), hashlib.sha256(), 0, 0

        def add(self, rendered, a, b):
            ((role, text),) = parse_turns(rendered)
            self.n += 1
            self.all.update(f"{role}\n{text}\n".encode())
            under = unescape(rendered[a:b])
            self.loss.update(under.encode())
            self.loss_chars += len(under)
            self.chars += len(rendered)

        def row(self):
            return (self.conv, self.n, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars)

    one = None
    for batch in batches:
        rows = []
        for conv, text, a, b in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("conv_id", "rendered", "loss_start", "loss_end")), strict=True):
            if one is None or conv != one.conv:
                rows += [one.row()] if one else []
                one = One(conv)
            one.add(text, a, b)
        if rows:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
    if one:
        yield pa.record_batch([pa.array([c], k) for c, k in zip(one.row(), kinds, strict=True)], names=names)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one with control strings, folded from their event logs, rendered and read back."""
    tricky = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    messages = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return fold_and_render(as_events(messages)).mapInArrow(_digests, DIGEST)


OP10_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, CASE role WHEN 'system' THEN 6 WHEN 'user' THEN 4 WHEN 'assistant' THEN 9
    ELSE 5 + length(replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ':', '\:')) END AS label,
  length(replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>')) AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + label + 2 + n + 9) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

QUERIES = {"op10_chat_format": op10_chat_format}
ORACLE = {"op10_chat_format": OP10_SQL}
