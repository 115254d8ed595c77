"""Chat formatting with a grammar round trip.

Every turn is rendered by a template, read back by a deterministic parser, and its conflicting
content is escaped until what the parser recovers is what went in. Turns render by themselves,
since each starts with an opening and ends with a closing control string, so the formatted
conversation is the concatenation of its turns and never has to be held in one value.

Defined results: a null text or role counts as empty; a null turn sorts first; turns of equal
number are ordered by role, then text; repeated rows are turns of their own; rows with a null
conversation id form one conversation; an empty table gives an empty result. Only the four named
columns are read, so further columns of any name do no harm.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Control strings of the template.
USER_OPEN, USER_CLOSE = "[INST] ", " [/INST]"
ASSISTANT_OPEN, ASSISTANT_CLOSE = "<s>", "</s>"
ROLE_OPEN, ROLE_TEXT, ROLE_CLOSE = "[ROLE]", "[TEXT]", "[/ROLE]"

# A control string whose first character is followed by any number of backslashes. With none it
# is live; the escaped form of a conflict has one more backslash than the text had.
CONTROL = re.compile(r"([<\[])(\\*)(/?s>|/?INST\]|/?ROLE\]|TEXT\])")
LIVE = re.compile(r"<s>|</s>|\[INST\]|\[/INST\]|\[ROLE\]|\[/ROLE\]|\[TEXT\]")

FORMATTED = "piece string, loss_start int, loss_end int, n_escapes int"
READ_BACK = (
    "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string,"
    " formatted_chars bigint"
)


class Unreadable(ValueError):
    """The formatted text does not follow the grammar."""


def render(role: str, text: str) -> tuple[str, int]:
    """The turn as formatted text, and where its own text starts."""
    if role == "user":
        return USER_OPEN + text + USER_CLOSE, len(USER_OPEN)
    if role == "assistant":
        return ASSISTANT_OPEN + text + ASSISTANT_CLOSE, len(ASSISTANT_OPEN)
    head = ROLE_OPEN + role + ROLE_TEXT
    return head + text + ROLE_CLOSE, len(head)


def escape(text: str) -> tuple[str, int]:
    return CONTROL.subn(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return CONTROL.sub(lambda m: m[1] + m[2][1:] + m[3], text)


def parse(text: str) -> Iterator[tuple[str, str, int, int]]:
    """Role, text and the span of the still escaped text of each turn of a formatted text."""
    at = 0

    def body(start: int, closing: str) -> int:
        found = LIVE.search(text, start)
        mark = closing.strip()
        end = found.end() - len(closing) if found else -1
        if not found or found[0] != mark or end < start or text[end : found.end()] != closing:
            raise Unreadable(f"no {mark} after position {start}")
        return end

    while at < len(text):
        if text.startswith(USER_OPEN, at):
            start = at + len(USER_OPEN)
            end = body(start, USER_CLOSE)
            role, at = "user", end + len(USER_CLOSE)
        elif text.startswith(ASSISTANT_OPEN, at):
            start = at + len(ASSISTANT_OPEN)
            end = body(start, ASSISTANT_CLOSE)
            role, at = "assistant", end + len(ASSISTANT_CLOSE)
        elif text.startswith(ROLE_OPEN, at):
            start = at + len(ROLE_OPEN)
            split = body(start, ROLE_TEXT)
            role, start = unescape(text[start:split]), split + len(ROLE_TEXT)
            end = body(start, ROLE_CLOSE)
            at = end + len(ROLE_CLOSE)
        else:
            raise Unreadable(f"no turn starts at position {at}")
        yield role, unescape(text[start:end]), start, end


def format_turn(role: str | None, text: str | None) -> tuple[str, int, int, int]:
    """Formatted turn, span of its text in it, and how many conflicts were escaped.

    The plain rendering is tried first; what the parser does not give back is escaped and tried
    again, until the turn it recovers equals the source.
    """
    source = (role or "", text or "")
    (tag, body), escapes = source, 0
    while True:
        piece, start = render(tag, body)
        try:
            turns = list(parse(piece))
        except Unreadable:
            turns = []
        if [t[:2] for t in turns] == [source]:
            return piece, start, start + len(body), escapes
        if escapes:
            raise Unreadable("escaping did not make the turn readable")
        (tag, in_tag), (body, in_body) = escape(tag), escape(body)
        escapes = in_tag + in_body
        if not escapes:
            raise Unreadable("a turn without conflicts was not recovered")


def format_turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per turn: ``conv_id, turn, role, text_order`` and its formatted ``piece``.

    ``loss_start`` and ``loss_end`` span the escaped text of an assistant's turn inside the
    piece and are null for others. No shuffle: each turn is formatted where it lies.
    """

    @F.arrow_udf(FORMATTED_TYPE)
    def run(roles: pa.Array, texts: pa.Array) -> pa.Array:
        rows = []
        for who, said in zip(roles.to_pylist(), texts.to_pylist()):
            piece, start, end, n = format_turn(who, said)
            own = who == "assistant"
            rows.append({"piece": piece, "loss_start": start if own else None, "loss_end": end if own else None, "n_escapes": n})
        return pa.array(rows, pa.struct([("piece", pa.string()), ("loss_start", pa.int32()), ("loss_end", pa.int32()), ("n_escapes", pa.int32())]))

    named = df.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # Of equal turn and role the text decides; escaping could change its order.
    return named.withColumn("f", run("role", "text")).select("conv_id", "turn", "role", F.col("text").alias("text_order"), "f.*")


FORMATTED_TYPE = "struct<" + FORMATTED.replace(" ", ":").replace(",:", ",") + ">"


def read_back(formatted: DataFrame) -> DataFrame:
    """Conversations recovered from the pieces of ``format_turns``, as counts and digests.

    A digest of a conversation runs over its turns one after another, so its rows meet in one
    task; they are sorted there by Spark, with spill, and streamed through a running digest.
    What is held is one batch of rows, however long a conversation is.
    """
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text_order")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None

        def close() -> dict:
            return {
                "conv_id": key, "n_turns": state[0], "turns_sha256": state[1].hexdigest(), "loss_chars": state[2],
                "loss_sha256": state[3].hexdigest(), "formatted_chars": state[4],
            }

        def batch(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(rows, READ_BACK_SCHEMA)

        for b in batches:
            done = []
            cols = [b.column(i).to_pylist() for i in range(b.num_columns)]
            for conv, piece, first, last in zip(*cols):
                if state is None or conv != key:
                    if state is not None:
                        done.append(close())
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, _, _ in parse(piece):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                if first is not None:
                    loss = unescape(piece[first:last])
                    state[2] += len(loss)
                    state[3].update(loss.encode())
                state[4] += len(piece)
            if done:
                yield batch(done)
        if state is not None:
            yield batch([close()])

    return ordered.select("conv_id", "piece", "loss_start", "loss_end").mapInArrow(fold, READ_BACK)


READ_BACK_SCHEMA = pa.schema(
    [
        ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
    ]
)


OP1_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *,
    length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|/?ROLE\]|TEXT\])', '\1\\\2\3', 'g'))
    + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 7
      ELSE 19 + length(regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\]|/?ROLE\]|TEXT\])', '\1\\\2\3', 'g')) END AS chars
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
