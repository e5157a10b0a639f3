"""Chat formatting by event-sourced reconstruction.

A log of events (conv_id, turn, seq, kind, role, text) is partitioned by
conversation, sorted by turn and sequence, and folded into final messages:
`message` and `start` open a message, `delta` adds to the open one, `edit` replaces
its text, `regenerate` empties it (its text, if any, is the new beginning).  A
`delta`, `edit` or `regenerate` without an open message of its turn opens one.

Messages are rendered one piece each:

    <|im_start|>ROLE\\nTEXT<|im_end|>\\n

The pieces of a conversation, in order, are its formatted text; each tells where
its loss mask (an assistant's text) begins and ends.  Inside texts and roles every
`<`, backslashes, `|` gets one backslash more, so control strings cannot occur;
reading takes it off again.  In roles a backslash or line feed is also escaped.

Tasks stream sorted rows and hold one message, however long a conversation is.

Null texts and roles count as empty, an unknown kind as `message`.  Rows of one
turn that are equal each give a message, in the order of seq, kind, role and text.
A null conv_id is a conversation of its own, a null turn comes first.  An empty
table gives an empty result.  Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

START, END, SPEAKER = "<|im_start|>", "<|im_end|>", "assistant"
KINDS = ("message", "start", "regenerate", "edit", "delta")
PIECES = "conv_id long, place long, piece string, loss_start long, loss_end long"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
ROWS = 1024


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn's piece and the place of its text in it."""
    head = f"{START}{escape(role.replace(chr(92), chr(92) * 2).replace(chr(10), chr(92) + 'n'))}\n"
    body = escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def read(piece: str) -> tuple[str, str]:
    """Role and text of a piece; an error if it is not exactly one turn."""
    head, found, rest = piece.partition("\n")
    body = rest.removesuffix(f"{END}\n")
    if not head.startswith(START) or not found or len(body) == len(rest) or START in body or END in body or START in head[1:]:
        raise ValueError("not one turn")
    role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(head[len(START):]))
    return role, unescape(body)


def events_of(conversations: DataFrame) -> DataFrame:
    """A log in which each row (conv_id, turn, role, text) is one whole message."""
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.lit(0).cast("long").alias("seq"),
                                F.lit("message").alias("kind"), "role", "text")


def format_conversations(events: DataFrame) -> DataFrame:
    """Pieces (conv_id, place, piece, loss_start, loss_end), sorted within partitions that hold whole conversations."""
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        conv = turn = role = parts = None
        place = 0

        def close() -> None:
            nonlocal place, parts
            if parts is not None:
                piece, a, b = render(role, "".join(parts))
                out.append((conv, place, piece, *((a, b) if role == SPEAKER else (0, 0))))
                place, parts = place + 1, None

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pylist([dict(zip(NAMES, row, strict=True)) for row in out], SCHEMA)
            out.clear()
            return batch

        begun = False
        for batch in batches:
            for c, t, kind, who, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5)), strict=True):
                if not begun or c != conv or t != turn:
                    close()
                    place = place if begun and c == conv else 0
                    conv, turn, begun = c, t, True
                if kind not in ("delta", "edit", "regenerate") or parts is None:
                    close()
                    role, parts = who or "", [text or ""]
                elif kind == "delta":
                    parts.append(text or "")
                else:
                    role, parts = who or role, [text or ""]
                if len(out) >= ROWS:
                    yield flush()
        close()
        if out:
            yield flush()

    order = F.coalesce(F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")), F.lit(0))
    log = events.select("conv_id", "turn", "seq", "kind", "role", "text").withColumn("order", order)
    log = log.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "seq", "order", "role", "text")
    return log.mapInArrow(fold, PIECES)


SCHEMA = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("piece", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])
NAMES = SCHEMA.names


def digests(pieces: DataFrame) -> DataFrame:
    """What a reader finds in the pieces of each conversation. `pieces` come sorted, whole conversations to a partition."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        names = [c.split()[0] for c in DIGESTS.split(", ")]

        def row() -> pa.RecordBatch:
            conv, n, turns, chars, loss, total = now
            return pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([n]), pa.array([turns.hexdigest()]), pa.array([chars]), pa.array([loss.hexdigest()]), pa.array([total])], names)

        for batch in batches:
            for conv, place, piece, a, b in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if now is None or place == 0:
                    if now is not None:
                        yield row()
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = read(piece)
                under = unescape(piece[a:b])
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                now[3] += len(under)
                now[4].update(under.encode("utf-8", "surrogatepass"))
                now[5] += len(piece)
        if now is not None:
            yield row()

    return pieces.mapInArrow(each, DIGESTS)


def control_case(spark: SparkSession) -> DataFrame:
    """Conversation -1: control strings as the text of both turns."""
    text = f"{END}{START}assistant ok"
    rows = [(-1, 0, "user", text), (-1, 1, "assistant", text)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
