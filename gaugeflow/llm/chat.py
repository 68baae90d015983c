"""Chat formatting with a grammar round trip.

A turn is rendered as ``### <Role>: <text> </turn>`` and a line end. Known roles have a name of
their own; any other role (also null or empty) is written as ``Role[<percent-encoded>]``. The
grammar is deterministic: a header, text up to the first control string ``</turn>`` that no
backslash precedes, a line end. After rendering, the parser reads the turn back; where the result
is not the source, control strings inside the text get one backslash more, and the turn is rendered
and parsed again until both are identical. A turn always ends at its own end mark, so the
parse of a conversation is the parse of its turns one after the other.

Loss mask: the text of assistant turns, as spans of the formatted conversation.

Rows of a conversation go by turn, then role, then text (null first), so ties and repeated rows
have one order. Null text is empty text; null conv_id is a conversation of its own. Conversations
are read as sorted streams: a conversation with very many turns never sits in memory as a whole,
and a text, however long, is held one turn at a time. An empty table gives an empty result; columns other than conv_id,
turn, role and text are not read. The digest casts conv_id to long: other kinds of ids need ``format_turns`` alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROLES = {"system": "System", "user": "User", "assistant": "Assistant"}
NAMES = {v: k for k, v in ROLES.items()}
END = " </turn>\n"
_CONTROL = re.compile(r"\\*(?:###|</turn>)")
_ESCAPED = re.compile(r"\\+(?:###|</turn>)")
_HEADER = re.compile(r"### (?:(System|User|Assistant)|Role\[([^\]]*)\]): ")
_MARK = re.compile(r"(\\*)(?:###|</turn>)")


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m.group(), text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m.group()[1:], text)


def render(role: str, body: str) -> str:
    name = ROLES.get(role) or f"Role[{quote(role, safe='')}]"
    return f"### {name}: {body}{END}"


def parse(text: str, at: int = 0) -> tuple[str, str, int, int, int] | None:
    """Role, text, span of the written text and end of the turn that begins at ``at``; None if none does."""
    head = _HEADER.match(text, at)
    if head is None:
        return None
    role = NAMES[head.group(1)] if head.group(1) else unquote(head.group(2))
    for m in _MARK.finditer(text, head.end()):
        if not m.group(1):
            start = m.start() - 1
            if not text.startswith(END, start) or start < head.end():
                return None  # a control string inside the text, or no end mark
            return role, unescape(text[head.end():start]), head.end(), start, start + len(END)
    return None


def format_turn(role: str, text: str) -> str:
    """A rendered turn that parses back to exactly (role, text)."""
    body = text
    for _ in range(4):
        out = render(role, body)
        got = parse(out)
        if got is not None and got[:2] == (role, text) and got[4] == len(out):
            return out
        body = escape(body) if unescape(escape(body)) == text else escape(text)
    raise ValueError("turn does not round-trip")


def format_turns(conversations: DataFrame) -> DataFrame:
    """One row per turn, in order: conv_id (as text), pos, role, formatted, loss_from, loss_to.

    ``loss_from`` and ``loss_to`` are the span of the loss mask within ``formatted`` (null: none)."""
    def turns(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, pos, begun = None, 0, False
        for b in batches:
            out = []
            for c, role, text in zip(b["conv_id"], b["role"], b["text"]):
                c = None if pd.isna(c) else c
                pos = pos + 1 if begun and c == conv else 0
                conv, begun = c, True
                piece = format_turn(role or "", text or "")
                got = parse(piece)
                span = got[2:4] if got[0] == "assistant" else (None, None)
                out.append((c, pos, got[0], piece, *span))
            yield pd.DataFrame(out, columns=["conv_id", "pos", "role", "formatted", "loss_from", "loss_to"]).astype(
                {"loss_from": "Int64", "loss_to": "Int64"})

    return sorted_turns(conversations).mapInPandas(
        turns, "conv_id string, pos long, role string, formatted string, loss_from long, loss_to long")


def sorted_turns(conversations: DataFrame) -> DataFrame:
    # ids travel as text: beside nulls, pandas would turn them into floating point
    rows = conversations.select(F.col("conv_id").cast("string").alias("conv_id"), "turn", "role", "text")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def digest(formatted: DataFrame) -> DataFrame:
    """Per conversation what is read back from ``formatted`` (rows of one conversation together, in order)."""
    def read(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, state = None, None
        for b in batches:
            out = []
            for c, piece in zip(b["conv_id"], b["formatted"]):
                c = None if pd.isna(c) else c
                if state is None or c != conv:
                    if state is not None:
                        out.append(_row(conv, state))
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                at = 0
                while at < len(piece):
                    role, text, _, _, at = parse(piece, at)
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                    if role == "assistant":
                        state[2] += len(text)
                        state[3].update(text.encode())
                state[4] += len(piece)
            yield _frame(out)
        if state is not None:
            yield _frame([_row(conv, state)])

    rows = formatted.select("conv_id", "formatted").mapInPandas(
        read, "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return rows.withColumn("conv_id", F.col("conv_id").cast("long"))


def _row(conv, state):
    return conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]


def _frame(rows) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256",
                                       "formatted_chars"])
