"""Chat formatting in budgeted, turn-aligned windows with a loss mask."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>\n"
#: Strings that chat templates use as marks; inside texts a backslash follows their first character.
CONTROL = re.compile(r"<\||</?s>|\[/?INST\]|<</?SYS>>|\\")
ESCAPED = re.compile(r"\\(.)", re.DOTALL)
#: Tokens that a turn's three marks count for.
MARKS = 3


@dataclass(frozen=True)
class Windows:
    """Tokens of a window's turns with what it repeats; of that history at most ``history_turns`` turns and ``history_tokens`` tokens.

    Tokens are those of the rank file ``ranks``; ``MARKS`` are added for each turn.
    """

    budget: int = 512
    history_turns: int = 2
    history_tokens: int = 128
    ranks: str = tokens.RANKS


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


class Formatter:
    """Turns of one conversation, one by one, into windows.

    ``total`` is the prefix sum of turn tokens; a window's new turns span from
    ``start`` to ``total``. One turn beyond the budget is a window of its own.
    """

    def __init__(self, p: Windows, count: Callable[[str], int]):
        self.p, self.count, self.total, self.start, self.number = p, count, 0, 0, 0
        self.system: tuple[str, str, int] | None = None
        self.repeated: list[tuple[str, str, int]] = []
        self.new: list[tuple[str, str, int]] = []
        self.extra = 0

    def add(self, role: str, text: str) -> Iterator[dict]:
        n = self.count(role) + self.count(text) + MARKS
        if self.new and self.total - self.start + n + self.extra > self.p.budget:
            yield self.window()
            self.begin(n)
        if not self.total and role == "system":
            self.system = (role, text, n)
        self.new.append((role, text, n))
        self.total += n

    def begin(self, n: int) -> None:
        """The next window repeats the system turn and as much history as its limits and the budget allow."""
        kept, left = [], min(self.p.history_tokens, self.p.budget - n - (self.system[2] if self.system else 0))
        for turn in reversed(self.new[-self.p.history_turns :] if self.p.history_turns else []):
            if turn is self.system or turn[2] > left:
                break
            kept.insert(0, turn)
            left -= turn[2]
        self.repeated = [self.system, *kept] if self.system else kept
        self.extra, self.start, self.new, self.number = sum(t[2] for t in self.repeated), self.total, [], self.number + 1

    def window(self) -> dict:
        pieces, mask, at = [], [], 0
        for i, (role, text, _) in enumerate([*self.repeated, *self.new]):
            head, body = TURN + escape(role) + BODY, escape(text)
            if role == "assistant" and i >= len(self.repeated):
                mask.append({"begin": at + len(head), "end": at + len(head) + len(body)})
            pieces += [head, body, END]
            at += len(head) + len(body) + len(END)
        return {"window": self.number, "text": "".join(pieces), "n_repeated": len(self.repeated), "loss": mask}


def _grouped(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[bool, int | None, tuple]]:
    """(conversation begins, conv_id, row) of rows that come sorted by conversation."""
    last: object = object()
    for batch in batches:
        for row in batch.itertuples(index=False):
            conv = None if pd.isna(row.conv_id) else int(row.conv_id)
            yield conv != last, conv, row
            last = conv


FORMATTED = "conv_id long, window int, text string, n_repeated int, loss array<struct<begin: int, end: int>>"


def format_windows(turns: DataFrame, p: Windows = Windows()) -> DataFrame:
    """(conv_id, window, text, n_repeated, loss) of conversations (conv_id, turn, role, text).

    Rows go by turn, then role and text; null roles and texts are empty, null
    turns come first, rows with a null conv_id are one conversation, repeated
    rows are turns of their own, extra columns are left out, and an empty table
    gives no windows. ``loss`` has the places of assistant texts that no
    earlier window had. A conversation's turns stream through one task in
    order, which holds no more than a window of them.
    """

    ranks = tokens.ship(turns.sparkSession, p.ranks)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: Formatter | None = None
        encode = tokens.shipped_encoder(ranks).encode_ordinary
        out: list[dict] = []
        size, conv_before = 0, None
        for begins, conv, row in _grouped(batches):
            if begins:
                if made:
                    out.append({"conv_id": conv_before, **made.window()})
                made, conv_before = Formatter(p, lambda t: len(encode(t))), conv
            for w in made.add(row.role, row.text):
                out.append({"conv_id": conv, **w})
                size += len(w["text"])
            if len(out) >= 1000 or size > 8_000_000:
                yield pd.DataFrame(out).astype({"conv_id": "Int64"})
                out, size = [], 0
        if made:
            out.append({"conv_id": conv_before, **made.window()})
        if out:
            yield pd.DataFrame(out).astype({"conv_id": "Int64"})

    columns = [F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")]
    ordered = turns.select(*columns).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInPandas(run, FORMATTED)


def parse_window(text: str) -> list[tuple[str, str]]:
    """The turns of a window, as they were before formatting."""
    out = []
    for block in text.split(END)[:-1]:
        role, _, body = block.removeprefix(TURN).partition(BODY)
        out.append((unescape(role), unescape(body)))
    return out


DIGESTED = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long, n_repeated long"


def read_back(windows: DataFrame) -> DataFrame:
    """One row per conversation of ``format_windows``' rows, which it sorts: what its windows say, read from their texts alone, and how many there are and turns they repeat.

    A null conv_id is a conversation; repeated windows are read as often as
    they come; extra columns are left out; no windows, no rows. A
    conversation's windows stream through one task, since one digest covers
    them all; it holds one of them.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        state: list | None = None

        def done() -> None:
            out.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), *state[5:]))

        for begins, conv, row in _grouped(batches):
            if begins:
                if state:
                    done()
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
            for role, text in parse_window(row.text)[row.n_repeated :]:
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            for span in row.loss:
                said = unescape(row.text[span["begin"] : span["end"]])
                state[3] += len(said)
                state[4].update(said.encode("utf-8", "surrogatepass"))
            state[5] += len(row.text)
            state[6] += 1
            state[7] += row.n_repeated
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=[c.split()[0] for c in DIGESTED.split(", ")]).astype({"conv_id": "Int64"})
                out.clear()
        if state:
            done()
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in DIGESTED.split(", ")]).astype({"conv_id": "Int64"})

    ordered = windows.select("conv_id", "window", "text", "n_repeated", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return ordered.mapInPandas(run, DIGESTED)
