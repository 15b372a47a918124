"""Chat formatting into budgeted windows of whole turns.

A conversation's turns, in order, are written by a template that marks each turn and
escapes control strings inside texts, so that the turns can be read back. With the prefix
sums of the turns' tokens, windows are chosen that end at turns: each repeats the system turn
and the latest turns within a history budget, then takes as many new turns as the window
budget allows (one at least). The loss mask covers the texts of assistant turns, but not of
repeated ones, so each is a target once.

A conversation streams through one task, sorted, with no more turns in memory than windows
span; its length is not bounded by that memory.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Encoder, load_vocabulary
from .store import partitions

#: The template's control strings.
CONTROL = ("<s>", "</s>", "[SYS]", "[/SYS]", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "[TEXT]")
_ANY = "|".join(map(re.escape, CONTROL))
_ESCAPE = re.compile(rf"\\|{_ANY}")
_UNESCAPE = re.compile(rf"\\(\\|{_ANY})")
_TOKEN = re.compile(rf"\\(?:\\|{_ANY})|{_ANY}")


def escape(text: str) -> str:
    """A backslash before each backslash and each control string."""
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int]:
    """A turn as written, and where its (escaped) text begins."""
    body = escape(text)
    if role == "assistant":
        return f" {body}</s>", 1
    if role in ("user", "system"):
        mark = "INST" if role == "user" else "SYS"
        return f"[{mark}] {body} [/{mark}]", len(mark) + 3
    head = f"[ROLE] {escape(role)}[TEXT]"
    return f"{head}{body} [/ROLE]", len(head)


def parse(window: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a window that render() wrote."""
    turns, at, opened, role = [], 0, None, None
    if window.startswith("<s>"):
        at = 3
    begin = at
    for m in _TOKEN.finditer(window, at):
        t = m[0]
        if t[0] == "\\":
            continue
        if t in ("[INST]", "[SYS]", "[ROLE]") and opened is None and m.start() == begin:
            opened, at = t, m.end() + 1
        elif t == "[TEXT]" and opened == "[ROLE]":
            role, at = unescape(window[at : m.start()]), m.end()
        elif opened and t == f"[/{opened[1:]}":
            turns.append(({"[INST]": "user", "[SYS]": "system"}.get(opened, role), unescape(window[at : m.start() - 1])))
            opened, begin = None, m.end()
        elif t == "</s>" and opened is None:
            turns.append(("assistant", unescape(window[begin + 1 : m.start()])))
            begin = m.end()
        else:
            raise ValueError(f"unexpected {t} at {m.start()}")
    if opened or begin != len(window):
        raise ValueError("a turn is not closed")
    return turns


@dataclass
class Turn:
    role: str
    written: str
    body_at: int
    tokens: int


class Windows:
    """Takes the turns of one conversation and gives its windows."""

    def __init__(self, budget: int, history: int):
        self.budget, self.history = budget, history
        self.system: Turn | None = None
        self.turns: deque[Turn] = deque()  # from the oldest that may be repeated
        self.sums: deque[int] = deque([0])  # tokens before each of them, and after the last
        self.done = 0  # of self.turns, how many are in windows already
        self.first = 0  # number of the next new turn

    def add(self, turn: Turn) -> Iterator[dict]:
        self.turns.append(turn)
        self.sums.append(self.sums[-1] + turn.tokens)
        # one more new turn than fits tells where the window ends
        while (end := self._end()) < len(self.turns):
            yield self._window(end)

    def finish(self) -> Iterator[dict]:
        while self.done < len(self.turns):
            yield self._window(self._end())

    def _fixed(self) -> int:
        return self.system.tokens if self.system else 0

    def _start(self) -> int:
        """The oldest turn repeated, given that the next new turn has to fit."""
        sums = self.sums
        limit = min(self.history, self.budget - self._fixed() - (sums[self.done + 1] - sums[self.done]) if self.done < len(self.turns) else 0)
        return min(self.done, bisect_left(sums, sums[self.done] - limit)) if limit > 0 else self.done

    def _end(self) -> int:
        if self.done >= len(self.turns):
            return len(self.turns)
        room = self.sums[self._start()] + self.budget - self._fixed()
        return max(self.done + 1, bisect_right(self.sums, room) - 1)

    def _window(self, end: int) -> dict:
        start = self._start()
        repeated = ([self.system] if self.system else []) + [self.turns[i] for i in range(start, self.done)]
        new = [self.turns[i] for i in range(self.done, end)]
        text, at, spans = ["<s>"], 3, []
        for i, t in enumerate([*repeated, *new]):
            if i >= len(repeated) and t.role == "assistant":
                spans.append((at + t.body_at, len(t.written) - t.body_at - len("</s>")))
            text.append(t.written)
            at += len(t.written)
        out = {"first_turn": self.first, "n_repeated": len(repeated), "n_new": len(new), "tokens": sum(t.tokens for t in repeated) + self.sums[end] - self.sums[self.done], "text": "".join(text), "loss": spans}
        if self.first == 0 and new[0].role == "system":
            self.system = new[0]
        self.first += len(new)
        self.done = end
        # keep what the next window may repeat; the system turn is kept apart
        floor = self.sums[self.done] - self.history
        while self.done and (self.sums[0] < floor or self.turns[0] is self.system):
            self.turns.popleft()
            self.sums.popleft()
            self.done -= 1
        return out


WINDOWS = "conv_id long, first_turn long, n_repeated long, n_new long, tokens long, text string, loss array<struct<start:long,length:long>>"


def format_windows(conversations: DataFrame, path: str, budget: int = 1024, history: int = 256) -> DataFrame:
    """The windows of each conversation, in order, from rows (conv_id, turn, role, text).

    text is the window as written; loss its masked spans in code points; the first n_repeated
    of its turns stand in earlier windows (the system turn, if the first turn is one, then
    history) and n_new follow, of which the first is turn number first_turn. tokens counts the
    written turns, each encoded alone by the vocabulary at ``path``; only a window of one new
    turn may go over ``budget``, and it then repeats nothing but the system turn. A null role or text is empty. Turns are
    ordered by turn (null first), then role and text; equal rows are turns of their own. Rows of null
    conv_id are one conversation. Other columns are not read.
    """
    spark = conversations.sparkSession
    shared = spark.sparkContext.broadcast(load_vocabulary(spark, path))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    rows = rows.repartition(partitions(spark), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        now, windows = object(), None
        for batch in batches:
            out: list[dict] = []
            written = [render(r, t) for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            _, at = encoder.encode(pa.array([w for w, _ in written], pa.large_string()))
            for i, (conv, role) in enumerate(zip(batch.column("conv_id").to_pylist(), batch.column("role").to_pylist(), strict=True)):
                if conv != now:
                    if windows:
                        out += [{"conv_id": now} | w for w in windows.finish()]
                    now, windows = conv, Windows(budget, history)
                out += [{"conv_id": now} | w for w in windows.add(Turn(role, *written[i], int(at[i + 1] - at[i])))]
            if out:
                yield _table(out)
        if windows:
            yield _table([{"conv_id": now} | w for w in windows.finish()])

    return rows.mapInArrow(run, WINDOWS)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
_FIELDS = pa.schema([("conv_id", pa.int64()), ("first_turn", pa.int64()), ("n_repeated", pa.int64()), ("n_new", pa.int64()), ("tokens", pa.int64()), ("text", pa.string()), ("loss", _SPANS)])


def _table(rows: list[dict]) -> pa.RecordBatch:
    for r in rows:
        r["loss"] = [{"start": a, "length": n} for a, n in r["loss"]]
    return pa.RecordBatch.from_pylist(rows, _FIELDS)


def read_back(windows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of format_windows()'s rows.

    Reads the written windows, which have to come in the order in which they were made:
    new turns are parsed from the text, repeated ones passed over, and the text under the mask is
    unescaped. formatted_chars is the code points of all windows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), None
        done: list[tuple] = []

        def close():
            if state:
                done.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def table() -> pa.RecordBatch:
            cols = list(zip(*done, strict=True))
            done.clear()
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            for conv, repeated, text, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "n_repeated", "text", "loss")), strict=True):
                if conv != now:
                    close()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, body in parse(text)[repeated:]:
                    state[0] += 1
                    state[1].update(f"{role}\n{body}\n".encode())
                for span in loss:
                    target = unescape(text[span["start"] : span["start"] + span["length"]])
                    state[2] += len(target)
                    state[3].update(target.encode())
                state[4] += len(text)
            if done:
                yield table()
        close()
        if done:
            yield table()

    return windows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
