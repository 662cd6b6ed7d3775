"""Chat formatting in budgeted windows.

A conversation's turns, in order, stream through one pass (sorted by conversation and turn, never
collected). Prefix sums of turn tokens choose turn-aligned windows: each opens with the system turn,
repeats a limited history, and takes new turns while the budget lasts. Only the new assistant
turns of a window are under its loss mask, so each is learnt once.

Template: `<|turn|>role\\ntext<|end|>\\n`. In role and text a backslash is doubled and a control string gets a
backslash after its first character; dropping each backslash and keeping what follows it undoes both.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Control strings that may not appear unescaped inside a text, the template's own first.
CONTROL = (
    "<|turn|>", "<|end|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<|system|>", "<|user|>", "<|assistant|>",
    "<s>", "</s>", "<unk>", "<pad>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
)
_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROL, key=len, reverse=True))))
_TOKEN = re.compile(r"\w+|[^\w\s]")
_TURN = re.compile(r"<\|turn\|>(.*?)\n(.*?)<\|end\|>\n", re.S)


def escaped(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def escaped_role(role: str) -> str:
    """A role's line feeds are marked too, since the first one ends it."""
    return escaped(role).replace("\n", "\\n\\")


def unescaped_role(role: str) -> str:
    return re.sub(r"\\n\\|\\(.)", lambda m: "\n" if m[0] == "\\n\\" else m[1], role, flags=re.S)


def turn_tokens(text: str) -> int:
    """Tokens of a turn: words and single other characters, and three for the template."""
    return sum(1 for _ in _TOKEN.finditer(text)) + 3


class _Windows:
    """State of one conversation: the system turn, the turns of the last history tokens, and the open window.

    total is the prefix sum of tokens up to here. A window spans the turns from prefix sum since on, and has fixed tokens besides (the system
    turn's, if it is repeated), so whether a turn still fits is a comparison of prefix sums.
    """

    def __init__(self, conv, budget: int, history: int):
        self.conv, self.budget, self.history = conv, budget, history
        self.system: tuple | None = None
        self.total, self.n, self.number = 0, 0, 0
        self.recent: deque = deque()  # (prefix sum before it, rendered turn, its head's length, role)
        self.open: list = []  # (rendered turn, its head's length, role, repeated)
        self.since, self.fixed = 0, 0

    def _render(self, role: str, text: str) -> tuple[str, int]:
        head = f"<|turn|>{escaped_role(role)}\n"
        return head + escaped(text) + "<|end|>\n", len(head)

    def add(self, role: str, text: str) -> dict | None:
        """Takes the next turn; gives the window that it closes, if it does."""
        tokens, (rendered, head), done = turn_tokens(text), self._render(role, text), None
        if self.open and self.fixed + self.total + tokens - self.since > self.budget:
            done = self.close()
        if not self.open:
            self._begin(tokens)
        self.open.append((rendered, head, role, False))
        if self.n == 0 and role == "system":
            self.system = (tokens, rendered, head, role)
        else:
            self.recent.append((self.total, rendered, head, role))
        self.total += tokens
        while self.recent and self.total - self.recent[0][0] > self.history:
            self.recent.popleft()
        self.n += 1
        return done

    def _begin(self, tokens: int) -> None:
        """Repeats what leaves room for a first new turn of so many tokens: the system turn, then as many of the latest turns."""
        self.fixed = 0
        if self.system and self.system[0] + tokens <= self.budget:
            self.fixed = self.system[0]
            self.open.append((*self.system[1:], True))
        least = self.total - (self.budget - self.fixed - tokens)
        kept = [x for x in self.recent if x[0] >= least]
        self.since = kept[0][0] if kept else self.total
        self.open += [(*x[1:], True) for x in kept]

    def close(self) -> dict:
        text, starts, ends, at = [], [], [], 0
        for rendered, head, role, repeated in self.open:
            if role == "assistant" and not repeated:
                starts.append(at + head)
                ends.append(at + len(rendered) - len("<|end|>\n"))
            text.append(rendered)
            at += len(rendered)
        row = {
            "conv_id": self.conv, "window": self.number, "text": "".join(text), "first_new": sum(x[3] for x in self.open),
            "n_new": sum(not x[3] for x in self.open), "loss_start": starts, "loss_end": ends, "n_tokens": self.fixed + self.total - self.since,
        }
        self.number, self.open = self.number + 1, []
        return row


_WINDOW = "conv_id long, window long, text string, first_new int, n_new int, loss_start array<int>, loss_end array<int>, n_tokens long"


def _format(budget: int, history: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: _Windows | None = None
        for pdf in batches:
            rows = []
            for conv, role, text, no_id in zip(pdf["conv"], pdf["role"], pdf["text"], pdf["no_id"], strict=True):
                conv = None if no_id else int(conv)
                if state is None or state.conv != conv:
                    if state:
                        rows.append(state.close())
                    state = _Windows(conv, budget, history)
                if done := state.add(role, text):
                    rows.append(done)
            if rows:
                yield _frame(rows)
        if state:
            yield _frame([state.close()])

    return run


def _frame(rows: list[dict]) -> pd.DataFrame:
    out = pd.DataFrame(rows)
    out["conv_id"] = out["conv_id"].astype("Int64")
    return out


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", budget: int = 2048, history: int = 512) -> DataFrame:
    """One row per window: conv_id, window, text, first_new, n_new, loss_start, loss_end, n_tokens.

    The first first_new turns of a window are repeated (the system turn, then at most history tokens of latest turns); the n_new after
    them are new. loss_start and loss_end are spans of the window's text. Turns stand by turn (nulls first; ties by role,
    then text); null role and text are empty. No window exceeds the budget, but a turn over the budget has a window of its own, whole. What is repeated
    gives way to the first new turn: history first, then the system turn. Turns of a null conversation form one. Repeated rows
    are turns of their own. An empty table gives an empty result. Other columns are not read.
    """
    rows = turns.select(
        F.col(conv_col).cast("long").alias("conv"), F.col(conv_col).isNull().alias("no_id"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    rows = rows.repartition("conv").sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text")
    return rows.select("conv", "no_id", "role", "text").mapInPandas(_format(budget, history), _WINDOW)


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def fresh(conv):
        return {"conv_id": conv, "n_turns": 0, "turns": hashlib.sha256(), "loss_chars": 0, "loss": hashlib.sha256(), "formatted_chars": 0, "n_windows": 0}

    def ready(s: dict) -> dict:
        return s | {"turns_sha256": s["turns"].hexdigest(), "loss_sha256": s["loss"].hexdigest()}

    state: dict | None = None
    for pdf in batches:
        rows = []
        for conv, text, first, starts, ends, no_id in zip(pdf["conv_id"], pdf["text"], pdf["first_new"], pdf["loss_start"], pdf["loss_end"], pdf["no_id"], strict=True):
            conv = None if no_id else int(conv)
            if state is None or state["conv_id"] != conv:
                if state:
                    rows.append(ready(state))
                state = fresh(conv)
            for role, body in _TURN.findall(text)[first:]:
                state["n_turns"] += 1
                state["turns"].update(f"{unescaped_role(role)}\n{unescaped(body)}\n".encode())
            for a, b in zip(starts, ends, strict=True):
                body = unescaped(text[a:b])
                state["loss_chars"] += len(body)
                state["loss"].update(body.encode())
            state["formatted_chars"] += len(text)
            state["n_windows"] += 1
        if rows:
            yield _digest_frame(rows)
    if state:
        yield _digest_frame([ready(state)])


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"


def _digest_frame(rows: list[dict]) -> pd.DataFrame:
    out = pd.DataFrame(rows)[[x.split(" ")[0] for x in _DIGEST.split(", ")]]
    out["conv_id"] = out["conv_id"].astype("Int64")
    return out


def read_back(windows: DataFrame) -> DataFrame:
    """One row per conversation, parsed from the formatted text: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows.

    windows: rows of format_conversations, each once; windows without any give an empty result. Other columns are not read.
    """
    rows = windows.withColumn("no_id", F.col("conv_id").isNull()).repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return rows.select("conv_id", "no_id", "text", "first_new", "loss_start", "loss_end").mapInPandas(_digests, _DIGEST)
