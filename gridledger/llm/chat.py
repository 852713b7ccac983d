"""Chat formatting: a hidden Markov model recovers speakers, then turns are rendered canonically.

The lines of a conversation are observations, its hidden states are roles, each as the first line of
a turn or a later one. A line is seen through its speaker marker (the row's role, or a name with a
colon or in brackets that opens the line) and its shape (length, question mark, whether a row or a
marker opens it). Transitions and shapes are counted over all turns whose role is known; how far
a marker is trusted is a parameter. Viterbi finds the most likely roles.

Conversations are cut into blocks of ``BLOCK`` turn numbers. Most have one block. Of longer ones,
each block gives its matrix of best scores between states; the matrices are chained in order, which
fixes the state at both ends of every block, and blocks are decoded apart. Only matrices meet.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed

ROLES = ("system", "user", "assistant")
NAMES = {
    "system": ("system", "developer", "instruction", "instructions"),
    "user": ("user", "human", "customer", "client", "prompter", "question", "q", "me"),
    "assistant": ("assistant", "ai", "bot", "gpt", "model", "agent", "answer", "a"),
}
BLOCK = 1024
TRUST = 0.98  # that a marker names its line's role
_ROLE_OF = {name: k for k, role in enumerate(ROLES) for name in NAMES[role]}
_MARKER = re.compile(r"^\s*(?:#{1,6}\s*|\*{1,2}|[<\[|]{1,3})?\s*(" + "|".join(sorted(_ROLE_OF, key=len, reverse=True)) + r")\s*(?:[>\]|]{1,3}\s*:?|\*{1,2}\s*:|:\s*\*{0,2})\s*", re.IGNORECASE)
_SHAPES = 16


def role_number(name: str | None) -> int:
    """0 to 2, or -1 for a name that says nothing."""
    return _ROLE_OF.get((name or "").strip().lower(), -1)


def observe(role: str | None, text: str | None) -> list[tuple[int, int, int]]:
    """(marker, shape, marker's length) of each line of a row; the row's role marks its first line."""
    out = []
    for k, line in enumerate((text or "").split("\n")):
        found = _MARKER.match(line)
        marker = role_number(role) if k == 0 and role_number(role) >= 0 else role_number(found[1]) if found else -1
        opens = k == 0 or found is not None
        words = line.count(" ") + 1
        shape = (words > 8) + (words > 30) + (words > 100) + 4 * opens + 8 * ("?" in line)
        out.append((marker, shape, found.end() if found else 0))
    return out


class Hmm:
    """States 0 to 2 open a turn of a role, 3 to 5 go on with it. Scores are logarithms."""

    def __init__(self, starts: np.ndarray, follows: np.ndarray, goes_on: np.ndarray, shapes: np.ndarray, trust: float = TRUST):
        self.start = np.concatenate((np.log((starts + 1) / (starts + 1).sum()), np.full(3, -60.0)))
        turn = (follows + 1) / (follows + 1).sum(axis=1, keepdims=True)
        on = ((goes_on[:, 1] + 1) / (goes_on.sum(axis=1) + 2))[:, None]
        step = np.log(np.concatenate((turn * (1 - on), np.eye(3) * on + 1e-12), axis=1))
        self.step = np.concatenate((step, step))
        shape = np.log((shapes + 0.5) / (shapes + 0.5).sum(axis=1, keepdims=True))
        marker = np.full((3, 4), np.log((1 - trust) / 2))  # column 3: no marker, which tells nothing
        marker[range(3), range(3)] = np.log(trust)
        marker[:, 3] = 0
        self.shape, self.marker = shape, np.concatenate((marker, np.where(np.arange(4) == 3, 0.0, marker)))

    def emissions(self, lines: list[tuple[int, int, int]]) -> np.ndarray:
        marker, shape = np.array([x[0] for x in lines]), np.array([x[1] for x in lines])
        return (self.marker[:, marker] + self.shape[:, shape]).T

    def decode(self, emitted: np.ndarray, entry: int = -1, exit_: int = -1) -> np.ndarray:
        """The best states; ``entry`` is the state before the first line, ``exit_`` that of the last."""
        best = (self.start if entry < 0 else self.step[entry]) + emitted[0]
        back = np.zeros((len(emitted), 6), np.int8)
        for t in range(1, len(emitted)):
            way = best[:, None] + self.step
            back[t] = way.argmax(axis=0)
            best = way.max(axis=0) + emitted[t]
        states = np.empty(len(emitted), np.int64)
        states[-1] = best.argmax() if exit_ < 0 else exit_
        for t in range(len(emitted) - 1, 0, -1):
            states[t - 1] = back[t, states[t]]
        return states

    def opening(self, emitted: np.ndarray) -> np.ndarray:
        """Best score of each state of the last line when these lines begin a conversation."""
        best = self.start + emitted[0]
        for e in emitted[1:]:
            best = (best[:, None] + self.step).max(axis=0) + e
        return best

    def transfer(self, emitted: np.ndarray) -> np.ndarray:
        """Best score from each state before the lines to each state of the last one."""
        best = self.step + emitted[0]
        for e in emitted[1:]:
            best = (best[:, :, None] + self.step[None]).max(axis=1) + e
        return best


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of one conversation and block at a time, of batches sorted by both."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and (row["conv_id"], row["block"]) != (held[-1]["conv_id"], held[-1]["block"]):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def turn_rows(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per distinct turn with its number of copies, sorted by conversation and block in its partition."""
    c = conversations.select(F.col(key).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    c = c.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    c = c.select("conv_id", F.coalesce(F.floor(F.col("turn") / block), F.lit(-1)).cast("long").alias("block"), "turn", "role", "text", "copies")
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return c.repartition(parts, "conv_id", "block").sortWithinPartitions("conv_id", "block", "turn", "role", "text")


def fit(rows: DataFrame, trust: float = TRUST) -> Hmm:
    """Counts over all turns with a known role. What reaches the driver is one table of 114 counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, follows, goes_on, shapes = np.zeros(3), np.zeros((3, 3)), np.zeros((3, 2)), np.zeros((6, _SHAPES))
        for group in _blocks(batches):
            last = -1
            for k, row in enumerate(group):
                r = role_number(row["role"])
                if r >= 0:
                    if k == 0 and row["block"] == 0:
                        starts[r] += 1
                    if last >= 0:
                        follows[last, r] += 1
                        goes_on[last, 0] += 1
                    lines = observe(row["role"], row["text"])
                    shapes[r, lines[0][1]] += 1
                    for x in lines[1:]:
                        shapes[r + 3, x[1]] += 1
                    goes_on[r, 1] += len(lines) - 1
                last = r
        flat = np.concatenate([x.ravel() for x in (starts, follows, goes_on, shapes)])
        yield pa.RecordBatch.from_pydict({"place": np.arange(len(flat), dtype=np.int32), "n": flat})

    got = rows.mapInArrow(count, "place int, n double").groupBy("place").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(18 + 6 * _SHAPES)
    for r in got:
        flat[r["place"]] = r["n"]
    return Hmm(flat[:3], flat[3:12].reshape(3, 3), flat[12:18].reshape(3, 2), flat[18:].reshape(6, _SHAPES), trust)


def _ends(rows: DataFrame, model: Hmm) -> DataFrame | None:
    """(conv_id, block, entry, exit) for conversations of several blocks; None if there are none."""
    many = rows.select("conv_id", "block").distinct().groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("conv_id")
    many = checkpointed(many)
    if many.isEmpty():
        return None

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _blocks(batches):
            emitted = model.emissions([x for row in group for x in observe(row["role"], row["text"])])
            yield pa.RecordBatch.from_pydict({"conv_id": pa.array([group[0]["conv_id"]], pa.int64()), "block": [group[0]["block"]],
                                              "between": [model.transfer(emitted).ravel().tolist()], "opening": [model.opening(emitted).tolist()]})

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        m = [np.array(x).reshape(6, 6) for x in pdf["between"]]
        forward = [np.array(pdf["opening"].iloc[0])]
        for x in m[1:]:
            forward.append((forward[-1][:, None] + x).max(axis=0))
        exits, entries = [int(forward[-1].argmax())], []
        for k in range(len(m) - 1, 0, -1):
            entries.append(int((forward[k - 1] + m[k][:, exits[-1]]).argmax()))
            exits.append(entries[-1])
        return pd.DataFrame({"conv_id": pdf["conv_id"], "block": pdf["block"], "entry": [-1, *entries[::-1]], "exit": exits[::-1]})

    part = rows.join(many, "conv_id", "left_semi")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = part.repartition(parts, "conv_id", "block").sortWithinPartitions("conv_id", "block", "turn", "role", "text")
    # one matrix per block of turns, so a conversation of a billion turns is a million rows here
    return part.mapInArrow(measure, "conv_id long, block long, between array<double>, opening array<double>").groupBy("conv_id").applyInPandas(
        chain, "conv_id long, block long, entry int, exit int")


def render(role: str, content: str) -> str:
    """A turn in canonical form. A ``<|`` in the content is set apart, so no text can pose as a marker."""
    return f"<|{role}|>\n{content.replace('<|', '< |')}\n<|end|>\n"


def format_conversations(conversations: DataFrame, model: Hmm | None = None, key: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text", block: int = BLOCK, trust: float = TRUST) -> DataFrame:
    """(conv_id, turn, part, role, content, rendered, copies), one row per recovered turn.

    A row of the input is one turn, or several where markers inside its text open new ones (``part``
    counts from 0). A role that is null or unknown is recovered from its neighbours and the lines.
    Turns are taken in the order of their numbers, those of one number by role and text; a null number
    comes first. Exact repeats of a row are one turn, ``copies`` says of how many rows. A null or empty
    text is a turn without content. Rows with a null key form one conversation, read block by block. An empty table gives no
    rows. Markers are taken off the content, which is trimmed; other columns are not read.
    """
    rows = turn_rows(conversations, key, turn, role, text, block)
    model = model or fit(rows, trust)
    ends = _ends(rows, model)
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if ends is None:
        rows = rows.withColumn("entry", F.lit(-1)).withColumn("exit", F.lit(-1))
    else:
        rows = (rows.join(ends, ["conv_id", "block"], "left").fillna(-1, ["entry", "exit"])
                .repartition(parts, "conv_id", "block").sortWithinPartitions("conv_id", "block", "turn", "role", "text"))
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("part", pa.int32()), ("role", pa.string()), ("content", pa.string()), ("rendered", pa.string()), ("copies", pa.int64())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _blocks(batches):
            seen = [observe(row["role"], row["text"]) for row in group]
            states = model.decode(model.emissions([x for lines in seen for x in lines]), group[0]["entry"], group[0]["exit"])
            out, at = [], 0
            for row, lines in zip(group, seen, strict=True):
                texts, part = (row["text"] or "").split("\n"), 0
                turns: list[tuple[int, list[str]]] = []
                for k, (line, x) in enumerate(zip(texts, lines, strict=True)):
                    state = int(states[at + k])
                    line = line[x[2]:] if state < 3 or k == 0 else line
                    if k == 0 or state < 3:
                        turns.append((state % 3, [line]))
                    else:
                        turns[-1][1].append(line)
                at += len(lines)
                for part, (r, content) in enumerate(turns):
                    body = "\n".join(content).strip()
                    out.append({"conv_id": row["conv_id"], "turn": row["turn"], "part": part, "role": ROLES[r], "content": body,
                                "rendered": render(ROLES[r], body), "copies": row["copies"]})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return rows.mapInArrow(decode, "conv_id long, turn long, part int, role string, content string, rendered string, copies long")
