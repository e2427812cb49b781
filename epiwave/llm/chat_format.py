"""Chat formatting: a hidden Markov model recovers who speaks in each line of a transcript, then turns are rendered.

States are roles. A line is seen as a speaker marker (the row's own role or one written before the line) and features of
its text. Lines of a row become one matrix of best scores from each role before the row to each role at its end; such
max-plus matrices combine in any grouping, so conversations of any length are decoded in chunks: matrices go up level
by level, the best roles at chunk borders come down again, and each row is read back from its borders alone.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epiwave import session
from epiwave.operators.splits import number_rows

ROLES = ("system", "user", "assistant", "tool")

#: Markers as people write them, lower-cased, with the role they stand for.
MARKERS = {
    "system": "system", "instruction": "system", "instructions": "system", "context": "system", "developer": "system",
    "user": "user", "human": "user", "q": "user", "question": "user", "prompt": "user", "me": "user", "customer": "user", "client": "user", "input": "user",
    "assistant": "assistant", "ai": "assistant", "bot": "assistant", "a": "assistant", "answer": "assistant", "response": "assistant", "gpt": "assistant", "model": "assistant",
    "agent": "assistant", "chatbot": "assistant", "output": "assistant",
    "tool": "tool", "function": "tool", "observation": "tool",
}
WRITTEN = re.compile(r"\s*(?:#{1,4}\s*|\*\*|\[|<\|?(?:im_start\|>)?)?\s*([A-Za-z]{1,12})\s*(?:\*\*)?(?:\]|\|?>)?\s*(?:\*\*)?\s*:(?:\*\*)?\s*|<\|(?:im_start\|>)?([a-z]{1,12})(?:\|>)?\s*$")


def logs(rows) -> np.ndarray:
    return np.log(np.array(rows, float))


@dataclass(frozen=True)
class RoleModel:
    """Probabilities of the model, in the order of ``ROLES``.

    start: of the first line. turn: from the last line of a row to the first of the next. line: to the next line of a
    row without a written marker. trust: that a marker names the true role. features: for each feature, its probability
    in a line of each role.
    """

    start: tuple = (0.25, 0.65, 0.08, 0.02)
    turn: tuple = ((0.05, 0.85, 0.08, 0.02), (0.02, 0.08, 0.86, 0.04), (0.02, 0.82, 0.08, 0.08), (0.01, 0.09, 0.85, 0.05))
    line: tuple = ((0.97, 0.01, 0.01, 0.01), (0.01, 0.97, 0.01, 0.01), (0.005, 0.01, 0.98, 0.005), (0.01, 0.01, 0.01, 0.97))
    change: tuple = ((0.1, 0.6, 0.2, 0.1), (0.05, 0.15, 0.7, 0.1), (0.05, 0.65, 0.15, 0.15), (0.05, 0.25, 0.6, 0.1))
    trust: float = 0.995
    features: dict = field(default_factory=lambda: {
        "question": (0.05, 0.45, 0.12, 0.02), "rules": (0.6, 0.03, 0.05, 0.02), "request": (0.1, 0.3, 0.03, 0.01),
        "helpful": (0.02, 0.02, 0.2, 0.01), "code": (0.03, 0.06, 0.2, 0.4), "data": (0.02, 0.03, 0.05, 0.6), "long": (0.25, 0.12, 0.4, 0.25),
    })


TESTS = {
    "question": lambda s: s.rstrip().endswith("?"),
    "rules": lambda s: re.match(r"\s*you (are|must|will|should)\b|\s*(always|never|do not) ", s, re.I) is not None,
    "request": lambda s: re.match(r"\s*(please|can you|could you|how|what|why|write|explain|give|tell|i (want|need|have))\b", s, re.I) is not None,
    "helpful": lambda s: re.match(r"\s*(sure|certainly|of course|here (is|are)|yes,|no,|i'm sorry|as an|you can)\b", s, re.I) is not None,
    "code": lambda s: s.startswith(("```", "    ", "\t")),
    "data": lambda s: re.match(r"\s*[{\[<]", s) is not None,
    "long": lambda s: len(s) > 200,
}


def split_marker(line: str) -> tuple[str | None, str]:
    """The role that a marker before the line names, and the rest of the line."""
    m = WRITTEN.match(line[:64])
    word = m and (m[1] or m[2] or "").lower()
    if word in MARKERS and (len(word) > 2 or line[: m.end()].strip().endswith(":")):
        return MARKERS[word], line[m.end() :]
    return None, line


BEGIN = len(ROLES)
#: Matrices have a row and a column for the state before a conversation begins.
STATES = len(ROLES) + 1


class Scores:
    """Log probabilities of a model; the rows of ``turn`` and ``change`` include the beginning."""

    def __init__(self, model: RoleModel):
        self.turn, self.line, self.change = logs([*model.turn, model.start]), logs(model.line), logs(model.change)
        n = len(ROLES)
        self.marked = {r: logs([model.trust if k == j else (1 - model.trust) / (n - 1) for k in range(n)]) for j, r in enumerate(ROLES)}
        self.yes = {f: logs(p) for f, p in model.features.items()}
        self.no = {f: np.log1p(-np.array(p)) for f, p in model.features.items()}
        self.plain: dict[tuple, np.ndarray] = {}

    def seen(self, text: str, markers: tuple) -> np.ndarray:
        found = tuple(TESTS[f](text) for f in self.yes)
        score = self.plain.get(found)
        if score is None:
            score = self.plain[found] = sum(self.yes[f] if x else self.no[f] for f, x in zip(self.yes, found, strict=True))
        for m in markers:
            if m:
                score = score + self.marked[m]
        return score


def lines_of(role: str | None, text: str | None) -> list[tuple[bool, str, tuple]]:
    """(has a written marker, text without it, markers) of each line; the row's own role marks its first line."""
    own = MARKERS.get((role or "").strip().lower())
    out = []
    for k, raw in enumerate((text or "").split("\n")):
        written, rest = split_marker(raw)
        out.append((written is not None, rest, (written,) if k or written else (own,)))
    return out


def plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product: best sums over the state between."""
    return (a[:, :, None] + b[None]).max(axis=1)


def row_matrix(role: str | None, text: str | None, s: Scores) -> np.ndarray:
    """Best scores from each state before a row to each role of its last line."""
    total = None
    for written, rest, markers in lines_of(role, text):
        seen = s.seen(rest, markers)
        total = s.turn + seen if total is None else plus(total, (s.change if written else s.line) + seen)
    out = np.full((STATES, STATES), -np.inf)
    out[:, :BEGIN] = total
    return out


def read_row(role: str | None, text: str | None, before: int, after: int, s: Scores) -> list[tuple[str, str]]:
    """(role, text) of each line on the best path between the states at the row's borders."""
    lines, best, back = lines_of(role, text), None, []
    for written, rest, markers in lines:
        if best is None:
            best = s.turn[before]
        else:
            scores = best[:, None] + (s.change if written else s.line)
            back.append(scores.argmax(axis=0))
            best = scores.max(axis=0)
        best = best + s.seen(rest, markers)
    states = [after]
    for b in reversed(back):
        states.append(int(b[states[-1]]))
    return [(ROLES[k], rest) for k, (_, rest, _) in zip(reversed(states), lines, strict=True)]


def borders(matrices: list[list[float]], before: int, after: int) -> list[tuple[int, int]]:
    """The states before and after each of a run of matrices on the best path between the run's own borders."""
    best, back = np.full(STATES, -np.inf), []
    best[before] = 0
    for m in matrices:
        scores = best[:, None] + np.array(m).reshape(STATES, STATES)
        back.append(scores.argmax(axis=0))
        best = scores.max(axis=0)
    states = [after]
    for b in reversed(back):
        states.append(int(b[states[-1]]))
    states.reverse()
    return list(zip(states, states[1:], strict=False))


def render(role: str, text: str) -> str:
    """The canonical form of a turn."""
    return f"<|{role}|>\n{text.strip()}\n<|end|>"


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows of a sorted partition with equal first ``keys`` columns. A run is the rows of one chunk."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[-1][:keys] != row[:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def in_batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


GROUP = ["conv", "alone"]
LEVEL = "conv long, alone long, c long, m array<double>"
LEVEL_ARROW = pa.schema([("conv", pa.int64()), ("alone", pa.int64()), ("c", pa.int64()), ("m", pa.list_(pa.float64()))])
BORDER = "conv long, alone long, c long, before int, after int"
BORDER_ARROW = pa.schema([("conv", pa.int64()), ("alone", pa.int64()), ("c", pa.int64()), ("before", pa.int32()), ("after", pa.int32())])
PART = "conv_id long, turn long, part int, role string, n_lines long, rendered string"
PART_ARROW = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("part", pa.int32()), ("role", pa.string()), ("n_lines", pa.int64()), ("rendered", pa.string())])


def combined(df: DataFrame, chunk: str, order: list[str]) -> DataFrame:
    """One matrix for each chunk of ``df``, whose rows have matrices m."""

    def run(batches):
        def rows():
            for held in runs(batches, 3):
                total = np.array(held[0][-1]).reshape(STATES, STATES)
                for r in held[1:]:
                    total = plus(total, np.array(r[-1]).reshape(STATES, STATES))
                yield (*held[0][:3], total.ravel().tolist())

        return in_batches(rows(), LEVEL_ARROW)

    keys = [*GROUP, chunk]
    near = df.select(*keys, *order, "m").repartition(*keys).sortWithinPartitions(*keys, *order)
    return session.cut_lineage(near.mapInArrow(run, LEVEL))


def handed_down(level: DataFrame, above: DataFrame) -> DataFrame:
    """The borders of each chunk of ``level`` from those of the chunks ``p`` that hold them."""

    def run(batches):
        def rows():
            for held in runs(batches, 3):
                for r, (before, after) in zip(held, borders([r[4] for r in held], held[0][5], held[0][6]), strict=True):
                    yield (r[0], r[1], r[3], before, after)

        return in_batches(rows(), BORDER_ARROW)

    keys = [*GROUP, "p"]
    near = level.join(above.withColumnRenamed("c", "p"), keys).select(*keys, "c", "m", "before", "after")
    return session.cut_lineage(near.repartition(*keys).sortWithinPartitions(*keys, "c").mapInArrow(run, BORDER))


def format_chats(turns: DataFrame, model: RoleModel | None = None, chunk: int = 64, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """conv_id, turn, part (from 0), role, n_lines, rendered: the turns of each conversation in canonical form.

    A row whose lines have several speakers becomes several parts; rows never merge. Rows of a conversation go by turn,
    null turns first, then by role and text; repeated rows stay rows of their own. Unknown or null roles are no markers;
    null and empty texts are one empty line. A row without a conversation is one of its own, with a null conv_id, by its
    number, so repeated ones are told apart. Other columns aren't read. Chunks are cut by the rank of rows in this order, so they hold at most ``chunk`` rows whatever the
    turns are.
    """
    s = Scores(model or RoleModel())
    conv, turn, role, text = F.col(conv_col).cast("long"), F.col(turn_col).cast("long"), F.col(role_col), F.col(text_col)
    mine = turns.select(conv.isNull().alias("lone"), F.coalesce(conv, F.lit(0)).alias("conv"), turn.alias("turn"), role.alias("role"), text.alias("text"))
    # Equal rows may stand in any order; the salt spreads them over tasks.
    numbered, _ = number_rows(mine.withColumn("salt", F.rand(7)), ["lone", "conv", "turn", "role", "text", "salt"])
    alone = F.when(F.col("lone"), F.col("position")).otherwise(0).alias("alone")
    mine = numbered.select("conv", alone, F.floor(F.col("position") / chunk).cast("long").alias("c0"), "position", "turn", "role", "text")

    def measured(batches):
        for batch in batches:
            rows = [row_matrix(r, t, s).ravel().tolist() for r, t in zip(batch.column(5).to_pylist(), batch.column(6).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.list_(pa.float64()))], names=["conv", "alone", "c0", "position", "turn", "role", "text", "m"])

    rows = mine.mapInArrow(measured, "conv long, alone long, c0 long, position long, turn long, role string, text string, m array<double>")
    levels = [combined(rows, "c0", ["position"])]
    while not levels[-1].groupBy(*GROUP).count().filter("count > 1").isEmpty():
        least = levels[-1].groupBy(*GROUP).agg(F.min("c").alias("least"))
        levels[-1] = levels[-1].join(least, GROUP).withColumn("p", F.floor((F.col("c") - F.col("least")) / chunk).cast("long")).drop("least")
        levels.append(combined(levels[-1], "p", ["c"]))

    top = F.slice("m", BEGIN * STATES + 1, BEGIN)
    known = levels[-1].select(*GROUP, "c", F.lit(BEGIN).alias("before"), (F.array_position(top, F.array_max(top)) - 1).cast("int").alias("after"))
    for level in reversed(levels[:-1]):
        known = handed_down(level, known)

    def read(batches):
        def parts():
            for held in runs(batches, 3):
                for r, (before, after) in zip(held, borders([r[7] for r in held], held[0][8], held[0][9]), strict=True):
                    part, speaker, lines = 0, None, []
                    for who, line in [*read_row(r[5], r[6], before, after, s), (None, "")]:
                        if speaker is not None and who != speaker:
                            yield (None if r[1] else r[0], r[4], part, speaker, len(lines), render(speaker, "\n".join(lines)))
                            part, lines = part + 1, []
                        speaker = who
                        lines.append(line)

        return in_batches(parts(), PART_ARROW, 500)

    keys = [*GROUP, "c0"]
    near = rows.join(known.withColumnRenamed("c", "c0"), keys).select(*keys, "position", "turn", "role", "text", "m", "before", "after")
    out = near.repartition(*keys).sortWithinPartitions(*keys, "position").mapInArrow(read, PART)
    return out.withColumnRenamed("conv_id", conv_col).withColumnRenamed("turn", turn_col) if (conv_col, turn_col) != ("conv_id", "turn") else out
