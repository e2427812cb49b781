"""Conversation structure repair: turns are aligned to the alternating grammar (s?(ua)+)?.

A target of the grammar is one string for each length, with or without a leading system turn. Wagner-Fischer tables align
a conversation's turns to each target, inside Ukkonen bands that the cheapest alignment so far allows; backtraced audits
settle ties. A conversation of any length is cut into segments of few turns. A segment is aligned from each state of the
grammar it may begin in, and what it costs to go from state to state combines over neighbouring segments, few at a time,
so no task holds the turns of a long conversation at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epiwave.llm.common import stored
from epiwave.operators.splits import number_rows

#: What the edits cost.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
BLANKS = " \t\n\x0b\x0c\r"
FAULTS = ("blank", "duplicate", "truncated")
#: Turns of a segment, and segments or results of segments that are combined at once.
SEGMENT, FAN_IN = 16, 32
#: States of the grammar: nothing yet, after a system turn, after a user turn, after an assistant turn.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTED = (NOTHING, ASSISTANT)
ROLES = {"u": "user", "a": "assistant"}


def target(state: int, system: bool, length: int) -> str:
    """What the grammar goes on with from ``state`` for ``length`` turns."""
    turns = "au" if state == USER else "ua"
    lead = "s" if system else ""
    return (lead + turns * (length // 2 + 1))[:length]


def end_state(state: int, made: str) -> int:
    return {"s": SYSTEM, "u": USER, "a": ASSISTANT}[made[-1]] if made else state


def align(turns: tuple[tuple[str, str], ...], made: str, most: int) -> tuple[int, str] | None:
    """Cost and ASCII-least audit of the cheapest edits of ``turns`` (initial, fault) to ``made``; None beyond ``most``.

    left[i][j] is what turns i.. and target j.. cost. An alignment in column j - i = k makes at least |k| insertions or
    deletions more before it and as many after it, so cells outside the band cost more than ``most``.
    """
    n, m = len(turns), len(made)
    far = most + 1
    more, fewer = most // INSERT, most // DELETE
    if not -fewer <= m - n <= more:
        return None
    left = [[far] * (m + 2) for _ in range(n + 2)]
    left[n][m] = 0
    for i in range(n, -1, -1):
        row, below = left[i], left[i + 1]
        if i < n:
            initial, fault = turns[i]
            gone, extra = fault in ("blank", "duplicate"), TRUNCATED if fault == "truncated" else 0
        for j in range(min(m, i + more), max(0, i - fewer) - 1, -1):
            best = row[j]
            if j < m and made[j] != "s":
                best = min(best, row[j + 1] + INSERT)
            if i < n:
                best = min(best, below[j] + DELETE)
                if j < m and not gone:
                    if initial == made[j]:
                        best = min(best, below[j + 1] + extra)
                    elif made[j] != "s":
                        best = min(best, below[j + 1] + REROLE + extra)
            row[j] = best
    cost = left[0][0]
    if cost > most:
        return None
    audit, i, j = [], 0, 0
    while i < n or j < m:
        here = left[i][j]
        initial, fault = turns[i] if i < n else ("", "")
        if i < n and left[i + 1][j] + DELETE == here:
            audit.append("D")
            i += 1
        elif j < m and made[j] != "s" and left[i][j + 1] + INSERT == here:
            audit.append("I")
            j += 1
        else:
            audit.append("K" if initial == made[j] and left[i + 1][j + 1] + (TRUNCATED if fault == "truncated" else 0) == here else "R")
            i, j = i + 1, j + 1
    return cost, "".join(audit)


@lru_cache(maxsize=100_000)
def repairs(turns: tuple[tuple[str, str], ...], begin: int) -> dict[int, tuple[int, str]]:
    """State at the end -> cost and audit of the cheapest edits that lead there from state ``begin``.

    The feasible lengths come by their distance from the number of turns that stay, so a near one gives the bound for the
    others early; a length whose insertions or deletions alone cost more than the bound of each state ends the search.
    """
    n = len(turns)
    found: dict[int, tuple[int, str]] = {}
    worst = DELETE * n + 2 * INSERT  # deleting all turns and going on to any state costs no more
    kept = sum(f not in ("blank", "duplicate") for _, f in turns)
    for length in sorted(range(2 * n + 3), key=lambda m: (abs(m - kept), m)):
        if (length - n) * INSERT > worst or (n - length) * DELETE > worst:
            continue
        for system in (False, True):
            if system and (begin != NOTHING or not length):
                continue
            made = target(begin, system, length)
            end = end_state(begin, made)
            new = align(turns, made, found[end][0] if end in found else worst)
            if new and (end not in found or new < found[end]):
                found[end] = new
    return found


def joined(parts: list[dict]) -> dict[tuple[int, int], tuple[int, str]]:
    """(state before, state after) -> cheapest (cost, audit) over neighbouring parts; equal costs go by the audit.

    No audit of a part is the beginning of another one of equal cost, so the least of each part stay least joined.
    """
    total = parts[0]
    for part in parts[1:]:
        new: dict[tuple[int, int], tuple[int, str]] = {}
        for (a, b), (cost, audit) in total.items():
            for (c, d), (more, rest) in part.items():
                if b == c:
                    both = cost + more, audit + rest
                    if (a, d) not in new or both < new[a, d]:
                        new[a, d] = both
        total = new
    return total


def text_of(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the stated damage: by crc32 of ``conv_id:turn`` modulo 20, nulls as one space.

    0 drops the row, 1 empties its text, 2 takes out full stops, question and exclamation marks, 3 repeats the row, 4 makes
    the user its speaker.
    """
    kind = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), kind.alias("__k")).filter("__k <> 0")
    text = F.when(F.col("__k") == 1, "").when(F.col("__k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("__k") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("__k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("__copy")).drop("__copy")


def numbered_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, place (over all turns: by conversation, turn, role and text, nulls first) and fault.

    fault: blank (nothing but ASCII blanks), else duplicate (role and text were there earlier in the conversation), else
    truncated (the last character that is no blank is none of . ! ?), else null. A null role or text is one space. Nothing
    is windowed by conversation: the first places of equal turns come from an aggregation and join by place.
    """
    plain = turns.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"))
    rows, _ = number_rows(plain, ["conv_id", "turn", "role", "text"], "place")
    first = rows.groupBy("conv_id", "role", F.sha2("text", 256)).agg(F.min("place").alias("place")).select("place", F.lit(True).alias("__first"))
    # The characters that are no blanks decide, so only the tail of a text is looked at.
    body = F.rtrim("text", F.lit(BLANKS))
    fault = (
        F.when(F.length(body) == 0, "blank").when(F.col("__first").isNull(), "duplicate")
        .when(~F.substring(body, -1, 1).isin(".", "!", "?"), "truncated")
    )
    return stored(rows.join(first, "place", "left").select("conv_id", "turn", "role", "text", "place", fault.alias("fault")))


def segments(rows: DataFrame) -> DataFrame:
    """conv_id, seg, counts of faults and illegal neighbours, first and last initial, edits between states."""
    conv = rows.schema["conv_id"]
    initial = F.substring("role", 1, 1)
    turn = F.struct("place", initial.alias("initial"), F.coalesce("fault", F.lit("")).alias("fault"))
    cut = rows.groupBy("conv_id", F.floor(F.col("place") / SEGMENT).alias("seg")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for turns in batch.column(2).to_pylist():
                key = tuple((t["initial"], t["fault"]) for t in turns)
                initials = [i for i, _ in key]
                found = {(b, e): v for b in range(4) for e, v in repairs(key, b).items()}
                out.append(summary([sum(f == x for _, f in key) for x in FAULTS], illegal(initials), initials[0], initials[-1], found))
            yield records(batch.column(0), batch.column(1), out)

    return cut.mapInArrow(run, result_schema(conv))


def illegal(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))


def result_schema(conv: T.StructField) -> T.StructType:
    edits = T.ArrayType(T.StructType([T.StructField("b", T.IntegerType()), T.StructField("e", T.IntegerType()), T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType())]))
    longs = [T.StructField(c, T.LongType()) for c in ("seg", *FAULTS, "illegal")]
    return T.StructType([conv, *longs, T.StructField("first", T.StringType()), T.StructField("last", T.StringType()), T.StructField("edits", edits)])


def summary(faults: list[int], bad: int, first: str, last: str, edits: dict) -> tuple:
    return *faults, bad, first, last, [{"b": b, "e": e, "cost": c, "audit": a} for (b, e), (c, a) in sorted(edits.items())]


def records(conv: pa.Array, seg: pa.Array, out: list[tuple]) -> pa.RecordBatch:
    edits = pa.list_(pa.struct([("b", pa.int32()), ("e", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [edits]
    cols = list(zip(*out, strict=True)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([conv, seg.cast(pa.int64()), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["conv_id", "seg", *FAULTS, "illegal", "first", "last", "edits"])


def combined(parts: DataFrame) -> DataFrame:
    """One row per conversation: neighbouring segments go together, ``FAN_IN`` at a time."""
    fields = ("seg", *FAULTS, "illegal", "first", "last", "edits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rows in batch.column(2).to_pylist():
                edits = joined([{(x["b"], x["e"]): (x["cost"], x["audit"]) for x in r["edits"]} for r in rows])
                bad = sum(r["illegal"] for r in rows) + sum(illegal([a["last"], b["first"]]) for a, b in zip(rows, rows[1:], strict=False))
                out.append(summary([sum(r[f] for r in rows) for f in FAULTS], bad, rows[0]["first"], rows[-1]["last"], edits))
            yield records(batch.column(0), batch.column(1), out)

    now = stored(parts)
    while not now.groupBy("conv_id").count().filter("count > 1").isEmpty():
        group = now.groupBy("conv_id", F.floor(F.col("seg") / FAN_IN).alias("seg")).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("rows"))
        now = stored(group.mapInArrow(run, parts.schema))
    return now


def audits(rows: DataFrame) -> DataFrame:
    """conv_id, blank, duplicate, truncated, illegal, cost, audit of the conversations in ``rows`` (numbered turns)."""
    whole = combined(segments(rows))
    ends = F.filter("edits", lambda x: (x["b"] == NOTHING) & x["e"].isin(*ACCEPTED))
    best = F.array_min(F.transform(ends, lambda x: F.struct(x["cost"].alias("cost"), x["audit"].alias("audit"))))
    return whole.select("conv_id", *FAULTS, "illegal", best["cost"].alias("cost"), best["audit"].alias("audit"))


def repaired_turns(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, place (from 0), role, text, edit: the turns of the repaired conversations.

    edit is K (kept), R (its role set) or I (inserted, with empty text). A conversation's turns stream in order through
    one task, one batch at a time, next to its audit.
    """
    conv = rows.schema["conv_id"]
    schema = T.StructType([conv, T.StructField("place", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("edit", T.StringType())])
    audit = found.select("conv_id", F.lit(-1).cast("long").alias("place"), F.lit("").alias("role"), F.col("audit").alias("text"))
    both = audit.unionByName(rows.select("conv_id", "place", "role", "text"))
    ordered = both.repartition("conv_id").sortWithinPartitions("conv_id", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edits, at, made, state, conv_id = "", 0, 0, NOTHING, None
        for batch in batches:
            out: list[tuple] = []

            def inserted():
                nonlocal at, made, state
                while at < len(edits) and edits[at] == "I":
                    role = "a" if state == USER else "u"
                    out.append((conv_id, made, ROLES[role], "", "I"))
                    state, at, made = end_state(state, role), at + 1, made + 1

            ids = batch.column(0).to_pylist()
            for conv_id, place, role, text in zip(ids, *(batch.column(k).to_pylist() for k in range(1, 4)), strict=True):
                if place < 0:
                    edits, at, made, state = text, 0, 0, NOTHING
                else:
                    edit, at = edits[at], at + 1
                    if edit != "D":
                        to = role[:1] if edit == "K" else "a" if state == USER else "u"
                        out.append((conv_id, made, role if edit == "K" else ROLES[to], text, edit))
                        state, made = end_state(state, to), made + 1
                inserted()
            cols = list(zip(*out, strict=True)) or [()] * 5
            types = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=schema.names)

    return ordered.mapInArrow(run, schema)


def digests(turns: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of ``role:text`` joined by line ends; ``turns`` as ``repaired_turns`` leaves them."""
    schema = T.StructType([turns.schema["conv_id"], T.StructField("repaired_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            done = []
            for conv_id, place, role, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if place == 0:
                    if state:
                        done.append((now, state.hexdigest()))
                    now, state = conv_id, hashlib.sha256()
                state.update(f"{chr(10) if place else ''}{role}:{text}".encode())
            kind = batch.schema.field(0).type
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], kind), pa.array([h for _, h in done], pa.string())], names=schema.names)
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([state.hexdigest()], pa.string())], names=schema.names)

    return turns.mapInArrow(run, schema)


def repair_digest(turns: DataFrame, originals: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 for each conv_id of ``originals``.

    ``turns`` (conv_id, turn, role, text) may lack some of these: their counts are 0, the audit is empty, the digest that of
    an empty text. gaps counts the whole numbers between the least and largest turn that no turn has. Rows without a
    conversation (null conv_id) are one conversation. Turns of one number are ordered by role, then text; repeated rows are turns of
    their own. Roles other than s..., u..., a... (by first letter) are set or deleted. Other columns are not read.
    """
    rows = numbered_turns(turns)
    found = stored(audits(rows))
    spans = rows.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps")
    )
    digest = digests(repaired_turns(rows, found))
    counts = [*FAULTS, "illegal", "cost"]
    parts = originals.select("conv_id")
    for more in (spans, found, digest):
        parts = parts.unionByName(more, allowMissingColumns=True)
    summed = parts.groupBy("conv_id").agg(*[F.max(c).alias(c) for c in ("gaps", *counts, "audit", "repaired_sha256")])
    return summed.select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", *counts)], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
