"""Chat formatting: roles of transcript lines by a hidden Markov model, then canonical turns.

The states are the roles; the observations of a line are its speaker marker, if any, and shape features. Viterbi
runs in steps, so that one conversation may be larger than a task: each segment (a row of the transcript)
gives the best score from any role before it to any role at its end; conversations are cut into chunks of at most
``CHUNK`` rows, by their number in the documented order. Where a conversation has several chunks, the segments of each
are combined, a bounded number at a time, to a tree, and the best roles at the borders are traced down from its top. Then each chunk, with its
borders known, traces its own segments, and each segment its lines. A segment may hold several turns: the role changes
wherever its lines say so.

Defined cases: a null or empty text is one blank line, which takes the role that fits around it and gives no
turn; a null position comes first; rows with equal positions go by text; rows that repeat are parsed as often as
they stand there; null conversations are one conversation; ties go to the role that is listed first; an empty
table gives an empty result; columns other than the named ones are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import materialise, number_rows, with_names

ROLES = ("system", "user", "assistant")
K = len(ROLES)
#: Rows in a chunk, and parts that one group of the tree over the chunks has at most.
CHUNK, FAN = 256, 256
#: Speaker markers of the common transcript formats, by role.
MARKERS = {
    "system": r"system(?: prompt)?|sys|instructions?",
    "user": r"user|human|question|q|prompt|customer|me",
    "assistant": r"assistant|ai|bot|answer|a|model|gpt|agent",
}
LABEL = "|".join(f"(?P<{role}>{names})" for role, names in MARKERS.items())
MARKER = re.compile(rf"\s*(?:<\|(?:im_start\|>)?\s*|\[|#{{1,4}}\s*|\*\*)?(?:{LABEL})\s*(?:\|>|\]|\*\*)?\s*(?::\s*(?:\*\*)?|(?<=\|>)|(?<=\])|$)", re.IGNORECASE)
#: Log chances. A marker nearly decides; without one, shapes lean a little. A new segment mostly changes the role, and
#: so does a line with a marker, which begins a turn; any other line mostly goes on in the same role.
MARKED, UNMARKED = np.log(0.97), np.log(0.015)
STAY, LEAVE = np.log(0.96), np.log(0.02)
#: Of the role that stands, unseen, before a conversation: after an assistant's a user's turn is likely.
START = np.log(np.array([0.15, 0.10, 0.75]))
NEXT = np.log(np.array([[0.05, 0.85, 0.10], [0.01, 0.07, 0.92], [0.01, 0.89, 0.10]]))
INSIDE = np.full((K, K), LEAVE) + np.eye(K) * (STAY - LEAVE)


def marker(line: str) -> tuple[int, str]:
    """The role that a line's marker names (-1: none) and the line without it."""
    m = MARKER.match(line)
    if not m:
        return -1, line
    return ROLES.index(m.lastgroup), line[m.end() :]


def emissions(lines: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Log chances of each line in each role (lines x roles), and of the change of roles at each line."""
    out, change = np.zeros((len(lines), K)), [NEXT] * len(lines)
    for i, line in enumerate(lines):
        role, rest = marker(line)
        if role >= 0:
            out[i] = UNMARKED
            out[i, role] = MARKED
            continue
        if i:
            change[i] = INSIDE
        shape = np.zeros(K)
        if rest.rstrip().endswith("?"):
            shape += (-0.6, 0.4, -0.2)
        if re.match(r"\s*(?:[-*+]|\d+[.)])\s", rest):
            shape += (0.0, -0.4, 0.4)
        if len(rest) > 400:
            shape += (-0.4, -0.4, 0.3)
        out[i] = shape
    return out, change


def split_lines(text: str | None) -> list[str]:
    return (text or "").split("\n")


def transfer(lines: list[str]) -> np.ndarray:
    """Best log chance from each role before the segment to each role of its last line."""
    emit, change = emissions(lines)
    best = change[0] + emit[0]
    for e, c in zip(emit[1:], change[1:], strict=True):
        best = (best[:, :, None] + c[None]).max(axis=1) + e
    return best


def through(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product of two transfers."""
    return (a[:, :, None] + b[None]).max(axis=1)


def trace(matrices: list[np.ndarray], start: np.ndarray, end: int | None) -> list[int]:
    """The role after each matrix on the best way; ``start``: log chance of each role before the first one."""
    forward, back = start, []
    for m in matrices:
        score = forward[:, None] + m
        back.append(score.argmax(axis=0))
        forward = score.max(axis=0)
    state = int(forward.argmax()) if end is None else end
    out = [state]
    for b in reversed(back[1:]):
        state = int(b[state])
        out.append(state)
    return out[::-1]


def label_lines(lines: list[str], before: int, after: int) -> list[int]:
    """The role of each line, given those before the segment and at its end."""
    if len(lines) == 1:
        return [after]
    emit, change = emissions(lines)
    start = change[0][before] + emit[0]
    steps = [c + e for e, c in zip(emit[1:], change[1:], strict=True)]
    states = trace(steps, start, after)
    score = start[:, None] + steps[0]
    return [int(score[:, states[0]].argmax()), *states]


def render(lines: list[str], roles: list[int]) -> list[dict]:
    """Turns: neighbouring lines of one role, without markers and outer blanks; blank turns are dropped."""
    turns: list[list] = []
    for line, role in zip(lines, roles, strict=True):
        named, rest = marker(line)
        text = rest if named >= 0 else line
        if turns and turns[-1][0] == role and named < 0:
            turns[-1][1].append(text)
        else:
            turns.append([role, [text]])
    joined = [(ROLES[role], "\n".join(parts).strip()) for role, parts in turns]
    return [{"role": role, "text": text} for role, text in joined if text]


def canonical(turns: list[dict]) -> str:
    return "".join(f"<|{t['role']}|>\n{t['text']}\n<|end|>\n" for t in turns)


def _flat(m: np.ndarray) -> list[float]:
    return m.ravel().tolist()


def deal(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``conv, pos, text``, the segment's transfer ``m``, ``number`` in the conversation and ``chunk``.

    Positions may be null or repeat, so chunks go by number: none has more than ``chunk`` rows.
    """
    kind = rows.schema["conv"].dataType.simpleString()

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [_flat(transfer(split_lines(t))) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.float64()))], names=[*batch.schema.names, "m"])

    numbered = number_rows(rows, ["conv"], [F.col("pos")], "text", measure, f"conv {kind}, pos long, text string, m array<double>")
    return numbered.withColumn("chunk", F.floor(F.col("number") / chunk).cast("long"))


def _matrices(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, K, K)


def _label(before: int | None, after: int | None, ms: list[np.ndarray], texts: list[str | None]) -> tuple[list[str], list[list[dict]]]:
    """Roles and turns of one chunk; a chunk that is a whole conversation has no borders."""
    begins = before is None or before < 0
    start = START if begins else np.where(np.arange(K) == before, 0.0, -np.inf)
    states = trace(ms, start, after)
    if begins:
        before = int((start[:, None] + ms[0])[:, states[0]].argmax())
    turns = []
    for text, was, now in zip(texts, [before, *states[:-1]], states, strict=True):
        lines = split_lines(text)
        turns.append(render(lines, label_lines(lines, was, now)))
    return [ROLES[s] for s in states], turns


def parse(rows: DataFrame, conv_col: str = "conv_id", pos_col: str = "turn", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """One row per row of the transcript: ``conv, pos``, ``role`` (of its last line), ``turns`` and ``rendered``."""
    rows = with_names(rows, conv=conv_col, pos=pos_col, text=text_col).withColumn("pos", F.col("pos").cast("long"))
    kind = rows.schema["conv"].dataType.simpleString()
    measured = deal(rows, chunk)

    def combine(table: pa.Table) -> pa.Table:
        total = None
        for m in _matrices(table.sort_by("number")["m"].combine_chunks()):
            total = m if total is None else through(total, m)
        return pa.table({"conv": table["conv"].slice(0, 1), "chunk": table["chunk"].slice(0, 1), "m": pa.array([_flat(total)], pa.list_(pa.float64()))})

    def borders(table: pa.Table) -> pa.Table:
        """The roles around each part, given those around the whole (none: a whole conversation)."""
        table = table.sort_by("chunk")
        first, last = table["first"][0].as_py(), table["last"][0].as_py()
        start = START if first is None or first < 0 else np.where(np.arange(K) == first, 0.0, -np.inf)
        states = trace(list(_matrices(table["m"].combine_chunks())), start, last)
        before = [-1 if first is None else first, *states[:-1]]
        return pa.table({"conv": table["conv"], "chunk": table["chunk"], "before": pa.array(before, pa.int32()), "after": pa.array(states, pa.int32())})

    # only conversations of several chunks have borders
    long = measured.where("number = " + str(chunk)).select(F.col("conv").alias("of")).distinct()
    parts = measured.select("conv", "chunk", "number", "m").join(long, F.col("conv").eqNullSafe(F.col("of")), "left_semi")
    schema, found = f"conv {kind}, chunk long, m array<double>", f"conv {kind}, chunk long, before int, after int"
    # a tree over the chunks of a conversation: no group has more than FAN parts, however long it is
    tree = [parts.groupBy("conv", "chunk").applyInArrow(combine, schema)]
    most = (measured.agg(F.max("number")).first()[0] or 0) // chunk + 1
    while most > FAN:
        tree[-1] = materialise(tree[-1])
        up = tree[-1].select("conv", F.floor(F.col("chunk") / FAN).cast("long").alias("chunk"), F.col("chunk").alias("number"), "m")
        tree.append(up.groupBy("conv", "chunk").applyInArrow(combine, schema))
        most = -(-most // FAN)
    none = F.lit(None).cast("int")
    ends = tree[-1].withColumns({"first": none, "last": none}).groupBy("conv").applyInArrow(borders, found)
    for level in reversed(tree[:-1]):
        above = ends.select(F.col("conv").alias("of"), F.col("chunk").alias("parent"), F.col("before").alias("first"), F.col("after").alias("last"))
        held = level.withColumn("group", F.floor(F.col("chunk") / FAN).cast("long")).join(above, F.col("conv").eqNullSafe(F.col("of")) & (F.col("group") == F.col("parent")))
        ends = held.groupBy("conv", "group").applyInArrow(borders, found)
    same = F.col("l.conv").eqNullSafe(F.col("r.conv")) & (F.col("l.chunk") == F.col("r.chunk"))
    both = measured.alias("l").join(ends.alias("r"), same, "left").select("l.*", "r.before", "r.after")

    def label(batches):
        """Chunks stand together and in order; one at a time is held, and a batch of results."""
        kinds = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        types = [None, pa.int64(), pa.string(), kinds, pa.string()]
        out: list[list] = [[] for _ in types]
        held: list[tuple] = []

        def settle() -> None:
            if held:
                roles, turns = _label(held[0][4], held[0][5], [h[6] for h in held], [h[3] for h in held])
                for c, v in zip(out, ([h[0] for h in held], [h[2] for h in held], roles, turns, map(canonical, turns)), strict=True):
                    c.extend(v)
                held.clear()

        def result() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["conv", "pos", "role", "turns", "rendered"])
            for c in out:
                c.clear()
            return batch

        for batch in batches:
            types[0] = batch.schema.field("conv").type
            columns = [batch.column(c).to_pylist() for c in ("conv", "chunk", "pos", "text", "before", "after")]
            for row in zip(*columns, _matrices(batch.column("m")), strict=True):
                if held and held[0][:2] != row[:2]:
                    settle()
                    if len(out[0]) >= 1000:
                        yield result()
                held.append(row)
        settle()
        if out[0]:
            yield result()

    ordered = both.repartition("conv", "chunk").sortWithinPartitions("conv", "chunk", "number")
    return ordered.mapInArrow(label, f"conv {kind}, pos long, role string, turns array<struct<role:string,text:string>>, rendered string")
