"""Segments of a text within a budget of tokens, by any counter of tokens, and maps that keep each item's error.

The text is cut into atoms that never split (protected spans), parts that end behind a mark, and, where a part alone is
over the budget, pieces of it by characters; neighbours are joined while their joint count fits. Counts of joined texts
are asked of the counter, as tokens may merge. A text is one row of an Arrow batch; the counter is made once in each task.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Marks behind which a text may be cut.
MARKS = "，。！？、；：,.!?;:\n"
Counter = Callable[[str], int]


def atoms(text: str, protected: str | None) -> list[tuple[str, bool]]:
    """Pieces of a text, and whether they must stay whole."""
    out, at = [], 0
    for m in re.finditer(protected, text) if protected else ():
        if m.end() > m.start():
            out += [(text[at : m.start()], False), (m[0], True)]
            at = m.end()
    return [p for p in [*out, (text[at:], False)] if p[0]]


def _longest(text: str, at: int, count: Counter, budget: int) -> int:
    """End of the longest piece from ``at`` on within the budget, one character at least: doubling, then halving."""
    step, good = 1, at + 1
    while good < len(text) and count(text[at : min(len(text), good + step)]) <= budget:
        good = min(len(text), good + step)
        step *= 2
    bad = min(len(text), good + step)
    while bad - good > 1:
        middle = (good + bad) // 2
        good, bad = (middle, bad) if count(text[at:middle]) <= budget else (good, middle)
    return good


def split_by_tokens(text: str, count: Counter, budget: int, protected: str | None = None) -> list[str]:
    """Segments that join to ``text``; none is over ``budget`` but single atoms and characters that are."""
    if count(text) <= budget:
        return [text]
    parts: list[str] = []
    for piece, whole in atoms(text, protected):
        for part in [piece] if whole else re.findall(f"[^{MARKS}]*[{MARKS}]|[^{MARKS}]+", piece):
            if whole or count(part) <= budget:
                parts.append(part)
                continue
            at = 0
            while at < len(part):
                end = _longest(part, at, count, budget)
                parts.append(part[at:end])
                at = end
    out: list[str] = []
    for part in parts:
        if out and count(out[-1] + part) <= budget:
            out[-1] += part
        else:
            out.append(part)
    return out


def token_segments(rows: DataFrame, key: list[str], text: str, make_counter: Callable[[], Counter], budget: int, protected: str | None = None, prefix: str = "") -> DataFrame:
    """``key``, pos, segment, tokens. ``prefix`` is said before each segment and takes its tokens from the budget; null counts as empty."""
    given = rows.select(*key, F.coalesce(text, F.lit("")).alias("_text"))
    schema = T.StructType([*given.schema.fields[:-1], *T.StructType.fromDDL("pos int, segment string, tokens int").fields])

    def split(batches):
        count = make_counter()
        room = max(1, budget - (count(prefix) if prefix else 0))
        for batch in batches:
            for row in batch.to_pylist():
                segments = split_by_tokens(row.pop("_text"), count, room, protected)
                yield pa.RecordBatch.from_pylist([{**row, "pos": i, "segment": s, "tokens": count(s)} for i, s in enumerate(segments)], to_arrow_schema(schema))

    return given.mapInArrow(split, schema)


def mapped(rows: DataFrame, column: str, function: Callable[[object], object], kind: str, stop_after: float | None = None) -> DataFrame:
    """``rows`` with value and error: the function's result for each row, or what it raised; one bad row stops no other.

    A task that has run for ``stop_after`` seconds starts no further call; its other rows have the error "stopped".
    """
    schema = T.StructType([*rows.schema.fields, *T.StructType.fromDDL(f"value {kind}, error string").fields])
    kept = rows.columns

    def applied(batches):
        until = None if stop_after is None else time.monotonic() + stop_after
        whole = to_arrow_schema(schema)
        for batch in batches:
            values, errors = [], []
            for x in batch.column(kept.index(column)).to_pylist():
                value = error = None
                if until is not None and time.monotonic() >= until:
                    error = "stopped"
                else:
                    try:
                        value = function(x)
                    except Exception as e:  # noqa: BLE001  a row's error is its result
                        error = f"{type(e).__name__}: {e}"
                values.append(value)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, whole.field("value").type), pa.array(errors, pa.string())], schema=whole)

    return rows.mapInArrow(applied, schema)
