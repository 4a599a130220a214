"""The second arm of guarded aggregates: verbatim cells, read and added up by another evaluator.

The first arm is column expressions over typed companions.  This one reads the cells themselves in
Arrow batches, one character after the other and in decimal arithmetic, and adds up exactly within
a task.  An error in either reading of numbers, or in the companions, makes the arms disagree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the grammar.
WORDS = {"thousand": 3, "million": 6, "billion": 9, "trillion": 12}
LETTERS = {"k": 3, "m": 6, "b": 9, "t": 12}
DIGITS = "0123456789"
SCHEMA = "told long, numbers long, total double, low double, high double"


def read_number(cell: str) -> Decimal | None:
    """The number that a cell reads as; None if it is none."""
    rest, minus = cell.strip().lower(), False
    if len(rest) > 1 and rest[0] == "(" and rest[-1] == ")":
        rest, minus = rest[1:-1].strip(), True
    if rest[:1] in ("$", "€", "£"):
        rest = rest[1:].lstrip()
        if rest[:1] == "-":
            rest, minus = rest[1:].lstrip(), not minus
    if rest[:1] in ("-", "+"):
        minus ^= rest[0] == "-"
        rest = rest[1:].lstrip()
    if rest[:1] == "-":
        rest, minus = rest[1:], not minus
    whole, tail = [], rest
    while tail[:1] and tail[0] in DIGITS + ",":
        whole.append(tail[0])
        tail = tail[1:]
    part = []
    if tail[:1] == ".":
        tail = tail[1:]
        while tail[:1] and tail[0] in DIGITS + ",":
            part.append(tail[0])
            tail = tail[1:]
        if not any(c in DIGITS for c in part):
            return None
    digits = "".join(c for c in whole if c != ",")
    if not digits:
        return None
    last = (part or whole)[-1]
    power = 0
    word = next((w for w in WORDS if tail.lstrip().startswith(w)), None)
    if word:
        power, tail = WORDS[word], tail.lstrip()[len(word) :]
    elif tail[:1] in LETTERS and tail and last in DIGITS:
        power, tail = LETTERS[tail[0]], tail[1:]
    if tail.strip() not in ("", "%"):
        return None
    value = Decimal(digits + "." + ("".join(c for c in part if c != ",") or "0")).scaleb(power)
    return -value if minus else value


def partial(rows: DataFrame, column: str, read: Callable[[str], Decimal | None] = read_number) -> DataFrame:
    """One row for each task: cells that are not empty, those that are numbers, their sum and their ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told, n, total, low, high = 0, 0, Fraction(0), None, None
        for batch in batches:
            for cell in batch.column(0).to_pylist():
                if cell is None or not cell.strip():
                    continue
                told += 1
                value = read(cell)
                if value is not None:
                    n, total = n + 1, total + Fraction(value)
                    low, high = value if low is None else min(low, value), value if high is None else max(high, value)
        yield pa.RecordBatch.from_pydict({"told": [told], "numbers": [n], "total": [float(total)], "low": [None if low is None else float(low)], "high": [None if high is None else float(high)]}, schema=pa.schema([("told", pa.int64()), ("numbers", pa.int64()), ("total", pa.float64()), ("low", pa.float64()), ("high", pa.float64())]))

    return rows.select(F.col(f"`{column}`").cast("string").alias("cell")).mapInArrow(run, SCHEMA)


def recomputed(rows: DataFrame, function: str, column: str, read: Callable[[str], Decimal | None] = read_number) -> DataFrame:
    """One row ``again``: the aggregate over the verbatim cells of ``rows``; null over no number (COUNT: 0)."""
    if column == "*":
        return rows.agg(F.count(F.lit(1)).cast("double").alias("again"))
    p = partial(rows, column, read)
    n = F.sum("numbers")
    value: dict[str, Column] = {"count": F.coalesce(F.sum("told"), F.lit(0)).cast("double"), "sum": F.when(n > 0, F.sum("total")), "avg": F.when(n > 0, F.sum("total") / n), "min": F.min("low"), "max": F.max("high")}
    return p.agg(value[function].alias("again"))


def agree(first: Column, again: Column) -> Column:
    """Both null, or both finite and within ``max(1, 1e-6 |again|)``."""
    finite = lambda c: ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return F.coalesce(finite(first) & finite(again) & (F.abs(first - again) <= F.greatest(F.lit(1.0), F.abs(again) * 1e-6)), F.lit(False))
