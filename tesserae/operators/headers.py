"""Column labels that a parser left in front of a table, put back as its header.

A table is touched only if it looks mis-structured and there is exactly one label for each value
column; anything else is left as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.numbers import looks_like_value


def header_rows(grid: Column) -> Column:
    """How many leading rows hold a cell that is flagged as header."""
    plain = F.transform(grid, lambda row: ~F.exists(row, lambda c: F.coalesce(c["header"], F.lit(False))))
    first = F.array_position(plain, True)
    return F.when(first == 0, F.size(grid)).otherwise(first - 1)


def has_row_labels(grid: Column) -> Column:
    """Whether the first column holds labels: text somewhere, none of it a value, no cell flagged as header."""
    first = F.transform(grid, lambda row: F.try_element_at(row, F.lit(1)))
    told = F.filter(first, lambda c: F.trim(F.coalesce(c["text"], F.lit(""))) != "")
    return (F.size(told) > 0) & ~F.exists(told, lambda c: looks_like_value(c["text"])) & ~F.exists(first, lambda c: F.coalesce(c["header"], F.lit(False)))


def mis_structured(grid: Column) -> Column:
    """No header row; or one whose first cell is a plain row label and whose flagged value cells all read as values."""
    n, top = header_rows(grid), F.element_at(grid, 1)
    corner, flagged = F.try_element_at(top, F.lit(1)), F.filter(top, lambda c: F.coalesce(c["header"], F.lit(False)))
    label = ~F.coalesce(corner["header"], F.lit(False)) & (F.trim(F.coalesce(corner["text"], F.lit(""))) != "")
    valued = (F.size(flagged) > 0) & F.forall(flagged, lambda c: looks_like_value(F.coalesce(c["text"], F.lit(""))))
    return F.when(n == 0, True).otherwise((n == 1) & label & valued)


def labels_before(run: Column, wanted: Column) -> Column:
    """Labels of the texts that stand right before a table: parts between wide gaps; single words where those are too few."""
    wide = F.flatten(F.transform(run, lambda t: F.filter(F.split(F.trim(t), " {2,}"), lambda x: x != "")))
    single = F.flatten(F.transform(run, lambda t: F.filter(F.split(F.trim(t), r"\s+"), lambda x: x != "")))
    return F.when(F.size(wide) >= wanted, wide).otherwise(single)


def trailing_run(items: Column) -> Column:
    """Texts at the end of what precedes a table (kind, text): the last stretch without a blank text or another kind of item."""
    run = lambda acc, x: F.when(x["kind"].isin("heading", "text") & (F.trim(F.coalesce(x["text"], F.lit(""))) != ""), F.concat(acc, F.array(F.trim(x["text"])))).otherwise(F.slice(acc, 1, 0))
    return F.aggregate(items, F.array().cast("array<string>"), run)


def reattach(tables: DataFrame) -> DataFrame:
    """``tables`` (doc_id, table_id, grid, before) with ``header``: the labels put back, null where none are.

    ``grid``: rows of cells (text, header); ``before``: the items in front of the table in reading order (kind, text).
    """
    grid, width = F.col("grid"), F.size(F.element_at("grid", 1))
    t = tables.withColumn("_values", width - has_row_labels(grid).cast("int")).withColumn("_labels", labels_before(trailing_run(F.col("before")), F.col("_values")))
    fits = (F.size("grid") > 0) & mis_structured(grid) & (F.col("_values") > 0) & (F.size("_labels") == F.col("_values"))
    header = F.when(fits, F.when(F.col("_values") < width, F.concat(F.array(F.lit("")), "_labels")).otherwise(F.col("_labels")))
    return t.withColumn("header", header).drop("_values", "_labels")
