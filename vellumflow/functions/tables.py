"""Tables as Markdown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_markdown(rows: Column) -> Column:
    """``array<array<string>>`` as a Markdown table.

    The first row is the header; short rows are padded, long ones cut, line ends in cells
    become blanks. An empty table gives ''.
    """
    width = F.size(F.element_at(rows, 1))

    def line(row: Column) -> Column:
        padded = F.concat(row, F.array_repeat(F.lit(""), F.greatest(width - F.size(row), F.lit(0))))
        cells = F.transform(F.slice(padded, F.lit(1), width), lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "\\r?\\n", " "))
        return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    lines = F.transform(rows, line)
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    body = F.when(F.size(rows) > 1, F.slice(lines, F.lit(2), F.size(rows) - 1)).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(rows) < 1, F.lit("")).otherwise(F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), body), "\n"))
