"""What the registered queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumflow.session import read_table

#: White space of all scripts, as a class that both pattern dialects understand.
SPACE = "[\\t\\n\\x0B\\f\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
BLANK = SPACE.replace("\\n", "")


def table(name: str):
    return lambda spark, folder: read_table(spark, folder, name)


def sections_of(spark: SparkSession, folder: str) -> DataFrame:
    """Sections of every delivered entry."""
    entries = read_table(spark, folder, "drug_entries")
    return entries.select("entry_id", "loaded_at", F.explode("sections").alias("s")).select("entry_id", "loaded_at", "s.section_id", "s.section_name", "s.content", "s.table_markdown")


SECTIONS_SQL = "SELECT entry_id, loaded_at, s.section_id, s.section_name, s.content, s.table_markdown FROM (SELECT entry_id, loaded_at, unnest(sections) AS s FROM drug_entries)"


def strip_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{SPACE}+', ''), '{SPACE}+$', '')"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def replace_sql(x: str, pairs) -> str:
    for a, b in pairs:
        x = f"replace({x}, {quoted(a)}, {quoted(b)})"
    return x


def list_sql(words) -> str:
    return "[" + ", ".join(map(quoted, words)) + "]"


def any_sql(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {quoted(w)})" for w in words) + ")"
