"""Sources and sinks: entries, chunks, vectors, evaluation sets, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SECTIONS = "array<struct<section_name:string,content:string,table_markdown:string,raw_paragraphs:array<string>>>"
ENTRIES = f"drug_name string, pinyin_name string, latin_name string, parent_drug string, is_sub_formulation boolean, is_yinpian boolean, category_hint string, intro_text string, sections {SECTIONS}, para_start int, para_end int"
CHUNKS = "chunk_id string, content string, drug_name string, pinyin_name string, latin_name string, category string, section string, chunk_type string, is_yinpian boolean, is_sub_formulation boolean, parent_drug string, table_markdown string, char_count int"
EVAL_SET = "name string, version string, description string, metrics map<string,string>, queries array<struct<id:string,type:string,query:string,expected_drugs:array<string>,expected_sections:array<string>,expected_answer_keywords:array<string>,follow_up:string>>"


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ENTRIES).json(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHUNKS).json(path)


def write_vectors(df: DataFrame, path: str, append: bool = False) -> None:
    """Append adds rows as they are; ids are not made unique."""
    df.write.mode("append" if append else "overwrite").parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def create_chunk_table(spark: SparkSession, name: str, path: str | None = None, buckets: int = 0, by: str = "drug_name") -> None:
    """An empty table of chunks in the catalog, if it is not there; bucketed by ``by`` on
    request, so that joins and filters on it need no shuffle."""
    where = f" LOCATION '{path}'" if path else ""
    clustered = f" CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS" if buckets else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({CHUNKS}) USING parquet{clustered}{where}")


def truncate(spark: SparkSession, path: str) -> None:
    """Empty the table at ``path`` and keep its schema."""
    schema = spark.read.parquet(path).schema
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def read_eval_set(spark: SparkSession, path: str, kind: str | None = None, limit: int | None = None) -> DataFrame:
    """Cases in file order, filtered by type, then cut to ``limit``."""
    cases = spark.read.schema(EVAL_SET).json(path, multiLine=True).select(F.posexplode("queries").alias("pos", "q")).select("pos", "q.*")
    if kind:
        cases = cases.filter(F.col("type") == kind)
    ordered = cases.orderBy("pos")
    return ordered.limit(limit) if limit else ordered


def report_json(report: DataFrame, by_type: DataFrame) -> DataFrame:
    """One JSON document from a one-row report and its breakdown, a few rows."""
    nested = by_type.agg(F.collect_list(F.struct(*by_type.columns)).alias("by_type"))
    return report.crossJoin(nested).select(F.to_json(F.struct("*")).alias("json"))  # one row each


def write_report(report: DataFrame, by_type: DataFrame, results: DataFrame, path: str) -> None:
    """The document under ``path/report``, and the rows of the evaluation, which may be many,
    as JSON lines under ``path/results``."""
    report_json(report, by_type).coalesce(1).write.mode("overwrite").text(f"{path}/report")
    results.write.mode("overwrite").json(f"{path}/results")
