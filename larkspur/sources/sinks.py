"""Sinks: sorted JSON lines, JSON documents, evaluation CSV, Markdown reports, the streams of a preparation."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text as one file, through the file system that the path names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_json(spark: SparkSession, path: str, value: object) -> None:
    """A small value as a JSON document with an indent of two."""
    write_text(spark, path, json.dumps(value, ensure_ascii=False, indent=2, default=str) + "\n")


def write_json_lines(df: DataFrame, path: str) -> None:
    """One object a row, keys in order of name, nulls written."""
    df.select(*sorted(df.columns)).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_items_csv(items: DataFrame, path: str) -> None:
    """Lists joined with semicolons."""
    flat = [F.array_join(c, ";").alias(c) if kind.startswith("array<string") else F.col(c) for c, kind in items.dtypes]
    items.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_prepared(records: DataFrame, path: str) -> DataFrame:
    """records has an error column: rows without one go to corpus, the others to failures, both from
    one written pass. Gives the number of rows for each error."""
    spark = records.sparkSession
    status = records if "status" in records.columns else records.withColumn("status", F.when(F.col("error").isNull(), "corpus").otherwise("failures"))
    status.write.mode("overwrite").partitionBy("status").parquet(f"{path}/all")
    return spark.read.parquet(f"{path}/all").groupBy("status", "error").agg(F.count("*").alias("rows"))


def shown(value: object) -> str:
    """n/a for nothing, four decimals for a float."""
    return "n/a" if value is None else f"{value:.4f}" if isinstance(value, float) else str(value)


def markdown_lines(title: str, columns: list[str], rows: Iterable[Iterable]) -> list[str]:
    return [f"## {title}", "", "| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *("| " + " | ".join(map(shown, r)) + " |" for r in rows), ""]


def markdown_table(small: DataFrame, title: str) -> str:
    """A report of an aggregate; only small results are meant to come here."""
    lines = markdown_lines(title, small.columns, small.collect())
    return "\n".join([lines[0][1:], *lines[1:-1]]) + "\n"
