"""Readers of text files, record files, evaluation sets and answers."""

from __future__ import annotations

import html
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..operators import chunking

ITEM = "id string, query_type string, difficulty string, negative string, question string, expected_answer string, expected_pdfs string, expected_record_ids string"


def decode_bytes(raw: bytes) -> str:
    """UTF-8 with or without a mark, else GB 18030, else UTF-8 with replacements."""
    for encoding in ("utf-8-sig", "gb18030"):
        try:
            return raw.decode(encoding)
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8", "replace")


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [decode_bytes(x) for x in batch.column("content").to_pylist()]
        yield pa.record_batch([batch.column("path"), pa.array(texts, pa.string())], names=["path", "text"])


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files, whatever their encoding."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInArrow(_decoded, "path string, text string")


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files of JSON lines to records; one bad line fails its whole file."""
    for batch in batches:
        out: list[tuple[str, int | None, str | None, str | None]] = []
        for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist()):
            rows: list[tuple[str, int | None, str | None, str | None]] = []
            for n, line in enumerate(text.splitlines(), 1):
                if not line.strip():
                    continue
                try:
                    rows.append((path, n, json.dumps(json.loads(line), ensure_ascii=False), None))
                except ValueError:
                    rows = [(path, n, None, "invalid_jsonl")]
                    break
            out += rows or [(path, None, None, "empty_jsonl")]
        names = ("path", "line", "record", "error")
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string())
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds], names=names)


def json_line_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, record, error): the records of a file, or one row that says why it failed."""
    return text_files(spark, path).mapInArrow(_parsed, "path string, line long, record string, error string")


@F.pandas_udf(T.StringType())
def unescape_all(texts):
    """All HTML entities, where those of functions.text don't do."""
    return texts.map(lambda x: html.unescape(x) if isinstance(x, str) else x)


def markdown_records(files: DataFrame, most: int = 4000) -> DataFrame:
    """(path, text) to path, title, part, content: title from the front matter, the first heading or the name."""
    meta, body = tx.front_matter(F.col("text"))
    stem = F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1)
    parts = files.select("path", meta.alias("meta"), body.alias("body")).select(
        "path", F.coalesce(F.nullif(F.try_element_at("meta", F.lit("title")), F.lit("")), tx.first_heading(F.col("body")), stem).alias("title"), tx.clean_markup(unescape_all("body")).alias("clean")
    )
    return parts.select("path", "title", F.posexplode(chunking.records(F.col("clean"), most)).alias("part", "content"))


def evaluation_items(spark: SparkSession, path: str) -> DataFrame:
    """Questions from CSV (by the suffix) or JSON lines; lists may be JSON arrays or words between | or ;."""
    if path.endswith(".csv"):
        raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    else:
        raw = spark.read.text(path).where("trim(value) <> ''").select(F.from_json("value", ITEM).alias("r")).select("r.*")
    have = {c.lstrip("﻿"): c for c in raw.columns}
    col = lambda name: F.col(f"`{have[name]}`") if name in have else F.lit(None).cast("string")
    return raw.select(
        *(F.coalesce(col(c), F.lit("")).alias(c) for c in ("id", "query_type", "difficulty", "question", "expected_answer")),
        tx.parse_bool(col("negative")).alias("negative"), tx.as_list(col("expected_pdfs")).alias("expected_pdfs"), tx.as_list(col("expected_record_ids")).alias("expected_record_ids"),
    )


def answers(spark: SparkSession, path: str) -> DataFrame:
    """(id, answer) from JSON lines; the last of equal ids counts, a line without one fails the read."""
    names = ("id", "eval_id", "answer", "generated_answer")
    parsed = spark.read.json(path, T.StructType([T.StructField(n, T.StringType()) for n in names])).withColumn("_at", F.monotonically_increasing_id())
    own = F.coalesce(F.nullif("id", F.lit("")), F.nullif("eval_id", F.lit("")), F.raise_error(F.lit("an answer has no id")))
    chosen = parsed.select(own.alias("id"), F.coalesce(F.nullif("answer", F.lit("")), "generated_answer", F.lit("")).alias("answer"), "_at")
    return chosen.groupBy("id").agg(F.max_by("answer", "_at").alias("answer"))


def parse_env(text: str) -> dict[str, str]:
    """KEY=value lines; comments, `export` and quotes are understood."""
    out = {}
    for line in map(str.strip, text.splitlines()):
        key, equals, value = line.removeprefix("export ").partition("=")
        if not equals or line.startswith("#") or not key.strip():
            continue
        value = value.strip()
        if value[:1] not in ("'", '"'):
            value = value.split(" #", 1)[0].rstrip()
        elif len(value) > 1 and value[-1] == value[0]:
            value = value[1:-1]
        out[key.strip()] = value
    return out
