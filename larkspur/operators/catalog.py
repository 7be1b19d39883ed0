"""File catalogue: listing, policy by ordered rules, parse routes, hashes and summaries."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

IMAGES, ARCHIVES = [".png", ".jpg", ".jpeg", ".webp", ".gif"], [".7z", ".zip", ".rar"]
TEXTS, OFFICE = [".jsonl", ".json", ".txt", ".md", ".pdf"], [".doc", ".docx", ".xls", ".xlsx"]
ROUTES = {
    "pdf_text_first": [".pdf"], "markdown": [".md"], "html_fallback": [".html"], "jsonl_records": [".jsonl"], "json_document": [".json"], "word_document": [".doc", ".docx"],
    "spreadsheet_metadata": [".xls", ".xlsx"], "image_reference_only": IMAGES, "archive_deferred": ARCHIVES,
}


@dataclass(frozen=True)
class Policy:
    """Names of the top-level folders that the rules speak of."""

    standards: list[str] = field(default_factory=list)
    lessons: list[str] = field(default_factory=list)
    wikis: list[str] = field(default_factory=list)
    articles: list[str] = field(default_factory=list)
    publishers: list[str] = field(default_factory=list)
    keywords: list[str] = field(default_factory=list)
    deferred: dict[str, str] = field(default_factory=dict)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(F.regexp_extract(path, r"[^/]*$", 0), r"^.+(\.[^./]+)$", 1))


def parse_route(ext: Column) -> Column:
    out = F.lit("unsupported")
    for route, extensions in ROUTES.items():
        out = F.when(ext.isin(extensions), route).otherwise(out)
    return out


def policy(path: Column, ext: Column, rules: Policy) -> Column:
    """(action, reason) by the first rule that holds."""
    top = F.split(path, "/")[0]
    publisher = F.coalesce(F.try_element_at(F.split(path, "/"), F.lit(2)), F.lit(""))
    engineering = publisher.isin(rules.publishers)
    for word in rules.keywords:
        engineering = engineering | F.contains(path, F.lit(word))
    sheet, in_ = ext.isin(".xls", ".xlsx"), lambda names: top.isin(names)
    cases = [
        (ext.isin(ARCHIVES), "defer", "archive_deferred"),
        (ext.isin(IMAGES), "exclude", "image_reference_only"),
        (ext == ".py", "exclude", "tooling_file"),
        (in_(rules.standards) & ext.isin(TEXTS + OFFICE), "include", "strong_evidence"),
        (in_(rules.standards), "defer", "unsupported_standard_extension"),
        (in_(rules.lessons) & (ext == ".jsonl"), "include", "lesson_evidence"),
        (in_(rules.wikis) & (ext == ".md"), "include", "wiki_auxiliary"),
        (in_(rules.wikis) & sheet, "defer", "wiki_metadata_table"),
        (in_(rules.wikis), "defer", "wiki_non_markdown"),
        (in_(rules.articles) & (ext == ".md") & engineering, "include", "article_auxiliary"),
        (in_(rules.articles) & (ext == ".md"), "defer", "article_non_engineering_or_uncertain"),
        (in_(rules.articles) & (ext == ".html"), "defer", "article_html_fallback"),
        (in_(rules.articles) & (ext == ".pdf"), "defer", "article_pdf_deferred"),
        (in_(rules.articles), "exclude", "article_attachment"),
        *((top == name, "defer", reason) for name, reason in rules.deferred.items()),
        (sheet, "defer", "metadata_spreadsheet"),
    ]
    out = F.struct(F.lit("exclude").alias("action"), F.lit("not_in_mvp_profile").alias("reason"))
    for condition, action, reason in reversed(cases):
        out = F.when(condition, F.struct(F.lit(action).alias("action"), F.lit(reason).alias("reason"))).otherwise(out)
    return out


def source_type(reason: Column) -> Column:
    return F.when(reason == "strong_evidence", "standard").when(reason == "lesson_evidence", "lesson").when(reason == "wiki_auxiliary", "wiki").when(reason == "article_auxiliary", "article").otherwise("source")


def authority(kind: Column) -> Column:
    return F.when(kind.isin("standard", "lesson"), kind).otherwise("auxiliary")


def content_hash(content: Column, name: Column, size: Column, modified: Column, most_mb: int | None = None) -> Column:
    """sha1: of the bytes, or of name, size and time for files above most_mb."""
    mark = F.concat(F.lit("fingerprint:"), F.sha1(F.concat_ws("|", name, size.cast("string"), modified.cast("string"))))
    own = F.concat(F.lit("sha1:"), F.sha1(content))
    return own if most_mb is None else F.when(size > most_mb << 20, mark).otherwise(own)


def scan(spark: SparkSession, root: str, rules: Policy, hashes: str = "fingerprint", most_mb: int = 64) -> DataFrame:
    """A row for each file under root. Contents are read only for hashes = "content"."""
    if hashes not in ("none", "fingerprint", "content"):
        raise ValueError("hashes is none, fingerprint or content")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace(F.col("path"), "^[a-z]+:/*", "/")
    base = "/" + root.split(":", 1)[-1].strip("/") + "/"
    name = F.regexp_extract("relative_path", r"[^/]*$", 0)
    modified, size = F.col("modificationTime"), F.col("length")
    if hashes == "content":
        mark = content_hash(F.col("content"), name, size, modified, most_mb)
    else:
        mark = F.lit("") if hashes == "none" else F.concat(F.lit("fingerprint:"), F.sha1(F.concat_ws("|", name, size.cast("string"), modified.cast("string"))))
    listed = files.withColumn("relative_path", F.replace(path, F.lit(base), F.lit(""))).withColumn("extension", extension(F.col("relative_path")))
    return listed.select(
        "relative_path", name.alias("name"), F.split("relative_path", "/")[0].alias("top_level"), "extension", size.alias("size_bytes"), modified.alias("modified"), mark.alias("hash"),
        parse_route(F.col("extension")).alias("parse_route"), policy(F.col("relative_path"), F.col("extension"), rules).alias("p"),
    ).select("*", "p.action", "p.reason").drop("p")


def directory_summary(files: DataFrame) -> DataFrame:
    """top_level, files, size_bytes, size_mb, largest first."""
    return files.groupBy("top_level").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("size_bytes")).withColumn("size_mb", F.bround(F.col("size_bytes") / float(1 << 20), 2)).orderBy(F.desc("size_bytes"), "top_level")


def counts(files: DataFrame, column: str, most: int | None = None) -> DataFrame:
    found = files.groupBy(F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit("<none>")).alias(column)).agg(F.count("*").alias("files"))
    return found.orderBy(F.desc("files"), column).limit(most) if most else found


def upsert_latest(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The last row of each key."""
    last = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_place", F.row_number().over(last)).where("_place = 1").drop("_place")
