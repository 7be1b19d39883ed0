"""The manifest of a source library: scan outputs, reader, selection and summaries."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import markdown_lines, write_json, write_json_lines, write_text
from . import catalog

#: Columns of a manifest, as strings in JSON lines.
MANIFEST = "generated_at string, profile string, source_root string, source_path string, relative_path string, top_level string, name string, extension string, size_bytes long, modified timestamp, hash string, parse_route string, action string, reason string"
DEFAULT_ROUTES = ("markdown", "jsonl_records", "pdf_text_first")


def now() -> str:
    """The present time in UTC, in ISO form."""
    return datetime.now(UTC).isoformat()


@dataclass(frozen=True)
class ScanOptions:
    root: str
    out_dir: str
    rules: catalog.Policy = catalog.Policy()
    profile: str = "default"
    hash_mode: str = "fingerprint"
    content_hash_max_mb: int = 64


def count_map(files: DataFrame, key: list[str], column: str) -> DataFrame:
    """Of each key an array of (value, files), most frequent first, then by value."""
    value = F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit("<none>"))
    counted = files.groupBy(*key, value.alias("value")).agg(F.count("*").alias("n"))
    sorted_ = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "value")))
    return counted.groupBy(*key).agg(F.transform(sorted_, lambda x: F.struct(x["value"].alias("value"), (-x["less"]).alias("files"))).alias(column))


def totals(files: DataFrame) -> DataFrame:
    """files, size_bytes, size_gb in one row."""
    found = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("size_bytes"))
    return found.withColumn("size_gb", F.bround(F.col("size_bytes") / float(1 << 30), 2))


def directories(files: DataFrame, extensions: int = 8) -> DataFrame:
    """catalog.directory_summary with the most frequent extensions and all actions of each folder."""
    most = count_map(files, ["top_level"], "extension").select("top_level", F.slice("extension", 1, extensions).alias("extensions"))
    actions = count_map(files, ["top_level"], "action").select("top_level", F.array_sort("action").alias("actions"))
    return catalog.directory_summary(files).join(most, "top_level").join(actions, "top_level").orderBy(F.desc("size_bytes"), "top_level")


def summary(files: DataFrame, root: str, profile: str, generated_at: str) -> dict:
    """Totals, counts by action, route and extension, and folders. Only aggregates are collected:
    folders and extensions are those of the top level."""
    pairs = lambda rows: {r["value"]: r["files"] for r in rows}
    by = lambda column: {r[column]: r["files"] for r in catalog.counts(files, column).collect()}
    total = totals(files).first()
    return {
        "root": root, "profile": profile, "generated_at": generated_at, "totals": total.asDict(),
        "actions": dict(sorted(by("action").items())), "parse_routes": dict(sorted(by("parse_route").items())),
        "extensions": {r["extension"]: r["files"] for r in catalog.counts(files, "extension", 20).collect()},
        "directories": [r.asDict() | {"extensions": pairs(r["extensions"]), "actions": dict(sorted(pairs(r["actions"]).items()))} for r in directories(files).collect()],
    }


def summary_markdown(found: dict) -> str:
    flat = lambda d: ", ".join(f"{k}:{v}" for k, v in d.items())
    lines = ["# Scan summary", "", *(f"- {k}: {v}" for k, v in [("Root", found["root"]), ("Profile", found["profile"]), ("Generated at", found["generated_at"]), ("Files", found["totals"]["files"]), ("Size in GB", found["totals"]["size_gb"])]), ""]
    lines += markdown_lines("Actions", ["Action", "Files"], found["actions"].items())
    lines += markdown_lines("Folders", ["Folder", "Files", "Size in MB", "Actions", "Extensions"], [(d["top_level"], d["files"], d["size_mb"], flat(d["actions"]), flat(d["extensions"])) for d in found["directories"]])
    lines += markdown_lines("Parse routes", ["Route", "Files"], found["parse_routes"].items())
    return "\n".join(lines)


def scan(spark: SparkSession, options: ScanOptions) -> dict:
    """Write manifest (JSON lines), scan_summary.json and scan_summary.md of all files under the root."""
    generated_at = now()
    listed = catalog.scan(spark, options.root, options.rules, options.hash_mode, options.content_hash_max_mb)
    base = options.root.rstrip("/")
    files = listed.withColumns({
        "generated_at": F.lit(generated_at), "profile": F.lit(options.profile), "source_root": F.lit(base), "source_path": F.concat(F.lit(base + "/"), "relative_path"),
    })
    write_json_lines(files.orderBy("relative_path"), f"{options.out_dir}/manifest.jsonl")
    written = read(spark, f"{options.out_dir}/manifest.jsonl")
    found = summary(written, base, options.profile, generated_at)
    write_json(spark, f"{options.out_dir}/scan_summary.json", found)
    write_text(spark, f"{options.out_dir}/scan_summary.md", summary_markdown(found))
    return {"manifest_path": f"{options.out_dir}/manifest.jsonl", "files": found["totals"]["files"], "size_bytes": found["totals"]["size_bytes"], "actions": found["actions"], "generated_at": generated_at}


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a manifest; blank lines are skipped, a line that isn't JSON fails the read."""
    return spark.read.schema(MANIFEST).option("mode", "FAILFAST").json(path)


def select(manifest: DataFrame, action: str = "include", routes: tuple[str, ...] | None = None, limit: int | None = None) -> DataFrame:
    """Files to prepare, the first `limit` by path."""
    chosen = manifest.where((F.col("action") == action) & F.col("parse_route").isin(*(routes or DEFAULT_ROUTES)))
    return chosen if limit is None else chosen.orderBy("relative_path").limit(limit)

