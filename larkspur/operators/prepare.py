"""From selected files of a manifest to corpus records: readers by route, splitting, records, failures.

A task reads its own files; what follows are expressions. A file is atomic: if anything in it fails,
none of its records are kept and one failure says why.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..scratch import materialise
from ..sources.readers import decode_bytes, unescape_all
from ..sources.sinks import markdown_lines, write_json, write_json_lines, write_text
from . import catalog, chunking, clauses, manifest

LESSON_FIELDS = ["Subject", "Abstract", "Driving Event", "Lesson(s) Learned", "Recommendation(s)", "Evidence of Recurrence Control Effectiveness"]
LESSON_KEYS = ["Lesson Number", "Lesson Date", "Submitting Organization", "Program/Project Phase", "Mission Directorate(s)", "Topic(s)", "source_id"]
CORPUS = "generated_at string, doc_id string, record_id string, title string, content string, source_path string, relative_path string, source_type string, authority_level string, record_kind string, part_index int, source_record long, page int, page_start int, page_end int, section string, section_title string, standard_id string, metadata map<string,string>"
_UNITS = "relative_path string, unit long, kind string, text string, title string, fields map<string,string>, error string, message string"
_NAMES = [c.split()[0] for c in _UNITS.split(", ")]


class ParseFailure(Exception):
    """Why a file gives no records."""

    def __init__(self, reason: str, message: str = ""):
        super().__init__(message)
        self.reason, self.message = reason, message


@dataclass(frozen=True)
class PrepareOptions:
    manifest_path: str
    out_dir: str
    action: str = "include"
    routes: tuple[str, ...] | None = None
    max_record_chars: int = 6000
    limit: int | None = None
    pdf_chunk_mode: str = "page"
    banners: tuple[str, ...] = ()


def pdf_pages(raw: bytes) -> list[tuple[int, str]]:
    """(page from 1, text), by the first PDF library that is installed."""
    try:
        import pypdf

        return [(i, page.extract_text() or "") for i, page in enumerate(pypdf.PdfReader(io.BytesIO(raw)).pages, 1)]
    except ImportError:
        pass
    try:
        import pdfplumber

        with pdfplumber.open(io.BytesIO(raw)) as pdf:
            return [(i, page.extract_text() or "") for i, page in enumerate(pdf.pages, 1)]
    except ImportError:
        raise ParseFailure("missing_pdf_backend", "install pypdf or pdfplumber") from None


def _json_lines(text: str) -> Iterator[tuple]:
    found = False
    for n, line in enumerate(text.splitlines(), 1):
        if not line.strip():
            continue
        try:
            value = json.loads(line)
        except ValueError as e:
            raise ParseFailure("invalid_jsonl", f"line {n}: {e}") from e
        plain = {k: v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in value.items() if v is not None} if isinstance(value, dict) else {}
        yield n, "jsonl_record", json.dumps(value, ensure_ascii=False, indent=2), plain.get("Subject") or plain.get("title") or f"JSONL record {n}", plain
        found = True
    if not found:
        raise ParseFailure("empty_jsonl", "the file holds no records")


def _units(name: str, route: str, raw: bytes, pdf_mode: str, banners: frozenset[str], pages=pdf_pages) -> Iterator[tuple]:
    """(unit, kind, text, title, fields) of one file."""
    stem = name.rsplit(".", 1)[0] or name
    if route == "markdown":
        yield 0, "markdown_section", decode_bytes(raw), None, {}
    elif route == "jsonl_records":
        yield from _json_lines(raw.decode("utf-8"))
    elif route == "json_document":
        value = json.loads(decode_bytes(raw))
        yield 0, "json_document", json.dumps(value, ensure_ascii=False, indent=2), str(value.get("title")) if isinstance(value, dict) else stem, {}
    elif route == "pdf_text_first":
        found = pages(raw)
        cut = clauses.clauses(found, banners) if pdf_mode == "clause" else []
        for i, (section, title, first, last, body) in enumerate(cut, 1):
            yield i, "standard_clause", body, stem, {"section": section, "section_title": title, "page_start": str(first), "page_end": str(last), "clause_index": str(i), "pdf_chunk_mode": "clause"}
        if not cut:
            edges = clauses.repeated_edges(found, banners) if pdf_mode == "clause" else frozenset()
            why = {"fallback_reason": "clause_headings_not_found"} if pdf_mode == "clause" else {}
            for page, text in found:
                body = clauses.clean_page(text, edges, banners) if pdf_mode == "clause" else text
                if body.strip():
                    yield page, "pdf_page", body, stem, {"page_start": str(page), "page_end": str(page), "pdf_page": str(page), "pdf_chunk_mode": "page", **why}
                    cut = [page]
        if not cut:
            raise ParseFailure("needs_ocr_or_empty_pdf", "no text was found")
    else:
        raise ParseFailure("unsupported_route", f"no reader for {route}")


def _read(path: str) -> bytes:
    store, place = pafs.FileSystem.from_uri(path if "://" in path else "file://" + path)
    with store.open_input_stream(place) as file:
        return file.read()


def _reader(pdf_mode: str, banners: frozenset[str], pages=pdf_pages):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                try:
                    rows = [(row["relative_path"], *u, None, None) for u in _units(row["name"], row["parse_route"], _read(row["source_path"]), pdf_mode, banners, pages)]
                except ParseFailure as e:
                    rows = [(row["relative_path"], None, None, None, None, {}, e.reason, e.message)]
                except Exception as e:  # a file that can't be read is reported, the others go on
                    rows = [(row["relative_path"], None, None, None, None, {}, "unexpected_error", f"{type(e).__name__}: {e}")]
                kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), pa.string()]
                columns = [list(c) for c in zip(*rows)]
                columns[5] = [list(m.items()) for m in columns[5]]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=_NAMES)

    return run


def lesson_content(fields: Column) -> Column:
    """The fields of a lesson under headings, without empty ones and without "none"."""
    parts = [F.when(~F.lower(tx.strip(fields[f])).isin("", "none"), F.concat(F.lit(f"## {f}\n"), fields[f])) for f in LESSON_FIELDS]
    return F.array_join(F.array_compact(F.array(*parts)), "\n\n")


def is_lesson(reason: Column, fields: Column) -> Column:
    return (F.coalesce(reason, F.lit("")) == "lesson_evidence") | F.map_contains_key(fields, "Lesson Number")


def record_metadata(fields: Column) -> Column:
    """The keys of a JSON record that are kept."""
    return F.map_filter(fields, lambda k, v: k.isin(LESSON_KEYS))


def parts_of(units: DataFrame, most: int) -> DataFrame:
    """Units with title, part (from 1) and content of the pieces that they are split into."""
    meta, body = tx.front_matter(F.col("text"))
    fields, kind = F.col("fields"), F.col("kind")
    marked = units.withColumns({"front": F.when(kind == "markdown_section", meta), "body": F.when(kind == "markdown_section", tx.clean_markup(unescape_all(body)))})
    heading = tx.normalize_text(F.concat_ws(" ", fields["section"], fields["section_title"]))
    named = marked.withColumn("heading", F.when(kind == "standard_clause", heading))
    text = (
        F.when(kind == "markdown_section", F.col("body"))
        .when((kind == "jsonl_record") & is_lesson(F.col("reason"), fields), lesson_content(fields))
        .when(kind == "standard_clause", F.concat("heading", F.lit("\n\n"), "text"))
        .otherwise(F.col("text"))
    )
    ready = named.withColumn("clean", tx.normalize_text(text))
    # a record of a file without text stays as one empty part, which fails its file
    whole = F.when(F.col("clean") == "", F.array(F.lit(""))).otherwise(F.filter(chunking.pack_paragraphs(F.col("clean"), most), lambda x: x != ""))
    cut = ready.withColumn("pieces", F.when(kind.isin("jsonl_record", "standard_clause"), whole).otherwise(chunking.records(F.col("clean"), most)))
    stem = F.regexp_extract("name", r"^(.*?)(?:\.[^.]*)?$", 1)
    title = F.coalesce(F.col("title"), F.nullif(F.try_element_at("front", F.lit("title")), F.lit("")), tx.first_heading(F.col("body")), stem)
    each = cut.withColumn("title", title).select("*", F.posexplode("pieces").alias("at", "piece"))
    piece = F.when(F.col("heading").isNotNull() & ~F.startswith("piece", "heading"), tx.normalize_text(F.concat("heading", F.lit("\n\n"), "piece"))).otherwise(tx.normalize_text(F.col("piece")))
    return each.withColumns({"part_index": F.col("at") + 1, "content": piece}).drop("clean", "pieces", "at", "piece", "body", "text")


def records(parts: DataFrame, generated_at: str) -> DataFrame:
    """Corpus records with stable ids from parts of files and the columns of the manifest."""
    kind, fields = F.col("kind"), F.col("fields")
    source = catalog.source_type(F.col("reason"))
    line = F.when(kind == "jsonl_record", F.col("unit"))
    page = fields["page_start"].cast("int")
    key = F.concat_ws("|", "relative_path", "kind", F.coalesce(line.cast("string"), F.lit("")), F.coalesce(page.cast("string"), F.lit("")), F.col("part_index").cast("string"), F.substring("content", 1, 80))
    stem = F.regexp_extract("name", r"^(.*?)(?:\.[^.]*)?$", 1)
    base = F.map_from_arrays(F.array(*map(F.lit, ("top_level", "relative_path", "reason", "parse_route", "hash"))), F.array(*(F.coalesce(c, F.lit("")) for c in ("top_level", "relative_path", "reason", "parse_route", "hash"))))
    own = F.when(kind == "jsonl_record", F.map_concat(record_metadata(fields), F.create_map(F.lit("jsonl_line"), F.col("unit").cast("string")))).when(kind == "markdown_section", F.create_map(F.lit("frontmatter"), F.to_json("front"))).otherwise(fields)
    return parts.select(
        F.lit(generated_at).alias("generated_at"), tx.stable_id(F.concat_ws("|", "hash", "relative_path")).alias("doc_id"), tx.stable_id(key).alias("record_id"),
        F.coalesce(F.nullif(tx.normalize_text(F.col("title")), F.lit("")), "name").alias("title"), "content", "source_path", "relative_path", source.alias("source_type"), catalog.authority(source).alias("authority_level"),
        kind.alias("record_kind"), "part_index", line.alias("source_record"), page.alias("page"), page.alias("page_start"), fields["page_end"].cast("int").alias("page_end"), fields["section"].alias("section"), fields["section_title"].alias("section_title"),
        F.when(kind.isin("pdf_page", "standard_clause"), tx.standard_id(stem)).alias("standard_id"), F.map_concat(base, own).alias("metadata"),
    )


def parse_files(files: DataFrame, generated_at: str, most: int = 6000, pdf_mode: str = "page", banners: tuple[str, ...] = (), pages=pdf_pages) -> tuple[DataFrame, DataFrame]:
    """(records, failures) of the files of a manifest."""
    if most <= 0:
        raise ValueError("records need room for characters")
    if pdf_mode not in ("page", "clause"):
        raise ValueError("PDF files are cut by page or by clause")
    narrow = files.select("relative_path", "name", "parse_route", "source_path")
    units = materialise(narrow.mapInArrow(_reader(pdf_mode, frozenset(banners), pages), _UNITS), "units")
    about = files.select("relative_path", "name", "source_path", "top_level", "hash", "parse_route", "reason")
    failed = units.where("error IS NOT NULL").select("relative_path", F.col("error").alias("failure"), "message")
    parts = materialise(parts_of(units.where("error IS NULL").drop("error", "message").join(about, "relative_path"), most), "parts")
    empty = units.where("error IS NULL").select("relative_path").distinct().join(parts.select("relative_path").distinct(), "relative_path", "left_anti")
    blank = parts.where("content = ''").select("relative_path").distinct()
    failed = failed.unionByName(blank.select("relative_path", F.lit("empty_record").alias("failure"), F.lit("a record is empty after cleaning").alias("message")))
    failed = failed.unionByName(empty.select("relative_path", F.lit("empty_content").alias("failure"), F.lit("no text records were produced").alias("message")))
    failures = failed.join(about, "relative_path").select(F.lit(generated_at).alias("generated_at"), F.col("failure").alias("reason"), "message", "source_path", "relative_path", "parse_route", F.col("reason").alias("selected_for"))
    return records(parts.join(blank, "relative_path", "left_anti"), generated_at), failures


def prepare(spark: SparkSession, options: PrepareOptions, pages=pdf_pages) -> dict:
    """Write corpus.jsonl, parse_failures.jsonl, parse_report.json and parse_report.md; gives the report."""
    generated_at = manifest.now()
    files = materialise(manifest.select(manifest.read(spark, options.manifest_path), options.action, options.routes, options.limit), "selected")
    corpus, failures = parse_files(files, generated_at, options.max_record_chars, options.pdf_chunk_mode, options.banners, pages)
    write_json_lines(corpus, f"{options.out_dir}/corpus.jsonl")
    write_json_lines(failures, f"{options.out_dir}/parse_failures.jsonl")
    by = lambda df, c: {r[c]: r["files"] for r in catalog.counts(df, c).collect()}
    kinds, lost, routes = by(corpus, "source_type"), by(failures, "reason"), by(files, "parse_route")
    chosen, failed = sum(routes.values()), sum(lost.values())
    report = {
        "generated_at": generated_at, "manifest_path": options.manifest_path, "out_dir": options.out_dir, "selected_action": options.action, "selected_routes": sorted(options.routes or manifest.DEFAULT_ROUTES),
        "pdf_chunk_mode": options.pdf_chunk_mode, "selected_files": chosen, "parsed_files": chosen - failed, "failed_files": failed, "records": sum(kinds.values()),
        "routes": dict(sorted(routes.items())), "source_types": dict(sorted(kinds.items())), "failures": dict(sorted(lost.items())),
    }
    write_json(spark, f"{options.out_dir}/parse_report.json", report)
    write_text(spark, f"{options.out_dir}/parse_report.md", report_markdown(report))
    return report


def report_markdown(report: dict) -> str:
    keys = ("manifest_path", "out_dir", "generated_at", "selected_files", "parsed_files", "failed_files", "records")
    lines = ["# Preparation", "", *(f"- {k.replace('_', ' ')}: {report[k]}" for k in keys), ""]
    lines += markdown_lines("Source types", ["Type", "Records"], report["source_types"].items())
    return "\n".join(lines + markdown_lines("Failures", ["Reason", "Files"], report["failures"].items()))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Corpus records from JSON lines."""
    return spark.read.schema(CORPUS).json(path)


def corpus_chunks(corpus: DataFrame, allowed: DataFrame | None = None, limit: int | None = None, skip: int = 0) -> DataFrame:
    """Corpus records as chunks: chunk_id, doc_id, content, source_path, metadata, doc (PDF name).
    allowed: column doc with the names to keep, none or an empty one for all; skip and limit count
    in order of record_id."""
    name = tx.pdf_name(F.col("source_path"), F.col("relative_path"))
    extra = [c for c in ("title", "source_type", "authority_level", "record_kind", "relative_path", "page", "page_start", "page_end", "section", "section_title", "standard_id", "part_index", "record_id") if c in corpus.columns]
    promoted = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, extra)), F.array(*(F.col(c).cast("string") for c in extra))), lambda k, v: v.isNotNull())
    known = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    rest = F.map_filter(promoted, lambda k, v: ~F.map_contains_key(known, k))
    out = corpus.select(F.coalesce(F.nullif("record_id", F.lit("")), "doc_id").alias("chunk_id"), "doc_id", F.coalesce("content", F.lit("")).alias("content"), F.coalesce("source_path", F.lit("")).alias("source_path"), F.map_concat(known, rest).alias("metadata"), name.alias("doc"))
    if allowed is not None and allowed.limit(1).count():
        out = out.join(allowed.select("doc").distinct(), "doc", "left_semi").select(*out.columns)
    if skip or limit is not None:
        out = out.orderBy("chunk_id").offset(skip)
        out = out if limit is None else out.limit(limit)
    return out
