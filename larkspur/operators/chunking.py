"""Chunks, sections and records as expressions over one row's text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound, normalize_text, strip

CHUNK_CHARS, OVERLAP, LEAST_TOP_UP = 900, 120, 120
_NONE = "array<string>"


def windows(text: Column, size: int = CHUNK_CHARS, overlap: int = OVERLAP) -> Column:
    """Stripped windows that begin each size - overlap characters; none empty."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive, overlap at least 0 and smaller than size")
    step = size - overlap

    def cut(text: Column) -> Column:
        last = F.ceil(F.greatest(F.length(text) - size, F.lit(0)) / step).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: strip(F.substring(text, i * step + 1, size)))

    return F.filter(bound(strip(F.coalesce(text, F.lit(""))), cut), lambda x: x != "")


def chunk_documents(docs: DataFrame, id_col: str, text_col: str, size: int = CHUNK_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """chunk_id, doc_id, part, content; parts count from 1."""
    parts = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.posexplode(windows(F.col(text_col), size, overlap)).alias("part", "content"))
    return parts.select(F.format_string("%s_chunk_%04d", "doc_id", F.col("part") + 1).alias("chunk_id"), "doc_id", (F.col("part") + 1).alias("part"), "content")


def sections(text: Column) -> Column:
    """Parts that each begin with a Markdown heading, but for the first."""
    parts = F.split(normalize_text(text), r"\n(?=[ \t]{0,3}#{1,6}\s)")
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def pack_paragraphs(text: Column, most: int) -> Column:
    """Paragraphs packed in order up to `most` characters. One that is longer tops up what was
    begun if over LEAST_TOP_UP characters are free, and is then cut hard."""
    paragraphs = F.filter(F.transform(F.split(text, r"\n\s*\n"), strip), lambda x: x != "")
    one = lambda x: F.array(x)
    none = F.array().cast(_NONE)

    def cut(p: Column) -> Column:
        found = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(p) / most).cast("int") - 1, F.lit(0))), lambda i: strip(F.substring(p, i * most + 1, most)))
        return F.filter(found, lambda x: x != "")

    def step(a: Column, p: Column) -> Column:
        held, size = F.length(a["current"]), F.length(p)
        free = most - held - 2
        tops = (held > 0) & (free > LEAST_TOP_UP)
        first = F.when(tops, one(F.concat(a["current"], F.lit("\n\n"), F.substring(p, F.lit(1), free)))).when(held > 0, one(a["current"])).otherwise(none)
        rest = F.when(tops, F.substring(p, free + 1, size)).otherwise(p)
        whole = F.when(held == 0, p).otherwise(F.concat(a["current"], F.lit("\n\n"), p))
        full = (held > 0) & (held + size + 2 > most)
        return (
            F.when(size > most, F.struct(F.concat(a["chunks"], first, cut(rest)).alias("chunks"), F.lit("").alias("current")))
            .when(full, F.struct(F.concat(a["chunks"], one(a["current"])).alias("chunks"), p.alias("current")))
            .otherwise(F.struct(a["chunks"].alias("chunks"), whole.alias("current")))
        )

    packed = F.aggregate(
        paragraphs, F.struct(none.alias("chunks"), F.lit("").alias("current")), step, lambda a: F.when(a["current"] != "", F.concat(a["chunks"], one(a["current"]))).otherwise(a["chunks"])
    )
    return F.when(F.length(text) <= most, F.array(text)).otherwise(packed)


def records(text: Column, most: int) -> Column:
    """Sections, each packed up to `most` characters."""
    return F.filter(F.flatten(F.transform(sections(text), lambda s: pack_paragraphs(s, most))), lambda x: x != "")
