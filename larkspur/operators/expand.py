"""Query expansion, hypothetical documents, source routing and citations, as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import CJK, STANDARD_ID, STANDARD_PDF, strip

#: term: words to add, in order. Pass a dictionary of your own for your domain.
SYNONYMS = {
    "test": ["trial", "examination", "testing"], "data": ["telemetry", "information"], "design": ["architecture", "layout"], "safety": ["risk", "hazard"], "control": ["regulation"],
    "system": ["platform", "assembly"], "water": ["liquid", "moisture"], "light": ["illumination"], "model": ["pattern", "template"], "value": ["worth", "amount"],
}
MOST_VARIANTS, MOST_PARTS, LEAST_LENGTH, MOST_WORDS = 5, 6, 200, 6


def _lookup(table: dict[str, list[str]]) -> Column:
    pairs = [x for term, words in table.items() for x in (F.lit(term), F.array(*map(F.lit, words)))]
    return F.create_map(*pairs)


def synonym_variants(query: Column, table: dict[str, list[str]] = SYNONYMS, most: int = MOST_VARIANTS) -> Column:
    """The query, then the query with one synonym of one of its words added, at most `most`."""
    words = F.regexp_extract_all(query, F.lit(rf"([A-Za-z0-9._-]+|[{CJK}])"), 1)
    mapped = _lookup(table)
    added = F.flatten(F.transform(words, lambda w: F.filter(F.coalesce(F.try_element_at(mapped, F.lower(w)), F.array().cast("array<string>")), lambda s: F.lower(s) != F.lower(w))))
    added = F.array_distinct(F.filter(added, lambda s: ~F.array_contains(words, s)))
    return F.slice(F.array_distinct(F.concat(F.array(query), F.transform(added, lambda s: F.concat(query, F.lit(" "), s)))), 1, most)


def subquery_variants(query: Column, most: int = MOST_PARTS) -> Column:
    """The query, its parts of 2 characters or more, and with 3 CJK characters its bigrams."""
    cjk = F.regexp_extract_all(query, F.lit(f"([{CJK}])"), 1)
    chinese = F.split(query, "[的与和及、,， ]+")
    latin = F.split(query, r"(?i)\s+(?:and|or|&)\s*|[\s,;]\s*")
    parts = F.filter(F.when(F.size(cjk) > 0, chinese).otherwise(latin), lambda p: F.length(p) >= 2)
    bigrams = F.array_join(F.zip_with(F.slice(cjk, 1, F.greatest(F.size(cjk) - 1, F.lit(0))), F.slice(cjk, 2, F.greatest(F.size(cjk), F.lit(1))), lambda a, b: F.concat(a, b)), " ")
    more = F.when(F.size(cjk) >= 3, F.array(F.concat(query, F.lit(" "), bigrams))).otherwise(F.array().cast("array<string>"))
    return F.slice(F.array_distinct(F.concat(F.array(query), parts, more)), 1, most)


def hypothetical(query: Column, table: dict[str, list[str]] = SYNONYMS, repeats: int = 3) -> Column:
    """The query, up to MOST_WORDS words of its domain, the query again, filled up to LEAST_LENGTH."""
    words = F.regexp_extract_all(F.lower(query), F.lit(rf"([A-Za-z]+|[{CJK}])"), 1)
    mapped = _lookup(table)
    added = F.slice(F.flatten(F.transform(words, lambda w: F.coalesce(F.try_element_at(mapped, w), F.array().cast("array<string>")))), 1, MOST_WORDS)
    parts = F.concat(F.array(query), F.when(F.size(added) > 0, F.array(F.array_join(added, " "))).otherwise(F.array().cast("array<string>")), F.array_repeat(query, max(1, repeats) - 1))
    text = F.array_join(parts, ". ")
    times = F.ceil(F.greatest(LEAST_LENGTH - F.length(text), F.lit(0)) / (F.length(query) + 1)).cast("int")
    return F.concat(text, F.repeat(F.concat(F.lit(" "), query), times))


def variants(queries: DataFrame, of: Column) -> DataFrame:
    """query_id, place, variant: a row for each string of `of`."""
    return queries.select("query_id", F.posexplode(of).alias("place", "variant"))


def routed_titles(query: Column) -> Column:
    """Titles of PDF files that the query names."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(query, F.lit(STANDARD_PDF), 1)))


def routed_standards(query: Column) -> Column:
    """Standards that the query names, unless it names files."""
    found = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(query, F.lit(f"{STANDARD_ID[:4]}({STANDARD_ID[4:]})"), 1), F.upper)))
    return F.when(F.size(routed_titles(query)) == 0, found).otherwise(F.array().cast("array<string>"))


def matches(metadata: Column, wanted: dict[str, str | list[str] | None]) -> Column:
    """All keys of a map column are equal, or one of a list; a missing key equals None, an empty list matches nothing."""
    out = F.lit(True)
    for key, value in wanted.items():
        own = F.try_element_at(metadata, F.lit(key))
        out = out & (F.coalesce(own.isin(value), F.lit(False)) if isinstance(value, list) else own.eqNullSafe(F.lit(value)))
    return out


def citation(source: Column, section: Column, title: Column, start: Column, end: Column, chunk_id: Column, index: Column | None = None) -> Column:
    """[i] file, section s t, pp.a-b, chunk_id=x, with n/a where something is missing."""
    text = lambda c: F.coalesce(strip(c.cast("string")), F.lit(""))
    section, title, start, end = map(text, (section, title, start, end))
    start, end = F.when(start == "", end).otherwise(start), F.when(end == "", start).otherwise(end)
    name = F.coalesce(F.nullif(F.regexp_extract(text(source), r"(?i)([^\\/]+\.pdf)", 1), F.lit("")), F.nullif(F.regexp_extract(text(source), r"[^/]*$", 0), F.lit("")), F.lit("unknown_source"))
    where = F.when((section == "") & (title == ""), "n/a").otherwise(strip(F.concat_ws(" ", section, title)))
    pages = F.when(start == "", "pp.n/a").when(start == end, F.concat(F.lit("p."), start)).otherwise(F.concat(F.lit("pp."), start, F.lit("-"), end))
    out = F.concat(name, F.lit(", section "), where, F.lit(", "), pages, F.lit(", chunk_id="), F.coalesce(F.nullif(text(chunk_id), F.lit("")), F.lit("n/a")))
    return out if index is None else F.concat(F.lit("["), index.cast("string"), F.lit("] "), out)
