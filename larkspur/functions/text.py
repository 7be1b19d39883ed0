"""Text functions as column expressions. Patterns are written so that Java and RE2 read them alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All white space of Unicode, in a form for Java and RE2.
SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: White space that normalising changes: all runs but single blanks.
_RUN = SPACE.replace(r"\x{1c}-\x{20}", r"\x{1c}-\x{1f}") + SPACE + "*| " + SPACE + "+"
CJK = r"\x{4e00}-\x{9fff}"
BM25_TOKEN = rf"[a-z0-9._-]+|[{CJK}]"
HASH_TOKEN = r"[\p{L}\p{N}]+"
CONTENT_TOKEN = rf"[a-z0-9][a-z0-9._-]*|[{CJK}]"
LINE_END = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
STOPWORDS = "the of and to in a is for on that with as are by at from it this an be or has have their".split()
ABSTENTIONS = ["insufficient information", "cannot determine", "no supported answer", "not found", "not provided", "not in these", "not in the selected", "没有找到", "无法找到", "无法确定", "资料中没有"]
STANDARD_ID = r"(?i)\bECSS-[A-Z]-[A-Z]{1,3}-\d{2}(?:-\d{2})?[A-Z]?\b"
STANDARD_PDF = r"(?i)\b(ECSS-[A-Z]-[A-Z]{1,3}-\d{2}(?:-\d{2})?[A-Z]?\([^)]*\))\.pdf\b"
CRITICAL = [
    r"(?i)\bECSS-[A-Z]-[A-Z]{1,2}-\d{2}(?:-\d{2})?[A-Z]?\b",
    r"\b\d+(?:\.\d+){1,5}\b",
    r"(?i)\b\d+(?:\.\d+)?[ \t\n]*(?:%|V|A|W|Hz|kHz|MHz|GHz|mN|N|kg|mm|cm|m|s|ms)\b",
]


def bound(value: Column, f) -> Column:
    """f(value) with the value computed once a row: inside lambdas, and where f uses it several
    times, it would be computed again and again."""
    return F.element_at(F.transform(F.array(value), f), 1)


def strip(text: Column) -> Column:
    """Without white space at both ends, as Python's strip."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+\z", "")


def normalize_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), _RUN, " "))  # what is left to strip is blanks


def normalize_lower(text: Column) -> Column:
    return normalize_space(F.lower(text))


def normalize_text(text: Column) -> Column:
    """Line ends to \\n, runs of blanks to one, at most one empty line, stripped."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n")
    return strip(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


#: The entities that are decoded, &amp; last.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def unescape(text: Column) -> Column:
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def clean_markup(text: Column) -> Column:
    """Markdown images and links to their words, tags to blanks or line ends, entities decoded."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), r"!\[([^\]]*)\]\([^)]+\)", "$1")
    text = unescape(F.regexp_replace(text, r"\[([^\]]+)\]\([^)]+\)", "$1"))
    text = F.regexp_replace(text, r"(?i)<br[ \t\n]*/?>|</(?:p|div|tr|li|h[0-9]|table|tbody|thead)>", "\n")
    return normalize_text(F.regexp_replace(text, r"<[^>]+>", " "))


def first_heading(text: Column) -> Column:
    return F.nullif(strip(F.regexp_extract(text, r"(?m)^[ \t]{0,3}#{1,6}[ \t]+(.+?)[ \t]*$", 1)), F.lit(""))


def front_matter(text: Column) -> tuple[Column, Column]:
    """(map of the leading block between --- lines, the rest)."""
    parts = F.split(text, "---", 3)
    has = text.startswith("---") & (F.size(parts) == 3)
    lines = F.filter(F.split(F.try_element_at(parts, F.lit(2)), "\n"), lambda x: F.contains(x, F.lit(":")))
    pairs = F.transform(
        lines,
        lambda x: F.struct(
            strip(F.substring_index(x, ":", 1)).alias("key"),
            F.regexp_replace(strip(F.substring(x, F.instr(x, ":") + 1, F.length(x))), '^"+|"+$', "").alias("value"),
        ),
    )
    # the last of equal keys counts
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    empty = F.create_map().cast("map<string,string>")
    return F.when(has, F.map_from_entries(last)).otherwise(empty), F.when(has, F.try_element_at(parts, F.lit(3))).otherwise(text)


def lines(text: Column) -> Column:
    """Lines as Python's splitlines."""
    out = F.split(text, LINE_END)
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).when(F.element_at(out, -1) == "", F.slice(out, 1, F.size(out) - 1)).otherwise(out)


def bm25_tokens(text: Column, ngrams: int = 2) -> Column:
    """Latin runs and CJK characters, then n-grams over the CJK characters in order, gaps ignored."""
    lower, none = F.lower(F.coalesce(text, F.lit(""))), F.array().cast("array<string>")

    def grams(single: Column) -> Column:
        n = F.size(single)
        parts = [F.when(n > 1, F.zip_with(F.slice(single, 1, F.greatest(n - 1, F.lit(0))), F.slice(single, 2, n), lambda a, b: F.concat(a, b))).otherwise(none)]
        if ngrams > 2:
            triples = F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.array_join(F.slice(single, i, 3), ""))
            parts.append(F.when(n > 2, triples).otherwise(none))
        return F.concat(*parts)

    base = F.regexp_extract_all(lower, F.lit(f"({BM25_TOKEN})"), 1)
    # only a text with two such characters has n-grams, and is read for them
    single = F.regexp_extract_all(lower, F.lit(f"([{CJK}])"), 1)
    return F.when(lower.rlike(f"(?s)[{CJK}].*[{CJK}]"), F.concat(base, bound(single, grams))).otherwise(base)


def hash_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({HASH_TOKEN})"), 1)


def rerank_tokens(text: Column) -> Column:
    return F.filter(F.split(F.translate(F.lower(F.coalesce(text, F.lit(""))), "\n", " "), " "), lambda t: t != "")


def content_tokens(text: Column) -> Column:
    found = F.regexp_extract_all(normalize_lower(text), F.lit(f"({CONTENT_TOKEN})"), 1)
    return F.filter(found, lambda t: t.rlike(f"^[{CJK}]$") | ((F.length(t) > 1) & ~t.isin(STOPWORDS)))


def sentences(text: Column) -> Column:
    """Sentences, of at least 4 characters and with a content token."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), rf"([.!?。！？]){SPACE}+", "$1\n")
    parts = F.transform(F.split(marked, r"\n+"), normalize_space)
    return F.filter(parts, lambda s: (F.length(s) >= 4) & (F.size(content_tokens(s)) > 0))


def is_abstention(text: Column) -> Column:
    words = normalize_lower(text)
    out = F.lit(False)
    for pattern in ABSTENTIONS:
        out = out | F.contains(words, F.lit(pattern))
    return out


def critical_terms(text: Column) -> Column:
    return F.concat(*(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"{p[:4] if p[:4] == '(?i)' else ''}({p.removeprefix('(?i)')})"), 1) for p in CRITICAL))


def stable_id(text: Column) -> Column:
    return F.substring(F.sha1(text), 1, 16)


def as_list(text: Column) -> Column:
    """A JSON array, or words between | or ;, stripped, without empty ones."""
    text = strip(F.coalesce(text, F.lit("")))
    parsed = F.from_json(text, "array<string>", {"mode": "PERMISSIVE"})
    parts = F.when(text.startswith("[") & parsed.isNotNull(), parsed).otherwise(F.split(text, r"[|;]"))
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def parse_bool(text: Column) -> Column:
    return F.lower(strip(F.coalesce(text.cast("string"), F.lit("")))).isin("1", "true", "yes", "y", "on")


def standard_id(stem: Column) -> Column:
    """The identifier of a standard in a file's stem, else the stem's first word."""
    stem = F.regexp_replace(stem, r"(?i)^\[OCR\]_", "")
    patterns = [r"ECSS-[A-Z]-[A-Z]+-\d+(?:-\d+)?[A-Z]?", r"ECSS-[A-Z]-[A-Z]+-\d+(?:-\d+)?[A-Z]?(?:[-_ ]?Rev\.?\s*\d+)?", r"GJB(?:[- ]?Z)?\s*[\w.]+(?:-\d{4})?", r"QJ\s*[\w.]+(?:-\d{4})?", r"GB/?T\s*[\w.]+(?:-\d{4})?", r"GBT\s*[\w.]+(?:-\d{4})?", r"NASA[- ][A-Z0-9-]+"]
    found = [F.nullif(F.regexp_extract(stem, f"(?i)({p})", 1), F.lit("")) for p in patterns]
    return F.coalesce(*(F.replace(normalize_text(f), F.lit("_"), F.lit(" ")) for f in found), F.split(stem, " ")[0])


def pdf_name(*candidates: Column) -> Column:
    """The first PDF file name in any of the candidates, else the empty string."""
    return F.coalesce(*(F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), r"(?i)([^\\/]+\.pdf)", 1), F.lit("")) for c in candidates), F.lit(""))
