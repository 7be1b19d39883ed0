"""Evaluation questions made of corpus records: pools by predicates, balanced picks, pairs, scenarios."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import text as tx
from ..scratch import materialise
from ..sources.sinks import markdown_lines, write_items_csv, write_json_lines, write_text
from . import evaluate

REQUIREMENTS = "shall should requirement requirements process plan programme management verification qualification acceptance".split()
METHODS = "method test analysis inspection verification measurement simulation assessment review".split()
COUNTS = {"definition": 15, "abbreviation": 10, "clause_locator": 20, "requirement_process": 20, "parameter_table": 15, "method_explanation": 10}
_UNIT = r"\b\d+(?:[.,]\d+)?\s*(?:v|a|hz|khz|mhz|ghz|db|w|kw|kg|mm|cm|m|rad|gy|ev|kev|mev|%)\b"
_COLUMNS = ["record_id", "doc_id", "pdf", "source_path", "section", "section_title", "page_start", "page_end", "content", "seq"]


@dataclass(frozen=True)
class Plan:
    """How many questions of each kind, pairs (pdf, keyword, pdf, keyword), scenarios (pdf, keyword,
    prompt) and questions that have no answer."""

    counts: dict[str, int] = field(default_factory=lambda: dict(COUNTS))
    pairs: tuple[tuple[str, str, str, str], ...] = ()
    scenarios: tuple[tuple[str, str, str], ...] = ()
    negatives: tuple[str, ...] = ()
    prefix: str = "eval"


def first_files(names: DataFrame, count: int) -> DataFrame:
    """The first `count` values of the column pdf, in order. A limit, as it is a choice of files."""
    return names.select("pdf").distinct().orderBy("pdf").limit(count)


def records(corpus: DataFrame, pdfs: DataFrame) -> DataFrame:
    """Corpus records of these files with the columns that questions need; empty ones go."""
    meta = lambda k: F.try_element_at("metadata", F.lit(k))
    at = lambda c: F.coalesce(F.col(c), F.col("page"))
    named = corpus.withColumn("pdf", F.regexp_extract(F.coalesce("source_path", F.lit("")), r"[^/\\]*$", 0)).join(pdfs.select("pdf").distinct(), "pdf", "left_semi")
    out = named.select(
        "record_id", "doc_id", "pdf", "source_path", F.coalesce("section", meta("section")).alias("section"), F.coalesce("section_title", meta("section_title"), F.lit("")).alias("section_title"),
        at("page_start").alias("page_start"), at("page_end").alias("page_end"), tx.normalize_space(F.col("content")).alias("content"), (F.col("seq") if "seq" in corpus.columns else F.col("record_id")).alias("seq"),
    )
    return out.where("content <> ''")


def excerpt(text: Column, most: int = 320) -> Column:
    return tx.bound(tx.normalize_space(text), lambda t: F.when(F.length(t) <= most, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, most - 1)), F.lit("…"))))


def clean_term(text: Column) -> Column:
    return F.regexp_replace(tx.normalize_space(text), r"^[ .:-]+|[ .:-]+$", "")


def label() -> Column:
    section, title = F.nullif("section", F.lit("")), F.nullif("section_title", F.lit(""))
    return F.coalesce(F.nullif(F.concat_ws(" ", section, title), F.lit("")), F.col("record_id").cast("string"))


def topic() -> Column:
    term = clean_term(F.col("section_title"))
    return F.when(term != "", term).otherwise(excerpt(F.col("content"), 80))


def _title() -> Column:
    return F.lower("section_title")


def is_definition() -> Column:
    n = F.length("section_title")
    return F.startswith(F.coalesce("section", F.lit("")), F.lit("3.")) & n.between(2, 80) & ~F.startswith(_title(), F.lit("terms ")) & ~F.startswith(_title(), F.lit("abbreviated"))


def has_word(words: list[str]) -> Column:
    """Whether title or content hold any of the words, inside others as well."""
    return tx.bound(F.lower(F.concat_ws(" ", "section_title", "content")), lambda t: _holds(t, words))


def _holds(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, w: a | F.contains(text, F.lit(w)), words, F.lit(False))


def good_title() -> Column:
    return F.length("section_title").between(4, 90) & ~F.startswith(_title(), F.lit("terms from"))


def has_parameter() -> Column:
    return tx.bound(F.lower("content"), lambda t: _holds(t, ["table", "figure", "threshold", "limit"]) | t.rlike(_UNIT))


def context_key() -> Column:
    return F.concat_ws("\x1f", "pdf", F.coalesce("section", F.lit("")), F.lower(clean_term(F.col("section_title"))))


def pick(pool: DataFrame, count: int, used: DataFrame | None) -> DataFrame:
    """`count` records of the pool, files in turn, each section once, none of those used; an error if
    there are too few. A limit, as it is a sampler."""
    keyed = pool.withColumn("context", context_key())
    if used is not None:
        keyed = keyed.join(used.select("record_id"), "record_id", "left_anti").join(used.select("context"), "context", "left_anti")
    # without texts; those chosen get theirs afterwards
    each = keyed.groupBy("context").agg(F.min(F.struct("seq", "record_id", "pdf")).alias("r")).select("context", "r.*")
    few = evaluate.balanced_pick(each, "pdf", ["seq", "record_id"], count)
    few = materialise(few.withColumn("place", F.row_number().over(Window.orderBy("turn", "pdf", "seq", "record_id"))), "chosen")
    key = few.select(*(F.col(c).alias(f"_{c}") for c in few.columns))
    same = reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"_{c}")), ["record_id", "seq", "pdf"], F.col("context") == F.col("_context"))
    whole = keyed.join(F.broadcast(key), same).select(*keyed.columns, F.col("_turn").alias("turn"), F.col("_place").alias("place"))
    chosen = materialise(whole.dropDuplicates(["place"]), "picked")
    if (found := chosen.count()) < count:
        raise ValueError(f"{count} records are wanted, but {found} are there")
    return chosen


def best(records: DataFrame, pdf: str, word: str) -> DataFrame:
    """The record of a file that has the word most often, ten times as much in the title, longer ones
    first; without any the one in the middle."""
    own = records.where(F.col("pdf") == pdf)
    scored = own.withColumns({
        "found": evaluate.best_record("section_title", "content", word) + F.coalesce((F.col("section") != "").cast("int"), F.lit(0)),
        "at": F.row_number().over(Window.orderBy("seq", "record_id")), "n": F.count("*").over(Window.partitionBy(F.lit(1))),
    })
    scored = scored.withColumn("most", F.max("found").over(Window.partitionBy(F.lit(1))))
    middle = (F.col("most") <= 0) & (F.col("at") == F.floor(F.col("n") / 2) + 1)
    return scored.orderBy(middle.desc(), F.desc("found"), F.desc(F.length("content")), "at").limit(1).select(*_COLUMNS)


def _gold() -> Column:
    return F.struct("record_id", "doc_id", "pdf", "source_path", "section", "section_title", "page_start", "page_end", excerpt(F.col("content")).alias("answer_span"))


def _items(chosen: DataFrame, kind: str, level: str, question: Column, answer: Column | None = None) -> DataFrame:
    gold = F.array(_gold())
    return chosen.select(
        "place", F.lit(kind).alias("query_type"), F.lit(level).alias("difficulty"), question.alias("question"), (excerpt(F.col("content")) if answer is None else answer).alias("expected_answer"),
        F.array("pdf").alias("expected_pdfs"), F.array("record_id").alias("expected_record_ids"), gold.alias("gold_context"), F.lit(False).alias("negative"),
    )


def questions(held: DataFrame, plan: Plan) -> DataFrame:
    """Items of all kinds, numbered in order of kind and place; an error if a question comes twice."""
    held = materialise(held, "question-records")
    pdf = F.col("pdf")
    pools = [
        ("definition", "easy", is_definition(), F.format_string('In %s, how is "%s" defined?', pdf, clean_term(F.col("section_title"))), None),
        ("abbreviation", "easy", has_word(["abbreviated", "abbreviation", "symbols"]), F.format_string("Which abbreviations or symbols does section %s of %s list?", label(), pdf), None),
        ("clause_locator", "easy", good_title(), F.format_string('Which section of %s is about "%s"?', pdf, clean_term(F.col("section_title"))), F.format_string("%s, section %s.", pdf, label())),
        ("requirement_process", "medium", has_word(REQUIREMENTS), F.format_string("What does section %s of %s say on %s?", label(), pdf, topic()), None),
        ("parameter_table", "medium", has_parameter(), F.format_string("Which clause of %s gives numbers, tables, units or limits on %s?", pdf, topic()), None),
        ("method_explanation", "medium", has_word(METHODS), F.format_string("What guidance on methods, tests or analyses does %s give in section %s?", pdf, label()), None),
    ]
    parts, used = [], None
    for kind, level, condition, question, answer in pools:
        if plan.counts.get(kind):
            chosen = pick(held.where(condition), plan.counts[kind], used)
            parts.append(_items(chosen, kind, level, question, answer))
            taken = chosen.select("record_id", "context")
            used = taken if used is None else used.unionByName(taken)
    spark = held.sparkSession
    for n, (a, one, b, two) in enumerate(plan.pairs):
        left, right = (best(held, p, w).select(F.struct(*_COLUMNS).alias(side)) for p, w, side in ((a, one, "l"), (b, two, "r")))
        both = left.crossJoin(right)  # one row each
        gold = lambda side: F.struct(*(F.col(f"{side}.{c}") for c in _COLUMNS[:8]), excerpt(F.col(f"{side}.content")).alias("answer_span"))
        said = F.format_string("%s section %s and %s section %s.", F.lit(a), F.coalesce("l.section", "l.record_id"), F.lit(b), F.coalesce("r.section", "r.record_id"))
        parts.append(both.select(F.lit(n).alias("place"), F.lit("cross_doc_compare").alias("query_type"), F.lit("hard").alias("difficulty"), F.lit(f'Compare what {a} says on "{one}" with what {b} says on "{two}".').alias("question"), said.alias("expected_answer"), F.array("l.pdf", "r.pdf").alias("expected_pdfs"), F.array("l.record_id", "r.record_id").alias("expected_record_ids"), F.array(gold("l"), gold("r")).alias("gold_context"), F.lit(False).alias("negative")))
    for n, (name, word, prompt) in enumerate(plan.scenarios):
        parts.append(_items(best(held, name, word).withColumn("place", F.lit(n)), "scenario", "hard", F.lit(prompt), F.format_string("%s, section %s.", pdf, label())))
    kinds = list(dict.fromkeys([k for k, *_ in pools] + ["cross_doc_compare", "scenario", "negative"]))
    if plan.negatives:
        rows = [(n, "negative", "hard", q, "No source holds the answer.", [], [], True) for n, q in enumerate(plan.negatives)]
        bare = spark.createDataFrame(rows, "place int, query_type string, difficulty string, question string, expected_answer string, expected_pdfs array<string>, expected_record_ids array<string>, negative boolean")
        parts.append(bare.withColumn("gold_context", F.from_json(F.lit("[]"), held.limit(0).select(F.array(_gold()).alias("g")).schema["g"].dataType)))
    found = materialise(reduce(lambda x, y: x.unionByName(y), parts), "questions")
    if twice := duplicates(found).limit(3).collect():
        raise ValueError(f"questions come twice: {[r.question for r in twice]}")
    order = F.array_position(F.array(*map(F.lit, kinds)), F.col("query_type"))
    return found.withColumn("id", F.format_string(f"{plan.prefix}_%03d", F.row_number().over(Window.orderBy(order, "place")))).drop("place")


def duplicates(items: DataFrame) -> DataFrame:
    """Questions that come more than once."""
    return items.groupBy("question").agg(F.count("*").alias("n")).where("n > 1")


def write(items: DataFrame, spark: SparkSession, path: str) -> None:
    """path.jsonl, path.csv and a summary path.md."""
    write_json_lines(items, f"{path}.jsonl")
    write_items_csv(items.drop("gold_context"), f"{path}.csv")
    counted = items.groupBy("query_type").agg(F.count("*").alias("n")).orderBy("query_type").collect()
    write_text(spark, f"{path}.md", "\n".join(["# Questions", "", *markdown_lines("Kinds", ["Kind", "Questions"], [(r.query_type, r.n) for r in counted])]))
