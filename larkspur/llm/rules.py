"""Quality rules with risk-controlled thresholds.

A rule is a score of the text, larger meaning worse, and a fixed grid of cutoffs. For every
stratum, rule and cutoff the labelled documents of good quality that the cutoff would reject are
counted: k of n. Down each rule's grid, from the most lenient cutoff on, a cutoff is certified while
the exact binomial test of "the false rejection rate is alpha / rules or more" rejects,
P(Bin(n, alpha / rules) <= k) <= delta / (strata x rules). Such a sequence in a fixed order needs no
further correction for its cutoffs, and Bonferroni is for strata and rules. The grid doesn't depend on
the data, so that all labelled documents are holdout. By the union bound, with probability 1 - delta
no stratum loses more than alpha of its good documents to all its rules together.

Among certified cutoffs of a rule the one with the largest (share of bad rejected - cost x share of
good rejected) is taken, the most lenient of equals; a rule with no certified cutoff or no gain is
off in that stratum. The cost is a parameter beside alpha: at 0 the cutoff that rejects most bad
documents is taken, at the default a cutoff has to leave nearly all good ones alone even where the
risk would allow more.

A stratum needs about 750 good labels without a loss before any cutoff can be certified (four strata,
six rules); one with fewer stays unfiltered.

Defined results: a null text counts as empty; a null stratum is a stratum of its own, as is one
without labels, where every rule is off and all is kept; null labels are left out; when a document
has several labels it counts once for each; repeated rows give repeated results; an empty table
gives an empty result; texts may be of any length; a score equal to the cutoff passes; other columns
are ignored.
"""

from __future__ import annotations

from math import exp, lgamma, log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import materialise

ALPHA, DELTA, COST = 0.05, 0.05, 400.0
SYMBOLS = "#$%&*|!@^~<>{}[]\\=+_`"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÂÄÇÉÈÊËÎÏÔÖÙÛÜÑÁÍÓÚ"
#: Grids of cutoffs; a document fails a rule when its score is above the chosen one.
GRIDS: dict[str, list[float]] = {
    "symbols": [0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2],
    "upper": [0.1, 0.2, 0.3, 0.5, 0.7, 0.9],
    "repeats": [0.02, 0.05, 0.1, 0.2, 0.4, 0.7],
    "long_words": [8.0, 10.0, 12.0, 15.0, 20.0, 40.0],
    "same_lines": [0.1, 0.2, 0.3, 0.5, 0.7, 0.9],
    "few_words": [-20.0, -10.0, -5.0, -3.0, -1.0],
}


def scores(text: Column) -> dict[str, Column]:
    """The rules' scores as built-in expressions."""
    text = F.coalesce(text, F.lit(""))
    chars = F.length(text)
    words = F.filter(F.split(F.translate(text, "\n\t\r", "   "), " "), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x != "")
    of = lambda count, total: F.when(total > 0, count / total).otherwise(F.lit(0.0))
    same = F.aggregate(
        words,
        F.struct(F.lit("").alias("last"), F.lit(0).alias("n")),
        lambda a, w: F.struct(w.alias("last"), (a["n"] + F.when(a["last"] == w, 1).otherwise(0)).alias("n")),
        lambda a: a["n"],
    )
    return {
        "symbols": of(chars - F.length(F.translate(text, SYMBOLS, "")), chars),
        "upper": of(chars - F.length(F.translate(text, UPPER, "")), chars),
        "repeats": of(same, F.size(words)),
        "long_words": of(chars, F.size(words)),
        "same_lines": of(F.size(lines) - F.size(F.array_distinct(lines)), F.size(lines)),
        "few_words": -F.size(words).cast("double"),
    }


def binomial_tail(n: int, k: int, p: float) -> float:
    """P(Bin(n, p) <= k), exactly, summed from the logarithms of its terms."""
    if k >= n:
        return 1.0
    at = lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log(1 - p))
    return min(1.0, sum(at(i) for i in range(k + 1)))


def choose(counts: dict[tuple[str, str, float], tuple[int, int, int, int]], alpha: float = ALPHA, delta: float = DELTA, cost: float = COST) -> dict[tuple[str, str], float]:
    """(stratum, rule, cutoff) -> (good, good rejected, bad, bad rejected) to the cutoffs of (stratum, rule)."""
    rules, strata = len({rule for _, rule, _ in counts}), len({stratum for stratum, _, _ in counts})
    best: dict[tuple[str, str], tuple[float, float]] = {}
    ended: set[tuple[str, str]] = set()
    for (stratum, rule, cutoff), (good, lost, bad, caught) in sorted(counts.items(), key=lambda x: -x[0][2]):
        if (stratum, rule) in ended:
            continue
        # at the mean or above it the tail is far above delta
        if lost >= good * alpha / rules or binomial_tail(good, lost, alpha / rules) > delta / (strata * rules):
            ended.add((stratum, rule))
        elif bad:
            gain = round(caught / bad - cost * lost / good, 12)
            if gain > best.get((stratum, rule), (0.0, 0.0))[0]:
                best[stratum, rule] = gain, cutoff
    return {k: cutoff for k, (_, cutoff) in best.items()}


def _stratum(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def certified_cutoffs(
    scored: DataFrame, labels: DataFrame, id_col: str = "doc_id", alpha: float = ALPHA, delta: float = DELTA, cost: float = COST
) -> dict[tuple[str, str], float]:
    """Cutoffs of (stratum, rule) from the columns doc_id, stratum and the rules' scores.

    Only counts for each stratum and cutoff reach the driver.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality IS NOT NULL")
    good, bad = F.col("quality") == 1, F.col("quality") != 1
    cells = [(rule, cutoff) for rule in GRIDS for cutoff in GRIDS[rule]]
    counted = (
        scored.join(known, "doc_id")
        .groupBy("stratum")
        .agg(
            F.count_if(good).alias("good"),
            F.count_if(bad).alias("bad"),
            *(F.count_if(good & (F.col(rule) > c)).alias(f"g{i}") for i, (rule, c) in enumerate(cells)),
            *(F.count_if(bad & (F.col(rule) > c)).alias(f"b{i}") for i, (rule, c) in enumerate(cells)),
        )
    )
    counts = {
        (row["stratum"], rule, c): (row["good"], row[f"g{i}"], row["bad"], row[f"b{i}"])
        for row in counted.toLocalIterator()
        for i, (rule, c) in enumerate(cells)
    }
    return choose(counts, alpha, delta, cost)


def failures(cutoffs: dict[tuple[str, str], float], stratum: Column, of: dict[str, Column]) -> list[Column]:
    """For each rule that is on anywhere, its name where the score is above the stratum's cutoff, else null."""
    out = []
    for rule, score in of.items():
        own = sorted((s, c) for (s, r), c in cutoffs.items() if r == rule)
        if own:
            limit = F.lit(float("inf"))
            for s, c in own:
                limit = F.when(stratum == s, F.lit(c)).otherwise(limit)
            out.append(F.when(score > limit, F.lit(rule)))
    return out


def _scored(docs: DataFrame, id_col: str, text_col: str, stratum_col: str) -> DataFrame:
    narrow = docs.select(F.col(id_col).alias("doc_id"), _stratum(stratum_col).alias("stratum"), F.col(text_col).alias("text"))
    return narrow.select("doc_id", "stratum", *(c.alias(name) for name, c in scores(F.col("text")).items()))


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum_col: str = "lang",
    alpha: float = ALPHA,
    delta: float = DELTA,
    cost: float = COST,
) -> DataFrame:
    """doc_id, stratum, keep and the failed rules, joined with commas, of every document.

    Scores are computed once and written.
    """
    scored = materialise(_scored(docs, id_col, text_col, stratum_col), "rule-scores")
    cutoffs = certified_cutoffs(scored, labels, id_col, alpha, delta, cost)
    failed = failures(cutoffs, F.col("stratum"), {rule: F.col(rule) for rule in GRIDS})
    failed = F.array_compact(F.array(*failed)) if failed else F.array().cast("array<string>")
    return scored.select("doc_id", "stratum", (F.size(failed) == 0).alias("keep"), F.array_join(failed, ",").alias("failed"))


def passing(
    docs: DataFrame,
    labels: DataFrame,
    label_docs: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum_col: str = "lang",
    alpha: float = ALPHA,
    delta: float = DELTA,
    cost: float = COST,
) -> DataFrame:
    """The rows of docs that fail no rule, with all their columns and without a shuffle of texts.
    label_docs: texts that labels speak of, docs unless given."""
    known = labels.where("quality IS NOT NULL").select(F.col(id_col)).distinct()
    # only labelled documents are scored here, the others once below
    of = (docs if label_docs is None else label_docs).select(id_col, text_col, stratum_col).join(known, id_col, "left_semi")
    cutoffs = certified_cutoffs(_scored(of, id_col, text_col, stratum_col), labels, id_col, alpha, delta, cost)
    out = docs
    for failed in failures(cutoffs, _stratum(stratum_col), scores(F.col(text_col))):
        out = out.where(failed.isNull())
    return out


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_GRID = ", ".join(f"({i}, '{rule}', {c!r}::DOUBLE)" for i, rule in enumerate(GRIDS) for c in GRIDS[rule])
SQL = rf"""
WITH x AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split(translate(text, chr(10) || chr(9) || chr(13), '   '), ' '), lambda x: x <> '') AS w,
        list_filter(string_split(text, chr(10)), lambda x: x <> '') AS l, length(text) AS n FROM x),
f AS (SELECT doc_id, stratum,
        CASE WHEN n > 0 THEN (n - length(translate(text, {_quoted(SYMBOLS)}, ''))) / n ELSE 0 END::DOUBLE AS symbols,
        CASE WHEN n > 0 THEN (n - length(translate(text, {_quoted(UPPER)}, ''))) / n ELSE 0 END::DOUBLE AS upper,
        CASE WHEN len(w) > 0 THEN len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i-1])) / len(w) ELSE 0 END::DOUBLE AS repeats,
        CASE WHEN len(w) > 0 THEN n / len(w) ELSE 0 END::DOUBLE AS long_words,
        CASE WHEN len(l) > 0 THEN (len(l) - len(list_distinct(l))) / len(l) ELSE 0 END::DOUBLE AS same_lines,
        -len(w)::DOUBLE AS few_words FROM w),
s AS (UNPIVOT f ON symbols, upper, repeats, long_words, same_lines, few_words INTO NAME rule VALUE score),
grid(place, rule, cutoff) AS (VALUES {_GRID}),
c AS (SELECT stratum, place, rule, cutoff, count_if(quality = 1)::BIGINT AS good, count_if(quality = 1 AND score > cutoff)::BIGINT AS lost,
        count_if(quality <> 1)::BIGINT AS bad, count_if(quality <> 1 AND score > cutoff)::BIGINT AS caught
      FROM s JOIN (SELECT doc_id, quality FROM labels WHERE quality IS NOT NULL) USING (doc_id) JOIN grid USING (rule) GROUP BY ALL),
p AS (SELECT *, CASE WHEN lost >= good THEN 1 ELSE list_sum(list_transform(range(0, lost + 1), lambda i:
        exp(lgamma(good + 1) - lgamma(i + 1) - lgamma(good - i + 1) + i * ln({ALPHA / len(GRIDS)!r}) + (good - i) * ln({1 - ALPHA / len(GRIDS)!r})))) END AS tail,
        (SELECT count(DISTINCT stratum) FROM c) * {len(GRIDS)} AS tests FROM c WHERE good > 0),
t AS (SELECT *, bool_and(tail <= {DELTA} / tests) OVER (PARTITION BY stratum, rule ORDER BY cutoff DESC) AS good_so_far FROM p),
b AS (SELECT *, round(caught / bad - {COST} * lost / good, 12) AS gain FROM t WHERE good_so_far AND bad > 0),
k AS (SELECT stratum, place, rule, cutoff FROM b WHERE gain > 0
      QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY gain DESC, cutoff DESC) = 1)
SELECT doc_id, s.stratum, count(k.rule) = 0 AS keep, coalesce(string_agg(k.rule, ',' ORDER BY place), '') AS failed
FROM s LEFT JOIN k ON s.stratum = k.stratum AND s.rule = k.rule AND s.score > k.cutoff GROUP BY doc_id, s.stratum
"""
