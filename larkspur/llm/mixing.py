"""Mixing documents to target weights of domains they belong to softly.

A classifier fitted on the labelled table gives every document a posterior over domains. With
n_i tokens and posterior p_i, rates r_i >= 0 are wanted whose expected totals, sum of r_i n_i p_i,
match the target weights times the corpus' tokens, while staying near 1:

    minimise |sum w_i r_i p_i - target|^2 / 2 + KEEP / 2 sum w_i (r_i - 1)^2,   w_i = n_i / sum n

A rate depends on all other documents only through the vector x of residuals, one number a domain:
r_i = max(0, 1 - p_i x / KEEP). So the problem is solved for x, by Newton steps on its dual

    minimise |x|^2 / 2 + target x + KEEP / 2 sum w_i max(0, 1 - p_i x / KEEP)^2

whose slope at x is what x is short of the residuals of the rates it gives. An iteration is one
aggregation to a few numbers, for the whole step and its halves at once, and a rate is recomputed
where its document lies: no state is kept between iterations, nothing of the corpus' size is
shuffled or cached, and a lost executor costs nothing but its own part. Iterations end when the
slope is under CLOSE, which puts every rate within CLOSE / KEEP of its optimum; if they don't get
there, the query fails.

Defined results: a null or empty text has no tokens, so that its rate matters to no total; it stays
near 1; texts may be of any length; without labels posteriors are uniform; targets are scaled to sum
1; equal texts have equal rates, so that there are no ties to settle; repeated rows get a rate each;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import classify
from ._shared import materialise
from ._text import slices
from .tokens import TOKENIZER, _Known, token_counts

#: Share of the corpus' tokens that each domain is to have; what is low or toxic is to go.
TARGETS = {"good": 1.0, "low": 0.0, "toxic": 0.0}
KEEP, ITERATIONS, CLOSE, HALVES = 2e-3, 40, 1e-9, 8


def labelled_domains() -> dict[str, Column]:
    """The domains of the table labels, as conditions on its columns; the first that holds counts."""
    return {"toxic": F.col("toxic") == 1, "low": F.col("quality") == 0, "good": F.col("quality") == 1}


def domain_label(domains: dict[str, Column], names: list[str]) -> Column:
    """Number in names of the first domain whose condition holds, else null."""
    if sorted(domains) != sorted(names):
        raise ValueError(f"targets are for {sorted(names)}, domains are {sorted(domains)}")
    out = F.lit(None).cast("int")
    for name, condition in reversed(domains.items()):
        out = F.when(condition, names.index(name)).otherwise(out)
    return out


def _posteriors(weights: np.ndarray, tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(tokenizer)
        for batch in batches:
            for part in slices(batch, "text"):
                p = classify.posteriors(part.column("text"), weights)
                n = token_counts(part.column("text"), known)
                yield pa.record_batch([part.column("doc_id"), pa.array(n), *(pa.array(p[:, c]) for c in range(p.shape[1]))], names=["doc_id", "n_tokens", *(f"p{c}" for c in range(p.shape[1]))])

    return run


def rates(p: np.ndarray, residuals: list[np.ndarray], keep: float) -> tuple[np.ndarray, np.ndarray]:
    """Rates and look-ahead points of documents with posteriors p after these residuals, by
    projected gradient with momentum: a slower way to the same rates, to compare with."""
    r = y = np.ones(len(p))
    step = 1 / (1 + keep)
    for t, residual in enumerate(residuals):
        fresh = np.maximum(0, y - step * (p @ residual + keep * (y - 1)))
        y = fresh + t / (t + 3) * (fresh - r)
        r = fresh
    return r, y


def rates_at(p: np.ndarray, x: np.ndarray, keep: float) -> np.ndarray:
    """Rates of documents with posteriors p that minimise at residuals x."""
    return np.maximum(0, 1 - p @ x / keep)


def _sums(domains: int, points: list[np.ndarray], keep: float):
    """Of each point: sum of n r^2, of n r p, and of n p p' where r > 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(points), 1 + domains + domains**2))
        for batch in batches:
            p = np.stack([batch.column(f"p{c}").to_numpy() for c in range(domains)], axis=1)
            n = batch.column("n_tokens").to_numpy()
            for i, x in enumerate(points):
                r = rates_at(p, x, keep)
                active = p[r > 0]
                sums[i] += np.r_[(n * r**2).sum(), (n * r) @ p, (active.T @ (active * n[r > 0, None])).ravel()]
        yield pa.record_batch([pa.array([s]) for s in sums.ravel()], names=[f"s{c}" for c in range(sums.size)])

    return run


def _final(domains: int, x: np.ndarray, keep: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.stack([batch.column(f"p{c}").to_numpy() for c in range(domains)], axis=1)
            yield pa.record_batch([batch.column("doc_id"), batch.column("n_tokens"), pa.array(rates_at(p, x, keep))], names=["doc_id", "n_tokens", "rate"])

    return run


def solve(table: DataFrame, targets: list[float], keep: float = KEEP, iterations: int = ITERATIONS) -> DataFrame:
    """(doc_id, n_tokens, p0, p1, ...) to doc_id, n_tokens, rate. Fails if as many iterations don't
    bring the slope under CLOSE."""
    domains = len(targets)
    wanted = np.array(targets, float) / sum(targets)
    total = table.agg(F.sum("n_tokens")).first()[0] or 0

    def measure(points: list[np.ndarray]) -> list[tuple[np.ndarray, float, np.ndarray, np.ndarray]]:
        """Points with their values, slopes and curvatures."""
        columns = [f"s{c}" for c in range(len(points) * (1 + domains + domains**2))]
        sums = table.mapInArrow(_sums(domains, points, keep), ", ".join(f"{c} double" for c in columns)).agg(*(F.sum(c) for c in columns)).first()
        out = []
        for x, s in zip(points, np.array(sums).reshape(len(points), -1) / total):
            value = x @ x / 2 + wanted @ x + keep / 2 * s[0]
            out.append((x, value, x + wanted - s[1 : 1 + domains], np.eye(domains) + s[1 + domains :].reshape(domains, domains) / keep))
        return out

    x = np.zeros(domains)
    if total:
        x, value, slope, curve = measure([x])[0]
        for _ in range(iterations):
            if np.linalg.norm(slope) <= CLOSE:
                break
            step = -np.linalg.solve(curve, slope)
            tried = measure([x + step / 2**h for h in range(HALVES)])
            # near the end a fall of the value is lost in rounding, but one of the slope isn't
            good = [t for h, t in enumerate(tried) if t[1] <= value + 1e-4 * (slope @ step) / 2**h or np.linalg.norm(t[2]) <= np.linalg.norm(slope) / 2]
            x, value, slope, curve = good[0] if good else min(tried, key=lambda t: t[1])
        if not np.linalg.norm(slope) <= CLOSE:
            raise RuntimeError(f"rates have not converged: slope {np.linalg.norm(slope):.1e} after {iterations} iterations")
    return table.mapInArrow(_final(domains, x, keep), "doc_id long, n_tokens long, rate double")


def mix(
    docs: DataFrame,
    labels: DataFrame,
    targets: dict[str, float] = TARGETS,
    id_col: str = "doc_id",
    text_col: str = "text",
    sample: int = classify.SAMPLE,
    tokenizer: str = TOKENIZER,
    label_docs: DataFrame | None = None,
    domains: dict[str, Column] | None = None,
    keep: float = KEEP,
) -> DataFrame:
    """doc_id, n_tokens, rate of every document. targets: share of the tokens of each domain;
    domains: conditions on the columns of labels by the same names, labelled_domains() unless given;
    label_docs: texts that labels speak of, docs unless given."""
    names = list(targets)
    weights = classify.train(docs if label_docs is None else label_docs, labels, domain_label(domains or labelled_domains(), names), len(names), id_col, text_col, sample)
    schema = "doc_id long, n_tokens long, " + ", ".join(f"p{c} double" for c in range(len(names)))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    table = materialise(rows.mapInArrow(_posteriors(weights, tokenizer), schema), "domain-posteriors")
    return solve(table, [targets[d] for d in names], keep)


def copies(rate: Column, key: Column) -> Column:
    """A whole number with mean `rate`: its floor, and one more for that share of hashes of key."""
    chance = F.pmod(F.xxhash64(key, F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rate) + (chance < rate - F.floor(rate)).cast("int")).cast("int")


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows of docs, each as often as its rate asks for. Rows that share an id share the mean of
    their rates; a row with a null id stays once. All columns are kept."""
    found = mix(docs, labels, id_col=id_col, text_col=text_col, **options).where("doc_id IS NOT NULL")
    mixed, often, time = (f"c{uuid.uuid4().hex}" for _ in range(3))
    # Almost every document stays once, so only the ids of the others are joined.
    other = found.groupBy(F.col("doc_id").alias(mixed)).agg(copies(F.round(F.avg("rate"), 6), F.col("doc_id")).alias(often)).where(F.col(often) != 1)
    joined = docs.join(other, F.col(id_col).cast("long") == F.col(mixed), "left").where(F.col(often).isNull() | (F.col(often) > 0))
    return joined.withColumn(time, F.explode(F.sequence(F.lit(1), F.coalesce(often, F.lit(1))))).select(*docs.columns)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.withColumn("rate", F.round("rate", 6))
