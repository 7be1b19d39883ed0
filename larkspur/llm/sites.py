"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

A softmax classifier gives every document a probability of good quality. Labels (weight 1) and the
classifier's probabilities of unlabelled documents (weight SOFT) are summed by host and path. The
global mean is the prior of hosts, a host's posterior mean is the prior of its paths; how many
observations a prior counts for comes from the variance between hosts, and between paths of a host,
by the method of moments, so that sparse sites shrink towards their parent. A document's log-odds
are the classifier's plus those of its path, less those of the global mean; its path's posterior is
taken without the document's own observation, so that no evidence counts twice.

Host and path come from a column of URLs, the path being that of the folder, or from two columns.

All sums are grouped aggregations; the two prior strengths are one row. Nothing is collected but the
classifier's bounded sample.

Defined results: a URL that can't be read has the host and path ""; a null text counts as empty; a null host or path is a group of its own; without
labels every probability is 0.5; a document with several labels counts with their mean; repeated
rows give repeated results; a posterior equal to the cut is kept; texts may be of any length; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import classify
from ._shared import materialise
from ._text import slices

SOFT, CUT = 0.1, 0.5


def _predict(weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                p = classify.posteriors(part.column("text"), weights)[:, 1]
                yield pa.record_batch([part.column("doc_id"), part.column("host"), part.column("path"), pa.array(p)], names=["doc_id", "host", "path", "p_doc"])

    return run


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, mean: str, name: str) -> DataFrame:
    """One row: how many observations the parent's mean counts for, by the method of moments.
    groups: n observations with k good, and the parent's mean."""
    sums = groups.where("n > 0").agg(
        F.sum(F.col("n") * (F.col("k") / F.col("n") - F.col(mean)) ** 2).alias("spread"),
        F.sum(F.col(mean) * (1 - F.col(mean))).alias("chance"),
        F.sum(F.col("n") * F.col(mean) * (1 - F.col(mean))).alias("weighted"),
        F.sum("n").alias("total"),
        F.sum(F.col("n") * F.col("n")).alias("squares"),
    )
    between = (F.col("spread") - F.col("chance")) / F.greatest(F.col("total") - F.col("squares") / F.col("total"), F.lit(1e-9))
    within = F.col("weighted") / F.col("total")
    found = F.when((F.col("total") > 0) & (between > 0), within / F.greatest(between, F.lit(1e-12)) - 1).otherwise(1e6)
    return sums.select(F.least(F.greatest(found, F.lit(1.0)), F.lit(1e6)).alias(name))


def url_host(url: Column) -> Column:
    """The host of a URL in lower case, without user and port."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1), F.lit("")))


def url_folder(url: Column) -> Column:
    """The path of a URL up to its last slash."""
    return F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*/|/)", 1), F.lit(""))


def site_posteriors(scored: DataFrame, truth: DataFrame, cut: float = CUT) -> DataFrame:
    """doc_id, p_doc, p_host, p_path, posterior, keep from doc_id, host, path, p_doc and from the
    mean label y of each labelled doc_id."""
    rows = scored.join(truth, "doc_id", "left").select("doc_id", "host", "path", "p_doc", F.coalesce("y", "p_doc").alias("own_k"), F.when(F.col("y").isNotNull(), 1.0).otherwise(SOFT).alias("own_n"))
    paths = materialise(rows.groupBy("host", "path").agg(F.sum("own_n").alias("n"), F.sum(F.col("own_k") * F.col("own_n")).alias("k")), "site-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    overall = hosts.agg(F.coalesce(F.sum("k") / F.sum("n"), F.lit(0.5)).alias("prior"))
    at_hosts = hosts.crossJoin(overall)  # one row, as are the strengths
    shrunk = at_hosts.crossJoin(_strength(at_hosts, "prior", "strength")).select(
        "host", "prior", ((F.col("k") + F.col("strength") * F.col("prior")) / (F.col("n") + F.col("strength"))).alias("p_host")
    )
    below = paths.join(shrunk, "host")
    table = below.crossJoin(_strength(below, "p_host", "strength"))
    joined = rows.join(table, ["host", "path"])
    others = (F.col("k") - F.col("own_k") * F.col("own_n") + F.col("strength") * F.col("p_host")) / (F.col("n") - F.col("own_n") + F.col("strength"))
    posterior = 1 / (1 + F.exp(-(_logit(F.col("p_doc")) + _logit(F.col("p_path")) - _logit(F.col("prior")))))
    out = joined.withColumn("p_path", others).select("doc_id", "p_doc", "p_host", "p_path", posterior.alias("posterior"))
    return out.withColumn("keep", F.col("posterior") >= cut)


def quality_posteriors(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    path_col: str = "lang",
    sample: int = classify.SAMPLE,
    cut: float = CUT,
    url_col: str | None = None,
) -> DataFrame:
    """doc_id, p_doc, p_host, p_path, posterior, keep of every document. Host and path come from
    url_col where it is given, else from host_col and path_col."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    host, path = (text(host_col), text(path_col)) if url_col is None else (url_host(F.col(url_col)), url_folder(F.col(url_col)))
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("y IS NOT NULL")
    weights = classify.train(docs, labels, F.when(F.col("quality").isNotNull(), (F.col("quality") == 1).cast("int")), 2, id_col, text_col, sample)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), host.alias("host"), path.alias("path"), F.col(text_col).alias("text"))
    scored = materialise(rows.mapInArrow(_predict(weights), "doc_id long, host string, path string, p_doc double"), "site-scores")
    truth = known.groupBy("doc_id").agg(F.avg((F.col("y") == 1).cast("double")).alias("y"))
    return site_posteriors(scored, truth, cut)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_posteriors(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
