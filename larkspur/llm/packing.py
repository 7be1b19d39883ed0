"""Sum-of-squares packing of documents into sequences of equal length.

Documents longer than a sequence are cut: whole sequences first, the rest is packed. A piece goes
where the sum over all gaps of the squared number of open sequences with that gap becomes
smallest; of equals to the smallest gap, and to a new sequence last. That sum depends on counts
alone, so a step is one vectorised comparison over the gaps, and the sequence filled is the oldest
open one with the chosen gap.

The rule is sequential, so documents are divided by hash into shards of about SHARD_TOKENS tokens
that are packed apart: the number of shards grows with the corpus and each leaves only its own few
sequences open at the end.

Defined results: a document without tokens (null or empty text) is in no sequence; texts may be of
any length; repeated rows are packed each; documents are taken in order of id, then of size, rows
equal in both are alike; a null id is packed as any other; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import materialise
from .tokens import TOKENIZER, with_token_counts

CAPACITY, SHARD_TOKENS = 2048, 8_000_000
_OUT = "doc_id long, part int, seq_id long, seq_offset int, n_tokens int"


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, 1 <= size <= capacity, in order."""
    count = np.zeros(capacity + 1, np.int64)
    open_bins: list[deque[int]] = [deque() for _ in range(capacity + 1)]
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    made = 0
    for k, size in enumerate(sizes.tolist()):
        # Moving a bin from gap g to g - size changes the sum by 2 (N[g - size] - N[g] + 1), or by
        # 1 - 2 N[g] if that fills it; a new bin adds 2 N[capacity - size] + 1, or nothing if full.
        from_ = count[size:capacity]
        change = 2 * (count[: capacity - size] - from_ + 1)
        if len(change):
            change[0] = 1 - 2 * from_[0]
            change[from_ == 0] = np.iinfo(np.int64).max
            gap = int(change.argmin())
            best = int(change[gap])
        else:
            best = np.iinfo(np.int64).max
        fresh = 0 if size == capacity else 2 * int(count[capacity - size]) + 1
        if best <= fresh:
            gap += size
            b = open_bins[gap].popleft()
            count[gap] -= 1
        else:
            gap, b = capacity, made
            made += 1
        bins[k], offsets[k] = b, capacity - gap
        if gap > size:
            count[gap - size] += 1
            open_bins[gap - size].append(b)
    return bins, offsets


def _pack(capacity: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("n_tokens", "ascending")])
        n = table.column("n_tokens").to_numpy()
        parts = -(-n // capacity)
        row = np.repeat(np.arange(len(n)), parts)
        part = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
        size = np.minimum(capacity, n[row] - part * capacity)
        bins, offsets = sum_of_squares(size, capacity)
        return pa.table(
            {
                "doc_id": table.column("doc_id").take(pa.array(row)),
                "part": part.astype(np.int32),
                "seq_id": (np.int64(key[0].as_py()) << np.int64(32)) + bins,
                "seq_offset": offsets.astype(np.int32),
                "n_tokens": size.astype(np.int32),
            }
        )

    return run


def pack(counted: DataFrame, capacity: int = CAPACITY, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(doc_id, n_tokens) to doc_id, part, seq_id, seq_offset, n_tokens: where each piece lies."""
    counted = materialise(counted.where("n_tokens > 0"), "token-counts")
    total = counted.agg(F.sum("n_tokens")).first()[0] or 0
    shards = max(1, -(-total // shard_tokens))
    sharded = counted.withColumn("shard", F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(shards)).cast("int"))
    return sharded.repartition(min(shards, 100_000), "shard").groupBy("shard").applyInArrow(_pack(capacity), _OUT)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(with_token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", TOKENIZER))
