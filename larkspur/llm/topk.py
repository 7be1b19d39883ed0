"""Exact top-k search by inner product over norm buckets.

Vectors are sorted into buckets of similar length, so that a bucket's largest norm bounds every
product in it. Each query is first compared with the bucket of the longest vectors, which has a fixed
number of rows and is broadcast; that gives it a lower bound of its k-th product. Bound over norm is
the least norm that a vector needs, so queries are put into blocks in order of that, and a block is
only sent to the buckets that hold so long a vector. Buckets stay where they are; a task reads its
bucket once and lets the blocks of queries pass. In a bucket the bound divided by both norms is the
query's local cosine threshold:

* a query whose threshold is above 1 skips the bucket (length pruning of the whole);
* a query with a high threshold takes coordinate pruning: its product over the first coordinates
  plus the largest product that the rests' norms admit must reach the bound;
* one with a low threshold takes length pruning: only vectors at least as long as the bound asks
  for, a prefix as buckets are sorted.

What survives is verified with full double-precision products. Where all vectors are equally long no
bucket can be skipped, and every query has to see every bucket.

Defined results: null vectors and null ids are left out, as are vectors with a null, NaN or
infinite entry; a vector shorter than the longest one counts as padded with zeros; vectors may be of
any width; zero vectors are legal; a vector isn't its own neighbour; equal products are ranked by id;
with fewer than k others all are returned; of rows that share an id the least vector counts; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ._shared import materialise

K, BLOCK_ROWS, QUERY_ROWS, COORDINATE_FROM, DIGITS, EVERY = 10, 4096, 1024, 0.6, 6, 100
_BLOCK = "block int, n int, dim int, most double, ids binary, vectors binary"
_QUERIES = "q_block int, n int, dim int, least double, ids binary, vectors binary, bounds binary"


def _gathered(batches: Iterator[pa.RecordBatch], key: str, most_rows: int) -> Iterator[pa.Table]:
    """Rows of one key at a time, at most so many; they come sorted by it."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        k = batch.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if rest and (rest[0].column(key)[0].as_py() != k[a] or sum(r.num_rows for r in rest) >= most_rows):
                yield pa.Table.from_batches(rest)
                rest = []
            if b > a:
                rest.append(batch.slice(a, b - a))
    if rest:
        yield pa.Table.from_batches(rest)


def _dense(column: pa.ChunkedArray) -> np.ndarray:
    """Lists as rows of a matrix, padded with zeros."""
    column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), int(lengths.max(initial=0))))
    row = np.repeat(np.arange(len(column)), lengths)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a bucket to one row with all its ids and vectors, longest first."""
    for table in _gathered(batches, "block", 1 << 40):
        ids, vectors = table.column("id").to_numpy(), _dense(table.column("v"))
        norms = np.linalg.norm(vectors, axis=1)
        order = np.lexsort((ids, -norms))
        values = (table.column("block")[0].as_py(), len(ids), vectors.shape[1], float(norms.max()), ids[order].tobytes(), vectors[order].tobytes())
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.binary(), pa.binary())
        yield pa.record_batch([pa.array([v], t) for v, t in zip(values, kinds)], names=["block", "n", "dim", "most", "ids", "vectors"])


def _pack_queries(block_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gathered(batches, "q_block", block_rows):
            vectors = _dense(table.column("v"))
            needs, bounds = table.column("needs").to_numpy(), table.column("bound").to_numpy()
            values = (table.column("q_block")[0].as_py(), len(vectors), vectors.shape[1], float(needs.min()), table.column("id").to_numpy().tobytes(), vectors.tobytes(), bounds.tobytes())
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.record_batch([pa.array([v], t) for v, t in zip(values, kinds)], names=["q_block", "n", "dim", "least", "ids", "vectors", "bounds"])

    return run


def _read(ids: bytes, vectors: bytes, n: int, dim: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    out = np.zeros((n, width))
    out[:, :dim] = np.frombuffer(vectors).reshape(n, dim)
    return np.frombuffer(ids, np.int64), out


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -np.round(scores, DIGITS)))[:k]
    return ids[order], scores[order]


def _products(q: np.ndarray, x: np.ndarray, bound: np.ndarray, norms_q: np.ndarray, norms_x: np.ndarray, head: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query the positions in x that may reach its bound, and the exact products."""
    slack = 1e-9 * (1 + np.abs(bound))
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(norms_q * norms_x[0] > 0, (bound - slack) / (norms_q * norms_x[0]), np.where(bound <= slack, -1.0, np.inf))
    alive = np.flatnonzero(local <= 1)
    by_coordinate = alive[local[alive] >= COORDINATE_FROM]
    for s in range(0, len(by_coordinate), 256):
        own = by_coordinate[s : s + 256]
        rest_q, rest_x = np.linalg.norm(q[own, head:], axis=1), np.linalg.norm(x[:, head:], axis=1)
        most = q[own, :head] @ x[:, :head].T + rest_q[:, None] * rest_x
        for i, row in zip(own.tolist(), most >= (bound - slack)[own, None]):
            at = np.flatnonzero(row)
            yield i, at, x[at] @ q[i]
    by_length = alive[local[alive] < COORDINATE_FROM]
    for s in range(0, len(by_length), 256):
        own = by_length[s : s + 256]
        with np.errstate(divide="ignore", invalid="ignore"):
            needed = np.where(norms_q[own] > 0, (bound - slack)[own] / norms_q[own], -np.inf)
        stop = int(np.searchsorted(-norms_x, -needed.min(), "right"))
        products = q[own] @ x[:stop].T
        for i, row in zip(own.tolist(), products):
            at = np.flatnonzero(row >= bound[i] - slack[i])
            yield i, at, row[at]


def _in_bucket(q_ids: np.ndarray, q: np.ndarray, bound: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query number, id and product of each query's k best in a bucket, as far as they can be among the best of all."""
    out_q, out_id, out_s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    norms_q, norms_x, bound, head = np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1), bound.copy(), max(1, x.shape[1] // 4)
    for s in range(0, len(ids), 512):  # the bounds rise from step to step
        part, y = ids[s : s + 512], x[s : s + 512]
        for i, at, products in _products(q, y, bound, norms_q, norms_x[s : s + 512], head):
            other = part[at] != q_ids[i]
            found, score = _best(part[at][other], products[other], k)
            if len(found):
                out_q.append(np.full(len(found), i))
                out_id.append(found)
                out_s.append(score)
                if len(found) == k:
                    bound[i] = max(bound[i], score[-1] - 10.0**-DIGITS)
    i, found, score = np.concatenate(out_q), np.concatenate(out_id), np.concatenate(out_s)
    order = np.lexsort((found, -np.round(score, DIGITS), i))
    i, found, score = i[order], found[order], score[order]
    good = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[good], found[good], score[good]


def _bounds(k: int, longest):
    """Queries to their bounds and the least norm that a vector needs to reach them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = longest.value
        for table in (pa.Table.from_batches([b]) for b in batches if b.num_rows):
            q_ids, q = table.column("id").to_numpy(), _dense(table.column("v"))
            width = max(q.shape[1], head["dim"])
            q = np.pad(q, ((0, 0), (0, width - q.shape[1])))
            ids, x = _read(head["ids"], head["vectors"], head["n"], head["dim"], width)
            i, _, score = _in_bucket(q_ids, q, np.full(len(q), -np.inf), ids, x, k)
            bound, last = np.full(len(q), -np.inf), np.flatnonzero(np.r_[i[1:] != i[:-1], True][: len(i)])
            whole = np.bincount(i, minlength=len(q))[i[last]] == k
            bound[i[last[whole]]] = score[last[whole]] - 10.0**-DIGITS
            norms = np.linalg.norm(q, axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                needs = np.where(norms > 0, bound / norms, -np.inf)
            yield pa.record_batch([table.column("id").combine_chunks(), table.column("v").combine_chunks(), pa.array(bound), pa.array(needs)], names=["id", "v", "bound", "needs"])

    return run


def _search(k: int):
    """A bucket and then the blocks of queries that it is sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket: dict = {}
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1).to_pylist()[0]
                if row["bounds"] is None:
                    bucket = row
                    continue
                width = max(row["dim"], bucket["dim"])
                q_ids, q = _read(row["ids"], row["vectors"], row["n"], row["dim"], width)
                ids, x = _read(bucket["ids"], bucket["vectors"], bucket["n"], bucket["dim"], width)
                i, found, score = _in_bucket(q_ids, q, np.frombuffer(row["bounds"]), ids, x, k)
                yield pa.record_batch([pa.array(q_ids[i]), pa.array(found), pa.array(score)], names=["query_id", "id", "score"])

    return run


def _clean(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    return (
        vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
        .where("id IS NOT NULL AND v IS NOT NULL")
        .where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
        .groupBy("id").agg(F.min("v").alias("v"))
    )


def top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, block_rows: int = BLOCK_ROWS, every: int = 1) -> DataFrame:
    """query_id, id, score, rank: the k largest inner products of each query with all other vectors.
    Queries are the vectors whose id is divisible by `every`."""
    spark = vectors.sparkSession
    normed = materialise(_clean(vectors, id_col, vector_col).withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))), "vectors")
    blocks = max(1, -(-normed.count() // block_rows))
    # a range of descending norms is a bucket; ids spread equal norms over several
    ranges = normed.repartitionByRange(blocks, F.col("norm").desc(), F.xxhash64("id")).select(F.spark_partition_id().alias("block"), "id", "v")
    packed = materialise(ranges.mapInArrow(_pack, _BLOCK), "blocks")
    first = packed.orderBy("block").first()  # one bucket: about block_rows vectors at any size
    longest = spark.sparkContext.broadcast(first.asDict() if first else {"dim": 0, "n": 0, "ids": b"", "vectors": b""})
    queries = normed.where(F.col("id") % every == 0)
    bounded = materialise(queries.select("id", "v").mapInArrow(_bounds(k, longest), "id long, v array<double>, bound double, needs double"), "bounds")
    q_blocks = max(1, -(-bounded.count() // QUERY_ROWS))
    q_ranges = bounded.repartitionByRange(q_blocks, "needs", F.xxhash64("id")).select(F.spark_partition_id().alias("q_block"), "id", "v", "bound", "needs")
    q_packed = materialise(q_ranges.mapInArrow(_pack_queries(2 * QUERY_ROWS), _QUERIES).withColumn("q_block", F.monotonically_increasing_id()), "query-blocks")
    # numbers and bounds of blocks alone meet here; vectors follow by an equi-join
    pairs = q_packed.select("q_block", "least").join(packed.select("block", "most"), F.col("most") >= F.col("least") - 1e-6).select("q_block", "block")
    sent = q_packed.join(pairs.hint("merge"), "q_block").select("block", "n", "dim", "ids", "vectors", "bounds")
    both = packed.select("block", "n", "dim", "ids", "vectors", F.lit(None).cast("binary").alias("bounds")).unionByName(sent)
    found = both.repartition("block").sortWithinPartitions("block", F.col("bounds").isNotNull()).mapInArrow(_search(k), "query_id long, id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.round("score", DIGITS).desc(), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "id", F.round("score", DIGITS).alias("score"), "rank")


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbours of every vector whose id is divisible by 100 among all vectors."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=EVERY)


SQL = f"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
p AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_inner_product(a.v, b.v), {DIGITS}) AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % {EVERY} = 0)
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM p
QUALIFY rank <= {K}
"""
