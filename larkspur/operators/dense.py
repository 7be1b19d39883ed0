"""Hash embeddings, and exact cosine search that keeps the best of each query while vectors pass."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha1

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import hash_tokens
from ..scratch import materialise
from .lexical import top

DIMENSIONS, BLOCK = 64, 2048
#: Numbers of a block of vectors, queries compared at once, bytes of queries that are sent to all tasks, and
#: pairs of blocks that a task's Python takes at once.
VALUES, AT_ONCE, SENT_BYTES, PAIRS = 1 << 17, 256, 16 << 20, 8


def _embed(dimensions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, BLOCK):
                part = batch.slice(s, BLOCK)
                lists = part.column(1)
                coded = lists.flatten().dictionary_encode()
                digests = [sha1(t.encode()).digest() for t in coded.dictionary.to_pylist()]
                place = np.array([int.from_bytes(d[:4], "big") % dimensions for d in digests], np.int64)
                sign = np.array([1.0 if d[4] % 2 == 0 else -1.0 for d in digests])
                token = coded.indices.to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                out = np.zeros(len(lists) * dimensions)
                if len(token):
                    out = np.bincount(row * dimensions + place[token], sign[token], len(out))
                out = out.reshape(len(lists), dimensions)
                norm = np.linalg.norm(out, axis=1, keepdims=True)
                out = np.divide(out, norm, out=out, where=norm > 0)
                offsets = pa.array(np.arange(len(lists) + 1, dtype=np.int32) * dimensions)
                yield pa.record_batch([part.column(0), pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))], names=[batch.schema.names[0], "vector"])

    return run


def hash_embedding(texts: DataFrame, id_col: str, text_col: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """(id, vector): each token adds +1 or -1 at a place, both from its SHA-1; of length 1, or 0
    without tokens. Within the row, without a shuffle; of a batch each distinct token is hashed
    once. A null text has no tokens."""
    rows = texts.select(F.col(id_col).cast("long").alias(id_col), hash_tokens(F.col(text_col)).alias("tokens"))
    return rows.mapInArrow(_embed(dimensions), f"`{id_col}` long, vector array<double>")


def with_hash_vectors(rows: DataFrame, text_col: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """rows with hash_embedding's vector, each made where its row lies."""
    own, embed = rows.columns, _embed(dimensions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, BLOCK):
                part = batch.slice(s, BLOCK)
                tokens = pa.record_batch([pa.nulls(part.num_rows), part.column(len(own))], names=["id", "tokens"])
                for made in embed(iter([tokens])):
                    yield pa.record_batch([*part.columns[:-1], made.column("vector")], names=[*own, "vector"])

    schema = T.StructType([*rows.schema.fields, T.StructField("vector", T.ArrayType(T.DoubleType()))])
    return rows.select(*(F.col(f"`{c}`") for c in own), hash_tokens(F.col(text_col))).mapInArrow(run, schema)


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists as rows, padded with zeros; what is null is NaN."""
    lengths = column.value_lengths().to_numpy()
    out = np.zeros((len(column), int(lengths.max(initial=0))))
    row = np.repeat(np.arange(len(column)), lengths)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of at most BLOCK rows and about VALUES numbers."""
    for batch in batches:
        widest = int(batch.column("vector").value_lengths().to_numpy().max(initial=0))
        step = max(64, min(BLOCK, VALUES // max(1, widest)))
        for s in range(0, batch.num_rows, step):
            part = batch.slice(s, step)
            yield part.column("id").to_numpy(), _matrix(part.column("vector"))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, vectors in _blocks(batches):
        yield pa.record_batch([pa.array([ids.tobytes()]), pa.array([vectors.shape[1]], pa.int32()), pa.array([vectors.tobytes()])], names=["ids", "width", "vectors"])


def _read(ids: bytes, width: int, vectors: bytes) -> tuple[np.ndarray, np.ndarray]:
    found = np.frombuffer(ids, np.int64)
    return found, np.frombuffer(vectors).reshape(len(found), width)


def _unit(v: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, norm, out=np.zeros_like(v), where=norm != 0)


class _Nearest:
    """The k most similar vectors of some queries, of those that have passed. A block's products in single
    precision that can't reach the k-th best so far are left out at once; the rest is computed in full, and
    waits until it is worth sorting."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, own: bool):
        self.ids, self.vectors, self.k, self.own, self.use = ids, vectors, k, own, -1
        self.bound = np.full(len(ids), -np.inf)
        self.held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {s: [] for s in range(0, len(ids), AT_ONCE)}

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        use = min(self.vectors.shape[1], vectors.shape[1])
        if use != self.use:
            self.use, self.q = use, _unit(self.vectors[:, :use])
            self.short = self.q.astype(np.float32)
        x, wanted, slack = _unit(vectors[:, :use]), self.k + self.own, 2.5e-7 * (use + 8)  # of a product of single precision
        short = x.astype(np.float32).T
        for s, held in self.held.items():
            about = self.short[s : s + AT_ONCE] @ short
            least = self.bound[s : s + AT_ONCE] - 1e-9 - slack
            if len(ids) > wanted and np.isneginf(least).any():
                about[np.isnan(about)] = -np.inf
                least = np.maximum(least, np.partition(about, len(ids) - wanted, axis=1)[:, len(ids) - wanted] - 1e-9 - 2 * slack)
            row, column = np.divmod(np.flatnonzero((about >= least.astype(np.float32)[:, None]).ravel()), max(1, len(ids)))
            value, found = np.einsum("ij,ij->i", self.q[s + row], x[column]), ids[column]
            good = value > -np.inf
            if self.own:
                good &= found != self.ids[s + row]
            if good.any():
                held.append((row[good], found[good], value[good]))
                if len(held) == 1 or sum(len(h[0]) for h in held[1:]) > AT_ONCE * self.k:
                    self._cut(s)

    def _cut(self, s: int) -> None:
        row, found, value = (np.concatenate(x) for x in zip(*self.held[s]))
        near = np.round(value, 9)
        order = np.lexsort((found, -near, row))
        row, found, value, near = row[order], found[order], value[order], near[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        last = place == self.k - 1
        self.bound[s + row[last]] = near[last]
        self.held[s] = [(row[place < self.k], found[place < self.k], value[place < self.k])]

    def rows(self) -> Iterator[pa.RecordBatch]:
        for s in self.held:
            if self.held[s]:
                self._cut(s)
                row, found, value = self.held[s][0]
                yield pa.record_batch([pa.array(self.ids[s + row]), pa.array(found), pa.array(value)], names=["query_id", "chunk_id", "score"])


def _pass(asked, k: int, own: bool):
    """All queries against the vectors of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [_Nearest(*_read(*block), k, own) for block in asked.value]
        for ids, vectors in _blocks(batches):
            for b in best:
                b.add(ids, vectors)
        for b in best:
            yield from b.rows()

    return run


def _search(k: int, own: bool):
    """A block of queries and the blocks of vectors that pass it, then the next one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, best = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                if row["q_number"].as_py() != number:
                    if best is not None:
                        yield from best.rows()
                    number = row["q_number"].as_py()
                    best = _Nearest(*_read(row["q_ids"].as_py(), row["q_width"].as_py(), row["q_vectors"].as_py()), k, own)
                best.add(*_read(row["ids"].as_buffer(), row["width"].as_py(), row["vectors"].as_buffer()))
        if best is not None:
            yield from best.rows()

    return run


def cosine_top_k(vectors: DataFrame, queries: DataFrame, k: int, candidates: Column | None = None, exclude_self: bool = False) -> DataFrame:
    """query_id, chunk_id, score, rank of the k most similar vectors of every query.

    vectors: chunk_id, vector and what `candidates` speaks of; queries: query_id, vector. Of two
    lengths the shorter counts; a zero or empty vector has the similarity 0; null vectors are left
    out. Queries of up to SENT_BYTES are sent to the tasks that make the vectors; of more, partitions of
    blocks meet pair by pair, and a task holds a block of queries while the vectors pass. k rows a query
    and task are shuffled. Equal scores, to 9 decimals, are ranked by chunk_id.
    """
    layout, found = "ids binary, width int, vectors binary", "query_id long, chunk_id long, score double"
    double = F.transform("vector", lambda x: x.cast("double")).alias("vector")
    if candidates is not None:
        vectors = vectors.where(candidates)
    x = vectors.where("vector IS NOT NULL").select(F.col("chunk_id").cast("long").alias("id"), double)
    q = materialise(queries.where("vector IS NOT NULL").select(F.col("query_id").cast("long").alias("id"), double).mapInArrow(_pack, layout), "query-blocks")
    if (q.agg(F.sum(F.length("vectors"))).first()[0] or 0) <= SENT_BYTES:
        asked = q.sparkSession.sparkContext.broadcast([(bytes(r.ids), r.width, bytes(r.vectors)) for r in q.collect()])
        return top(x.mapInArrow(_pass(asked, k, exclude_self), found), k, F.round("score", 9).desc(), F.col("chunk_id"))
    x = materialise(x.mapInArrow(_pack, layout), "vector-blocks")
    numbered = q.select(F.monotonically_increasing_id().alias("q_number"), *(F.col(c).alias(f"q_{c}") for c in q.columns))
    pairs = numbered.hint("shuffle_replicate_nl").crossJoin(x)
    best = materialise(pairs.mapInArrow(_search(k, exclude_self), found), "nearest", PAIRS)
    return top(best, k, F.round("score", 9).desc(), F.col("chunk_id"))
