"""Stores of vectors and of texts: Parquet tables, or services through a transport."""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .operators.dense import cosine_top_k
from .operators.expand import matches
from .operators.lexical import bm25
from .providers import Embedder, Http, Transport, with_vectors
from .scratch import materialise


def _last(rows: DataFrame) -> DataFrame:
    """One row of each id: of repeated ids the last by the column seq, which goes, or any of equal rows.
    Only ids are shuffled, and the rows whose id is repeated."""
    own = [F.col(f"`{c}`") for c in rows.columns if c != "seq"]
    often = rows.groupBy("chunk_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("chunk_id").alias("again"))
    if not often.limit(1).count():
        return rows.select(*own)
    same = F.col("chunk_id").eqNullSafe(F.col("again"))
    again = rows.join(often, same, "left_semi")
    if "seq" in rows.columns:
        again = again.withColumn("place", F.row_number().over(Window.partitionBy("chunk_id").orderBy(F.col("seq").desc_nulls_last()))).where("place = 1")
    return rows.join(often, same, "left_anti").select(*own).unionByName(again.select(*own).dropDuplicates(["chunk_id"]))


@dataclass(frozen=True)
class TableStore:
    """Rows by chunk_id in a Parquet folder of versions: an upsert adds a version, a row of a later one
    takes the place of an earlier one. Compact from time to time."""

    spark: SparkSession
    path: str

    def _versions(self) -> list[str]:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in files.listStatus(place)) if files.exists(place) else []

    def upsert(self, rows: DataFrame, once: bool = False) -> int:
        """Of repeated ids in rows the last by the column seq counts, or any of equal rows; once: no id is
        repeated. Gives the version."""
        number = max([int(v.split("=")[1]) for v in self._versions() if v.startswith("version=")], default=-1) + 1
        (rows if once else _last(rows)).write.parquet(f"{self.path}/version={number}")
        return number

    def read(self) -> DataFrame:
        """The present row of each id. A single version is read as it is."""
        rows = self.spark.read.option("mergeSchema", True).option("basePath", self.path).parquet(f"{self.path}/version=*")
        if sum(v.startswith("version=") for v in self._versions()) == 1:
            return rows.drop("version")
        newest = rows.groupBy("chunk_id").agg(F.max("version").alias("version"))
        return rows.join(newest, ["chunk_id", "version"]).drop("version")

    def compact(self) -> None:
        """Put all versions into one."""
        old = self._versions()
        self.upsert(materialise(self.read(), "compacted"))
        place = self.spark._jvm.org.apache.hadoop.fs.Path
        files = place(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for v in old:
            files.delete(place(f"{self.path}/{v}"), True)

    def count(self) -> int:
        return self.read().count()


def where(metadata: dict | None) -> Column | None:
    """A condition on the column metadata; none for no filter."""
    return matches(F.col("metadata"), metadata) if metadata else None


@dataclass(frozen=True)
class TableVectors:
    """Vectors in a TableStore, searched exactly."""

    store: TableStore

    def upsert(self, chunks: DataFrame, vectors: DataFrame) -> int:
        """chunks: chunk_id and more; vectors: chunk_id, vector. As many vectors as chunks are needed."""
        both = chunks.join(vectors, "chunk_id", "left")
        if both.where("vector IS NULL").limit(1).count():
            raise ValueError("a chunk has no vector")
        return self.store.upsert(both)

    def search(self, queries: DataFrame, k: int, condition: Column | None = None) -> DataFrame:
        """queries: query_id, vector. Ids that aren't whole numbers stand under their hashes meanwhile,
        by which equal scores are ranked then."""
        rows = self.store.read() if condition is None else self.store.read().where(condition)
        sides = {"chunk_id": rows, "query_id": queries}
        hashed = {c: df.withColumns({"own": F.col(c), c: F.xxhash64(c)}) for c, df in sides.items() if df.schema[c].dataType.simpleString() not in ("bigint", "int", "smallint", "tinyint")}
        found = cosine_top_k(*(hashed.get(c, df).select(c, "vector") for c, df in sides.items()), k)
        for c, df in hashed.items():
            found = found.join(df.select(c, "own"), c).drop(c).withColumnRenamed("own", c)
        return found.select("query_id", "chunk_id", "score", "rank").withColumn("source", F.lit("vector"))


@dataclass(frozen=True)
class TableKeywords:
    """Texts in a TableStore, searched with BM25: statistics are those of the present rows."""

    store: TableStore
    ngrams: int = 2

    def upsert(self, chunks: DataFrame) -> int:
        return self.store.upsert(chunks)

    def search(self, queries: DataFrame, k: int, condition: Column | None = None) -> DataFrame:
        return bm25(self.store.read(), queries, k, condition, ngrams=self.ngrams).withColumn("source", F.lit("bm25"))


def service_filter(metadata: dict | None, key: str = "metadata") -> dict | None:
    """The filter of a vector service: all of equal values or one of a list; an empty list is no
    condition there."""
    must = [{"key": f"{key}.{k}", "match": {"any": v} if isinstance(v, list) else {"value": v}} for k, v in (metadata or {}).items() if v != []]
    return {"must": must} if must else None


def point_id(chunk_id: object) -> str:
    """The same UUID for the same chunk."""
    return str(uuid.uuid5(uuid.NAMESPACE_URL, str(chunk_id)))


def _sent(rows: DataFrame, batch: int, send) -> int:
    """Rows to a service in batches, by the tasks that hold them; gives how many. A repeated task
    sends the same ids again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, batch):
                send(b.slice(s, batch).to_pylist())
            yield pa.record_batch([pa.array([b.num_rows], pa.int64())], names=["n"])

    return rows.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def _results(queries: DataFrame, search, source: str) -> DataFrame:
    """query_id, chunk_id, score, rank, source; one call a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(row["query_id"], str(chunk), float(score), i) for row in b.to_pylist() for i, (chunk, score) in enumerate(search(row), 1)]
            kinds = [b.schema.field("query_id").type, pa.string(), pa.float64(), pa.int32()]
            yield pa.record_batch([pa.array([r[c] for r in out], k) for c, k in enumerate(kinds)], names=["query_id", "chunk_id", "score", "rank"])

    kind = queries.schema["query_id"].dataType.simpleString()
    return queries.mapInArrow(run, f"query_id {kind}, chunk_id string, score double, rank int").withColumn("source", F.lit(source))


@dataclass(frozen=True)
class VectorService:
    """A Qdrant service."""

    url: str
    collection: str = "chunks"
    vector_name: str = "dense"
    key: str | None = None
    transport: Transport = field(default_factory=Http)

    def _call(self, method: str, path: str, body: object = None) -> object:
        return self.transport(method, f"{self.url.rstrip('/')}/collections/{self.collection}{path}", {"api-key": self.key} if self.key else {}, body)

    def create(self, dimensions: int, drop: bool = False) -> None:
        if drop:
            self._call("DELETE", "")
        self._call("PUT", "", {"vectors": {self.vector_name: {"size": dimensions, "distance": "Cosine"}}})

    def upsert(self, rows: DataFrame, batch: int = 64) -> int:
        """rows: chunk_id, vector, and columns that become the payload."""

        def send(some: list[dict]) -> None:
            points = [{"id": point_id(r["chunk_id"]), "vector": {self.vector_name: r["vector"]}, "payload": {k: v for k, v in r.items() if k != "vector"}} for r in some]
            self._call("PUT", "/points?wait=true", {"points": points})

        return _sent(rows, batch, send)

    def count(self) -> int:
        return self._call("POST", "/points/count", {"exact": True})["result"]["count"]

    def search(self, queries: DataFrame, k: int, metadata: dict | None = None) -> DataFrame:
        def one(row: dict):
            body = {"query": row["vector"], "using": self.vector_name, "limit": k, "with_payload": True}
            found = self._call("POST", "/points/query", body | ({"filter": f} if (f := service_filter(metadata)) else {}))["result"]
            return [(p["payload"]["chunk_id"], p["score"]) for p in (found["points"] if isinstance(found, dict) else found)]

        return _results(queries.select("query_id", "vector"), one, "vector")


@dataclass(frozen=True)
class KeywordService:
    """An Elasticsearch service."""

    url: str
    index: str = "chunks"
    analyzer: str = "ik_max_word"
    search_analyzer: str = "ik_smart"
    username: str | None = None
    password: str | None = None
    key: str | None = None
    transport: Transport = field(default_factory=lambda: Http(timeout=10.0))

    def _call(self, method: str, path: str, body: object = None) -> object:
        head = {"Authorization": f"ApiKey {self.key}"} if self.key else {}
        if self.username and not self.key:
            head = {"Authorization": "Basic " + base64.b64encode(f"{self.username}:{self.password or ''}".encode()).decode()}
        return self.transport(method, f"{self.url.rstrip('/')}/{path.lstrip('/')}", head, body)

    def ping(self) -> bool:
        try:
            self._call("GET", "")
            return True
        except RuntimeError:
            return False

    def exists(self) -> bool:
        try:
            self._call("GET", self.index)
            return True
        except RuntimeError:
            return False

    def settings(self) -> dict:
        text = {"type": "text", "analyzer": self.analyzer, "search_analyzer": self.search_analyzer}
        word = {"type": "keyword"}
        return {"mappings": {"properties": {"content": text, "chunk_id": word, "doc_id": word, "source_path": word, "metadata": {"type": "object", "dynamic": True}}}}

    def create(self) -> None:
        if not self.exists():
            self._call("PUT", self.index, self.settings())

    def upsert(self, chunks: DataFrame, batch: int = 64) -> int:
        def send(some: list[dict]) -> None:
            for r in some:
                self._call("PUT", f"{self.index}/_doc/{point_id(r['chunk_id'])}", r)

        n = _sent(chunks, batch, send)
        self._call("POST", f"{self.index}/_refresh")
        return n

    def search(self, queries: DataFrame, k: int, metadata: dict | None = None) -> DataFrame:
        def term(name: str, value: object) -> dict:
            some = value if isinstance(value, list) else [value]
            path = f"metadata.{name}" + (".keyword" if any(isinstance(v, str) for v in some) else "")
            return {"terms": {path: value}} if isinstance(value, list) else {"term": {path: value}}

        def one(row: dict):
            must = [{"match": {"content": row["query"]}}, *(term(n, v) for n, v in (metadata or {}).items())]
            hits = self._call("POST", f"{self.index}/_search", {"size": k, "query": {"bool": {"must": must}}})["hits"]["hits"]
            return [(h["_source"]["chunk_id"], h["_score"]) for h in hits]

        return _results(queries.select("query_id", "query"), one, "bm25")


@dataclass(frozen=True)
class Ingestor:
    """Embeds chunks and writes both stores, from one set of rows."""

    embedder: Embedder
    vectors: TableVectors | VectorService
    keywords: TableKeywords | KeywordService

    def chunks(self, rows: DataFrame) -> int:
        """rows: chunk_id, content and more; blank contents are left out. Gives how many were written."""
        kept = materialise(rows.where("trim(content) <> ''"), "ingested")
        last = _last(kept)
        if isinstance(self.vectors, TableVectors):
            self.vectors.store.upsert(with_vectors(last, "content", self.embedder), True)
        else:
            self.vectors.upsert(with_vectors(kept, "content", self.embedder))
        if isinstance(self.keywords, TableKeywords):
            self.keywords.store.upsert(last, True)
        else:
            self.keywords.upsert(kept)
        return kept.count()

    def documents(self, docs: DataFrame, size: int = 900, overlap: int = 120) -> int:
        """docs: doc_id, content and more, cut to windows first."""
        from .operators.chunking import chunk_documents

        return self.chunks(chunk_documents(docs, "doc_id", "content", size, overlap))


def bulk_load(records: DataFrame, embedder: Embedder, service: VectorService, recreate: bool = False, batch: int = 64, verify: str | None = None, dimensions: int | None = None) -> dict:
    """Chunks with content to a vector service; gives how many were read, sent and are there, and the
    first result of the query `verify`."""
    kept = records.where("trim(content) <> ''")
    service.create(dimensions or len(embedder.embed(["size"])[0]), recreate)
    sent = service.upsert(with_vectors(kept, "content", embedder), batch)
    out = {"read": records.count(), "sent": sent, "count": service.count()}
    if verify:
        spark = records.sparkSession
        asked = spark.createDataFrame([(0, embedder.embed([verify])[0])], "query_id long, vector array<double>")
        first = service.search(asked, 1).first()
        out["verified"] = first["chunk_id"] if first else None
    return out
