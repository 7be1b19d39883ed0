"""Contract queries of the library's own operators and their SQL, over the tables of a folder.

documents are the chunks, benchmark the queries, embeddings the vectors, pages the files, and
conversations the answers.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..config import Config
from ..functions import text as tx
from ..operators import catalog, chunking, clauses, evaluate, expand, manifest, questions
from ..operators.dense import cosine_top_k, hash_embedding
from ..operators.fusion import blended_rerank, identity_rerank, lexical_rerank, rrf
from ..operators.lexical import bm25, document_frequencies, document_lengths
from ..providers import HashEmbedder
from ..scratch import materialise, scratch_path
from ..search import Hybrid, Hyde, MultiQuery
from ..stores import Ingestor, TableKeywords, TableStore, TableVectors

QUERIES: dict = {}
SQL: dict[str, str] = {}

RULES = catalog.Policy(standards=["docs"], wikis=["wiki"], articles=["blog", "news", "articles"], publishers=["2024"], keywords=["tech", "data"], deferred={"forum": "textbook_deferred"})


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumnsRenamed({"doc_id": "chunk_id", "text": "content"})


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


# --- fragments of SQL ---------------------------------------------------------------------------

_SP = tx.SPACE


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{_SP}+|{_SP}+\z', '', 'g')"


def _norm(x: str) -> str:
    return _strip(rf"regexp_replace({x}, '{_SP}+', ' ', 'g')")


def _clean(x: str) -> str:
    return _strip(rf"regexp_replace(regexp_replace(regexp_replace({x}, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")


def _tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '{tx.BM25_TOKEN}')"


_STOP = ", ".join(f"'{w}'" for w in tx.STOPWORDS)


def _content(x: str) -> str:
    return rf"list_filter(regexp_extract_all({_norm(f'lower({x})')}, '{tx.CONTENT_TOKEN}'), lambda t: regexp_matches(t, '^[{tx.CJK}]$') OR (length(t) > 1 AND t NOT IN ({_STOP})))"


def _overlap(a: str, b: str) -> str:
    return f"coalesce(list_sum(list_transform(list_distinct({a}), lambda t: least(len(list_filter({a}, lambda u: u = t)), len(list_filter({b}, lambda u: u = t))))), 0)"


_BASE = f"""
qt AS (SELECT query_id, token, count(*) AS qf FROM (SELECT query_id, unnest({_tokens('query')}) AS token FROM q) GROUP BY ALL),
dt AS (SELECT doc_id, {_tokens('text')} AS t FROM documents),
st AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM dt),
po AS (SELECT doc_id, token, any_value(l) AS l, count(*) AS tf FROM (SELECT doc_id, len(t) AS l, unnest(t) AS token FROM dt) WHERE token IN (SELECT token FROM qt) GROUP BY doc_id, token),
fr AS (SELECT token, count(*) AS df FROM po GROUP BY token)"""


def _bm25(k: int, where: str = "", name: str = "b", base: bool = True) -> str:
    kept = f"JOIN (SELECT doc_id FROM documents WHERE {where}) USING (doc_id)" if where else ""
    return f"""{_BASE + ',' if base else ''}
{name}s AS (SELECT query_id, doc_id AS chunk_id, sum(qf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / mean))) AS score
  FROM po JOIN fr USING (token) JOIN qt USING (token) {kept}, st GROUP BY ALL),
{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM {name}s QUALIFY rank <= {k})"""


_Q = "q AS (SELECT item_id AS query_id, text AS query FROM benchmark)"


def _hashed(source: str, key: str, text: str, name: str) -> str:
    return f"""
{name}t AS (SELECT {key} AS id, unnest(regexp_extract_all(lower({text}), '{tx.HASH_TOKEN}')) AS t FROM {source}),
{name}p AS (SELECT id, ('0x' || substr(sha1(t), 1, 8))::BIGINT % 64 AS d, sum(CASE WHEN ('0x' || substr(sha1(t), 9, 2))::BIGINT % 2 = 0 THEN 1 ELSE -1 END) AS v FROM {name}t GROUP BY ALL),
{name}n AS (SELECT id, sqrt(sum(v * v)) AS n FROM {name}p GROUP BY id),
{name} AS (SELECT id, d, v / n AS v FROM {name}p JOIN {name}n USING (id) WHERE v <> 0)"""


def _dense(k: int) -> str:
    """Needs q; gives v: query_id, chunk_id, score, rank."""
    return f"""{_hashed('documents', 'doc_id', 'text', 'hd')}, {_hashed('q', 'query_id', 'query', 'hq')},
vs AS (SELECT a.query_id, b.doc_id AS chunk_id, coalesce(s, 0) AS score FROM q a CROSS JOIN documents b
  LEFT JOIN (SELECT x.id AS query_id, y.id AS doc_id, sum(x.v * y.v) AS s FROM hq x JOIN hd y USING (d) GROUP BY ALL) USING (query_id, doc_id)),
v AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM vs QUALIFY rank <= {k})"""


def _fuse(k: int, w: tuple[float, float] = (1.0, 1.0), name: str = "f") -> str:
    return f"""
{name}u AS (SELECT query_id, chunk_id, {w[0]} / (60 + rank) AS part, 'vector' AS source, rank AS place, 0 AS l FROM v UNION ALL SELECT query_id, chunk_id, {w[1]} / (60 + rank), 'bm25', rank, 1 FROM b),
{name}g AS (SELECT query_id, chunk_id, sum(part) AS score, string_agg(source, '+' ORDER BY source) AS source, min(l * 1000000 + place) AS pos FROM {name}u GROUP BY ALL),
{name} AS (SELECT query_id, chunk_id, score, source, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, pos, chunk_id) AS rank FROM {name}g QUALIFY rank <= {k})"""


_SHOW = "query_id, chunk_id, round(score, 6) AS score, rank"


def _show(df: DataFrame, *more: str) -> DataFrame:
    return df.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank", *more)


# --- keyword search -------------------------------------------------------------------------------


@query(f"SELECT token, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({_tokens('text')}) AS token FROM documents) GROUP BY token")
def bm25_doc_freq(spark, sf_dir):
    return document_frequencies(chunks(spark, sf_dir))


@query(f"SELECT doc_id AS chunk_id, len({_tokens('text')}) AS length FROM documents")
def bm25_doc_len(spark, sf_dir):
    return document_lengths(chunks(spark, sf_dir))


@query(f"WITH {_Q}, {_bm25(10)} SELECT {_SHOW} FROM b")
def bm25_topk(spark, sf_dir):
    return _show(bm25(chunks(spark, sf_dir), asked(spark, sf_dir), 10))


@query(f"""WITH {_Q}, {_bm25(10, "lang = 'en'")} SELECT {_SHOW} FROM b""")
def bm25_topk_filtered(spark, sf_dir):
    return _show(bm25(chunks(spark, sf_dir), asked(spark, sf_dir), 10, F.col("lang") == "en"))


@query(f"""WITH {_Q}, {_bm25(10, "lang IN ('en', 'de') AND source IS NOT DISTINCT FROM source")} SELECT {_SHOW} FROM b""")
def bm25_topk_metadata(spark, sf_dir):
    """A filter on a map of metadata: one of a list, and a key that no chunk has."""
    held = chunks(spark, sf_dir).withColumn("metadata", F.create_map(F.lit("lang"), "lang", F.lit("source"), "source"))
    return _show(bm25(held, asked(spark, sf_dir), 10, expand.matches(F.col("metadata"), {"lang": ["en", "de"], "missing": None})))


# --- vector search --------------------------------------------------------------------------------

_COS = """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)
SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, round(list_cosine_similarity(a.v, b.v), 6) AS score,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.v, b.v), 9) DESC, b.vec_id) AS rank
FROM e a JOIN e b ON a.vec_id <> b.vec_id {where} QUALIFY rank <= 8"""


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), "label")


@query(_COS.format(where=""))
def vector_topk(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return _show(cosine_top_k(v, v.withColumnRenamed("chunk_id", "query_id"), 8, exclude_self=True))


@query(_COS.format(where="WHERE b.label IN (1, 2, 3)"))
def vector_topk_filtered(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return _show(cosine_top_k(v, v.withColumnRenamed("chunk_id", "query_id"), 8, F.col("label").isin(1, 2, 3), exclude_self=True))


@query(f"WITH {_hashed('documents', 'doc_id', 'text', 'h')} SELECT id AS doc_id, d AS place, round(v, 6) AS value FROM h")
def hash_embed(spark, sf_dir):
    v = hash_embedding(table(spark, sf_dir, "documents"), "doc_id", "text")
    return v.select("doc_id", F.posexplode("vector").alias("place", "value")).where("value <> 0").select("doc_id", F.col("place").cast("long").alias("place"), F.round("value", 6).alias("value"))


def _dense_search(spark, sf_dir, queries: DataFrame, k: int) -> DataFrame:
    found = hash_embedding(chunks(spark, sf_dir), "chunk_id", "content")
    return cosine_top_k(found, hash_embedding(queries, "query_id", "query"), k)


@query(f"WITH {_Q}, {_dense(10)} SELECT {_SHOW} FROM v")
def hash_vector_topk(spark, sf_dir):
    return _show(_dense_search(spark, sf_dir, asked(spark, sf_dir), 10))


# --- fusion and reranking -------------------------------------------------------------------------


def hybrid(spark, sf_dir, queries: DataFrame | None = None, k: int = 60, weights: tuple[float, float] = (1.0, 1.0), n_vector: int = 100, n_bm25: int = 100) -> DataFrame:
    queries = asked(spark, sf_dir) if queries is None else queries
    dense = _dense_search(spark, sf_dir, queries, n_vector).withColumn("source", F.lit("vector"))
    sparse = bm25(chunks(spark, sf_dir), queries, n_bm25).withColumn("source", F.lit("bm25"))
    return rrf([dense, sparse], k, weights=list(weights))


_HYBRID = f"WITH {_Q}, {_dense(100)}, {_bm25(100)}, "


@query(f"{_HYBRID}{_fuse(60)} SELECT {_SHOW}, source FROM f")
def rrf_hybrid(spark, sf_dir):
    return _show(hybrid(spark, sf_dir), "source")


@query(f"{_HYBRID}{_fuse(20, (1.0, 0.7))} SELECT {_SHOW}, source FROM f")
def rrf_weighted(spark, sf_dir):
    return _show(hybrid(spark, sf_dir, k=20, weights=(1.0, 0.7)), "source")


@query(f"{_HYBRID}{_fuse(8)} SELECT {_SHOW}, source FROM f")
def rerank_identity(spark, sf_dir):
    return _show(identity_rerank(hybrid(spark, sf_dir), 8), "source")


def _words(x: str) -> str:
    return f"list_filter(string_split(replace(lower({x}), chr(10), ' '), ' '), lambda t: t <> '')"


def searcher(spark, sf_dir, **sizes) -> Hybrid:
    """Documents in stores of their own, with vectors of hashes."""
    vectors, keywords = (TableStore(spark, scratch_path(spark, n)) for n in ("vectors", "keywords"))
    store = Ingestor(HashEmbedder(), TableVectors(vectors), TableKeywords(keywords))
    store.chunks(chunks(spark, sf_dir).select("chunk_id", "content", "lang"))
    return Hybrid(store.embedder, store.vectors, store.keywords, config=Config(**sizes))


@query(f"{_HYBRID}{_fuse(60)} SELECT {_SHOW}, source FROM f WHERE rank <= 8")
def hybrid_search(spark, sf_dir):
    """Ingest into both stores, then vector and keyword search, fusion and cut with default sizes."""
    return _show(searcher(spark, sf_dir).search(asked(spark, sf_dir)), "source")


@query(f"""{_HYBRID}{_fuse(60)}, x AS (SELECT f.query_id, f.chunk_id, f.rank AS place, f.source || '+rerank' AS source,
  len(list_distinct(list_intersect({_words('q.query')}, {_words('d.text')}))) + 0.01 * f.score AS score FROM f JOIN q USING (query_id) JOIN documents d ON d.doc_id = f.chunk_id)
SELECT query_id, chunk_id, round(score, 6) AS score, source, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, place) AS rank FROM x QUALIFY rank <= 8""")
def rerank_lexical(spark, sf_dir):
    return _show(lexical_rerank(hybrid(spark, sf_dir), asked(spark, sf_dir), chunks(spark, sf_dir), 8), "source")


@query(f"""{_HYBRID}{_fuse(60)}, x AS (SELECT f.query_id, f.chunk_id, f.score, f.rank AS place, bs.score AS given FROM f LEFT JOIN bs USING (query_id, chunk_id)),
y AS (SELECT *, CASE WHEN given IS NOT NULL THEN row_number() OVER (PARTITION BY query_id ORDER BY given DESC NULLS LAST, place) END AS remote,
  coalesce(given, min(given) OVER (PARTITION BY query_id), 0) AS r, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM x),
z AS (SELECT *, CASE WHEN hi - lo < 1e-12 THEN 0.5 ELSE (score - lo) / (hi - lo) END AS sn, min(r) OVER (PARTITION BY query_id) AS rl, max(r) OVER (PARTITION BY query_id) AS rh FROM y),
w AS (SELECT *, CASE WHEN rh - rl < 1e-12 THEN 0.5 ELSE (r - rl) / (rh - rl) END AS rn FROM z)
SELECT query_id, chunk_id, round(0.65 * rn + 0.35 * sn, 6) AS score,
  row_number() OVER (PARTITION BY query_id ORDER BY round(0.65 * rn + 0.35 * sn, 9) DESC, round(rn, 9) DESC, remote NULLS LAST, place) AS rank FROM w QUALIFY rank <= 8""")
def rerank_blend(spark, sf_dir):
    """The scores of the reranker are those of BM25 over all documents, of what is to be ranked."""
    found = materialise(hybrid(spark, sf_dir), "results")
    given = bm25(chunks(spark, sf_dir), asked(spark, sf_dir), 2**31 - 1, among=found).select("query_id", "chunk_id", F.col("score").alias("rerank_score"))
    return _show(blended_rerank(found, given, 8))


# --- texts ----------------------------------------------------------------------------------------


@query(f"""WITH t AS (SELECT doc_id, {_strip('text')} AS t FROM documents),
w AS (SELECT doc_id, list_filter(list_transform(range(0, ceil(greatest(length(t) - 900, 0) / 780)::BIGINT + 1), lambda i: {_strip("substr(t, i * 780 + 1, 900)")}), lambda x: x <> '') AS w FROM t)
SELECT doc_id::VARCHAR AS doc_id, i AS part, doc_id || '_chunk_' || lpad(i::VARCHAR, greatest(4, length(i::VARCHAR))::INT, '0') AS chunk_id, w[i] AS content FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w)""")
def chunk_fixed(spark, sf_dir):
    return chunking.chunk_documents(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"SELECT doc_id, {_clean('text')} AS text, {_norm('text')} AS line, substr(sha1(text), 1, 16) AS stable_id, 'sha1:' || sha1(text) AS hash FROM documents")
def normalized_texts(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", tx.normalize_text(t).alias("text"), tx.normalize_space(t).alias("line"), tx.stable_id(t).alias("stable_id"), F.concat(F.lit("sha1:"), F.sha1(t)).alias("hash"))


def _unescaped(x: str) -> str:
    for name, char in tx.ENTITIES:
        x = f"replace({x}, '{name}', '{char.replace(chr(39), chr(39) * 2)}')"
    return x


_MARKUP = _unescaped(r"regexp_replace(regexp_replace(html, '!\[([^\]]*)\]\([^)]+\)', '\1', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g')")


@query("SELECT page_id, " + _clean(rf"regexp_replace(regexp_replace({_MARKUP}, '(?i)<br[ \t\n]*/?>|</(?:p|div|tr|li|h[0-9]|table|tbody|thead)>', chr(10), 'g'), '<[^>]+>', ' ', 'g')") + " AS text FROM pages")
def clean_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.clean_markup(F.col("html")).alias("text"))


@query(rf"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace({_clean('text')}, '\n([ \t]{{0,3}}#{{1,6}}\s)', chr(1) || '\1', 'g'), chr(1)), lambda x: {_strip('x')}), lambda x: x <> '') AS s FROM documents)
SELECT doc_id, i - 1 AS place, s[i] AS section FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM s)""")
def split_sections(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunking.sections(F.col("text"))).alias("place", "section"))
    return found.withColumn("place", F.col("place").cast("long"))


_PIECES = f"list_filter(list_transform(range(0, greatest(ceil(length(y) / 700)::BIGINT - 1, 0) + 1), lambda i: {_strip('substr(y, i * 700 + 1, 700)')}), lambda z: z <> '')"
_SECTIONS = rf"list_filter(list_transform(string_split(regexp_replace({_clean('text')}, '\n([ \t]{{0,3}}#{{1,6}}\s)', chr(1) || '\1', 'g'), chr(1)), lambda x: {_strip('x')}), lambda x: x <> '')"


@query(rf"""WITH RECURSIVE s AS (SELECT doc_id, unnest({_SECTIONS}) AS s, unnest(range(len({_SECTIONS}))) AS sn FROM documents),
p AS (SELECT doc_id, sn, s, CASE WHEN length(s) <= 700 THEN [s] ELSE list_filter(list_transform(regexp_split_to_array(s, '\n\s*\n'), lambda x: {_strip('x')}), lambda x: x <> '') END AS ps FROM s),
r(doc_id, sn, ps, i, out, cur) AS (
  SELECT doc_id, sn, ps, 1, CASE WHEN length(s) <= 700 THEN [s] ELSE []::VARCHAR[] END, '' FROM p WHERE len(ps) > 0 AND (length(s) > 700 OR true)
  UNION ALL SELECT doc_id, sn, ps, i + 1, out || CASE
      WHEN length(x) > 700 THEN (CASE WHEN tops THEN [cur || chr(10) || chr(10) || substr(x, 1, free)] WHEN length(cur) > 0 THEN [cur] ELSE []::VARCHAR[] END) || {_PIECES.replace('y', 'y')}
      WHEN length(cur) > 0 AND length(cur) + length(x) + 2 > 700 THEN [cur] ELSE []::VARCHAR[] END,
    CASE WHEN length(x) > 700 THEN '' WHEN length(cur) > 0 AND length(cur) + length(x) + 2 > 700 THEN x WHEN length(cur) = 0 THEN x ELSE cur || chr(10) || chr(10) || x END
  FROM (SELECT *, ps[i] AS x, 700 - length(cur) - 2 AS free, length(cur) > 0 AND 700 - length(cur) - 2 > 120 AS tops,
          CASE WHEN length(cur) > 0 AND 700 - length(cur) - 2 > 120 THEN substr(ps[i], 700 - length(cur) - 2 + 1) ELSE ps[i] END AS y FROM r WHERE i <= len(ps) AND NOT (i = 1 AND len(out) = 1)) t),
e AS (SELECT doc_id, sn, CASE WHEN len(out) = 1 AND i = 1 THEN out WHEN cur <> '' THEN out || [cur] ELSE out END AS out FROM r WHERE i > len(ps) OR (i = 1 AND len(out) = 1)),
f AS (SELECT doc_id, sn, unnest(range(len(out))) AS j, unnest(out) AS content FROM e)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY sn, j) - 1)::INT AS place, content FROM f WHERE content <> ''""")
def split_long(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunking.records(F.col("text"), 700)).alias("place", "content"))


_MARKED = rf"regexp_replace(text, '([.!?。！？]){_SP}+', '\1' || chr(10), 'g')"
_SENT = rf"list_filter(list_transform(regexp_split_to_array({_MARKED}, '\n+'), lambda s: {_norm('s')}), lambda s: length(s) >= 4 AND len({_content('s')}) > 0)"
_TERMS = " || ".join(f"regexp_extract_all(text, '{p}')" for p in tx.CRITICAL)
_NO_ANSWER = " OR ".join(f"contains({_norm('lower(text)')}, '{p}')" for p in tx.ABSTENTIONS)


@query(f"SELECT conv_id, turn, array_to_string({_SENT}, '|') AS sentences, ({_NO_ANSWER}) AS abstained, array_to_string({_TERMS}, '|') AS terms FROM conversations")
def sentences_and_terms(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.array_join(tx.sentences(t), "|").alias("sentences"), tx.is_abstention(t).alias("abstained"), F.array_join(tx.critical_terms(t), "|").alias("terms")
    )


_LINE_OF = lambda x: _strip(rf"regexp_replace(translate(translate({_unescaped(x)}, '{clauses._FROM}', '{clauses._TO}'), '{clauses._BLANKS}' || chr(173), '{' ' * len(clauses._BLANKS)}'), '[ \t]+', ' ', 'g')")
_LINES = f"list_filter(list_transform(regexp_split_to_array(text, '{tx.LINE_END}'), lambda x: {_LINE_OF('x')}), lambda x: x <> '' AND NOT regexp_matches(x, '^\\d{{1,4}}$'))"


def _as_pages(spark, sf_dir) -> DataFrame:
    """Documents as the pages of their sources, with a list of contents every 50 pages."""
    listed = F.concat(F.lit("Contents\nFirst part .... 3\nSecond part .... 9\nThird part 12\n"), F.coalesce("text", F.lit("")))
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), F.when(F.col("doc_id") % 50 == 0, listed).otherwise(F.col("text")).alias("text"))


_PAGES = f"""pg AS (SELECT source AS doc_id, doc_id AS page, CASE WHEN doc_id % 50 = 0 THEN 'Contents' || chr(10) || 'First part .... 3' || chr(10) || 'Second part .... 9' || chr(10) || 'Third part 12' || chr(10) || coalesce(text, '') ELSE coalesce(text, '') END AS text FROM documents),
ln AS (SELECT doc_id, page, {_LINES} AS l FROM pg)"""


@query(f"""WITH {_PAGES}, e AS (SELECT doc_id, unnest(l[1:{clauses.EDGE}] || l[greatest(len(l) - {clauses.EDGE - 1}, 1):len(l)]) AS line FROM ln),
k AS (SELECT doc_id, line, count(*) AS n FROM e WHERE length(line) >= 4 AND NOT regexp_matches(line, '{clauses.TOC}') AND (regexp_matches(line, '{clauses.MARKS}') OR (length(line) <= 80 AND substr(line, -1) NOT IN ('.', '!', '?', ';', ':'))) GROUP BY ALL),
z AS (SELECT doc_id, greatest(floor(count(*) * {clauses.SHARE}), 3) AS least FROM pg GROUP BY doc_id)
SELECT doc_id, line, n FROM k JOIN z USING (doc_id) WHERE n >= least""")
def edge_lines(spark, sf_dir):
    return clauses.edge_lines(_as_pages(spark, sf_dir))


@query(rf"""WITH {_PAGES}, c AS (SELECT doc_id, page, len(list_filter(l, lambda x: regexp_matches(x, '{clauses.TOC}') OR (regexp_extract(x, ' (\d{{1,3}})$', 1) <> '' AND TRY_CAST(regexp_extract(x, ' (\d{{1,3}})$', 1) AS INT) <> page)))::INT AS n, len(l) AS size,
  len(list_filter(l, lambda x: lower(x) IN ('contents', 'table of contents'))) > 0 AS named FROM ln)
SELECT doc_id, page, n FROM c WHERE n >= 3 AND (named OR n / size >= 0.12)""")
def toc_pages(spark, sf_dir):
    return clauses.toc_pages(_as_pages(spark, sf_dir))


# --- catalogue ------------------------------------------------------------------------------------

_PATH = r"regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*/?', ''), '[?#].*$', '')"
_EXT = r"lower(regexp_extract(regexp_extract(path, '[^/]*$'), '^.+(\.[^./]+)$', 1))"


def _files(spark, sf_dir) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]*/?", ""), "[?#].*$", "")
    files = table(spark, sf_dir, "pages").select("page_id", path.alias("path"), F.length("html").cast("long").alias("size_bytes"))
    return files.withColumn("extension", catalog.extension(F.col("path"))).withColumn("top_level", F.split("path", "/")[0])


_FILES = f"p AS (SELECT page_id, {_PATH} AS path, length(html) AS size_bytes FROM pages), f AS (SELECT *, {_EXT} AS ext, split_part(path, '/', 1) AS top, split_part(path, '/', 2) AS publisher FROM p)"
_IN = lambda xs: ", ".join(f"'{x}'" for x in xs)
_ROUTE = "CASE " + " ".join(f"WHEN ext IN ({_IN(e)}) THEN '{r}'" for r, e in catalog.ROUTES.items()) + " ELSE 'unsupported' END"
_ENGINEERING = f"(publisher IN ({_IN(RULES.publishers)}) OR " + " OR ".join(f"contains(path, '{k}')" for k in RULES.keywords) + ")"
_REASON = f"""CASE WHEN ext IN ({_IN(catalog.ARCHIVES)}) THEN 'defer archive_deferred' WHEN ext IN ({_IN(catalog.IMAGES)}) THEN 'exclude image_reference_only'
WHEN ext = '.py' THEN 'exclude tooling_file' WHEN top IN ({_IN(RULES.standards)}) AND ext IN ({_IN(catalog.TEXTS + catalog.OFFICE)}) THEN 'include strong_evidence'
WHEN top IN ({_IN(RULES.standards)}) THEN 'defer unsupported_standard_extension' WHEN top IN ({_IN(RULES.wikis)}) AND ext = '.md' THEN 'include wiki_auxiliary'
WHEN top IN ({_IN(RULES.wikis)}) AND ext IN ('.xls', '.xlsx') THEN 'defer wiki_metadata_table' WHEN top IN ({_IN(RULES.wikis)}) THEN 'defer wiki_non_markdown'
WHEN top IN ({_IN(RULES.articles)}) AND ext = '.md' AND {_ENGINEERING} THEN 'include article_auxiliary' WHEN top IN ({_IN(RULES.articles)}) AND ext = '.md' THEN 'defer article_non_engineering_or_uncertain'
WHEN top IN ({_IN(RULES.articles)}) AND ext = '.html' THEN 'defer article_html_fallback' WHEN top IN ({_IN(RULES.articles)}) AND ext = '.pdf' THEN 'defer article_pdf_deferred'
WHEN top IN ({_IN(RULES.articles)}) THEN 'exclude article_attachment' WHEN top = 'forum' THEN 'defer textbook_deferred'
WHEN ext IN ('.xls', '.xlsx') THEN 'defer metadata_spreadsheet' ELSE 'exclude not_in_mvp_profile' END"""


@query(f"WITH {_FILES} SELECT page_id, path, ext AS extension, {_ROUTE} AS route, split_part({_REASON}, ' ', 1) AS action, split_part({_REASON}, ' ', 2) AS reason FROM f")
def policy_case(spark, sf_dir):
    found = _files(spark, sf_dir).withColumn("p", catalog.policy(F.col("path"), F.col("extension"), RULES))
    return found.select("page_id", "path", "extension", catalog.parse_route(F.col("extension")).alias("route"), "p.action", "p.reason")


@query(f"WITH {_FILES} SELECT top AS top_level, count(*) AS files, sum(size_bytes)::BIGINT AS size_bytes, round_even(sum(size_bytes) / 1048576, 2) AS size_mb FROM f GROUP BY top")
def directory_summary(spark, sf_dir):
    return catalog.directory_summary(_files(spark, sf_dir))


@query(f"WITH {_FILES} SELECT CASE WHEN ext = '' THEN '<none>' ELSE ext END AS extension, count(*) AS files FROM f GROUP BY ext ORDER BY files DESC, extension LIMIT 20")
def top_extensions(spark, sf_dir):
    """A report of the 20 most frequent extensions."""
    return catalog.counts(_files(spark, sf_dir), "extension", 20)


@query(f"WITH {_FILES} SELECT count(*) AS files, sum(size_bytes)::BIGINT AS size_bytes, round_even(sum(size_bytes) / 1073741824, 2) AS size_gb FROM f")
def scan_totals(spark, sf_dir):
    return manifest.totals(_files(spark, sf_dir))


@query(f"""WITH {_FILES}, k AS (SELECT top, size_bytes, CASE WHEN ext = '' THEN '<none>' ELSE ext END AS e, split_part({_REASON}, ' ', 1) AS a FROM f),
x AS (SELECT top, e, count(*) AS n FROM k GROUP BY ALL), y AS (SELECT top, a, count(*) AS n FROM k GROUP BY ALL)
SELECT t.top AS top_level, files, size_bytes, size_mb, (SELECT string_agg(e || ':' || n, ', ' ORDER BY n DESC, e) FROM (SELECT * FROM x WHERE x.top = t.top ORDER BY n DESC, e LIMIT 8)) AS extensions,
  (SELECT string_agg(a || ':' || n, ', ' ORDER BY a) FROM y WHERE y.top = t.top) AS actions
FROM (SELECT top, count(*) AS files, sum(size_bytes)::BIGINT AS size_bytes, round_even(sum(size_bytes) / 1048576, 2) AS size_mb FROM k GROUP BY top) t""")
def scan_directories(spark, sf_dir):
    files = _files(spark, sf_dir).withColumn("action", catalog.policy(F.col("path"), F.col("extension"), RULES)["action"])
    flat = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["value"], x["files"].cast("string"))), ", ")
    return manifest.directories(files).withColumns({c: flat(c) for c in ("extensions", "actions")})


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def upsert_latest(spark, sf_dir):
    return catalog.upsert_latest(table(spark, sf_dir, "events"), "user_id", F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", "event_type", "value")


# --- queries, citations ---------------------------------------------------------------------------


@query(rf"""SELECT item_id AS query_id, CASE WHEN len(regexp_extract_all(text, '{tx.STANDARD_PDF}', 1)) = 0
  THEN array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '{tx.STANDARD_ID}'), lambda x: upper(x)))), '|') ELSE '' END AS standards,
  array_to_string(list_sort(list_distinct(regexp_extract_all(text, '{tx.STANDARD_PDF}', 1))), '|') AS titles
FROM (SELECT item_id, text || CASE WHEN length(text) > 200 THEN ' see ecss-e-hb-10-02A and ECSS-Q-ST-70C' ELSE ' in ECSS-E-ST-10C(2009).pdf' END AS text FROM benchmark)""")
def query_routing(spark, sf_dir):
    named = F.concat("query", F.when(F.length("query") > 200, " see ecss-e-hb-10-02A and ECSS-Q-ST-70C").otherwise(" in ECSS-E-ST-10C(2009).pdf"))
    q = asked(spark, sf_dir).select("query_id", named.alias("query"))
    return q.select("query_id", F.array_join(expand.routed_standards(F.col("query")), "|").alias("standards"), F.array_join(expand.routed_titles(F.col("query")), "|").alias("titles"))


@query(f"""WITH {_Q}, {_bm25(10)} SELECT query_id, rank, '[' || rank || '] ' || coalesce(nullif(source, ''), 'unknown_source') || ', section ' || coalesce(nullif(lang, ''), 'n/a') || ', p.' || n_chars || ', chunk_id=' || chunk_id AS citation
FROM b JOIN documents ON doc_id = chunk_id""")
def citation(spark, sf_dir):
    found = materialise(bm25(chunks(spark, sf_dir), asked(spark, sf_dir), 10), "results").join(chunks(spark, sf_dir).drop("content"), "chunk_id")
    name = F.regexp_extract("source", r"[^/]*$", 0)
    return found.select("query_id", "rank", expand.citation(name, F.col("lang"), F.lit(""), F.col("n_chars"), F.lit(None), F.col("chunk_id"), F.col("rank")).alias("citation"))


_MAP = "MAP {" + ", ".join(f"'{k}': [{', '.join(repr(w) for w in v)}]" for k, v in expand.SYNONYMS.items()) + "}"
_QW = rf"regexp_extract_all(query, '[A-Za-z0-9._-]+|[{tx.CJK}]')"
_VARIANTS = f"""
sw AS (SELECT query_id, query, i, w, {_QW} AS ws, {_MAP}[lower(w)] AS s FROM (SELECT query_id, query, unnest({_QW}) AS w, unnest(range(len({_QW}))) AS i FROM q)),
sx AS (SELECT query_id, query, i, ws, w, unnest(s) AS s, unnest(range(len(s))) AS j FROM sw WHERE s IS NOT NULL),
sd AS (SELECT query_id, query, s, min(i * 100 + j) AS pos FROM sx WHERE lower(s) <> lower(w) AND NOT list_contains(ws, s) GROUP BY ALL),
sv AS (SELECT query_id, 0 AS place, query AS variant FROM q UNION ALL
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS place, query || ' ' || s FROM sd QUALIFY place < 5)"""


@query(f"WITH {_Q}, {_VARIANTS} SELECT query_id, place::INT AS place, variant FROM sv")
def synonym_variants(spark, sf_dir):
    return expand.variants(asked(spark, sf_dir), expand.synonym_variants(F.col("query")))


@query(rf"""WITH {_Q}, c AS (SELECT query_id, query, regexp_extract_all(query, '[{tx.CJK}]') AS c FROM q),
p AS (SELECT query_id, [query] || list_filter(CASE WHEN len(c) > 0 THEN regexp_split_to_array(query, '[的与和及、,， ]+') ELSE regexp_split_to_array(query, '(?i)\s+(?:and|or|&)\s*|[\s,;]\s*') END, lambda x: length(x) >= 2)
  || CASE WHEN len(c) >= 3 THEN [query || ' ' || array_to_string(list_transform(range(1, len(c)), lambda i: c[i] || c[i + 1]), ' ')] ELSE []::VARCHAR[] END AS p FROM c),
u AS (SELECT query_id, unnest(p) AS variant, unnest(range(len(p))) AS i FROM p), d AS (SELECT query_id, variant, min(i) AS i FROM u GROUP BY ALL)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY i) - 1)::INT AS place, variant FROM d QUALIFY place < 6""")
def subquery_variants(spark, sf_dir):
    return expand.variants(asked(spark, sf_dir), expand.subquery_variants(F.col("query")))


_HYDE = rf"""
hw AS (SELECT query_id, query, flatten(list_filter(list_transform(regexp_extract_all(lower(query), '[A-Za-z]+|[{tx.CJK}]'), lambda w: {_MAP}[w]), lambda x: x IS NOT NULL))[1:6] AS s FROM q),
hx AS (SELECT query_id, query, query || CASE WHEN len(s) > 0 THEN '. ' || array_to_string(s, ' ') ELSE '' END || '. ' || query || '. ' || query AS t FROM hw),
hy AS (SELECT query_id, t || repeat(' ' || query, ceil(greatest(200 - length(t), 0) / (length(query) + 1))::BIGINT) AS query FROM hx)"""


@query(f"WITH {_Q}, {_HYDE} SELECT query_id, query AS text FROM hy")
def hyde_text(spark, sf_dir):
    return asked(spark, sf_dir).select("query_id", expand.hypothetical(F.col("query")).alias("text"))


def multi_query(spark, sf_dir, of: Column, k: int = 20) -> DataFrame:
    """All variants are searched in one plan, each a query of its own, then fused by query."""
    rows = expand.variants(asked(spark, sf_dir), of)
    keyed = rows.select(F.concat_ws("/", "query_id", "place").alias("query_id"), F.col("variant").alias("query"))
    found = bm25(chunks(spark, sf_dir), keyed, k).withColumn("source", F.lit("bm25"))
    parts = found.select(F.split("query_id", "/")[0].cast("long").alias("query_id"), F.split("query_id", "/")[1].cast("int").alias("variant"), "chunk_id", "rank", "source")
    fused = parts.groupBy("query_id", "chunk_id").agg(F.sum(1 / (60 + F.col("rank"))).alias("score"), F.min(F.struct("variant", "rank")).alias("at"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), "at", "chunk_id"))
    return fused.withColumn("rank", place).where(F.col("rank") <= k)


@query(f"""WITH o AS (SELECT item_id AS query_id, text AS query FROM benchmark), {_VARIANTS.replace('FROM q', 'FROM o')},
q AS (SELECT query_id * 100 + place AS query_id, variant AS query FROM sv), {_bm25(20)},
g AS (SELECT query_id // 100 AS query_id, chunk_id, sum(1 / (60 + rank)) AS score, min(query_id % 100 * 1000 + rank) AS pos FROM b GROUP BY ALL)
SELECT query_id, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, pos, chunk_id) AS rank FROM g QUALIFY rank <= 20""")
def multi_query_rrf(spark, sf_dir):
    return _show(multi_query(spark, sf_dir, expand.synonym_variants(F.col("query"))))


_CTES = "hdt hdp hdn hd hqt hqp hqn hq vs v qt dt st po fr bs b fu fg f q".split()


def _renamed(sql: str, suffix: str) -> str:
    """A fragment whose tables have other names."""
    return re.sub(rf"\b({'|'.join(_CTES)})\b", rf"\1{suffix}", sql)


_BY_TEXT = _renamed(f"q AS (SELECT query_id, query FROM hy), {_dense(100)}, {_bm25(1)}, {_fuse(20)}", "_t")
_BY_WORD = _renamed(f"q AS (SELECT query_id, query FROM q0), {_dense(1)}, {_bm25(100)}, {_fuse(20)}", "_w")


@query(f"""WITH q0 AS (SELECT item_id AS query_id, text AS query FROM benchmark), {_HYDE.replace('FROM q)', 'FROM q0)')}, {_BY_TEXT}, {_BY_WORD},
z AS (SELECT query_id, chunk_id, 1.0 / (60 + rank) AS part, source || '+hyde' AS source, rank AS pos FROM f_t UNION ALL SELECT query_id, chunk_id, 1.0 / (60 + rank), source, 1000000 + rank FROM f_w),
y AS (SELECT query_id, chunk_id, sum(part) AS score, array_to_string(list_sort(list_distinct(flatten(list(string_split(source, '+'))))), '+') AS source, min(pos) AS pos FROM z GROUP BY ALL)
SELECT query_id, chunk_id, round(score, 6) AS score, source, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, pos, chunk_id) AS rank FROM y QUALIFY rank <= 20""")
def hyde_rrf(spark, sf_dir):
    """Vector search with the hypothetical text and keyword search with the query, fused."""
    return _show(Hyde(searcher(spark, sf_dir, final_top_k=20)).search(asked(spark, sf_dir)), "source")


# --- evaluation -----------------------------------------------------------------------------------

_METRICS = ["mrr", *(f"{m}_{k}" for k in evaluate.DEPTHS for m in ("recall", "precision"))]


def _items(spark, sf_dir) -> DataFrame:
    """Queries, the documents that quote them as gold; negative without any."""
    q, docs = asked(spark, sf_dir), chunks(spark, sf_dir).select("chunk_id", "content", "source")
    held = materialise(evaluate.quoting(docs, q), "quoting").join(docs.select("chunk_id", "source"), "chunk_id").groupBy("query_id").agg(F.collect_set("chunk_id").alias("gold"), F.collect_set("source").alias("gold_docs"))
    items = q.join(held, "query_id", "left").withColumns({"kind": F.when(F.length("query") < 200, "short").otherwise("long"), "negative": F.col("gold").isNull()})
    return materialise(items, "items")


def _measured(spark, sf_dir) -> DataFrame:
    return evaluate.retrieval_metrics(_items(spark, sf_dir), bm25(chunks(spark, sf_dir), asked(spark, sf_dir), 10))


_MEASURED = f"""WITH {_Q}, {_bm25(10)},
g AS (SELECT query_id, doc_id AS chunk_id FROM q JOIN documents ON contains(text, query)), n AS (SELECT query_id, count(*) AS n FROM g GROUP BY ALL),
h AS (SELECT query_id, rank, g.chunk_id IS NOT NULL AS hit FROM b LEFT JOIN g USING (query_id, chunk_id)),
m AS (SELECT q.query_id, any_value(n) IS NULL AS negative, CASE WHEN length(query) < 200 THEN 'short' ELSE 'long' END AS kind, coalesce(1 / min(rank) FILTER (hit), 0) AS mrr,
  {', '.join(f"CASE WHEN any_value(n) > 0 THEN count_if(hit AND rank <= {k}) / any_value(n) END AS recall_{k}, CASE WHEN any_value(n) > 0 THEN coalesce(count_if(hit AND rank <= {k}) / nullif(count_if(rank <= {k}), 0), 0) END AS precision_{k}" for k in evaluate.DEPTHS)}
  FROM q LEFT JOIN h USING (query_id) LEFT JOIN n USING (query_id) GROUP BY q.query_id, query)"""


@query(f"{_MEASURED} SELECT query_id, {', '.join(f'round({m}, 6) AS {m}' for m in _METRICS)} FROM m")
def retrieval_metrics(spark, sf_dir):
    return _measured(spark, sf_dir).select("query_id", *(F.round(m, 6).alias(m) for m in _METRICS))


@query(f"{_MEASURED} SELECT kind, count(*) AS items, count_if(NOT negative)::BIGINT AS positive_items, {', '.join(f'round(avg({m}) FILTER (NOT negative), 6) AS {m}' for m in _METRICS)} FROM m GROUP BY GROUPING SETS ((), (kind))")
def metrics_by_type(spark, sf_dir):
    """Means over the items that have gold, by kind and over all."""
    found = evaluate.summary(_measured(spark, sf_dir), "kind", _METRICS)
    return found.select("kind", "items", "positive_items", *(F.round(m, 6).alias(m) for m in _METRICS))


def _grounding(key: str, source: str) -> str:
    """Needs a table with key, text (the answer) and before (the evidence); gives gs: key, abstained,
    n_sentences, unsupported."""
    terms = _TERMS.replace("(text,", "(s,")
    supported = f"{_overlap('a', 'b')} / len(a) >= {evaluate.SUPPORT} AND len(list_filter({terms}, lambda t: NOT contains({_norm('lower(before)')}, {_norm('lower(t)')}))) = 0"
    return f"""gt AS (SELECT {key}, text, before, {_SENT} AS ss, ({_NO_ANSWER}) AS abstained FROM {source}),
gu AS (SELECT {key}, before, unnest(ss) AS s FROM gt), gv AS (SELECT {key}, s, before, {_content('s')} AS a, {_content('before')} AS b FROM gu),
gw AS (SELECT {key}, count_if(NOT ({supported})) AS bad FROM gv GROUP BY ALL),
gs AS (SELECT {key}, abstained, len(ss)::INT AS n_sentences, (CASE WHEN abstained THEN 0 ELSE coalesce(bad, 0) END)::INT AS unsupported,
  CASE WHEN len(ss) > 0 THEN (CASE WHEN abstained THEN 0 ELSE coalesce(bad, 0) END) / len(ss) ELSE 0 END AS hallucination_rate FROM gt LEFT JOIN gw USING ({key}))"""


_RAG_MEANS = ["mrr", "first_gold_rank_median", *(f"{m}_{k}" for k in evaluate.DEPTHS for m in ("slice_recall", "slice_all_hit", "doc_recall", "doc_all_hit", "source_precision", "coverage")), *evaluate.ANSWER_MEANS]
_SAY = "CASE query_id % 3 WHEN 0 THEN 'Insufficient information.' WHEN 1 THEN query || ' It weighs 12.5 kg.' END"
_PER_K = lambda f: ", ".join(f(k) for k in evaluate.DEPTHS)


@query(f"""WITH {_Q}, {_bm25(10)}, g AS (SELECT query_id, doc_id AS chunk_id, source FROM q JOIN documents ON contains(text, query)),
n AS (SELECT query_id, count(DISTINCT chunk_id) AS n, count(DISTINCT source) AS nd FROM g GROUP BY ALL), gd AS (SELECT DISTINCT query_id, source FROM g),
r AS (SELECT b.query_id, b.rank, d.source, d.text AS content, g.chunk_id IS NOT NULL AS hit, gd.source IS NOT NULL AS dochit FROM b JOIN documents d ON d.doc_id = b.chunk_id
  LEFT JOIN g ON g.query_id = b.query_id AND g.chunk_id = b.chunk_id LEFT JOIN gd ON gd.query_id = b.query_id AND gd.source = d.source),
et AS (SELECT query_id, token, count(*) AS wanted FROM (SELECT query_id, unnest({_content('query')}) AS token FROM q) GROUP BY ALL),
rt AS (SELECT query_id, rank, token, count(*) AS n FROM (SELECT query_id, rank, unnest({_content('content')}) AS token FROM r) GROUP BY ALL),
ct AS (SELECT query_id, token, wanted, {_PER_K(lambda k: f'coalesce(sum(n) FILTER (rank <= {k}), 0) AS n_{k}')} FROM et LEFT JOIN rt USING (query_id, token) GROUP BY ALL),
cv AS (SELECT query_id, {_PER_K(lambda k: f'sum(least(wanted, n_{k})) / sum(wanted) AS coverage_{k}')} FROM ct GROUP BY ALL),
ev AS (SELECT query_id, string_agg(content, chr(10) ORDER BY rank) AS before FROM r GROUP BY ALL),
an AS (SELECT query_id, query, {_SAY} AS text, coalesce(before, '') AS before FROM q LEFT JOIN ev USING (query_id) WHERE query_id % 3 < 2), {_grounding('query_id', 'an')},
m AS (SELECT q.query_id, query, any_value(n) IS NULL AS negative, CASE WHEN length(query) < 200 THEN 'short' ELSE 'long' END AS kind, min(rank) FILTER (hit) AS first,
  {_PER_K(lambda k: f'''count_if(hit AND rank <= {k}) / any_value(n) AS slice_recall_{k}, coalesce(count_if(hit AND rank <= {k}) = any_value(n), false) AS slice_all_hit_{k},
  count(DISTINCT source) FILTER (dochit AND rank <= {k}) / any_value(nd) AS doc_recall_{k}, coalesce(count(DISTINCT source) FILTER (dochit AND rank <= {k}) = any_value(nd), false) AS doc_all_hit_{k},
  CASE WHEN any_value(n) > 0 THEN coalesce(count_if(dochit AND rank <= {k}) / nullif(count_if(rank <= {k}), 0), 0) END AS source_precision_{k}''')}
  FROM q LEFT JOIN r USING (query_id) LEFT JOIN n USING (query_id) GROUP BY q.query_id, query),
w AS (SELECT m.*, an.text AS answer, abstained, hallucination_rate, {_content('m.query')} AS x, {_content('an.text')} AS y, cv.* EXCLUDE (query_id) FROM m LEFT JOIN cv USING (query_id) LEFT JOIN an USING (query_id) LEFT JOIN gs USING (query_id)),
o AS (SELECT *, CASE WHEN answer IS NOT NULL AND NOT negative THEN CASE WHEN len(x) > 0 AND len(y) > 0 THEN 2 * {_overlap('y', 'x')} / (len(x) + len(y)) ELSE 0 END END AS f1,
  CASE WHEN answer IS NOT NULL AND NOT negative THEN CASE WHEN len(x) > 0 THEN {_overlap('x', 'y')} / len(x) ELSE 0 END END AS er FROM w)
SELECT kind, count(*) AS items, count_if(NOT negative)::BIGINT AS positive_items, count_if(negative)::BIGINT AS negative_items, count(answer) AS answered_items,
  round(avg(coalesce(1 / first, 0)) FILTER (NOT negative), 6) AS mrr, round(median(first) FILTER (NOT negative), 6) AS first_gold_rank_median,
  {_PER_K(lambda k: f'''round(avg(slice_recall_{k}) FILTER (NOT negative), 6) AS slice_recall_{k}, round(avg(slice_all_hit_{k}::INT) FILTER (NOT negative), 6) AS slice_all_hit_{k}, round(avg(doc_recall_{k}) FILTER (NOT negative), 6) AS doc_recall_{k},
  round(avg(doc_all_hit_{k}::INT) FILTER (NOT negative), 6) AS doc_all_hit_{k}, round(avg(source_precision_{k}) FILTER (NOT negative), 6) AS source_precision_{k}, round(avg(coalesce(coverage_{k}, 0)) FILTER (NOT negative), 6) AS coverage_{k}''')},
  round(avg(f1), 6) AS answer_token_f1, round(avg(er), 6) AS answer_expected_recall, round(avg(hallucination_rate), 6) AS hallucination_rate, round(avg(1 - hallucination_rate), 6) AS grounded_rate,
  round(avg(CASE WHEN negative AND answer IS NOT NULL THEN abstained::INT END), 6) AS negative_abstention_correct FROM o GROUP BY GROUPING SETS ((), (kind))""")
def evaluate_rag(spark, sf_dir):
    """Retrieval, coverage and answers of all items, summed up over all and by kind."""
    q = asked(spark, sf_dir)
    found = materialise(bm25(chunks(spark, sf_dir), q, 10), "results")
    held = materialise(found.join(chunks(spark, sf_dir).select("chunk_id", "content", F.col("source").alias("doc")), "chunk_id"), "held")
    said = F.when(F.col("query_id") % 3 == 0, "Insufficient information.").when(F.col("query_id") % 3 == 1, F.concat("query", F.lit(" It weighs 12.5 kg.")))
    answers = q.select("query_id", said.alias("answer")).where("answer IS NOT NULL")
    scored = evaluate.score_items(_items(spark, sf_dir).withColumn("expected_answer", F.col("query")), held, answers)
    found = evaluate.summarise(scored, "kind")
    return found.select("kind", "items", "positive_items", "negative_items", "answered_items", *(F.round(F.col(m).cast("double"), 6).alias(m) for m in _RAG_MEANS))


_SAID = "c AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn, text) AS before FROM conversations), k AS (SELECT *, " + f"{_content('text')} AS a, {_content('before')} AS b FROM c WHERE before IS NOT NULL)"


@query(f"""WITH {_SAID} SELECT conv_id, turn, round(CASE WHEN len(a) > 0 AND len(b) > 0 THEN 2 * {_overlap('a', 'b')} / (len(a) + len(b)) ELSE 0 END, 6) AS f1,
  round(CASE WHEN len(b) > 0 THEN {_overlap('b', 'a')} / len(b) ELSE 0 END, 6) AS coverage FROM k""")
def answer_overlap(spark, sf_dir):
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn", "text"))
    said = table(spark, sf_dir, "conversations").withColumn("before", before).where("before IS NOT NULL")
    return said.select("conv_id", "turn", F.round(evaluate.token_f1(F.col("text"), F.col("before")), 6).alias("f1"), F.round(evaluate.coverage(F.col("before"), F.col("text")), 6).alias("coverage"))


@query(f"""WITH {_SAID}, {_grounding('conv_id, turn', 'k')} SELECT conv_id, turn, abstained, n_sentences, unsupported, round(hallucination_rate, 6) AS hallucination_rate, round(1 - hallucination_rate, 6) AS grounded_rate FROM gs""")
def answer_grounding(spark, sf_dir):
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn", "text"))
    said = table(spark, sf_dir, "conversations").withColumn("before", before).where("before IS NOT NULL")
    found = evaluate.answer_metrics(said, "text", "before")
    return found.select("conv_id", "turn", "abstained", "n_sentences", "unsupported", F.round("hallucination_rate", 6).alias("hallucination_rate"), F.round("grounded_rate", 6).alias("grounded_rate"))


_HAS = lambda words: "(" + " OR ".join(f"contains(lower(source || ' ' || t), '{w}')" for w in words) + ")"
_COMMON = ["dom", "tera", "lis"]
_RECORDS = f"x AS (SELECT doc_id, source, lang, {_norm('text')} AS t FROM documents)"
_PARAMETER = rf"(regexp_matches(lower(t), '{questions._UNIT}') OR " + " OR ".join(f"contains(lower(t), '{w}')" for w in ("table", "figure", "threshold", "limit")) + ")"


def _question_records(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    none = F.lit(None).cast("int")
    return docs.select(
        F.col("doc_id").alias("record_id"), F.col("doc_id").cast("string").alias("doc_id"), F.col("lang").alias("pdf"), F.lit("").alias("source_path"), F.col("doc_id").cast("string").alias("section"), F.col("source").alias("section_title"),
        none.alias("page_start"), none.alias("page_end"), F.explode(F.array(tx.normalize_space(F.col("text")))).alias("content"), F.col("doc_id").alias("seq"),
    ).where("content <> ''")  # fmt: skip  # an explode, or the text would be normalised anew wherever it is used


@query(f"""WITH {_RECORDS} SELECT doc_id AS record_id, {_HAS(questions.REQUIREMENTS)} AS requirement, {_HAS(questions.METHODS)} AS method, {_HAS(_COMMON)} AS common, {_PARAMETER} AS parameter, length(source) BETWEEN 4 AND 90 AS good_title,
  doc_id || ' ' || source AS label, CASE WHEN length(t) <= 320 THEN t ELSE rtrim(substr(t, 1, 319), ' ') || '…' END AS excerpt FROM x WHERE t <> ''""")
def question_signals(spark, sf_dir):
    held = _question_records(spark, sf_dir)
    return held.select(
        "record_id", questions.has_word(questions.REQUIREMENTS).alias("requirement"), questions.has_word(questions.METHODS).alias("method"), questions.has_word(_COMMON).alias("common"), questions.has_parameter().alias("parameter"),
        questions.good_title().alias("good_title"), questions.label().alias("label"), questions.excerpt(F.col("content")).alias("excerpt"),
    )


@query(f"""WITH {_RECORDS}, c AS (SELECT doc_id, lang, {_HAS(_COMMON)} AS a, length(t) > 900 AS b FROM x WHERE t <> ''),
p AS (SELECT doc_id, lang, row_number() OVER (ORDER BY turn, lang, doc_id) AS place FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS turn FROM c WHERE a) QUALIFY place <= 20),
s AS (SELECT doc_id, lang, row_number() OVER (ORDER BY turn, lang, doc_id) AS place FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS turn FROM c WHERE b AND doc_id NOT IN (SELECT doc_id FROM p)) QUALIFY place <= 20)
SELECT 1 AS pool, place::INT AS place, doc_id AS record_id, lang AS pdf FROM p UNION ALL SELECT 2, place::INT, doc_id, lang FROM s""")
def question_picks(spark, sf_dir):
    """A sampler of 20 and again 20 records from two pools, none twice, languages in turn."""
    held = _question_records(spark, sf_dir)
    first = questions.pick(held.where(questions.has_word(_COMMON)), 20, None)
    second = questions.pick(held.where(F.length("content") > 900), 20, first)
    show = lambda df, n: df.select(F.lit(n).alias("pool"), "place", "record_id", "pdf")
    return show(first, 1).unionByName(show(second, 2))


@query("SELECT doc_id, source, turn FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM documents) ORDER BY turn, source, doc_id LIMIT 50")
def balanced_pick(spark, sf_dir):
    """A sampler of 50 documents, its sources in turn."""
    return evaluate.balanced_pick(table(spark, sf_dir, "documents"), "source", ["doc_id"], 50).select("doc_id", "source", "turn")


@query("""SELECT source, doc_id, score FROM (SELECT source, doc_id, 10 * (length(source) - length(replace(lower(source), 'the', ''))) / 3 + (length(text) - length(replace(lower(text), 'the', ''))) / 3 AS score FROM documents)
QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) = 1""")
def best_record(spark, sf_dir):
    scored = table(spark, sf_dir, "documents").select("source", "doc_id", evaluate.best_record("source", "text", "the").alias("score"))
    return catalog.upsert_latest(scored, "source", F.desc("score"), F.col("doc_id"))
