"""Substring dedup on a compacted de Bruijn graph.

Edges are all k-mers of LENGTH words, nodes the LENGTH - 1 words that two neighbouring edges share.
An edge is repeated if two documents hold it. A node cuts if repeated edges branch there, or if some
document enters or leaves the repeated edges at it; between cuts all documents that hold an edge
also hold the next one, so that such a path is one passage with one set of documents. Paths compact
in three steps:

* The text falls into stretches of neighbouring nodes with the same minimiser, the least hash of the
  runs of MINIMISER words inside a node. A stretch goes with both neighbours to the partition of its
  minimiser. All stretches that hold a node meet there, with all its edges, so that whether an edge
  is repeated and whether a node cuts is known exactly, and stretches compact to pieces of paths.
* A join by the stretch gives the pieces their source coordinates: document and word. The pieces
  of a document are glued to whole paths.
* Source coordinates verify the paths: their words are read again, and a join by path and by a
  128-bit hash of these words leaves the paths that two documents or more hold as they stand. It
  also says which document of a path is the first.

Stretches that many documents hold meet once a chunk, as their words and two of their documents;
coordinates never go to the partition of a minimiser, but only to the join, which splits skew.

Defined results: a word is a run of letters and digits, in lower case. Every passage of LENGTH words
or more that two documents share is found from its first word to its last, and each word reported
lies in LENGTH words that another document has as well. is_first marks what is in the least doc_id
that holds it, the one to keep; spans of a document that touch are one. A null text and one of fewer
than LENGTH words have no repeats, texts may be of any length; a passage that repeats inside one
document only, or in rows with the same id, isn't a repeat; exact copies repeat as wholes; rows with
a null id are left out; repeated rows count once; texts that share an id are read each; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import materialise
from ._text import WORD_RE2, Words, mix, parts_of, runs_at, slices, spread

LENGTH, MINIMISER = 50, 12
#: Nodes of a chunk, characters of text a partition (more where that would make over MOST_PARTS:
#: there executors need memory for larger ones).
CHUNK_NODES, PART_CHARS, MOST_PARTS = 750_000, 8 << 20, 100_000
_BLOCKS = "pid int, stretches binary, lows binary, highs binary, sides binary, counts binary, nodes binary"
_LOW = np.uint64(32)


def _stretches(words: Words, length: int, m: int):
    """Minimisers of the stretches, their hashes, texts, first nodes of their own, whether there is a
    node to the left (1) and to the right (2), how many nodes with these, and all these nodes."""
    at, h = words.ngrams(length - 1)
    long_ = np.diff(words.first)[words.doc[at]] >= length if len(at) else np.zeros(0, bool)
    at, h = at[long_], h[long_]
    none = np.zeros(0, np.int64)
    if not len(at):
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none, none, none.astype(np.uint32)
    i = np.arange(len(words.doc) - m + 1)
    least, have, width = words.spans(i, i + m - 1), 1, length - m
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    key, doc = least[at], words.doc[at]
    first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])
    stop = np.r_[first[1:], len(at)]
    left = np.r_[False, doc[1:] == doc[:-1]][first]
    right = np.r_[doc[1:] == doc[:-1], False][stop - 1]
    sides = left + 2 * right
    a, b = first - left, stop + right
    name = mix(words.spans(at[a], at[b - 1] + length - 2) ^ sides.astype(np.uint64) ^ ((b - a).astype(np.uint64) << np.uint64(8)))
    nodes = (h >> _LOW).astype(np.uint32)[spread(a, b - a)]
    return key[first], name, doc[first], at[first] - words.first[doc[first]], sides, b - a, nodes


def _once(name: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One place of each name, and its least and largest document."""
    order = np.argsort(name, kind="stable")
    at = runs_at(name[order])
    if not len(at):
        return order, low, high
    return order[at], np.minimum.reduceat(low[order], at), np.maximum.reduceat(high[order], at)


def _graph(length: int, m: int, parts: int):
    """Texts to the distinct stretches of each chunk, a row for each partition of minimisers."""

    def flush(some: list[tuple]) -> pa.RecordBatch:
        key, name, ids, sides, counts, nodes = (np.concatenate(x) for x in zip(*some))
        starts = np.cumsum(counts) - counts
        own, low, high = _once(name, ids, ids)
        pid = parts_of(mix(key[own]), parts)  # least hashes are small, so they are mixed again
        order = np.argsort(pid, kind="stable")
        own, low, high, pid = own[order], low[order], high[order], pid[order]
        at = runs_at(pid)
        rows = []
        for a, b in zip(at.tolist(), [*at[1:].tolist(), len(pid)]):
            x = own[a:b]
            rows.append((int(pid[a]), name[x].tobytes(), low[a:b].tobytes(), high[a:b].tobytes(), sides[x].astype(np.uint8).tobytes(), counts[x].astype(np.int32).tobytes(), nodes[spread(starts[x], counts[x])].tobytes()))
        columns = list(zip(*rows))
        return pa.record_batch([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["pid", "stretches", "lows", "highs", "sides", "counts", "nodes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, total = [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                key, name, doc, _, sides, counts, nodes = _stretches(Words(part.column("text")), length, m)
                if len(key):
                    some.append((key, name, part.column("doc_id").to_numpy()[doc], sides, counts, nodes))
                    total += len(nodes)
                if total >= CHUNK_NODES:
                    yield flush(some)
                    some, total = [], 0
        if some:
            yield flush(some)

    return run


def _cuts(node: np.ndarray, before: np.ndarray, after: np.ndarray, edge_before: np.ndarray, edge_after: np.ndarray, branching: bool = True) -> np.ndarray:
    """Which of the places cut: of each place its node, and whether the edges before and after it are
    repeated and what they are. A node cuts at all its places."""
    order = np.argsort(node, kind="stable")
    at = runs_at(node[order])
    if not len(at):
        return np.zeros(0, bool)
    apart = np.logical_or.reduceat((before ^ after)[order], at)
    if branching:
        for edge in (edge_before[order], edge_after[order]):
            apart |= np.minimum.reduceat(edge, at) < np.maximum.reduceat(edge, at)
    out = np.empty(len(node), bool)
    out[order] = np.repeat(apart, np.diff(np.r_[at, len(node)]))
    return out


_PIECES = "stretch long, pieces array<struct<at:int,n:int,opens:boolean,edge:long>>"


def _compact(branching: bool):
    """All stretches of a partition to their pieces of repeated paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: list[list[np.ndarray]] = [[] for _ in range(6)]
        for batch in batches:
            for c, (name, kind) in enumerate([("stretches", np.uint64), ("lows", np.int64), ("highs", np.int64), ("sides", np.uint8), ("counts", np.int32), ("nodes", np.uint32)]):
                columns[c] += [np.frombuffer(x, kind) for x in batch.column(name).to_pylist()]
        if not columns[0]:
            return
        name, low, high, sides, counts, nodes = map(np.concatenate, columns)
        del columns
        counts = counts.astype(np.int64)
        starts = np.cumsum(counts) - counts
        own, low, high = _once(name, low, high)
        name, sides, counts, starts = name[own], sides[own], counts[own], starts[own]
        nodes = nodes[spread(starts, counts)].astype(np.uint64)
        starts = np.cumsum(counts) - counts
        n = len(nodes)
        row = np.repeat(np.arange(len(name), dtype=np.int32), counts)
        edge = np.zeros(n, np.uint64)  # the one that begins at the node
        edge[:-1] = nodes[:-1] << _LOW | nodes[1:]
        inside = np.ones(n, bool)
        inside[starts + counts - 1] = False
        places = np.flatnonzero(inside)
        order = places[np.argsort(edge[places], kind="stable")]
        at = runs_at(edge[order])
        repeated = np.zeros(n, bool)
        if len(at):
            twice = np.minimum.reduceat(low[row[order]], at) < np.maximum.reduceat(high[row[order]], at)
            repeated[order] = np.repeat(twice, np.diff(np.r_[at, len(order)]))
        del order, places, inside
        mine = np.ones(n, bool)  # nodes of the stretch itself
        mine[starts[(sides & 1) > 0]] = False
        mine[(starts + counts - 1)[(sides & 2) > 0]] = False
        before = np.r_[False, repeated[:-1]]
        some = np.flatnonzero(mine & (before | repeated))
        cut = np.zeros(n, bool)
        cut[some] = _cuts(nodes[some], before[some], repeated[some], edge[some - 1], edge[some], branching)
        first = starts + (sides & 1)
        opens = np.zeros(n, bool)
        opens[first] = True
        held = np.flatnonzero(mine & repeated)
        if not len(held):
            return
        begin = np.flatnonzero(cut[held] | opens[held])
        lengths = np.diff(np.r_[begin, len(held)])
        begin = held[begin]
        stretch = row[begin]
        at = runs_at(stretch)
        pieces = pa.StructArray.from_arrays(
            [pa.array((begin - first[stretch]).astype(np.int32)), pa.array(lengths.astype(np.int32)), pa.array(cut[begin]), pa.array(edge[begin].view(np.int64))],
            names=["at", "n", "opens", "edge"],
        )
        offsets = np.r_[at, len(begin)]
        for a in range(0, len(at), 50_000):
            b = min(len(at), a + 50_000)
            lists = pa.ListArray.from_arrays(pa.array((offsets[a : b + 1] - offsets[a]).astype(np.int32)), pieces.slice(int(offsets[a]), int(offsets[b] - offsets[a])))
            yield pa.record_batch([pa.array(name[stretch[at[a:b]]].view(np.int64)), lists], names=["stretch", "pieces"])

    return run


def _occurrences(length: int, m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                _, name, doc, at, _, _, _ = _stretches(Words(part.column("text")), length, m)
                ids, keys = (part.column(c).to_numpy()[doc] for c in ("doc_id", "key"))
                yield pa.record_batch([pa.array(name.view(np.int64)), pa.array(ids), pa.array(keys), pa.array(at.astype(np.int32))], names=["stretch", "doc_id", "key", "start"])

    return run


def _flat(column: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Row of each struct of a list column, and the structs' fields."""
    values = column.flatten()
    row = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
    return row, {values.type.field(i).name: values.field(i).to_numpy(zero_copy_only=False) for i in range(values.type.num_fields)}


def _listed(row: np.ndarray, n: int, fields: dict[str, np.ndarray]) -> pa.ListArray:
    values = pa.StructArray.from_arrays([pa.array(v) for v in fields.values()], names=list(fields))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32)), values)


def _glue(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sorted pieces of a document to whole paths."""
    for batch in batches:
        row, p = _flat(batch.column("pieces"))
        stop = p["start"] + p["n"]
        fresh = p["opens"] | np.r_[True, (row[1:] != row[:-1]) | (p["start"][1:] != stop[:-1])][: len(row)]
        at = np.flatnonzero(fresh)
        n = np.add.reduceat(p["n"], at) if len(at) else p["n"]
        paths = _listed(row[at], batch.num_rows, {"start": p["start"][at], "n": n.astype(np.int32), "edge": p["edge"][at]})
        yield pa.record_batch([batch.column("doc_id"), batch.column("key"), paths], names=["doc_id", "key", "paths"])


def _read(length: int):
    """Texts with their paths to the paths with a hash of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"))
                row, p = _flat(part.column("paths"))
                first = words.first[row] + p["start"]
                begin, end = words.starts[first], words.ends[first + p["n"] + length - 2]
                data = words.flat.data
                checks = [xxhash.xxh3_128_digest(data[a:b]) for a, b in zip(begin.tolist(), end.tolist())]
                ids, keys = (part.column(c).to_numpy()[row] for c in ("doc_id", "key"))
                yield pa.record_batch([pa.array(ids), pa.array(keys), pa.array(p["start"]), pa.array(p["n"]), pa.array(p["edge"]), pa.array(checks, pa.binary())], names=["doc_id", "key", "start", "n", "edge", "check"])

    return run


def _spans(length: int):
    """The verified paths of a document, sorted by is_first and place, to spans that don't touch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, p = _flat(batch.column("paths"))
            group = 2 * row + p["is_first"]
            stop = p["start"].astype(np.int64) + p["n"] + length - 1
            # a running maximum within each group: groups are set apart by more than any place
            wide = int(stop.max()) + 2 if len(stop) else 1
            reach = np.maximum.accumulate(stop + group * wide) - group * wide
            at = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (p["start"][1:] > reach[:-1])][: len(row)])
            last = np.r_[at[1:], len(row)][: len(at)] - 1
            first = p["start"][at]
            yield pa.record_batch(
                [pa.array(batch.column("doc_id").to_numpy()[row[at]]), pa.array(first.astype(np.int32)), pa.array((reach[last] - first).astype(np.int32)), pa.array(p["is_first"][at].astype(bool))],
                names=["doc_id", "first_word", "n_words", "is_first"],
            )

    return run


def repeated_paths(docs: DataFrame, length: int = LENGTH, m: int = MINIMISER, part_chars: int = PART_CHARS, branching: bool = True) -> DataFrame:
    """doc_id, key, start, n (edges), edge (the first one), check of every compacted path of repeated
    edges, from the columns doc_id, key and text."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, min(MOST_PARTS, -(-chars // part_chars)))
    narrow = docs.select("doc_id", "text")
    # pieces and paths are written, so that the passes over the texts come one after another
    pieces = materialise(narrow.mapInArrow(_graph(length, m, parts), _BLOCKS).repartitionById(parts, F.col("pid")).mapInArrow(_compact(branching), _PIECES), "repeat-pieces")
    where = docs.mapInArrow(_occurrences(length, m), "stretch long, doc_id long, key long, start int").join(pieces.hint("merge"), "stretch").select("doc_id", "key", "start", F.explode("pieces").alias("p"))
    placed = where.groupBy("doc_id", "key").agg(F.sort_array(F.collect_set(F.struct((F.col("start") + F.col("p.at")).alias("start"), "p.n", "p.opens", "p.edge"))).alias("pieces"))
    paths = materialise(placed.mapInArrow(_glue, "doc_id long, key long, paths array<struct<start:int,n:int,edge:long>>"), "repeat-glued")
    return docs.join(paths.hint("merge"), ["doc_id", "key"]).mapInArrow(_read(length), "doc_id long, key long, start int, n int, edge long, check binary")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, m: int = MINIMISER, part_chars: int = PART_CHARS, branching: bool = True) -> DataFrame:
    """doc_id, first_word, n_words, is_first of all maximal spans that other documents hold as well.
    branching = False leaves out the test for branches, and with it the right is_first."""
    if not 1 <= m < length:
        raise ValueError("a minimiser must be shorter than length")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("key"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL")
    paths = materialise(repeated_paths(docs, length, m, part_chars, branching), "repeat-paths")
    same = ["edge", "n", "check"]
    verified = paths.groupBy(same).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").drop("high")
    kept = paths.join(verified.hint("merge"), same).groupBy("doc_id", "key").agg(F.sort_array(F.collect_set(F.struct((F.col("doc_id") == F.col("low")).cast("int").alias("is_first"), "start", "n"))).alias("paths"))
    return kept.mapInArrow(_spans(length), "doc_id long, first_word int, n_words int, is_first boolean")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '{WORD_RE2}') AS w FROM documents WHERE doc_id IS NOT NULL),
e AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - {LENGTH - 2}), lambda i: {{'i': i - 1, 'h': md5(array_to_string(w[i:i+{LENGTH - 1}], ' '))}})) AS x
      FROM w WHERE len(w) >= {LENGTH}),
m AS (SELECT x.h AS h, min(doc_id) AS low FROM e GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
k AS (SELECT DISTINCT doc_id, x.i AS i, doc_id = low AS is_first FROM e JOIN m ON x.h = m.h),
a AS (SELECT *, coalesce(i > lag(i) OVER (PARTITION BY doc_id, is_first ORDER BY i) + {LENGTH}, true) AS apart FROM k),
r AS (SELECT *, sum(apart::INT) OVER (PARTITION BY doc_id, is_first ORDER BY i) AS run FROM a)
SELECT doc_id, min(i)::INT AS first_word, (max(i) - min(i) + {LENGTH})::INT AS n_words, is_first FROM r GROUP BY doc_id, is_first, run
"""
