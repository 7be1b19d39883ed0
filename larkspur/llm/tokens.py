"""Token counts: flat token files and the scan for their separators.

A flat file is nothing but token ids, two bytes each in little-endian order, with an
end-of-document id after every document: no index, no offsets. `separator_scan` cuts every file
into blocks of equal size, looks for the separator in each block with one vectorised comparison,
and stitches documents that cross blocks with an exclusive prefix scan over the few numbers that a
block leaves: how many separators it holds and where the last one lies.

`write_token_files` makes such files from a table of texts. Each task writes a file of its own
under a new name and reports it in a row; the table of these rows, written by Spark's own commit
protocol, says which files count, so that repeated and lost tasks do no harm.

Defined results: a null or empty text is a document of no tokens; text that spells a special token
is ordinary text; tokens behind the last separator of a file are a document without end, marked
closed = false; an empty file has no documents; texts may be of any length; repeated rows are
documents of their own, in the order in which a task reads them, so that there are no ties; an empty
table makes no files; other columns are ignored.
"""

from __future__ import annotations

import base64
import os
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ._shared import materialise, scratch_path
from ._text import pieces, slices

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SEPARATOR = 50256
BLOCK_BYTES = 8 << 20
#: How such vocabularies cut a text before they merge bytes.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_TEXT_SLICE = 8 << 20


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    if not os.path.exists(path):  # sent with SparkContext.addFile
        path = SparkFiles.get(os.path.basename(path))
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class _Known:
    """Tokens of many pieces at once. Pieces that begin with their space are cut there by the
    tokeniser as well, whatever they follow, so that they are encoded as one text; where a piece's
    tokens end is read off the tokens' lengths in bytes."""

    def __init__(self, path: str):
        found = encoder(path)
        self.encode = found.encode_ordinary
        self.bytes = np.zeros(found.max_token_value + 1, np.int64)
        for i in range(len(self.bytes)):
            try:
                self.bytes[i] = len(found.decode_single_token_bytes(i))
            except KeyError:
                pass

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All pieces' tokens one behind another, and the n + 1 offsets of the pieces in these."""
        texts = texts.cast(pa.large_string())
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        spaced = np.zeros(n, bool)
        whole = np.flatnonzero(np.diff(offsets) > 1)
        spaced[whole] = (data[offsets[whole]] == 32) & ~np.isin(data[offsets[whole] + 1], _SOFT)
        apart = [self.encode(t) for t in texts.filter(pa.array(~spaced)).to_pylist()]
        joined = texts.filter(pa.array(spaced))
        ends = np.cumsum(np.diff(offsets)[spaced])
        together = np.array(self.encode("".join(joined.to_pylist())), np.int64)
        reached = np.searchsorted(np.cumsum(self.bytes[together]), ends, "left") + 1
        sizes = np.empty(n, np.int64)
        sizes[spaced] = np.diff(np.r_[0, reached]) if len(ends) else 0
        sizes[~spaced] = [len(x) for x in apart]
        at = np.r_[0, np.cumsum(sizes)]
        flat = np.empty(int(at[-1]), np.int64)
        mine = np.repeat(spaced, sizes)
        flat[mine] = together
        flat[~mine] = np.fromiter((t for x in apart for t in x), np.int64, int((~mine).sum()))
        return flat, at


#: White space of one byte; a piece that begins with two of these isn't one.
_SOFT = np.array([*range(9, 14), *range(28, 33)], np.uint8)


def token_counts(column: pa.Array, known: _Known) -> np.ndarray:
    """Tokens of each text of a column."""
    distinct, index, at = pieces(column)
    if not len(index):
        return np.zeros(len(at) - 1, np.int64)
    sizes = np.diff(known(distinct)[1])
    return np.diff(np.r_[0, np.cumsum(sizes[index])][at])


def token_ids(column: pa.Array, known: _Known, separator: int) -> np.ndarray:
    """All texts' ids in one array, a separator after each text."""
    distinct, index, at = pieces(column)
    flat, heads = known(distinct) if len(index) else (np.zeros(0, np.int64), np.zeros(1, np.int64))
    if separator > 0xFFFF or (len(known.bytes) > 0x10000) or (separator < len(known.bytes) and known.bytes[separator]):
        raise ValueError("ids must fit two bytes and the separator must be an id of its own")
    each = np.diff(heads)[index]
    ends = np.cumsum(each)
    total = int(ends[-1]) if len(ends) else 0
    own = flat[np.arange(total) + np.repeat(heads[index] - (ends - each), each)].astype(np.uint16)
    return np.insert(own, np.r_[0, ends][at[1:]], np.uint16(separator))


def with_token_counts(docs: DataFrame, id_col: str, text_col: str, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) of every row, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(path)
        for batch in batches:
            for part in slices(batch, "text", _TEXT_SLICE):
                yield pa.record_batch([part.column("doc_id"), pa.array(token_counts(part.column("text"), known))], names=["doc_id", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long")


def write_token_files(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", path: str = TOKENIZER, separator: int = SEPARATOR) -> DataFrame:
    """One flat file a partition; gives (file, ordinal, doc_id): which document is which in its
    file, as a flat file can't say."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, name, out, done = _Known(path), f"{folder}/{uuid.uuid4().hex}.bin", None, 0
        try:
            for batch in batches:
                for part in slices(batch, "text", _TEXT_SLICE):
                    if out is None:
                        store, place = _store(name)
                        store.create_dir(os.path.dirname(place), recursive=True)
                        out = store.open_output_stream(place)
                    out.write(token_ids(part.column("text"), known, separator).astype("<u2").tobytes())
                    n = part.num_rows
                    yield pa.record_batch([pa.array([name] * n), pa.array(np.arange(done, done + n)), part.column("doc_id")], names=["file", "ordinal", "doc_id"])
                    done += n
        finally:
            if out is not None:
                out.close()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return materialise(rows.mapInArrow(run, "file string, ordinal long, doc_id long"), "token-file-rows")


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


def _blocks(block_bytes: int):
    """(file) to (file, block, start, stop) in tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("file").to_pylist():
                store, place = _store(name)
                size = store.get_file_info(place).size // 2
                starts = np.arange(0, size, block_bytes // 2)
                yield pa.record_batch(
                    [pa.array([name] * len(starts), pa.string()), pa.array(np.arange(len(starts))), pa.array(starts), pa.array(np.minimum(starts + block_bytes // 2, size))],
                    names=["file", "block", "start", "stop"],
                )

    return run


def _scan(separator: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, block, start, stop in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "start", "stop"))):
                store, place = _store(name)
                with store.open_input_file(place) as file:
                    ids = np.frombuffer(file.read_at(2 * (stop - start), 2 * start), "<u2")
                ends = np.flatnonzero(ids == separator) + start
                yield pa.record_batch(
                    [pa.array([name]), pa.array([block]), pa.array([stop]), pa.array([len(ends)]), pa.array([int(ends[-1]) if len(ends) else None], pa.int64()), pa.array([ends], pa.list_(pa.int64()))],
                    names=["file", "block", "stop", "n", "last", "ends"],
                )

    return run


def separator_scan(files: DataFrame, separator: int = SEPARATOR, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, ordinal, start, n_tokens, closed) of every document of the flat files in column file.

    A block's row holds only the places of its separators, so that the window over the blocks of a
    file, the prefix scan, moves a small part of what the scan reads.
    """
    blocks = files.select("file").distinct().mapInArrow(_blocks(block_bytes), "file string, block long, start long, stop long")
    found = blocks.repartition("file", "block").mapInArrow(_scan(separator), "file string, block long, stop long, n long, last long, ends array<long>")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("file").orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    stitched = found.select(
        "file",
        "ends",
        "stop",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ordinal"),
        (F.coalesce(F.max("last").over(before), F.lit(-1)) + 1).alias("open"),
        F.max("block").over(after).isNull().alias("at_end"),
    )
    start = lambda e, i: F.when(i == 0, F.col("open")).otherwise(F.try_element_at(F.col("ends"), i.cast("int")) + 1)
    closed = F.transform("ends", lambda e, i: F.struct((F.col("ordinal") + i).alias("ordinal"), start(e, i).alias("start"), e.alias("end"), F.lit(True).alias("closed")))
    tail = F.coalesce(F.try_element_at(F.col("ends"), F.lit(-1)) + 1, F.col("open"))
    rest = F.when(
        F.col("at_end") & (tail < F.col("stop")),
        F.array(F.struct((F.col("ordinal") + F.size("ends")).alias("ordinal"), tail.alias("start"), F.col("stop").alias("end"), F.lit(False).alias("closed"))),
    )
    return (
        stitched.select("file", F.explode(F.concat(closed, F.coalesce(rest, F.slice(closed, 1, 0)))).alias("d"))
        .select("file", "d.ordinal", "d.start", (F.col("d.end") - F.col("d.start")).alias("n_tokens"), "d.closed")
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, from flat files that are written first. Which file a document is in
    differs from run to run, so that the result has its place in the file only."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = write_token_files(docs, scratch_path(spark, "token-files"))
    return separator_scan(rows).join(rows.hint("merge"), ["file", "ordinal"]).select("doc_id", "ordinal", "start", "n_tokens", "closed")
