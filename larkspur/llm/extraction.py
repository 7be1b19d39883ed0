"""HTML extraction with suffix arrays of hosts.

Markup, scripts, styles and comments are dropped; what is left is a page's token stream. The
streams of a host are concatenated, a sentinel of its own after each, and a suffix array sorts
all places by the MIN_TOKENS tokens that follow, by doubling. Neighbours in it that agree on all
of these and come from two pages or more are a long substring repeated across pages; all tokens
that such a substring covers are boilerplate. The runs of tokens between them are kept.

A block, which is the text between two tags that aren't inline, may be shorter than that: menu items,
ads and footers mostly are. Such a block is boilerplate as a whole, whatever its length, if a block
of another page of the host has the same tokens.

A longer repeat is covered by its windows of MIN_TOKENS tokens, so the array needs no greater
depth. That also lets the array of a large host be divided exactly: a window belongs to the shard
that the least hash of its 4-grams chooses, which equal windows share, and neighbouring windows of
one shard travel together as a stretch; a short block belongs to a shard of blocks that its own hash
chooses. A host above BIG_BYTES of HTML is sorted in shards of about that size, and the covered
places return to its pages by a join; a smaller host is one task. Stretches with the same words, as
those of a footer, go to their shard once a batch of pages (BATCH_PAGES, or fewer whose words reach
BATCH_BYTES), with the places where they lie.

Defined results: null html is an empty page; a null or unreadable url has the host ""; rows with a
null id are left out; rows that repeat an id are one page, so a repeat between them isn't one
across pages, but each keeps its own text; exact copies of a page on a host cover each other as
wholes and leave empty texts; pages may be of any length; there are no ties, as all occurrences of a
repeat go; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import materialise
from ._text import SLICE_BYTES, _BASE, _power_tables, mix

MIN_TOKENS, BIG_BYTES, MOST_BROADCAST = 20, 16 << 20, 8 << 20
BATCH_PAGES, BATCH_BYTES = 10_000, 128 << 20
_GRAM = 4
_DROP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)", re.I | re.S)
_TAG = re.compile(r"<[^<>]*>")
_INLINE = "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr"
_EDGE = re.compile(rf"<(?!/?(?:{_INLINE.replace(' ', '|')})[\s/>])[^<>]*>", re.I)


def visible(page: str | None) -> str:
    """The text of a page, tokens one space apart."""
    return " ".join(html.unescape(_TAG.sub(" ", _DROP.sub(" ", page or ""))).split())


def blocks(page: str | None) -> str:
    """The same tokens, a line for each block that has any."""
    lines = (" ".join(html.unescape(_TAG.sub(" ", x)).split()) for x in _EDGE.split(_DROP.sub(" ", page or "")))
    return "\n".join(filter(None, lines))


def token_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, and the offsets of the texts among them."""
    counts = np.array([t.count(b" ") + t.count(b"\n") + 1 if t else 0 for t in texts], np.int64)
    parts, i = [], 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) < SLICE_BYTES):
            size += len(texts[j])
            j += 1
        data = np.frombuffer(b" ".join(t for t in texts[i:j] if t), np.uint8)
        power, inverse = _power_tables(len(data) + 1)
        prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=prefix[1:])
        gaps = np.flatnonzero((data == 32) | (data == 10))
        starts, ends = np.r_[0, gaps + 1], np.r_[gaps, len(data)]
        if len(data):
            parts.append(mix((prefix[ends] - prefix[starts]) * inverse[starts]))
        i = j
    return np.concatenate([np.zeros(0, np.uint64), *parts]), np.r_[0, np.cumsum(counts)]


def suffix_array(tokens: np.ndarray, first: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places sorted by their next `depth` tokens, whether each has the same as the one before it,
    and the stream of each place. Only places with `depth` tokens left in their stream."""
    lengths = np.diff(first)
    n = len(tokens)
    _, rank = np.unique(tokens, return_inverse=True)
    have = 1

    def compose(rank: np.ndarray, shift: int) -> np.ndarray:
        key = rank[: len(rank) - shift].astype(np.int64) * (n + 1) + rank[shift:]
        _, out = np.unique(key, return_inverse=True)
        return out

    if n < depth:
        empty = np.zeros(0, np.int64)
        return empty, empty.astype(bool), empty
    while have < depth:
        shift = min(have, depth - have)
        rank = compose(rank, shift)
        have += shift
    stream = np.repeat(np.arange(len(lengths)), lengths)
    places = np.flatnonzero(stream[: n - depth + 1] == stream[depth - 1 :])
    order = places[np.argsort(rank[places], kind="stable")]
    same = np.zeros(len(order), bool)
    same[1:] = rank[order[1:]] == rank[order[:-1]]
    return order, same, stream[order]


def covered(tokens: np.ndarray, first: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int) -> np.ndarray:
    """Which tokens lie in `depth` tokens that two different pages hold; low and high are the least and
    the largest page of each stream."""
    out = np.zeros(len(tokens), bool)
    order, same, stream = suffix_array(tokens, first, depth)
    if len(order):
        heads = np.flatnonzero(~same)
        twice = np.minimum.reduceat(low[stream], heads) < np.maximum.reduceat(high[stream], heads)
        places = order[np.repeat(twice, np.diff(np.r_[heads, len(order)]))]
        edge = np.zeros(len(tokens) + 1, np.int64)
        np.add.at(edge, places, 1)
        np.add.at(edge, places + depth, -1)
        out = np.cumsum(edge)[:-1] > 0
    return out


def block_starts(texts: list[bytes]) -> np.ndarray:
    """The first token of each block of all texts."""
    counts = np.array([x.count(b" ") + 1 for t in texts if t for x in t.split(b"\n")], np.int64)
    return np.cumsum(counts) - counts


def block_hashes(tokens: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the tokens starts .. ends, the latter left out."""
    power, inverse = _power_tables(len(tokens) + 1)
    prefix = np.zeros(len(tokens) + 1, np.uint64)
    np.cumsum(tokens * power[: len(tokens)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * inverse[starts])


def short_blocks(texts: list[bytes], tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """First tokens and ends of the blocks that are shorter than a window."""
    starts = block_starts(texts)
    ends = np.r_[starts[1:], len(tokens)][: len(starts)]
    short = ends - starts < depth
    return starts[short], ends[short]


def on_two_pages(hashes: np.ndarray, pages: np.ndarray) -> np.ndarray:
    """Which of the hashes two different pages hold."""
    _, group = np.unique(hashes, return_inverse=True)
    order = np.lexsort((pages, group))
    heads = np.flatnonzero(np.r_[True, np.diff(group[order]) > 0]) if len(order) else order
    last = np.r_[heads[1:], len(order)][: len(heads)] - 1
    twice = pages[order[heads]] < pages[order[last]]
    return twice[group]


def _unique_runs(text: bytes, drop: np.ndarray) -> str:
    """Runs of tokens that aren't dropped, one a line."""
    text = text.replace(b"\n", b" ")
    if not drop.any():
        return text.decode()
    runs, last = [], False
    for token, gone in zip(text.split(b" "), drop.tolist()):
        if not gone:
            if last:
                runs[-1].append(token)
            else:
                runs.append([token])
        last = not gone
    return "\n".join(b" ".join(r).decode() for r in runs)


_OUT = "page_id long, host string, text string, n_tokens int, n_removed int"


def _rows(ids, hosts, texts: list[bytes], drops: list[np.ndarray]) -> pa.Table:
    return pa.table(
        {
            "page_id": pa.array(ids, pa.int64()),
            "host": pa.array(hosts, pa.string()),
            "text": pa.array([_unique_runs(t, d) for t, d in zip(texts, drops)], pa.string()),
            "n_tokens": pa.array([len(d) for d in drops], pa.int32()),
            "n_removed": pa.array([int(d.sum()) for d in drops], pa.int32()),
        }
    )


def _compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=6)
    for batch in batches:
        for s in range(0, batch.num_rows, 256):
            part = batch.slice(s, 256)
            texts = [pack.compress(blocks(x).encode("utf-8", "replace")) for x in part.column("html").to_pylist()]
            kept = [c for c in batch.schema.names if c != "html"]
            yield pa.record_batch([*(part.column(c) for c in kept), pa.array(texts, pa.binary())], names=[*kept, "text"])


def _texts(column) -> list[bytes]:
    unpack = zstandard.ZstdDecompressor()
    return [unpack.decompress(x) for x in column.to_pylist()]


def _whole_host(depth: int):
    def run(table: pa.Table) -> pa.Table:
        texts = _texts(table.column("text"))
        ids = table.column("page_id").to_numpy()
        tokens, first = token_hashes(texts)
        drop = covered(tokens, first, ids, ids, depth)
        starts, ends = short_blocks(texts, tokens, depth)
        twice = on_two_pages(block_hashes(tokens, starts, ends), ids[np.searchsorted(first, starts, "right") - 1])
        for a, b in zip(starts[twice].tolist(), ends[twice].tolist()):
            drop[a:b] = True
        return _rows(ids, table.column("host").to_pylist(), texts, [drop[a:b] for a, b in zip(first[:-1], first[1:])])

    return run


def _stretches(part: pa.RecordBatch, depth: int) -> Iterator[tuple[int, str, int, int, bytes]]:
    """Row, host, shard, first token and words of the stretches whose windows fall to one shard, and of
    short blocks, whose shards are below 0."""
    texts = [blocks(x).encode("utf-8", "replace") for x in part.column("html").to_pylist()]
    tokens, first = token_hashes(texts)
    starts, ends = short_blocks(texts, tokens, depth)
    cold = np.searchsorted(starts, first)
    hashes = block_hashes(tokens, starts, ends)
    gram = tokens.copy()
    for g in range(1, _GRAM):
        gram[: len(tokens) - g] = gram[: len(tokens) - g] * _BASE + tokens[g:] if len(tokens) > g else gram[:0]
    gram = mix(gram)
    for d, (host, shards) in enumerate(zip(part.column("host").to_pylist(), part.column("shards").to_pylist())):
        a, b = int(first[d]), int(first[d + 1])
        words = texts[d].replace(b"\n", b" ").split(b" ")
        for x, y, h in zip(*(v[cold[d] : cold[d + 1]].tolist() for v in (starts - a, ends - a, hashes))):
            yield d, host, -1 - h % shards, x, b" ".join(words[x:y])
        if b - a < depth:
            continue
        view = np.lib.stride_tricks.sliding_window_view(gram[a : b - _GRAM + 1], depth - _GRAM + 1)
        shard = (view.min(1) % np.uint64(shards)).astype(np.int64)
        cuts = np.r_[0, np.flatnonzero(shard[1:] != shard[:-1]) + 1, len(shard)]
        for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            yield d, host, int(shard[x]), x, b" ".join(words[x : y + depth - 1])


_PIECES = "host string, shard long, counts array<int>, pages array<long>, rows array<int>, starts array<int>, text binary"


def _divide(depth: int):
    """Pages of large hosts to the distinct stretches of a batch and their places, a row for each shard.
    A place is three small numbers in arrays, as a batch has hundreds of them a page."""

    def flush(shards: dict, pages: np.ndarray, rows: np.ndarray, pack: zstandard.ZstdCompressor) -> Iterator[pa.RecordBatch]:
        for (host, shard), (held, kinds, at, starts) in shards.items():
            kinds, at, starts = (np.frombuffer(x, np.int32) for x in (kinds, at, starts))
            order = np.argsort(kinds, kind="stable")
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values))
            columns = [
                pa.array([host], pa.string()), pa.array([shard], pa.int64()), one(np.bincount(kinds, minlength=len(held)).astype(np.int32)),
                one(pages[at[order]]), one(rows[at[order]]), one(starts[order]), pa.array([pack.compress(b"\n".join(held))], pa.binary()),
            ]
            yield pa.record_batch(columns, names=[c.split()[0] for c in _PIECES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=6)
        shards: dict[tuple[str, int], tuple[dict[bytes, int], array, array, array]] = {}
        pages, rows, count, size = [], [], 0, 0
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                for d, host, shard, start, words in _stretches(part, depth):
                    if (own := shards.get((host, shard))) is None:
                        own = shards[host, shard] = {}, array("i"), array("i"), array("i")
                    held = own[0]
                    if (kind := held.get(words)) is None:
                        kind = held[words] = len(held)
                        size += len(words)
                    own[1].append(kind)
                    own[2].append(count + d)
                    own[3].append(start)
                pages.append(part.column("page_id").to_numpy())
                rows.append(part.column("row").to_numpy())
                count += part.num_rows
                if count >= BATCH_PAGES or size >= BATCH_BYTES:
                    yield from flush(shards, np.concatenate(pages), np.concatenate(rows), pack)
                    shards, pages, rows, count, size = {}, [], [], 0, 0
        if count:
            yield from flush(shards, np.concatenate(pages), np.concatenate(rows), pack)

    return run


def _shard(depth: int):
    """The stretches of a shard to the covered places of pages."""

    def run(table: pa.Table) -> pa.Table:
        held: dict[bytes, int] = {}
        kind = np.array([held.setdefault(w, len(held)) for x in _texts(table.column("text")) for w in x.split(b"\n")], np.int64)
        counts, pages, rows, starts = (table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("counts", "pages", "rows", "starts"))
        of = np.repeat(kind, counts)  # the words of each place
        low, high = np.full(len(held), np.iinfo(np.int64).max), np.full(len(held), np.iinfo(np.int64).min)
        np.minimum.at(low, of, pages)
        np.maximum.at(high, of, pages)
        tokens, first = token_hashes(list(held))
        stream = np.repeat(np.arange(len(held)), np.diff(first))
        drop = (low < high)[stream] if table.column("shard")[0].as_py() < 0 else covered(tokens, first, low, high, depth)
        edge = np.r_[True, stream[1:] != stream[:-1], True]
        begin = np.flatnonzero(drop & (edge[:-1] | ~np.r_[False, drop[:-1]])) if len(drop) else np.zeros(0, np.int64)
        end = np.flatnonzero(drop & (edge[1:] | ~np.r_[drop[1:], False])) + 1 if len(drop) else begin
        own = stream[begin]
        # every place of a stretch has all of its covered runs
        many = np.bincount(own, minlength=len(held))[of]
        place = np.repeat(np.arange(len(of)), many)
        heads = np.searchsorted(own, of)
        run_ = np.arange(len(place)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(heads, many)
        at = starts[place] - first[of[place]]
        return pa.table({"page_id": pages[place], "row": rows[place], "start": (begin[run_] + at).astype(np.int32), "stop": (end[run_] + at).astype(np.int32)})

    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in range(0, batch.num_rows, 256):
            part = batch.slice(s, 256)
            texts, drops = _texts(part.column("text")), []
            for text, spans in zip(texts, part.column("spans").to_pylist()):
                drop = np.zeros(text.count(b" ") + text.count(b"\n") + 1 if text else 0, bool)
                for span in spans or []:
                    drop[span["start"] : span["stop"]] = True
                drops.append(drop)
            yield from _rows(part.column("page_id"), part.column("host"), texts, drops).to_batches()


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_tokens: int = MIN_TOKENS, big_bytes: int = BIG_BYTES) -> DataFrame:
    """page_id, host, text (unique runs, one a line), n_tokens, n_removed of every page."""
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1), F.lit("")))
    pages = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), F.col(html_col).alias("html")).where("page_id IS NOT NULL")
    sizes = pages.groupBy("host").agg(F.sum(F.length("html")).alias("bytes")).where(F.col("bytes") > big_bytes)
    big = materialise(sizes.select("host", F.ceil(F.col("bytes") / big_bytes).cast("int").alias("shards")), "large-hosts")
    # A host is large at BIG_BYTES, so their names are few bytes; if they aren't, both sides are shuffled.
    size = big.agg(F.sum(F.length("host") * 4 + 16)).first()[0] or 0
    big = big.hint("broadcast" if size <= MOST_BROADCAST else "merge")
    small = pages.join(big, "host", "left_anti").select("page_id", "host", "html").mapInArrow(_compress, "page_id long, host string, text binary")
    direct = small.groupBy("host").applyInArrow(_whole_host(min_tokens), _OUT)
    # rows that share a page_id are told apart by a hash of their text
    large = pages.join(big, "host").select("page_id", "host", F.hash("host", "html").alias("row"), "shards", "html")
    packed = large.mapInArrow(_compress, "page_id long, host string, row int, shards int, text binary")
    spans = (
        large.mapInArrow(_divide(min_tokens), _PIECES).groupBy("host", "shard").applyInArrow(_shard(min_tokens), "page_id long, row int, start int, stop int")
        .groupBy("page_id", "row").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    )
    texts = packed.select("page_id", "host", "row", "text")
    returned = texts.join(spans.hint("merge"), ["page_id", "row"], "left").select("page_id", "host", "text", "spans").mapInArrow(_remove, _OUT)
    return direct.unionByName(returned)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
