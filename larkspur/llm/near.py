"""N-gram Jaccard join with signature trees.

Each document is the set of its distinct word n-grams; equal sets are one set with several members.
The join is exact. It rests on two bounds and a tree:

* Two sets at Jaccard t share at least t times the size of either. N-grams that only one set holds
  are in no overlap, so that a set with fewer shared n-grams than that has no partner and goes.
* Let all sets put their n-grams in one order: those of one set only, then by the number of sets up
  to HOT, then by hash. Two partners share an n-gram among the first size - ceil(t size) + 1. So
  every n-gram that two such prefixes hold names a bucket, the least set that holds it; partners
  meet in the bucket of that n-gram. A group of near copies shares most n-grams and so is in a few
  buckets only, not in one for each n-gram.
* Buckets lie side by side in an order by bucket and size, which is cut into nodes of equal weight.
  Each node is a signature tree: a leaf has LEAF sets, an inner node FAN nodes, and each of them the
  OR of its sets' token bitmaps, the ranges of their sizes and buckets, and the largest number of
  n-grams that share bits. A dual traversal from the root drops a pair of nodes when the largest
  overlap that these admit is below what the threshold asks for. What is left is verified on whole
  n-gram sets. Where a bucket reaches over several nodes, pairs of its nodes are pruned the same way
  first, and each pair left is a task of its own, so that no group has to fit one task.

Pairs don't leave the task that verifies them: it gives each set its number of links and the
representative of its connected part, so that the result has a row a document, not one a pair.

Before the shuffle each chunk of documents drops repeated sets, and n-grams that HOT sets of the
chunk hold are settled there; a partition hears of them once a chunk. N-grams and sets are known by
64-bit hashes.

Defined results: a null or wordless text has no n-grams and no links; a text of fewer than n words
is one n-gram, the whole, however long; rows with a null id are left out; repeated rows of one id
and text count once; an id with several texts is in the least of their classes and has the links of
all; ties in size don't matter; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ._shared import materialise
from ._text import WORD_RE2, Words, mix, parts_of, runs_at, slices, spread

NGRAM, THRESHOLD, BITS, LEAF, FAN, HOT = 5, 0.6, 1024, 16, 8, 16
#: N-grams of a chunk, characters of text a partition of n-grams (more where that would make over
#: MOST_PARTS: there executors need memory for larger ones), bytes of n-grams a node.
CHUNK_GRAMS, PART_CHARS, MOST_PARTS, NODE_BYTES = 750_000, 8 << 20, 100_000, 16 << 20
#: Rows of a tile of pairs, and products that cost as much as one n-gram of a pair verified alone.
TILE, DENSE = 1 << 11, 500

_BLOCKS = "kind byte, pid int, sids binary, sizes binary, place binary, grams binary, level binary, hot binary"
_GRAMS, _SETTLED, _MEMBERS = 0, 1, 2


def _blocks(kind: int, pid: np.ndarray, place: np.ndarray, grams: np.ndarray, level: np.ndarray | None, sids: np.ndarray, sizes: np.ndarray, hot: dict[int, bytes] | None = None) -> pa.RecordBatch:
    """A row for each pid with its n-grams, the sets that hold them and places of n-grams in the latter."""
    order = np.argsort(pid, kind="stable")
    pid, place, grams = pid[order], place[order], grams[order]
    level = level[order] if level is not None else None
    cuts = np.flatnonzero(np.r_[True, pid[1:] != pid[:-1]]) if len(pid) else np.zeros(0, np.int64)
    hot = dict(hot or {})
    rows: list[list] = [[] for _ in range(8)]
    used, number = np.zeros(len(sids), bool), np.zeros(len(sids), np.int64)
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(pid)]):
        at = place[a:b]
        used[at] = True
        own = np.flatnonzero(used)
        number[own] = np.arange(len(own))
        used[own] = False
        narrow = np.uint16 if len(own) <= 0xFFFF else np.uint32
        p = int(pid[a])
        for column, value in zip(rows, (kind, p, sids[own].tobytes(), sizes[own].astype(np.int32).tobytes(), number[at].astype(narrow).tobytes(), grams[a:b].tobytes(), level[a:b].astype(np.uint8).tobytes() if level is not None else b"", hot.pop(p, b""))):
            column.append(value)
    for p, value in hot.items():
        for column, v in zip(rows, (kind, p, b"", b"", b"", b"", b"", value)):
            column.append(v)
    return pa.record_batch([pa.array(rows[0], pa.int8()), pa.array(rows[1], pa.int32()), *(pa.array(c, pa.binary()) for c in rows[2:])], names=["kind", "pid", "sids", "sizes", "place", "grams", "level", "hot"])


def _unpack(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sets and sizes; of each n-gram the number of its set, its hash and its level."""
    sids, sizes, place, grams, level, base = [], [], [], [], [], 0
    for r in rows:
        own, h = np.frombuffer(r["sids"], np.uint64), np.frombuffer(r["grams"], np.uint64)
        if not len(h):
            continue
        sids.append(own)
        sizes.append(np.frombuffer(r["sizes"], np.int32))
        place.append(np.frombuffer(r["place"], np.uint16 if len(r["place"]) == 2 * len(h) else np.uint32).astype(np.int64) + base)
        grams.append(h)
        level.append(np.frombuffer(r["level"], np.uint8) if r["level"] else np.zeros(len(h), np.uint8))
        base += len(own)
    if not sids:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint8)
    found, first, number = np.unique(np.concatenate(sids), return_index=True, return_inverse=True)
    return found, np.concatenate(sizes)[first].astype(np.int64), number[np.concatenate(place)], np.concatenate(grams), np.concatenate(level)


def _divide(n: int, parts: int, hot: int):
    """Texts to blocks of n-grams by hash, blocks of settled n-grams by set, and members."""

    def flush(texts: list[tuple], seen: np.ndarray) -> tuple[list[pa.RecordBatch], np.ndarray]:
        ids, keys, sid, size, grams = (np.concatenate(x) for x in zip(*texts))
        members = pa.record_batch(
            [pa.array([_MEMBERS], pa.int8()), pa.array([int(sid[0] % np.uint64(parts))], pa.int32()), *(pa.array([x], pa.binary()) for x in (sid.tobytes(), size.astype(np.int32).tobytes(), ids.tobytes(), keys.tobytes(), b"", b""))],
            names=["kind", "pid", "sids", "sizes", "place", "grams", "level", "hot"],
        )
        unique, first = np.unique(sid, return_index=True)
        fresh = first[~np.isin(unique, seen)]
        seen = np.concatenate([seen, sid[fresh]]) if len(seen) < 1 << 20 else sid[fresh]
        chosen = np.zeros(len(sid), bool)
        chosen[fresh] = True
        row = np.repeat(np.arange(len(sid)), size)
        own = chosen[row]
        row, grams = row[own], grams[own]
        order = np.argsort(grams)
        row, grams = row[order], grams[order]
        heads = runs_at(grams)
        often = np.diff(np.r_[heads, len(grams)])
        is_hot = often >= hot
        cold = np.repeat(~is_hot, often)
        witness = grams[heads[is_hot]]
        pid = parts_of(witness, parts)
        told = {int(p): witness[pid == p].tobytes() for p in np.unique(pid)}
        out = [members, _blocks(_GRAMS, parts_of(grams[cold], parts), row[cold], grams[cold], None, sid, size, told)]
        if not cold.all():
            settled, h = row[~cold], grams[~cold]
            out.append(_blocks(_SETTLED, parts_of(sid[settled], parts), settled, h, np.full(len(h), hot), sid, size))
        return out, seen

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, count, seen = [], 0, np.zeros(0, np.uint64)
        for batch in batches:
            for part in slices(batch, "text"):
                h, at = Words(part.column("text")).shingles(n)
                has = np.flatnonzero(np.diff(at))
                if not len(has):
                    continue
                heads, size = at[:-1][has], np.diff(at)[has]
                sid = mix(np.add.reduceat(mix(h + np.uint64(1)), heads) ^ mix(np.bitwise_xor.reduceat(mix(h ^ np.uint64(0x5DEECE66D)), heads)) ^ size.astype(np.uint64))
                texts.append((part.column("doc_id").to_numpy()[has], part.column("key").to_numpy()[has], sid, size, h))
                count += len(h)
                if count >= CHUNK_GRAMS:
                    out, seen = flush(texts, seen)
                    yield from out
                    texts, count = [], 0
        if texts:
            yield from flush(texts, seen)[0]

    return run


def _settle(parts: int, most: int):
    """All of a partition's n-grams to those that two sets hold, by set, with the number of sets up to `most`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            if (kind != _GRAMS).any():
                yield batch.filter(pa.array(kind != _GRAMS))
            rows += batch.filter(pa.array(kind == _GRAMS)).to_pylist()
        hot = np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r["hot"], np.uint64) for r in rows)]))
        sids, sizes, place, grams, _ = _unpack(rows)
        del rows
        order = np.argsort(grams)
        place, grams = place[order], grams[order]
        heads = runs_at(grams)
        often = np.diff(np.r_[heads, len(grams)])
        keep = np.repeat((often > 1) | np.isin(grams[heads], hot), often)
        place, grams = place[keep], grams[keep]
        order = np.lexsort((place, grams))
        place, grams = place[order], grams[order]
        if len(grams):
            fresh = np.r_[True, (grams[1:] != grams[:-1]) | (place[1:] != place[:-1])]
            place, grams = place[fresh], grams[fresh]
        heads = runs_at(grams)
        often = np.diff(np.r_[heads, len(grams)])
        level = np.where(np.isin(grams[heads], hot), most, np.minimum(often, most))
        level = np.repeat(level, often)
        keep = level > 1
        if keep.any():
            place, grams, level = place[keep], grams[keep], level[keep]
            yield _blocks(_SETTLED, parts_of(sids[place], parts), place, grams, level, sids, sizes)

    return run


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            columns = [np.frombuffer(r["place"], np.int64), np.frombuffer(r["grams"], np.int64), np.frombuffer(r["sids"], np.int64)]
            yield pa.record_batch([pa.array(c) for c in columns], names=["doc_id", "key", "sid"])


def _bitmaps(row: np.ndarray, grams: np.ndarray, n: int, bits: int) -> np.ndarray:
    """n bitmaps of n-grams; row is sorted."""
    out = np.zeros((n, bits // 8), np.uint8)
    for a in range(0, n, 4096):
        b = min(n, a + 4096)
        own = slice(*np.searchsorted(row, (a, b)))
        flags = np.zeros((b - a) * bits, bool)
        flags[(row[own] - a) * bits + (grams[own] % np.uint64(bits)).astype(np.int64)] = True
        out[a:b] = np.packbits(flags.reshape(b - a, bits), axis=1)
    return out


def _partners(threshold: float, bits: int):
    """Sets with enough shared n-grams to have a partner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sids, sizes, place, grams, level = _unpack([r for b in batches for r in b.to_pylist()])
        order = np.lexsort((grams, place))
        place, grams, level = place[order], grams[order], level[order]
        if len(grams):
            fresh = np.r_[True, (grams[1:] != grams[:-1]) | (place[1:] != place[:-1])]
            place, grams, level = place[fresh], grams[fresh], level[fresh]
        count = np.bincount(place, minlength=len(sids))
        needed = np.ceil(threshold * sizes - 1e-9).astype(np.int64)
        good = count >= needed
        if not good.any():
            return
        own = good[place]
        number = np.cumsum(good) - 1
        place, grams, level = number[place[own]], grams[own], level[own]
        sids, sizes, count, needed = sids[good], sizes[good], count[good], needed[good]
        maps = _bitmaps(place, grams, len(sids), bits)
        ends = np.cumsum(count)
        order = np.lexsort((grams, level, place))
        first = np.arange(len(grams)) - np.repeat(ends - count, count) <= np.repeat(count - needed, count)
        prefix = grams[order][first]
        at = np.r_[0, np.cumsum(count - needed + 1)].astype(np.int32)
        for a in range(0, len(sids), 8192):
            b = min(len(sids), a + 8192)
            yield pa.record_batch(
                [
                    pa.array(sids[a:b].view(np.int64)),
                    pa.array(sizes[a:b].astype(np.int32)),
                    pa.array([grams[e - c : e].tobytes() for e, c in zip(ends[a:b].tolist(), count[a:b].tolist())], pa.binary()),
                    pa.array([m.tobytes() for m in maps[a:b]], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(at[a : b + 1] - at[a]), pa.array(prefix[at[a] : at[b]].view(np.int64))),
                ],
                names=["sid", "size", "grams", "bitmap", "prefix"],
            )

    return run


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """A table for each run of the key; the rows come sorted by it."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy()
        cuts = np.flatnonzero(k[1:] != k[:-1]) + 1
        if rest and rest[0].column(key)[0].as_py() != k[0]:
            yield pa.Table.from_batches(rest)
            rest = []
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(k)]):
            rest.append(batch.slice(a, b - a))
            if b < len(k):
                yield pa.Table.from_batches(rest)
                rest = []
    if rest:
        yield pa.Table.from_batches(rest)


def _fixed(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1)


def _at_least(sizes, threshold: float):
    """The least overlap with which two sets of these sizes together reach the threshold."""
    return np.ceil(threshold / (1 + threshold) * sizes - 1e-9)


class SignatureTree:
    """Nodes over sets sorted by bucket and size; level 0 holds the leaves."""

    def __init__(self, buckets: np.ndarray, sizes: np.ndarray, shared: np.ndarray, maps: np.ndarray):
        excess = shared - np.bitwise_count(maps).sum(1)
        self.levels = [self._node(buckets, buckets, sizes, sizes, shared, excess, maps, np.arange(0, len(sizes), LEAF))]
        while len(self.levels[-1][0]) > 1:
            self.levels.append(self._node(*self.levels[-1], np.arange(0, len(self.levels[-1][0]), FAN)))

    @staticmethod
    def _node(first, last, low, high, shared, excess, maps, starts):
        least, most = (lambda x: np.minimum.reduceat(x, starts)), (lambda x: np.maximum.reduceat(x, starts))
        return least(first), most(last), least(low), most(high), most(shared), most(excess), np.bitwise_or.reduceat(maps, starts, axis=0)

    def pairs(self, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of leaves, a <= b, that may hold partners."""
        a = b = np.zeros(1, np.int64)
        for level in reversed(range(len(self.levels))):
            first, last, low, high, shared, excess, maps = self.levels[level]
            good = (first[b] <= last[a]) & (np.minimum(high[a], high[b]) >= threshold * np.maximum(low[a], low[b]) - 1e-9)
            a, b = a[good], b[good]
            kept_a, kept_b = [], []
            for s in range(0, len(a), 1 << 16):
                x, y = a[s : s + (1 << 16)], b[s : s + (1 << 16)]
                most = np.bitwise_count(maps[x] & maps[y]).sum(1) + np.minimum(excess[x], excess[y])
                most = np.minimum(most, np.minimum(shared[x], shared[y]))
                good = most >= _at_least(low[x] + low[y], threshold)
                kept_a.append(x[good])
                kept_b.append(y[good])
            a, b = np.concatenate([a[:0], *kept_a]), np.concatenate([b[:0], *kept_b])
            if level:
                below = len(self.levels[level - 1][0])
                step = np.arange(FAN * FAN)
                i = (a[:, None] * FAN + step // FAN).ravel()
                j = (b[:, None] * FAN + step % FAN).ravel()
                good = (i <= j) & (j < below)
                a, b = i[good], j[good]
        return a, b


def _in_both(starts: np.ndarray, lengths: np.ndarray, values: np.ndarray, width: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many values rows i and j have in common, pair by pair; values of a row are distinct and below width."""
    out = np.zeros(len(i), np.int64)
    each = np.cumsum(lengths[i] + lengths[j])
    a = 0
    while a < len(i):
        b = max(a + 1, int(np.searchsorted(each, (each[a - 1] if a else 0) + (4 << 20), "right")))
        x, y, n = i[a:b], j[a:b], np.arange(b - a)
        key = np.concatenate([np.repeat(n * width, lengths[r]) + values[spread(starts[r], lengths[r])] for r in (x, y)])
        key.sort()
        out[a:b] = np.bincount(key[1:][key[1:] == key[:-1]] // width, minlength=b - a)
        a = b
    return out


def _overlaps(starts: np.ndarray, lengths: np.ndarray, values: np.ndarray, width: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The same, where many pairs are of few rows by products of dense indicator tiles. A product
    costs its rows times its columns however few the pairs are, so that a tile whose pairs cost less
    one by one is left to _in_both."""
    out = np.zeros(len(i), np.int64)
    tile = (i // TILE << 32) + j // TILE
    order = np.argsort(tile, kind="stable")
    for p in np.split(order, runs_at(tile[order])[1:]):
        (x, at_x), (y, at_y) = np.unique(i[p], return_inverse=True), np.unique(j[p], return_inverse=True)
        work = int((lengths[i[p]] + lengths[j[p]]).sum())
        columns = np.zeros(0, values.dtype)
        dense = work > 2 * int(lengths[x].sum() + lengths[y].sum())
        if dense:
            own = [values[spread(starts[r], lengths[r])] for r in (x, y)]
            columns = np.intersect1d(*own)
            dense = len(x) * len(y) * len(columns) <= DENSE * work
        if not dense:
            out[p] = _in_both(starts, lengths, values, width, i[p], j[p])
            continue
        for c in range(0, len(columns), 4096):
            part, sides = columns[c : c + 4096], []
            for r, v in zip((x, y), own):
                place = np.minimum(np.searchsorted(part, v), len(part) - 1)
                found = part[place] == v
                full = np.zeros((len(r), len(part)), np.float32)
                full[np.repeat(np.arange(len(r)), lengths[r])[found], place[found]] = 1
                sides.append(full)
            out[p] += (sides[0] @ sides[1].T)[at_x, at_y].astype(np.int64)
    return out


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least of 0 .. n - 1 that each is connected to."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(before, root):
            return root
    return root


def _links(threshold: float, most_pairs: int = 1 << 20):
    """The rows of a node, or of two nodes of one bucket, to (sid, root, links)."""

    def unit(table: pa.Table) -> pa.RecordBatch | None:
        bucket, sid, size, m, side = (table.column(c).to_numpy() for c in ("bucket", "sid", "size", "m", "side"))
        size, n = size.astype(np.int64), table.num_rows
        maps = _fixed(table.column("bitmap"), np.uint64)
        raw = table.column("grams").to_pylist()
        lengths = np.array([len(x) // 8 for x in raw], np.int64)
        starts = np.cumsum(lengths) - lengths
        kinds, values = np.unique(np.frombuffer(b"".join(raw), np.uint64), return_inverse=True)
        earlier = table.column("earlier").to_pylist()
        before = np.array([len(x) for x in earlier], np.int64)
        others, other = np.unique(np.array([v for x in earlier for v in x], np.int64), return_inverse=True)
        links, up = np.zeros(n), (np.zeros(0, np.int64), np.zeros(0, np.int64))

        def verify(i: np.ndarray, j: np.ndarray) -> None:
            nonlocal links, up
            both = (before[i] > 0) & (before[j] > 0)
            if both.any():  # a pair belongs to the first bucket that holds both
                at = np.flatnonzero(both)
                again = _in_both(np.cumsum(before) - before, before, other, len(others), i[at], j[at]) > 0
                keep = np.ones(len(i), bool)
                keep[at[again]] = False
                i, j = i[keep], j[keep]
            order = np.argsort(bucket[i], kind="stable")
            i, j = i[order], j[order]
            heads = runs_at(bucket[i])
            dense = np.zeros(len(i), bool)
            overlap = np.zeros(len(i), np.int64)
            for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(i)]):
                if b - a > 256:
                    overlap[a:b] = _overlaps(starts, lengths, values, len(kinds), i[a:b], j[a:b])
                    dense[a:b] = True
            rest = np.flatnonzero(~dense)
            overlap[rest] = _in_both(starts, lengths, values, len(kinds), i[rest], j[rest])
            good = overlap / (size[i] + size[j] - overlap) >= threshold
            i, j = i[good], j[good]
            links += np.bincount(i, m[j], n) + np.bincount(j, m[i], n)
            root = _roots(n, np.r_[up[0], i], np.r_[up[1], j])
            up = np.flatnonzero(root != np.arange(n)), root[root != np.arange(n)]

        a, b = SignatureTree(bucket, size, lengths, maps).pairs(threshold)
        order = np.lexsort((b, a, b * LEAF // TILE, a * LEAF // TILE))  # what is verified together is of few rows
        a, b = a[order], b[order]
        own = np.bitwise_count(maps).sum(1)
        step = np.arange(LEAF * LEAF)
        some, count = [], 0
        for s in range(0, len(a), 1024):
            i = (a[s : s + 1024, None] * LEAF + step // LEAF).ravel()
            j = (b[s : s + 1024, None] * LEAF + step % LEAF).ravel()
            good = (i < j) & (j < n)
            i, j = i[good], j[good]
            needed = _at_least(size[i] + size[j], threshold)
            good = (bucket[i] == bucket[j]) & (np.minimum(lengths[i], lengths[j]) >= needed) & ((side[i] == 0) | (side[i] != side[j])) & (sid[i] != sid[j])
            i, j, needed = i[good], j[good], needed[good]
            good = np.bitwise_count(maps[i] & maps[j]).sum(1) + np.minimum(lengths[i] - own[i], lengths[j] - own[j]) >= needed
            some.append((i[good], j[good]))
            count += int(good.sum())
            if count >= most_pairs:
                verify(*map(np.concatenate, zip(*some)))
                some, count = [], 0
        if count:
            verify(*map(np.concatenate, zip(*some)))
        found = np.flatnonzero(links)
        if not len(found):
            return None
        root = np.arange(n)
        root[up[0]] = up[1]
        return pa.record_batch([pa.array(sid[found]), pa.array(sid[root[found]]), pa.array(links[found].astype(np.int64))], names=["sid", "root", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, "unit"):
            found = unit(table)
            if found is not None:
                yield found

    return run


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one bucket in one node to the node's ranges and bitmap; rows come sorted by both."""
    for table in _runs(batches, "place"):
        size, shared = (table.column(c).to_numpy().astype(np.int64) for c in ("size", "shared"))
        maps = _fixed(table.column("bitmap"), np.uint64)
        excess = shared - np.bitwise_count(maps).sum(1)
        values = [table.column("bucket")[0].as_py(), table.column("node")[0].as_py(), int(size.min()), int(size.max()), int(shared.max()), int(excess.max()), np.bitwise_or.reduce(maps, axis=0).view(np.int64).tolist()]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
        yield pa.record_batch([pa.array([v], k) for v, k in zip(values, kinds)], names=["bucket", "node", "low", "high", "shared", "excess", "bitmap"])


def _node_pairs(placed: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(bucket, n1, n2): pairs of different nodes that a bucket reaches over and that may hold partners."""
    wide = placed.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("bucket")
    rows = placed.join(wide.hint("merge"), "bucket").join(sets.select("sid", "bitmap"), "sid")
    rows = rows.select("bucket", "node", F.xxhash64("bucket", "node").alias("place"), "size", "shared", "bitmap")
    nodes = rows.repartition("place").sortWithinPartitions("place").mapInArrow(_summaries, "bucket long, node int, low long, high long, shared long, excess long, bitmap array<long>")
    one, two = (nodes.select("bucket", *(F.col(c).alias(f"{c}{i}") for c in ("node", "low", "high", "shared", "excess", "bitmap"))) for i in (1, 2))
    bits = F.aggregate(F.zip_with("bitmap1", "bitmap2", lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda a, x: a + x)
    most = F.least(bits + F.least("excess1", "excess2"), F.least("shared1", "shared2"))
    fits = F.least("high1", "high2") >= threshold * F.greatest("low1", "low2") - 1e-9
    return one.join(two, "bucket").where("node1 < node2").where(fits).where(most >= threshold / (1 + threshold) * (F.col("low1") + F.col("low2")) - 1e-9).select("bucket", F.col("node1").alias("n1"), F.col("node2").alias("n2"))


def _classes(docs: DataFrame, id_col: str, text_col: str, n: int, threshold: float, part_chars: int, node_bytes: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """Members (doc_id, key, sid), key a hash of the text, and (sid, links, leader, first) of the
    sets with several members or partners; first is the least (doc_id, key) of the class."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("key"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, min(MOST_PARTS, -(-chars // part_chars)))
    by_pid = lambda df: df.repartitionById(parts, F.col("pid"))
    settled = materialise(by_pid(texts.mapInArrow(_divide(n, parts, hot), _BLOCKS)).mapInArrow(_settle(parts, hot), _BLOCKS), "near-shared")
    members = materialise(settled.where(F.col("kind") == _MEMBERS).mapInArrow(_members, "doc_id long, key long, sid long").distinct(), "near-members")
    sets = materialise(by_pid(settled.where(F.col("kind") == _SETTLED)).mapInArrow(_partners(threshold, BITS), "sid long, size int, grams binary, bitmap binary, prefix array<long>"), "near-sets")
    many = members.groupBy("sid").agg(F.count_distinct("doc_id").alias("m"), F.min(F.struct("doc_id", "key")).alias("first"))
    prefix = sets.select("sid", F.explode("prefix").alias("gram"))
    least = prefix.groupBy("gram").agg(F.min("sid").alias("bucket"), F.count("*").alias("often")).where("often > 1").select("gram", "bucket")
    buckets = prefix.join(least.hint("merge"), "gram").groupBy("sid").agg(F.collect_set("bucket").alias("buckets"))
    narrow = sets.select("sid", "size", (F.length("grams") / 8).cast("int").alias("shared")).join(buckets, "sid").join(many.select("sid", "m"), "sid")
    rows = materialise(
        narrow.select("sid", "size", "shared", "m", "buckets", F.explode("buckets").alias("bucket")).select("bucket", "sid", "size", "shared", "m", F.filter("buckets", lambda x: x < F.col("bucket")).alias("earlier")),
        "near-buckets",
    )
    nodes = max(1, -(-8 * (rows.agg(F.sum("shared")).first()[0] or 0) // node_bytes))
    placed = materialise(rows.repartitionByRange(nodes, "bucket", "size", "sid").withColumn("node", F.spark_partition_id()), "near-nodes")
    pairs = materialise(_node_pairs(placed, sets, threshold).withColumn("unit", F.monotonically_increasing_id() + nodes), "near-node-pairs")
    within = placed.select("bucket", "sid", "size", "m", "earlier", F.col("node").cast("long").alias("unit"), F.lit(0).alias("side"))
    side = F.when(F.col("node") == F.col("n1"), 1).otherwise(2)
    across = placed.join(pairs.hint("merge"), "bucket").where("node = n1 OR node = n2").select("bucket", "sid", "size", "m", "earlier", "unit", side.alias("side"))
    units = within.unionByName(across).join(sets.select("sid", "grams", "bitmap").hint("merge"), "sid")
    # a partition for each node, and for pairs of nodes as many as there are pairs
    crossings = max(1, pairs.count())
    place = F.when(F.col("side") == 0, F.col("unit")).otherwise(nodes + F.pmod(F.xxhash64("unit"), F.lit(crossings))).cast("int")
    found = materialise(units.repartitionById(nodes + crossings, place).sortWithinPartitions("unit", "bucket", "size", "sid").mapInArrow(_links(threshold), "sid long, root long, links long"), "near-links")
    leaders = components(found.select("sid", "root"), "sid", "root").select(F.col("node").alias("sid"), "leader")
    links = found.groupBy("sid").agg(F.sum("links").alias("links"))
    own = many.join(links, "sid", "left").join(leaders, "sid", "left").select("sid", "first", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("links"), F.coalesce("leader", "sid").alias("leader"))
    own = own.where("links > 0")
    first = own.groupBy("leader").agg(F.min("first").alias("first"))
    return members, own.select("sid", "links", "leader").join(first, "leader").select("sid", "links", "leader", "first")


def ngram_jaccard_join(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = NGRAM,
    threshold: float = THRESHOLD,
    part_chars: int = PART_CHARS,
    node_bytes: int = NODE_BYTES,
    hot: int = HOT,
) -> DataFrame:
    """doc_id, class_id, n_links of every document with a link: the least id of the documents that
    chains of links lead to, and with how many others it has a Jaccard of the threshold or more."""
    members, classes = _classes(docs, id_col, text_col, n, threshold, part_chars, node_bytes, hot)
    joined = members.select("doc_id", "sid").distinct().join(classes.hint("merge"), "sid")
    return joined.groupBy("doc_id").agg(F.min("first.doc_id").alias("class_id"), F.sum("links").alias("n_links"))


def components(pairs: DataFrame, a: str = "doc_a", b: str = "doc_b") -> DataFrame:
    """(node, leader) for every value in a pair of different ones: the least that chains of pairs
    lead to. Nulls and pairs of equal values are left out; an empty table gives an empty result;
    repeated pairs count once.

    Each round hangs the larger neighbours of a node on the least of its neighbourhood, then all
    smaller ones too; tables are written, so that no lineage grows. The number of rounds is
    logarithmic in the length of the longest chain.
    """
    both = lambda df: df.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*").distinct()
    edges = materialise(both(pairs.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")), "edges")
    while True:
        least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        down = edges.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = both(down.join(low, "u").select("u", "v", "m").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")).where("u > v")
        small = materialise(small, "stars")
        again = small.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
        if not again and not small.join(small.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count():
            return small.select(F.col("u").alias("node"), F.col("v").alias("leader")).unionByName(small.select(F.col("v").alias("node"), F.col("v").alias("leader")).distinct())
        edges = both(small)


def _key(column: Column) -> Column:
    return F.xxhash64(column)


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs less all but one of each class of near copies, the one with the least id and,
    if that has several texts, the least hash of the text. Of rows with the same id and text one
    stays; rows with a null id and rows without words all stay, rows that share an id but not their
    text are documents of their own. All columns are kept, whatever their names; texts may be of any
    length; an empty table stays empty."""
    sizes = {"n": NGRAM, "threshold": THRESHOLD, "part_chars": PART_CHARS, "node_bytes": NODE_BYTES, "hot": HOT} | options
    members, classes = _classes(docs, id_col, text_col, **sizes)
    c_id, c_key, c_place = (f"c{uuid.uuid4().hex}" for _ in range(3))
    tagged = docs.withColumns({c_id: F.col(id_col).cast("long"), c_key: _key(F.col(text_col))})
    named = lambda df: df.select(F.col("doc_id").alias(c_id), F.col("key").alias(c_key))
    lost = named(members.join(classes.select("sid", "first").hint("merge"), "sid").where("doc_id <> first.doc_id OR key <> first.key"))
    out = tagged.join(lost, [c_id, c_key], "left_anti")
    often = tagged.where(F.col(c_id).isNotNull() & F.col(text_col).rlike("[0-9A-Za-z\\x{80}-\\x{10FFFF}]")).groupBy(c_id, c_key).count().where("count > 1").select(c_id, c_key)
    often = materialise(often, "near-repeated")
    if often.limit(1).count():
        order = Window.partitionBy(c_id, c_key).orderBy(text_col)
        one = out.join(often, [c_id, c_key], "left_semi").withColumn(c_place, F.row_number().over(order)).where(F.col(c_place) == 1).drop(c_place)
        out = out.join(often, [c_id, c_key], "left_anti").unionByName(one)
    return out.select(*docs.columns)


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '{WORD_RE2}') AS w FROM documents),
g AS (SELECT doc_id, list_distinct(CASE
        WHEN len(w) >= {NGRAM} THEN list_transform(range(1, len(w) - {NGRAM - 2}), lambda i: array_to_string(w[i:i+{NGRAM - 1}], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
s AS (SELECT doc_id, g, len(g) AS n, md5(array_to_string(list_sort(g), '|')) AS k FROM g WHERE len(g) > 0),
r AS (SELECT *, min(doc_id) OVER (PARTITION BY k) AS rep, count(*) OVER (PARTITION BY k) AS m FROM s),
x AS (SELECT doc_id, n, m, unnest(g) AS t FROM r WHERE doc_id = rep),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(b.m) AS m, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS j
      FROM x a JOIN x b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2 HAVING j >= {THRESHOLD}),
reach(a, b) AS (SELECT rep, rep FROM r UNION SELECT reach.a, o.b FROM reach JOIN o ON reach.b = o.a),
c AS (SELECT a AS rep, min(b) AS class_id FROM reach GROUP BY a),
l AS (SELECT a AS rep, sum(m)::BIGINT AS links FROM o GROUP BY a)
SELECT doc_id, class_id, (coalesce(links, 0) + m - 1)::BIGINT AS n_links
FROM r JOIN c USING (rep) LEFT JOIN l USING (rep) WHERE coalesce(links, 0) + m > 1
"""
