"""Repeated passages across documents: enhanced suffix arrays over the places where texts can repeat at all.

A suffix array of the whole corpus doesn't fit one machine, and most of it is of no use: a passage repeats only
where texts share the least-hashed k-gram of a window. So the work goes in three passes over one exchange of the
texts (dealt to parts by id), and what moves between them is small and aggregated for each part:

1. Every window of ``min_len`` bytes has a key, the least hash of its k-grams. Parts send the distinct keys they
   hold; buckets of keys send back those that more than one document has.
2. Parts send the *contexts* of these keys: a run of neighbouring windows with one key, as a string of bytes
   (window start of the first to window end of the last), distinct, with the smallest document that has it.
   Equal windows have equal keys, so they meet in one bucket. There, an enhanced suffix array of all window starts is
   scanned with a stack: every interval of the tree of common prefixes is a repeat with all its places, its smallest
   document and whether the bytes on its left differ. Left-diverse intervals (the others are inside a longer repeat) go
   back to the parts, as spans of their contexts with that document.
3. Parts take out the spans whose repeat also starts in a smaller document. That is all of it: a window's places are
   those of the maximal repeat around it, so the windows of smaller documents cover what these spans cover.

``maximal_repeats`` needs how often and after which bytes a window occurs, so it counts the windows of shared keys by
their digests, and compares what follows the left-diverse ones as far as windows repeat without a gap, by the whole tree of their intervals.

A copy, line or passage that a third of all documents hold is in each part once, however often it occurs there. A
key with so many different contexts that it outweighs a bucket is dealt window by window, by the window's hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gather, id_text, label_column, labels, mix64, runs, shuffle_partitions

MIN_LEN, GRAM = 50, 24
BLOCK = 1 << 18  # bytes worked on at once
SUB_CONTEXTS = 60_000  # contexts of a suffix array, about
HOT_SHARE = 4  # a key with more than a quarter of the mean bucket is dealt by windows
BASE = np.uint64(0xD6E8FEB86659FD93)
NO_ID = (1 << 63) - 1  # documents without an id come after all others
HOT = 1 << 63  # flag of a key whose windows are dealt one by one
START = b"\xff"  # stands before a text's first byte; no byte of UTF-8


# ---- windows, keys and runs ----------------------------------------------------------------------------------


def gram_hashes(buf: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-grams of a byte array, by doubling."""
    n = len(buf)
    if n < k:
        return np.zeros(0, np.uint64)
    power, have, width, length, base, rest = buf.astype(np.uint64) + np.uint64(1), None, 0, 1, BASE, k
    while True:  # binary parts of k, from the lowest bit
        if rest & 1:
            if have is None:
                have, width = power, length
            else:
                m = n - (width + length) + 1
                have = have[:m] * base + power[width : width + m]
                width += length
        rest >>= 1
        if not rest:
            break
        m = n - 2 * length + 1
        power = power[:m] * base + power[length : length + m]
        base = np.uint64(int(base) ** 2 & (1 << 64) - 1)
        length *= 2
    out = have[: n - k + 1]
    return (out ^ out >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n, have = len(x) - w + 1, 1
    if n <= 0:
        return np.zeros(0, x.dtype)
    while have * 2 <= w:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[:n], x[w - have : w - have + n]) if have < w else x[:n]


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def digests(buf: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit digests of buf[a:b] for arrays a and b: sums of bytes times powers of an odd base, shifted to one place."""
    n = len(buf)
    if len(_POWERS[0]) < n:
        for i, base in enumerate((BASE, np.uint64(pow(int(BASE), -1, 1 << 64)))):
            _POWERS[i] = np.r_[np.uint64(1), np.cumprod(np.full(n, base, np.uint64))]
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _POWERS[0][:n], out=total[1:])
    return mix64((total[b] - total[a]) * _POWERS[1][a] + (b - a).astype(np.uint64) * np.uint64(0x94D049BB133111EB))


class Windows:
    """The runs of neighbouring windows with one key in a block of texts.

    at, count: first window and number of windows of a run; key: its key; part: the place of its text in the block.
    """

    def __init__(self, parts: list[tuple[int, int, bytes, bytes]], min_len: int, gram: int, buckets: int):
        """parts: (row of the text, where in it the bytes begin, the byte before them, bytes)."""
        self.min_len = min_len
        self.rows, self.bases = np.array([p[0] for p in parts], np.int64), np.array([p[1] for p in parts], np.int64)
        self.buf = np.frombuffer(b"".join(x for p in parts for x in p[2:]), np.uint8)
        self.sizes = np.array([len(p[3]) for p in parts], np.int64)
        self.begins = np.cumsum(self.sizes + 1) - self.sizes
        least = sliding_min(gram_hashes(self.buf, gram), min_len - gram + 1)
        wins = np.maximum(0, self.sizes - min_len + 1)
        first = np.zeros(len(least), bool)
        first[1:] = least[1:] != least[:-1]
        has = wins > 0
        first[self.begins[has]] = True
        live = np.zeros(len(least) + 1, np.int8)
        live[self.begins[has]] += 1
        live[(self.begins + wins)[has]] -= 1
        stop = first.copy()
        ends = (self.begins + wins)[has]
        stop[ends[ends < len(stop)]] = True
        first &= np.cumsum(live[:-1]) > 0
        at, stops = np.flatnonzero(first), np.r_[np.flatnonzero(stop), len(least)]
        count = stops[np.searchsorted(stops, at, side="right")] - at if len(at) else at
        cap = min_len - gram + 1
        if len(count) and count.max() > cap:  # a k-gram that recurs: cut its run
            pieces = -(-count // cap)
            step = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            at, total = np.repeat(at, pieces) + step * cap, np.repeat(count, pieces)
            count = np.minimum(cap, total - step * cap)
        self.buckets, self.gram, self.least = buckets, gram, least
        self.key = self.keys_of(least[at])
        self.at, self.count = at, count
        self.part = np.searchsorted(self.begins, at, side="right") - 1

    def keys_of(self, least: np.ndarray) -> np.ndarray:
        m = mix64(least)
        return (m % np.uint64(self.buckets)) << np.uint64(32) | m >> np.uint64(32)

    def chosen(self) -> np.ndarray:
        """The key of every place whose k-gram is the least of a window: equal windows have it at two places, in one run or two."""
        cap = self.min_len - self.gram + 1
        if not len(self.least):
            return np.zeros(0, np.uint64)
        grams, edge = gram_hashes(self.buf, self.gram), np.zeros(cap - 1, np.uint64)
        greatest = ~sliding_min(~np.r_[edge, self.least, edge], cap)  # of the windows that a place is in
        return self.keys_of(grams[grams == greatest])

    def every(self) -> np.ndarray:
        """All windows."""
        return gather(self.begins, np.maximum(0, self.sizes - self.min_len + 1))

    def contexts(self, at: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(digest, begin, size) of the byte before and the bytes of ``count`` windows from ``at``."""
        size = count + self.min_len
        return digests(self.buf, at - 1, at - 1 + size), at - 1, size

    def single(self, runs_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(run, window) for every window of the runs."""
        return np.repeat(runs_, self.count[runs_]), gather(self.at[runs_], self.count[runs_])


def blocks(texts: Iterator[bytes], min_len: int) -> Iterator[list[tuple[int, int, bytes, bytes]]]:
    """Whole texts together up to BLOCK bytes; a longer text in overlapping blocks, so that no window is lost."""
    held, total = [], 0
    for i, text in enumerate(texts):
        if held and total + len(text) > BLOCK:
            yield held
            held, total = [], 0
        if len(text) <= BLOCK + min_len:
            held.append((i, 0, START, text))
            total += len(text)
            continue
        for at in range(0, len(text) - min_len + 1, BLOCK):
            yield [(i, at, text[at - 1 : at] if at else START, text[at : at + BLOCK + min_len - 1])]
    if held:
        yield held


def texts_of(col: pa.ChunkedArray) -> Iterator[bytes]:
    for chunk in col.chunks if isinstance(col, pa.ChunkedArray) else [col]:
        for x in chunk.cast(pa.binary()):
            yield x.as_py() or b""


def member(sorted_keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(sorted_keys, x), len(sorted_keys) - 1)
    return sorted_keys[at] == x


def squeeze(*arrays: np.ndarray | bytes) -> bytes:
    raw = [a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(np.array([len(raw), *map(len, raw)], np.int64).tobytes() + b"".join(raw))


def unsqueeze(blob: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes, at, out = np.frombuffer(raw, np.int64, n, 8), 8 + 8 * n, []
    for s in sizes:
        out.append(raw[at : at + s])
        at += int(s)
    return out


# ---- the enhanced suffix array -------------------------------------------------------------------------------


class SuffixArray:
    """Sorted window starts of distinct contexts, with the common prefixes of neighbours and the left bytes.

    A context is one byte to the left, then bytes; its suffixes are those of at least ``min_len`` bytes.
    """

    def __init__(self, data: np.ndarray, size: np.ndarray, min_len: int):
        self.min_len = min_len
        begin = np.cumsum(size) - size
        wins = size - min_len  # one byte to the left
        self.owner = np.repeat(np.arange(len(size)), wins)
        self.offset = gather(np.zeros(len(wins), np.int64), wins)
        start = begin[self.owner] + 1 + self.offset
        buf = np.r_[data, np.zeros(8 + 2 * min_len, np.uint8)]
        words = np.zeros(len(buf) - 7, np.uint64)
        for j in range(8):
            words = words << np.uint64(8) | buf[j : j + len(words)]
        steps = [*range(0, min_len - 7, 8)] + ([min_len - 8] if min_len % 8 else [])
        keys = [words[start + s] for s in steps]
        self.order = np.lexsort(keys[::-1])
        same = np.ones(max(0, len(start) - 1), bool)
        for k in keys:
            k = k[self.order]
            same &= k[1:] == k[:-1]
        self.same, self.left, self.start, self.buf, self.words = same, buf[start - 1], start, buf, words
        self.end = begin[self.owner] + size[self.owner]

    def top(self) -> np.ndarray:
        """Group of each place of the order: places with a common prefix of min_len or more to their neighbours."""
        return np.cumsum(np.r_[0, ~self.same]) if len(self.order) else np.zeros(0, np.int64)

    def full(self) -> tuple[np.ndarray, np.ndarray]:
        """The places that share their first min_len bytes with another, in full order, and the common prefix of each with the next
        one: of all bytes up to the shorter's end, 0 where a group ends."""
        group = self.top()
        size = runs(group)[1]
        many = np.repeat(size > 1, size)
        place, group = self.order[many], group[many]
        more = self.end[place] - self.start[place] - self.min_len  # bytes that the first sort didn't see
        keys = []
        for at in range(0, int(more.max(initial=0)), 8):
            own = np.clip(more - at, 0, 8)  # zeros stand for what lies beyond a tail's end
            mask = np.where(own > 0, ~np.uint64(0) << np.uint64(8) * (np.uint64(8) - np.maximum(own, 1).astype(np.uint64)), np.uint64(0))
            keys.append(self.words[np.minimum(self.start[place] + self.min_len + at, len(self.words) - 1)] & mask)
        order = np.lexsort((more, *keys[::-1], group))
        place, group, more = place[order], group[order], more[order]
        lcp = np.zeros(len(place), np.int64)
        if len(place):
            common, alive = np.zeros(len(place) - 1, np.int64), np.ones(len(place) - 1, bool)
            for key in keys:
                differ = key[order][1:] ^ key[order][:-1]
                common += alive * sum((differ < np.uint64(1) << np.uint64(8 * b)).astype(np.int64) for b in range(8))
                alive &= differ == 0
            lcp[:-1] = np.where(group[1:] == group[:-1], self.min_len + np.minimum(common, np.minimum(more[1:], more[:-1])), 0)
        return place, lcp

    def spans(self, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(context, offset, length, document) of what repeats: the ``length`` bytes from ``offset`` of a context also start in ``document``.

        For every place, the intervals of the tree that hold it are passed from the deepest up; each whose smallest document is
        smaller than those below it is given, as long as it is left-diverse. One that isn't is inside a longer one that begins
        a byte earlier. A context's first place counts as diverse: what stands before it is another context's business.
        """
        n = np.bincount(self.owner, minlength=len(least))
        found = [(np.arange(len(least)), np.zeros(len(least), np.int64), n + self.min_len - 1, least)]  # the context itself
        place, lcp = self.full()
        owner, offset = self.owner[place], self.offset[place]
        left = self.left[place].astype(np.int64)
        tree = IntervalTree(lcp, least[owner], np.where(offset == 0, -1, left), np.where(offset == 0, 256, left))
        at, best, live = tree.leaf, least[owner], np.arange(len(place))
        while len(live):
            fewer = tree.least[at] < best
            give = fewer & (tree.lo[at] != tree.hi[at])
            found.append((owner[live[give]], offset[live[give]], tree.depth[at[give]], tree.least[at[give]]))
            best = np.minimum(best, tree.least[at])
            at = tree.parent[at]
            go = at >= 0
            at, best, live = at[go], best[go], live[go]
        return tuple(map(np.concatenate, zip(*found)))


class IntervalTree:
    """The tree of common-prefix intervals of sorted places, by one scan with a stack.

    ``lcp[i]`` is the common prefix of place i and the next one; below 1 no interval joins them. For every interval: ``depth`` (its
    common prefix), ``first`` and ``last`` place, ``least`` (smallest document), ``lo`` and ``hi`` (least and greatest left byte: they
    differ where it is left-diverse) and ``parent`` (-1: none); ``leaf`` is the deepest interval of each place (-1: none).
    """

    def __init__(self, lcp: np.ndarray, least: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        depth, first, last, low, least_byte, most_byte, parent = [], [], [], [], [], [], []
        leaf: list[int] = []
        stack: list[int] = []

        def node(d: int, at: int) -> int:
            for to, x in ((depth, d), (first, at), (last, at), (low, NO_ID), (least_byte, 257), (most_byte, -2), (parent, -1)):
                to.append(x)
            stack.append(len(depth) - 1)
            return stack[-1]

        def merge(to: int, end: int, doc: int, a: int, b: int) -> None:
            last[to] = end
            if doc < low[to]:
                low[to] = doc
            if a < least_byte[to]:
                least_byte[to] = a
            if b > most_byte[to]:
                most_byte[to] = b

        for i, (d, doc, a, b) in enumerate(zip(lcp.tolist(), least.tolist(), lo.tolist(), hi.tolist())):
            own = stack[-1] if stack and depth[stack[-1]] >= d else node(d, i) if d > 0 else -1
            leaf.append(own)
            if own >= 0:
                merge(own, i, doc, a, b)
            while stack and depth[stack[-1]] > d:
                done = stack.pop()
                up = stack[-1] if stack and depth[stack[-1]] >= d else node(d, first[done]) if d > 0 else -1
                parent[done] = up
                if up >= 0:
                    merge(up, i, low[done], least_byte[done], most_byte[done])
        self.depth, self.first, self.last, self.least, self.lo, self.hi, self.parent, self.leaf = (np.array(x, np.int64) for x in (depth, first, last, low, least_byte, most_byte, parent, leaf))


def tree(tails: list[bytes], left: list[int], min_len: int) -> Iterator[tuple[int, int, int, bool]]:
    """(first, last, common prefix, left-diverse) of every interval of sorted strings with a common prefix of min_len or more."""
    lcp = np.array([n if n >= min_len else 0 for n in (common_prefix(a, b) for a, b in zip(tails, tails[1:]))] + [0], np.int64)
    side = np.array(left, np.int64)
    t = IntervalTree(lcp, np.zeros(len(tails), np.int64), side, side)
    for a, b, depth, lo, hi in zip(t.first.tolist(), t.last.tolist(), t.depth.tolist(), t.lo.tolist(), t.hi.tolist()):
        yield a, b, depth, lo != hi or lo == START[0]


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n  # a[:lo] == b[:lo], a[:hi] != b[:hi]
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid)
    return lo


# ---- the passes ----------------------------------------------------------------------------------------------


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """(bucket, [(part, blob)]) of rows sorted by bucket."""
    now, held = None, []
    for batch in batches:
        for b, p, blob in zip(*(c.to_pylist() for c in batch.columns)):
            if b != now and held:
                yield now, held
                held = []
            now = b
            held.append((p, blob))
    if held:
        yield now, held


BLOBS = "bucket int, part int, blob binary"


def _blobs(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    b, p, x = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(p, pa.int32()), pa.array(x, pa.binary())], ["bucket", "part", "blob"])


class Passes:
    """The functions of the passes, with their parameters."""

    def __init__(self, min_len: int, gram: int, buckets: int, within: bool = False):
        """within: what occurs twice in one document is shared too."""
        self.min_len, self.gram, self.buckets, self.within = min_len, gram, buckets, within
        self.label = labels(buckets)
        self.place = {label: place for place, label in enumerate(self.label)}

    def windows(self, texts: Iterator[bytes]) -> Iterator[Windows]:
        for b in blocks(texts, self.min_len):
            yield Windows(b, self.min_len, self.gram, self.buckets)

    def keys(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pass 1: for each bucket the distinct keys, their runs, and whether two documents have them."""
        held: dict[int, tuple[list, list]] = {}
        for batch in batches:
            ids, part = np.asarray(batch.column(0).fill_null(NO_ID)), np.asarray(batch.column(2))
            for p in np.unique(part):  # one, as labels() deals them
                own = np.flatnonzero(part == p)
                keys, docs = held.setdefault(int(p), ([], []))
                for w in self.windows(texts_of(batch.column(1).take(pa.array(own)) if len(own) < len(part) else batch.column(1))):
                    if self.within:
                        keys.append(w.chosen())
                        docs.append(np.arange(len(keys[-1])) + sum(map(len, docs)))  # every place by itself
                        continue
                    keys.append(w.key)
                    docs.append(ids[own[w.rows[w.part]]])
        for part in held:
            yield self._key_blobs(part, *map(np.concatenate, held[part]))

    def _key_blobs(self, part: int, key: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        first, count = runs(key)
        many = np.zeros(len(first), np.uint8)
        if len(first):
            many[:] = doc[first] != doc[first + count - 1]
        key = key[first]
        bucket = (key >> np.uint64(32)).astype(np.int64)
        bounds = np.searchsorted(bucket, np.arange(self.buckets + 1))
        rows = []
        for b in range(self.buckets):
            own = slice(bounds[b], bounds[b + 1])
            if bounds[b] < bounds[b + 1]:
                rows.append((self.label[b], part, squeeze(key[own].astype(np.uint32), np.minimum(count[own], 255).astype(np.uint8), many[own])))
        return _blobs(rows)

    def shared_keys(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each part, the keys of a bucket that more than one document has; hot ones apart."""
        for bucket, blobs in by_bucket(batches):
            key, count, many = [], [], []
            for _, blob in blobs:
                k, c, m = unsqueeze(blob)
                key.append(np.frombuffer(k, np.uint32))
                count.append(np.frombuffer(c, np.uint8).astype(np.int64))
                many.append(np.frombuffer(m, np.uint8))
            ends = np.cumsum([len(k) for k in key])
            key, count, many = map(np.concatenate, (key, count, many))
            order = np.argsort(key, kind="stable")
            first, n = runs(key[order])
            shared = (n > 1) | (np.maximum.reduceat(many[order], first) > 0)
            hot = shared & (np.add.reduceat(count[order], first) * HOT_SHARE > max(count.sum(), 1 << 14))
            flag = np.empty(len(key), np.uint8)
            flag[order] = np.repeat(shared + hot.astype(np.uint8), n)
            place, rows = self.place[bucket], []
            for (part, _), stop, size in zip(blobs, ends, np.diff(np.r_[0, ends])):  # a part's keys lie together
                own, what = key[stop - size : stop], flag[stop - size : stop]
                if what.any():
                    rows.append((place, part, squeeze(np.sort(own[what == 1]), np.sort(own[what == 2]))))
            yield _blobs(rows)

    def _table(self, table: pa.Table) -> tuple[np.ndarray, Iterator[bytes]]:
        return np.asarray(table.column("doc_id").combine_chunks().fill_null(NO_ID)) if table.num_rows else np.zeros(0, np.int64), texts_of(table.column("text"))

    def _shared(self, shared: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """The shared keys of a part, and the hot ones."""
        plain, hot = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for b, blob in zip(shared.column("bucket").to_pylist(), shared.column("blob").to_pylist()):
            for to, raw in zip((plain, hot), unsqueeze(blob)):
                to.append(np.frombuffer(raw, np.uint32).astype(np.uint64) | np.uint64(b << 32))
        return np.sort(np.concatenate(plain)), np.sort(np.concatenate(hot))

    def contexts(self, texts: pa.Table, shared: pa.Table) -> pa.Table:
        """Pass 2: the distinct contexts of a part, for each bucket, with their smallest and largest document."""
        plain, hot = self._shared(shared)
        ids, whole = self._table(texts)
        found = []
        for w in self.windows(whole):
            use = np.flatnonzero(member(plain, w.key))
            at, count, key, part = w.at[use], w.count[use], w.key[use], w.part[use]
            bucket = key >> np.uint64(32)
            if len(hot):
                run, win = w.single(np.flatnonzero(member(hot, w.key)))
                at, count = np.r_[at, win], np.r_[count, np.ones(len(win), np.int64)]
                key, part = np.r_[key, w.key[run] | np.uint64(HOT)], np.r_[part, w.part[run]]
                # by the window alone: equal windows meet whatever stands before them
                bucket = np.r_[bucket, digests(w.buf, win, win + self.min_len) % np.uint64(self.buckets)]
            digest, begin, size = w.contexts(at, count)
            digest, first, least, most = _by_digest(digest, ids[w.rows[part]], ids[w.rows[part]])
            found.append((digest, w.buf[gather(begin[first], size[first])], size[first], least, most, key[first], bucket[first].astype(np.int64)))
        if not found:
            return pa.Table.from_batches([_blobs([])])
        digest, data, size, least, most, key, bucket = map(np.concatenate, zip(*found))
        begin = np.cumsum(size) - size
        digest, first, least, most = _by_digest(digest, least, most)
        key, bucket, begin, size = key[first], bucket[first], begin[first], size[first]
        order = np.argsort(bucket, kind="stable")
        part, rows = texts.column("part")[0].as_py(), []
        for f, n in zip(*runs(bucket[order])):
            own = order[f : f + n]
            rows.append((self.label[bucket[own[0]]], part, squeeze(data[gather(begin[own], size[own])], size[own].astype(np.uint8), least[own], most[own], key[own])))
        return pa.Table.from_batches([_blobs(rows)])

    def _arrays(self, blobs: list[tuple[int, bytes]]) -> Iterator[tuple[np.ndarray, ...]]:
        """Distinct contexts of a bucket, a range of keys at a time: bytes, sizes, smallest documents, digests; and every
        part's share: part, which of the contexts, its largest document, key."""
        cols: list[list[np.ndarray]] = [[] for _ in range(7)]
        for part, blob in blobs:
            data, size, least, most, key = (np.frombuffer(x, t) for x, t in zip(unsqueeze(blob), (np.uint8, np.uint8, np.int64, np.int64, np.uint64)))
            size = size.astype(np.int64)
            end, made = np.cumsum(size), []
            for i in range(0, len(size), 4096):  # digests of a bounded stretch of bytes at once
                stop = min(len(size), i + 4096)
                base = end[i] - size[i]
                made.append(digests(data[base : end[stop - 1]], end[i:stop] - size[i:stop] - base, end[i:stop] - base))
            for to, x in zip(cols, (data, size, least, most, key, np.concatenate(made), np.full(len(size), part, np.int64))):
                to.append(x)
        data, size, least, most, key, digest, part = map(np.concatenate, cols)
        begin, sets = np.cumsum(size) - size, max(1, -(-len(size) // SUB_CONTEXTS))
        which = mix64(key & np.uint64(HOT - 1)) % np.uint64(sets)
        for s in range(sets):
            own = np.flatnonzero(which == s)
            if not len(own):
                continue
            unique, first, at = np.unique(digest[own], return_index=True, return_inverse=True)
            low = np.full(len(unique), NO_ID)
            np.minimum.at(low, at, least[own])
            one = own[first]
            yield data[gather(begin[one], size[one])], size[one], low, unique, part[own], at, most[own], key[own]

    def marks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each part: its contexts with a span that a document smaller than one of the part's has, and these spans."""
        for bucket, blobs in by_bucket(batches):
            out = []
            for data, size, least, digest, part, at, most, key in self._arrays(blobs):
                owner, offset, length, doc = SuffixArray(data, size, self.min_len).spans(least)
                order = np.argsort(owner, kind="stable")
                begin, many = np.searchsorted(owner[order], np.arange(len(size))), np.bincount(owner, minlength=len(size))
                rows, which = np.repeat(np.arange(len(at)), many[at]), order[gather(begin[at], many[at])]
                use = doc[which] < most[rows]
                rows, which = rows[use], which[use]
                first, count = runs(rows)
                own = rows[first]  # shares with a span
                out.append((part[own], digest[at[own]], size[at[own]] - self.min_len, key[own], count, offset[which], length[which], doc[which]))
            part, digest, n, key, count, offset, length, doc = map(np.concatenate, zip(*out))
            begin, order = np.cumsum(count) - count, np.argsort(part, kind="stable")
            rows = []
            for f, c in zip(*runs(part[order])):
                own = order[f : f + c]
                of = gather(begin[own], count[own])
                rows.append((bucket, int(part[own[0]]), squeeze(digest[own], n[own].astype(np.uint8), key[own], count[own].astype(np.uint16), offset[of].astype(np.uint8), length[of].astype(np.uint8), doc[of])))
            yield _blobs(rows)

    def counts(self, texts: pa.Table, shared: pa.Table) -> pa.Table:
        """The distinct windows of shared keys in a part, for each bucket: digest, occurrences (1 or more), least and greatest left byte."""
        keys = np.sort(np.concatenate(self._shared(shared)))
        held = (np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.uint8))
        found, rows = [held], []
        for w in self.windows(texts_of(texts.column("text"))):
            _, win = w.single(np.flatnonzero(member(keys, w.key)))
            left = w.buf[win - 1]
            found.append(_by_window(digests(w.buf, win, win + self.min_len), np.ones(len(win), np.uint8), left, left))
        digest, many, lo, hi = _by_window(*map(np.concatenate, zip(*found)))
        bucket = (digest % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        for f, n in zip(*runs(bucket[order])):
            own = order[f : f + n]
            rows.append((self.label[bucket[own[0]]], texts.column("part")[0].as_py(), squeeze(digest[own], many[own], lo[own], hi[own])))
        return pa.Table.from_batches([_blobs(rows)])

    def repeated(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each part: its windows that occur twice or more anywhere, and which of them are left-diverse."""
        for bucket, blobs in by_bucket(batches):
            cols = [[np.frombuffer(x, t) for x, t in zip(unsqueeze(blob), (np.uint64, np.uint8, np.uint8, np.uint8))] for _, blob in blobs]
            digest, many, lo, hi = _by_window(*map(np.concatenate, zip(*cols)))
            twice = many > 1
            digest, diverse = digest[twice], ((lo != hi) | (lo == START[0]))[twice]
            rows = []
            for (part, _), (mine, *_) in zip(blobs, cols):
                mine = np.sort(mine[member(digest, mine)])
                if len(mine):
                    rows.append((bucket, part, squeeze(mine, diverse[np.searchsorted(digest, mine)])))
            yield _blobs(rows)

    def tails(self, texts: pa.Table, marks: pa.Table) -> Iterator[tuple[int, int, bytes, int, int]]:
        """(window, left byte, tail, row, start) of every left-diverse window: the tail goes on as long as each window of it
        is repeated. What two places have in common consists of repeated windows, so it lies inside both tails."""
        digest, diverse = [np.zeros(0, np.uint64)], [np.zeros(0, bool)]
        for blob in marks.column("blob").to_pylist():
            d, v = unsqueeze(blob)
            digest.append(np.frombuffer(d, np.uint64))
            diverse.append(np.frombuffer(v, bool))
        digest, diverse = np.concatenate(digest), np.concatenate(diverse)
        order = np.argsort(digest)
        digest, diverse = digest[order], diverse[order]
        source = list(texts_of(texts.column("text")))
        seen: dict[int, list] = {}
        for w in self.windows(iter(source)) if len(digest) else ():
            win = w.every()
            mine = digests(w.buf, win, win + self.min_len)
            hit = np.flatnonzero(member(digest, mine))
            part = np.searchsorted(w.begins, win[hit], side="right") - 1
            place = win[hit] - w.begins[part] + w.bases[part]
            for f, n in zip(*runs(w.rows[part])):
                own = hit[f : f + n]
                seen.setdefault(int(w.rows[part[f]]), []).append((place[f : f + n], mine[own], diverse[np.searchsorted(digest, mine[own])]))
        for r, got in seen.items():
            place, window, starts = map(np.concatenate, zip(*got))  # by place
            last = np.r_[np.flatnonzero(np.diff(place) != 1), len(place) - 1]  # of each stretch
            text = source[r]
            for k in np.flatnonzero(starts).tolist():
                at = int(place[k])
                stop = int(place[last[np.searchsorted(last, k)]]) + self.min_len
                yield int(window[k]), text[at - 1] if at else START[0], text[at:stop], r, at

    def occurrences(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(group, length, doc_id, start) of every occurrence, out of rows (window, tail, left, doc_id, start) sorted by the first two."""
        out: list[list] = [[], [], [], []]

        def groups(tails: list[bytes], left: list[int], ids: list, starts: list[int]) -> Iterator[pa.RecordBatch]:
            for a, b, depth, diverse in tree(tails, left, self.min_len):
                if diverse:
                    group, n = xxhash.xxh64_intdigest(tails[a][:depth]), b - a + 1
                    for to, x in zip(out, ([group - (1 << 64) if group >> 63 else group] * n, [depth] * n, ids[a : b + 1], starts[a : b + 1])):
                        to.extend(x)
                    if len(out[0]) >= 1 << 14:
                        yield flush()

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["group_id", "length", "doc_id", "start"])
            for x in out:
                x.clear()
            return batch

        now, held = None, []
        for batch in batches:
            for window, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if window != now and held:
                    yield from groups(*map(list, zip(*held)))
                    held = []
                now = window
                held.append(row)
        if held:
            yield from groups(*map(list, zip(*held)))
        yield flush()

    def covered(self, texts: pa.Table, marks: pa.Table) -> Iterator[tuple[int, bytes, np.ndarray | None]]:
        """Pass 3: (row, text, mask of its removed bytes) of every document of a part."""
        cols: list[list] = [[np.zeros(0, t)] for t in (np.uint64, np.int64, np.uint64, np.int64, np.int64, np.int64, np.int64)]
        for blob in marks.column("blob").to_pylist():
            for to, raw, t in zip(cols, unsqueeze(blob), (np.uint64, np.uint8, np.uint64, np.uint16, np.uint8, np.uint8, np.int64)):
                to.append(np.frombuffer(raw, t).astype(to[0].dtype))
        digest, size, key, many, offset, length, least = map(np.concatenate, cols)
        begin, order = np.cumsum(many) - many, np.argsort(digest)
        digest, size, begin, many = digest[order], size[order], begin[order], many[order]
        hot = np.unique(key[key >= np.uint64(HOT)] & np.uint64(HOT - 1))
        keys = np.unique(key[key < np.uint64(HOT)])
        ids, whole = self._table(texts)
        source, done = list(whole), 0
        masks: dict[int, np.ndarray] = {}
        for w in self.windows(iter(source)) if len(digest) else ():
            for r in range(done, int(w.rows[0])):  # all their blocks are through
                yield r, source[r], masks.pop(r, None)
            done = max(done, int(w.rows[0]))
            use = np.flatnonzero(member(keys, w.key))
            at, count, part = w.at[use], w.count[use], w.part[use]
            if len(hot):
                run, win = w.single(np.flatnonzero(member(hot, w.key)))
                at, count, part = np.r_[at, win], np.r_[count, np.ones(len(win), np.int64)], np.r_[part, w.part[run]]
            if not len(at):
                continue
            mine = w.contexts(at, count)[0]
            place = np.minimum(np.searchsorted(digest, mine), len(digest) - 1)
            hit = np.flatnonzero((digest[place] == mine) & (size[place] == count))
            n, of = many[place[hit]], gather(begin[place[hit]], many[place[hit]])
            dup = least[of] < np.repeat(ids[w.rows[part[hit]]], n)
            starts, of = (np.repeat(at[hit], n) + offset[of])[dup], of[dup]
            if not len(starts):
                continue
            edge = np.bincount(starts, minlength=len(w.buf) + 1) - np.bincount(starts + length[of], minlength=len(w.buf) + 1)
            mask = np.cumsum(edge[:-1]) > 0
            for p in np.unique(np.searchsorted(w.begins, starts, side="right") - 1):
                row, a, b = int(w.rows[p]), w.begins[p], w.sizes[p]
                own = masks.setdefault(row, np.zeros(len(source[row]), bool))
                own[w.bases[p] : w.bases[p] + b] |= mask[a : a + b]
        for r in range(done, len(source)):
            yield r, source[r], masks.pop(r, None)


def _by_digest(digest: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct digests, where each is first, and the least and greatest of its documents."""
    order = np.argsort(digest, kind="stable")
    first, _ = runs(digest[order])
    if not len(first):
        return digest, order, least, most
    return digest[order[first]], order[first], np.minimum.reduceat(least[order], first), np.maximum.reduceat(most[order], first)


def _by_window(digest: np.ndarray, many: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct digests, how often each occurs (2: twice or more), the least and greatest byte on its left."""
    order = np.argsort(digest, kind="stable")
    first, _ = runs(digest[order])
    if not len(first):
        return digest, many, lo, hi
    total = np.minimum(np.add.reduceat(many[order].astype(np.int64), first), 2).astype(np.uint8)
    return digest[order[first]], total, np.minimum.reduceat(lo[order], first), np.maximum.reduceat(hi[order], first)


# ---- operators -----------------------------------------------------------------------------------------------


def _parts(docs: DataFrame, n: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """One exchange of the texts, in n parts of about one size; every pass reads it again. ``carry``: columns to take along."""
    part = label_column(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)), n)
    own = id_text(docs) if not carry else docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *(F.col(c).alias(f"_carry{i}") for i, c in enumerate(carry)))
    return own.select("doc_id", "text", part.alias("part"), *own.columns[2:]).repartition(n, "part")


def _dealt(df: DataFrame, n: int) -> DataFrame:
    return df.repartition(n, "bucket").sortWithinPartitions("bucket")


def _shared_keys(docs: DataFrame, min_len: int, gram: int, carry: tuple[str, ...] = (), within: bool = False) -> tuple[DataFrame, DataFrame, Passes, int]:
    if not 8 <= gram <= min_len <= 127:
        raise ValueError("8 <= gram <= min_len <= 127")
    n = shuffle_partitions(docs.sparkSession)
    passes, parts = Passes(min_len, gram, n, within), _parts(docs, n, carry)
    return parts, _dealt(parts.mapInArrow(passes.keys, BLOBS), n).mapInArrow(passes.shared_keys, BLOBS), passes, n


def _context_blobs(docs: DataFrame, min_len: int, gram: int, carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, Passes, int]:
    parts, shared, passes, n = _shared_keys(docs, min_len, gram, carry)
    contexts = parts.groupBy("part").cogroup(shared.groupBy("part")).applyInArrow(lambda texts, own: passes.contexts(texts, own), BLOBS)
    return parts, _dealt(contexts, n), passes, n


def remove_repeats(docs: DataFrame, min_len: int = MIN_LEN, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """Bytes of every text without those in a ``min_len``-byte string that also starts in a smaller document.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, ``with_text``, the text that is left: where a
    removed run would cut a character, the whole character stays. A null text is empty; a text shorter than
    min_len loses nothing. Documents with a null id come after all others; rows with the same id (repeated rows)
    don't count as smaller than each other, so they keep what only they share. An empty table gives no rows.
    """
    parts, contexts, passes, n = _context_blobs(docs, min_len, gram)
    marks = contexts.mapInArrow(passes.marks, BLOBS)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", text string" * with_text

    def finish(texts: pa.Table, own: pa.Table) -> pa.Table:
        rows = []
        ids = texts.column("doc_id").to_pylist()
        for r, text, mask in passes.covered(texts, own):
            if mask is None:
                kept, removed, spans, left = text, 0, 0, text
            else:
                raw = np.frombuffer(text, np.uint8)
                kept = raw[~mask].tobytes()
                removed, spans = int(mask.sum()), int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum())
                left = whole_characters(raw, mask) if with_text else b""
            rows.append((ids[r], len(text), removed, spans, hashlib.sha256(kept).hexdigest(), *([left.decode()] if with_text else [])))
        cols = zip(*rows) if rows else [()] * (5 + with_text)
        return pa.table([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + [pa.string()] * 2)], names=[x.split()[0] for x in schema.split(", ")])

    return parts.groupBy("part").cogroup(marks.groupBy("part")).applyInArrow(finish, schema)


def whole_characters(raw: np.ndarray, mask: np.ndarray) -> bytes:
    """What is left when only characters that are removed wholly go."""
    first = np.flatnonzero((raw & 0xC0) != 0x80)
    gone = np.logical_and.reduceat(mask, first)
    return raw[~np.repeat(gone, np.diff(np.r_[first, len(raw)]))].tobytes()


def without_repeats(docs: DataFrame, min_len: int = MIN_LEN, gram: int = GRAM) -> DataFrame:
    """The documents with repeated passages taken out of their texts (whole characters only); all columns, n_chars as the new
    length. Documents that lose everything stay, with an empty text. Rules for nulls and ids are those of remove_repeats."""
    carry = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    parts, contexts, passes, _ = _context_blobs(docs, min_len, gram, carry)
    marks = contexts.mapInArrow(passes.marks, BLOBS)
    kinds = dict(docs.dtypes)
    schema = "doc_id long, text string" + "".join(f", _carry{i} {kinds[c]}" for i, c in enumerate(carry))

    def finish(texts: pa.Table, own: pa.Table) -> pa.Table:
        left = [t if mask is None else whole_characters(np.frombuffer(t, np.uint8), mask) for _, t, mask in passes.covered(texts, own)]
        taken = [texts.column(f"_carry{i}") for i in range(len(carry))]
        return pa.table([texts.column("doc_id"), pa.array([t.decode() for t in left], pa.string()), *taken], names=["doc_id", "text", *(f"_carry{i}" for i in range(len(carry)))])

    out = parts.groupBy("part").cogroup(marks.groupBy("part")).applyInArrow(finish, schema)
    told = {"doc_id": F.col("doc_id").cast(kinds["doc_id"]), "text": F.col("text"), "n_chars": F.length("text").cast(kinds.get("n_chars", "long"))} | {c: F.col(f"_carry{i}") for i, c in enumerate(carry)}
    return out.select(*(told[c].alias(c) for c in docs.columns))


def maximal_repeats(docs: DataFrame, min_len: int = MIN_LEN, gram: int = GRAM) -> DataFrame:
    """Maximal repeat groups with all their occurrences: group_id, length, doc_id, start (bytes), one row each.

    A group is a string of ``min_len`` bytes or more, of whatever length, with two occurrences or more, in one text or
    several, that differ in the byte to their left (or begin a text) and in the byte to their right (or end one): an
    interval of the common-prefix tree over the places of a left-diverse window, whose strings are compared whole.
    Nulls, ids and empty tables are as in remove_repeats; repeated rows count as occurrences of their own. All places of
    one left-diverse window meet in one task.
    """
    parts, shared, passes, n = _shared_keys(docs, min_len, gram, within=True)
    counts = parts.groupBy("part").cogroup(shared.groupBy("part")).applyInArrow(lambda texts, own: passes.counts(texts, own), BLOBS)
    marks = _dealt(counts, n).mapInArrow(passes.repeated, BLOBS)

    def places(texts: pa.Table, own: pa.Table) -> pa.Table:
        ids = texts.column("doc_id").to_pylist()
        w, left, tail, row, at = zip(*rows) if (rows := list(passes.tails(texts, own))) else ((), (), (), (), ())
        return pa.table([pa.array(np.array(w, np.uint64).view(np.int64)), pa.array(tail, pa.binary()), pa.array(left, pa.int32()), pa.array([ids[r] for r in row], pa.int64()), pa.array(at, pa.int64())], names=["window", "tail", "left", "doc_id", "start"])

    found = parts.groupBy("part").cogroup(marks.groupBy("part")).applyInArrow(places, "window long, tail binary, left int, doc_id long, start long")
    return found.repartition(n, "window").sortWithinPartitions("window", "tail").mapInArrow(passes.occurrences, "group_id long, length long, doc_id long, start long")
