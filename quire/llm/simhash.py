"""SimHash near-duplicates through BK-trees.

Fingerprints within ``radius`` bits agree on whole blocks of bits, so distinct fingerprints are sharded by every
choice of blocks that must agree; a shard's fingerprints go into a BK-tree, whose children hang on integer
Hamming distances to their parent, and a search follows only the edges within the radius of its own
distance. A shard of more than TILE fingerprints is cut into tiles: each pair of tiles is a task of its own, one's
tree searched with the other's fingerprints. Tasks give the links that join what they hold (a spanning forest).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, shuffle_partitions, slices
from .components import Shelf, components

RADIUS, SHINGLE, SEED = 3, 3, 42
TILE = 4096
#: (blocks, blocks that agree): the least key bits for so many distinct fingerprints; all are exact.
SCHEMES = ((4_000_000, 4), (1_000_000_000, 5), (1 << 62, 6))


# ---- fingerprints --------------------------------------------------------------------------------------------


def shingle_hashes(text: str, size: int = SHINGLE) -> list[int]:
    words = text.encode().lower().split()  # bytes: A-Z only, and only \x20 \x09-\x0D part words
    if not words:
        return []
    grams = map(b" ".join, zip(*(words[i:] for i in range(size)))) if len(words) >= size else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return [digest(g, SEED) for g in grams]


def fingerprints_of(hashes: list[list[int]]) -> np.ndarray:
    """For each list, bit i is set if more than half its hashes have it; no hashes give 0."""
    out = np.zeros(len(hashes), np.uint64)
    sizes = np.array([len(h) for h in hashes], np.int64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    flat = np.fromiter((x for h in hashes for x in h), np.uint64, int(sizes.sum()))
    ends = np.cumsum(sizes[full])
    votes = np.empty((len(full), 64), np.int64)
    begins = ends - sizes[full]
    for k, (a, b) in enumerate(zip(begins, ends)):
        total = np.zeros(64, np.int64)
        for at in range(a, b, 1 << 16):
            total += np.unpackbits(flat[at : min(b, at + (1 << 16))].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        votes[k] = total
    bits = (2 * votes > sizes[full, None]).astype(np.uint8)
    out[full] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the 64-bit fingerprint of every whole text, as a signed long. Map only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for part in slices(big):
                fp = fingerprints_of([shingle_hashes(t) for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return id_text(docs).mapInArrow(run, "doc_id long, fp long")


# ---- trees ---------------------------------------------------------------------------------------------------


class BKTree:
    """Children by their Hamming distance to the parent. Values are distinct."""

    def __init__(self, values: list[int]):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []
        for v in values:
            self.add(v)

    def add(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        new, at = len(self.values) - 1, 0
        while at != new:
            at = self.children[at].setdefault((self.values[at] ^ value).bit_count(), new)

    def near(self, value: int, radius: int) -> list[int]:
        """Places of the values within radius."""
        out, stack = [], [0] if self.values else []
        while stack:
            at = stack.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                out.append(at)
            kids = self.children[at]
            if len(kids) <= 2 * radius + 1:
                stack += [k for e, k in kids.items() if -radius <= d - e <= radius]
            else:
                stack += [kids[e] for e in range(d - radius, d + radius + 1) if e in kids]
        return out

    def near_all(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(place, queries within radius of it), all queries moving down the tree together."""
        stack = [(0, np.arange(len(queries)))] if self.values and len(queries) else []
        while stack:
            at, live = stack.pop()
            d = np.bitwise_count(queries[live] ^ np.uint64(self.values[at])).astype(np.int64)
            hit = live[d <= radius]
            if len(hit):
                yield at, hit
            for e, kid in self.children[at].items():
                go = live[np.abs(d - e) <= radius]
                if len(go):
                    stack.append((kid, go))


def forest(fps: np.ndarray, tree_rows: np.ndarray, query_rows: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links (row, row) that join all rows whose fingerprints are linked, found in the tree of some by the others."""
    label, out = np.arange(len(fps)), []
    if len(tree_rows) <= 48 and len(query_rows) <= 48:
        tree = BKTree([int(fps[r]) for r in tree_rows])
        pairs = ((at, np.array([i])) for i, r in enumerate(query_rows) for at in tree.near(int(fps[r]), radius))
    else:
        pairs = BKTree([int(fps[r]) for r in tree_rows]).near_all(fps[query_rows], radius)
    for at, hit in pairs:
        row, others = tree_rows[at], query_rows[hit]
        strange = others[label[others] != label[row]]
        for r in strange:
            if label[r] != label[row]:
                out.append((int(row), int(r)))
                label[label == label[r]] = label[row]
    return out


# ---- links ---------------------------------------------------------------------------------------------------


def shard_keys(blocks: int, radius: int) -> list[int]:
    """A mask for each choice of blocks - radius blocks of the 64 bits."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    return [sum(masks[i] for i in c) for c in combinations(range(blocks), blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(distinct: DataFrame, n_distinct: int, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(a, b): reps of distinct fingerprints (fp, rep) linked directly; enough of them to join all that are linked."""
    spark = distinct.sparkSession
    blocks = max(radius + 1, next(b for top, b in SCHEMES if n_distinct <= top))
    masks = shard_keys(blocks, radius)
    shards = distinct.select("fp", "rep", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks))).alias("choice", "value"))
    large = shards.groupBy("choice", "value").count().where(F.col("count") > tile).select("choice", "value", F.ceil(F.col("count") / tile).cast("int").alias("tiles"))
    tiled = shards.join(large, ["choice", "value"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    own = tiled.withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = own.select("choice", "value", F.least("tile", "with").alias("i"), F.greatest("tile", "with").alias("j"), "tile", "fp", "rep")
    n = shuffle_partitions(spark)
    key = ["choice", "value", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(cols: list[np.ndarray]) -> list[tuple[int, int]]:
            fps, tiles, reps = cols[5].view(np.uint64), cols[4], cols[6]
            rows = np.arange(len(fps))
            a, b = (rows, rows) if cols[2][0] == cols[3][0] else (rows[tiles == cols[2][0]], rows[tiles == cols[3][0]])
            return [(int(reps[x]), int(reps[y])) for x, y in forest(fps, a, b, radius)]

        held: list[np.ndarray] | None = None
        for batch in batches:
            cols = [np.asarray(c) for c in batch.columns]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            change = np.zeros(len(cols[0]), bool)
            change[:1] = True
            for c in cols[:4]:
                change[1:] |= c[1:] != c[:-1]
            first = np.flatnonzero(change)
            if not len(first):
                continue
            last = first[-1]
            size = np.diff(first)
            out = [p for f, s in zip(first[:-1][size > 1], size[size > 1]) for p in solve([c[f : f + s] for c in cols])]
            held = [c[last:] for c in cols]
            yield _pairs(out)
        if held is not None and len(held[0]) > 1:
            yield _pairs(solve(held))

    return dealt.repartition(n, *key).sortWithinPartitions(*key).mapInArrow(run, "a long, b long")


def _pairs(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id reachable by links of fingerprints within ``radius`` bits.

    Texts without words, and null texts, have fingerprint 0 and are linked like others. Rows with a null id
    have a fingerprint but are linked with nothing: their component_id is null. Repeated rows each come back.
    An empty table gives no rows. Copies share a fingerprint, so only distinct fingerprints are searched.
    """
    shelf = Shelf(docs.sparkSession, "simhash")
    own = shelf.keep(fingerprints(docs))
    distinct = shelf.keep(own.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = components(links(distinct, distinct.count(), radius), shelf)
    classes = distinct.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return own.join(classes, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One document of each group (the one with the smallest id), with all its columns; documents without an id all stay.

    Rows that repeat an id and its text are one document. Only ids are joined to the documents' rows.
    """
    found = near_duplicates(docs, radius)
    dropped = found.where("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(dropped, "doc_id", "left_anti").select(docs.columns)
    twice = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if twice.isEmpty():
        return kept
    once = kept.join(twice, "doc_id", "left_anti").select(docs.columns)
    return once.unionByName(kept.join(twice, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id", "text"]))
