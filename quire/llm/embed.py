"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products within cells, one kept per group.

Every distinct vector has a home cell, that of its nearest centroid, and is compared in each cell where a partner
could be at home. Let t be the threshold, x at home in cell c, y elsewhere, and cos(x, y) >= t:

* x.(c - c') >= 0 for y's own centroid c', and y is no further from x than sqrt(2 - 2t), so y.(c' - c) / |c' - c| <= sqrt(2 - 2t);
* angles obey the triangle inequality, so the angles of x and y to c differ by acos(t) at most, and so do those to c'.

Both hold for either of the two, whatever the centroids: they only decide how much is compared, and no pair is lost.
Homes are laid into tiles of about TILE vectors: small cells together, large ones in shells by the angle to their centroid. A task has
one tile's homes and a block of the vectors that visit it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import label_column, runs, shuffle_partitions
from .components import Shelf, components

THRESHOLD = 0.95
SAMPLE, SAMPLE_BYTES = 20_000, 32 << 20  # vectors that centroids are fitted on, at most
CELL, MAX_CELLS, ROUNDS = 512, 2048, 8
TILE, VISITORS, BLOCK = 8192, 16_384, 1024
STEPS = 128  # to the radian, in which angles are counted


def unit(vectors: np.ndarray) -> np.ndarray:
    v = np.asarray(vectors, np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # no overflow of the squares
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def kmeans(units: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 11) -> np.ndarray:
    """Unit centroids of unit vectors; a cell that empties takes the vector furthest from its own."""
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(units)))
    centres = units[rng.choice(len(units), k, replace=False)]
    for _ in range(rounds):
        sims = units @ centres.T
        cell, best = sims.argmax(axis=1), sims.max(axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, cell, units)
        norm = np.sqrt((total**2).sum(axis=1))
        empty = np.flatnonzero(norm < 1e-12)
        total[empty] = units[np.argsort(best)[: len(empty)]]
        norm[empty] = 1
        centres = total / norm[:, None]
    return np.unique(centres, axis=0)


class Cells:
    """Centroids of one dimension."""

    def __init__(self, centres: np.ndarray, threshold: float):
        self.centres = centres
        self.reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
        self.angle = math.acos(max(-1.0, min(1.0, threshold))) + 1e-6

    def sims(self, units: np.ndarray) -> np.ndarray:
        return units @ self.centres.T

    def near(self, sims: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Boolean (vectors x cells): on which sides of the bisectors a partner can be; always its own."""
        cells, at = np.unique(own, return_inverse=True)
        gap = np.sqrt(np.maximum(0, 2 - 2 * self.centres[cells] @ self.centres.T))
        out = sims[np.arange(len(own)), own][:, None] - sims <= self.reach * np.maximum(gap, 1e-12)[at]
        out[np.arange(len(own)), own] = True
        return out


def angles(sims: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(sims, -1, 1))


def _binary(df: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, str]:
    """(vec_id, dim, digest, vec) and the kind of number that vec's bytes hold; digest is null where nothing can be linked."""
    kind = "<f4" if dict(df.dtypes)[vec_col] == "array<float>" else "<f8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            dims, digests, vecs = [], [], []
            for i in range(batch.num_rows):
                x = lists[i].values if ids[i].is_valid and lists[i].is_valid else None
                v = None
                if x is not None and len(x) and not x.null_count:
                    v = np.asarray(x).astype(kind) + np.dtype(kind).type(0)  # one zero
                    if not np.isfinite(v).all() or not v.any():
                        v = None
                raw = None if v is None else v.tobytes()
                dims.append(0 if v is None else len(v))
                digests.append(None if raw is None else hashlib.blake2b(raw, digest_size=16).digest())
                vecs.append(raw)
            yield pa.RecordBatch.from_arrays([ids, pa.array(dims, pa.int32()), pa.array(digests, pa.binary()), pa.array(vecs, pa.binary())], ["vec_id", "dim", "digest", "vec"])

    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<float>" if kind == "<f4" else "array<double>").alias("v"))
    return rows.mapInArrow(run, "vec_id long, dim int, digest binary, vec binary"), kind


def stack(raw: pa.Array | list, dim: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(x if isinstance(x, bytes) else x.as_py() for x in raw), kind).reshape(-1, dim)


def fit_cells(distinct: DataFrame, n: int, threshold: float, sample: int, kind: str) -> dict[int, Cells]:
    """Centroids for each dimension, fitted on at most ``sample`` vectors by a hash of their bytes."""
    by_dim: dict[int, list[bytes]] = {}
    for r in distinct.select("dim", "vec").orderBy(F.xxhash64("digest"), "digest").limit(sample).collect():
        by_dim.setdefault(r.dim, []).append(bytes(r.vec))
    k = max(1, min(MAX_CELLS, n // CELL))
    return {d: Cells(kmeans(unit(stack(x, d, kind)), max(1, k * len(x) // min(n, sample))), threshold) for d, x in by_dim.items()}


class Tiles:
    """Which tiles the homes of a cell are in: shells (first tile, how many, least and greatest angle) in the order of their angles."""

    def __init__(self, counts: list[tuple[int, int, int, int]], tile: int):
        """counts: (dim, cell, step of the angle, homes), sorted."""
        self.shells: dict[tuple[int, int], list[tuple[int, int, int, int]]] = {}
        at, room, last_dim = -1, 0, None
        for (dim, cell), held_by in groupby(counts, key=lambda x: x[:2]):
            own = list(held_by)
            low, total = own[0][2], sum(x[3] for x in own)
            if total <= tile:  # a small cell: beside others, where there is room
                if total > room or dim != last_dim:
                    at, room, last_dim = at + 1, tile, dim
                room -= total
                self.shells[dim, cell] = [(at, 1, low, own[-1][2])]
                continue
            out, held = [], 0
            for _, _, step, homes in own:
                if out and held + homes <= tile:
                    first, many, low, _ = out[-1]
                    out[-1], held = (first, many, low, step), held + homes
                else:
                    many = -(-homes // tile)  # one step alone may fill many tiles
                    out.append((at + 1, many, step, step))
                    at, held = at + many, homes if many == 1 else tile
            room, last_dim = 0, None
            self.shells[dim, cell] = out
        self.count = at + 1

    def of(self, dim: int) -> list[tuple[int, int, int, int, int]]:
        """(cell, first tile, how many, least and greatest step) of every shell of a dimension."""
        return [(cell, *shell) for (d, cell), shells in self.shells.items() if d == dim for shell in shells]


def near_duplicates(df: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding", tile: int = TILE, visitors: int = VISITORS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector.

    Vectors link where their cosine in double precision is ``threshold`` or more; equal vectors are compared once.
    Vectors that are null, empty or zero, or hold nulls or numbers that aren't finite, link with nothing, like vectors of
    other dimensions and rows with a null id (whose component_id is null and which aren't kept). Repeated rows are
    vectors of their own with one id, and so are different vectors with one id. An empty table gives no rows.
    """
    spark = df.sparkSession
    shelf, parts = Shelf(spark, "embed"), shuffle_partitions(spark)
    rows, kind = _binary(df, id_col, vec_col)
    own = shelf.keep(rows)
    distinct = own.where("digest IS NOT NULL").groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("dim").alias("dim"), F.first("vec").alias("vec"))
    distinct = shelf.keep(distinct.withColumn("node", F.concat(_sortable(F.col("rep")), "digest")).drop("rep"))  # the least node of a group has its smallest id
    n, widest = distinct.agg(F.count("*"), F.coalesce(F.max("dim"), F.lit(1))).first()
    cells = fit_cells(distinct, n, threshold, max(1, min(SAMPLE, SAMPLE_BYTES // (8 * widest))), kind)
    state = spark.sparkContext.broadcast(cells)  # no more numbers than the sample has

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The home of each vector and its angle there, once and for all: -1 for a dimension that the sample hasn't."""
        for batch in batches:
            dims, cell, step = np.asarray(batch.column(2)), np.full(batch.num_rows, -1, np.int32), np.zeros(batch.num_rows, np.int32)
            for d in np.unique(dims):
                at, c = np.flatnonzero(dims == d), state.value.get(int(d))
                for i in range(0, len(at) if c else 0, BLOCK):
                    part = at[i : i + BLOCK]
                    sims = c.sims(unit(stack(batch.column(3).take(pa.array(part)), int(d), kind)))
                    cell[part] = sims.argmax(axis=1)
                    step[part] = (angles(sims.max(axis=1)) * STEPS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(step)], ["node", "copies", "dim", "vec", "cell", "step"])

    placed = shelf.keep(distinct.select("node", "copies", "dim", "vec").mapInArrow(place, "node binary, copies long, dim int, vec binary, cell int, step int"))
    counts = placed.groupBy("dim", "cell", "step").count().orderBy("dim", "cell", "step")  # as many rows as cells have steps
    tiles = Tiles([tuple(r) for r in counts.collect()], tile)
    blocks, told = max(1, -(-n // visitors)), spark.sparkContext.broadcast(tiles)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row at home (kind 0) for each block of its tile, and a row to compare (kind 1) in its block of each tile that it visits."""
        for batch in batches:
            dims, cells_, steps = (np.asarray(batch.column(i)) for i in (2, 4, 5))
            spread = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u8")[2::3]  # the digests' last bytes
            for d in np.unique(dims).tolist():
                where, c, shells, every = np.flatnonzero(dims == d), state.value.get(d), told.value.of(d), told.value.count
                for i in range(0, len(where), BLOCK):
                    part = where[i : i + BLOCK]
                    if c:
                        sims = c.sims(unit(stack(batch.column(3).take(pa.array(part)), d, kind)))
                        near, angle = c.near(sims, cells_[part]), angles(sims)
                    home, seen = np.zeros(len(part), np.int64), [np.zeros(0, np.int64)]
                    for cell, first, many, low, high in shells:
                        own = np.flatnonzero((cells_[part] == cell) & (low <= steps[part]) & (steps[part] <= high))
                        home[own] = first + (spread[part[own]] >> np.uint64(20)).astype(np.int64) % many
                        to = np.flatnonzero(near[:, cell] & (low / STEPS - c.angle <= angle[:, cell]) & (angle[:, cell] <= (high + 1) / STEPS + c.angle)) if c else np.arange(len(part))
                        seen.append((to[:, None] * every + first + np.arange(many)).ravel())
                    visits = np.unique(np.concatenate(seen))
                    row, to = visits // every, visits % every
                    rows = np.r_[np.repeat(part, blocks), part[row]]
                    task = np.r_[(home[:, None] * blocks + np.arange(blocks)).ravel(), to * blocks + (spread[part[row]] % np.uint64(blocks)).astype(np.int64)]
                    yield batch_of(batch, rows, task, np.repeat([0, 1], [len(part) * blocks, len(row)]))

    def batch_of(batch: pa.RecordBatch, rows: np.ndarray, to: np.ndarray, kinds: np.ndarray) -> pa.RecordBatch:
        taken = batch.take(pa.array(rows, pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array(kinds, pa.int32()), *taken.columns], ["task", "kind", *batch.schema.names])

    dealt = placed.mapInArrow(deal, "task long, kind int, node binary, copies long, dim int, vec binary, cell int, step int")
    dealt = dealt.withColumn("label", label_column(F.pmod(F.col("task"), F.lit(parts)), parts)).repartition(parts, "label").sortWithinPartitions("task", "kind", "cell")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in batches:
            for a, size in zip(*runs(np.asarray(batch.column(0)))):
                if work is None or work.task != batch.column(0)[a].as_py():
                    work = _Tile(batch.column(0)[a].as_py(), state.value, threshold, kind)
                yield from work.add(batch.slice(a, size))

    found = shelf.keep(dealt.drop("label").mapInArrow(compare, "a binary, b binary, n long"))
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    joined = components(found.where("b IS NOT NULL"), shelf)
    classes = distinct.select("digest", "node", "copies").join(counts, "node", "left").join(joined, "node", "left")
    classes = classes.select("digest", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), _number(F.substring(F.coalesce("component", "node"), 1, 8)).alias("component"))
    out = own.select("vec_id", "digest").join(classes, "digest", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def _sortable(x: Column) -> Column:
    """A long as eight bytes that sort as it does."""
    return F.unhex(F.lpad(F.hex(x.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))


def _number(x: Column) -> Column:
    """The long that _sortable took."""
    return (F.conv(F.hex(x), 16, 10).cast("decimal(20,0)") - F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("long")


class _Tile:
    """The homes of a tile, by cell, and the vectors that are compared with them."""

    def __init__(self, task: int, cells: dict[int, Cells], threshold: float, kind: str):
        self.task, self.cells, self.threshold, self.kind = task, cells, threshold, kind
        self.homes: list[tuple] = []
        self.ready = False

    def _columns(self, batch: pa.RecordBatch) -> tuple:
        """unit vectors, home cells, nodes, copies, dimension"""
        dim = batch.column(4)[0].as_py()
        return unit(stack(batch.column(5), dim, self.kind)), np.asarray(batch.column(6)), np.array(batch.column(2).to_pylist(), "V24"), np.asarray(batch.column(3)), dim

    def add(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        split = int((np.asarray(batch.column(1)) == 0).sum())
        if split:
            self.homes.append(self._columns(batch.slice(0, split)))
        if split == batch.num_rows or not self.homes:
            return
        if not self.ready:
            self.units, self.cell, self.node, self.copies = (np.concatenate(x) for x in list(zip(*self.homes))[:4])
            self.group, self.ready, c = np.arange(len(self.cell)), True, self.cells.get(self.homes[0][4])
            if c:
                sims = c.sims(self.units)
                self.near, self.angle = c.near(sims, self.cell), angles(sims)
        for i in range(split, batch.num_rows, BLOCK):
            yield self._compare(*self._columns(batch.slice(i, BLOCK)))

    def _pairs(self, q: np.ndarray, cell: np.ndarray, c: Cells | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(vectors, homes) whose products are needed: those of two cells at a time, less what either's centroid rules out."""
        if c is None:
            yield np.arange(len(q)), np.arange(len(self.cell))
            return
        sims = c.sims(q)
        near, angle = c.near(sims, cell), angles(sims)
        for a, size in zip(*runs(self.cell)):
            home, mine = int(self.cell[a]), slice(a, a + size)
            reach = self.angle[mine, home]
            use = near[:, home] & (angle[:, home] >= reach.min() - c.angle) & (angle[:, home] <= reach.max() + c.angle)
            for f, m in zip(*runs(cell)):
                rows = f + np.flatnonzero(use[f : f + m])
                if len(rows):
                    at, own = int(cell[f]), angle[rows, cell[f]]
                    homes = a + np.flatnonzero(self.near[mine, at] & (self.angle[mine, at] >= own.min() - c.angle) & (self.angle[mine, at] <= own.max() + c.angle))
                    if len(homes):
                        yield rows, homes

    def _compare(self, q: np.ndarray, cell: np.ndarray, ids: np.ndarray, copies: np.ndarray, dim: int) -> pa.RecordBatch:
        count, pairs, linked = np.zeros(len(q), np.int64), [], np.full(len(q), -1, np.int64)
        for rows, homes in self._pairs(q, cell, self.cells.get(dim)):
            r, h = np.nonzero(q[rows] @ self.units[homes].T >= self.threshold)
            r, h = rows[r], homes[h]
            other = ids[r] != self.node[h]
            r, h = r[other], h[other]
            if not len(r):
                continue
            count += np.bincount(r, self.copies[h], minlength=len(q)).astype(np.int64)
            for f, m in zip(*runs(r)):
                x = int(r[f])
                if linked[x] < 0:
                    linked[x] = h[f]
                    pairs.append((ids[x].tobytes(), self.node[h[f]].tobytes()))
                strange = h[f : f + m][self.group[h[f : f + m]] != self.group[linked[x]]]
                for y in strange.tolist():  # two homes that a vector links
                    if self.group[y] != self.group[linked[x]]:
                        pairs.append((self.node[linked[x]].tobytes(), self.node[y].tobytes()))
                        self.group[self.group == self.group[y]] = self.group[linked[x]]
        some = np.flatnonzero(count)
        a, b = [*(p[0] for p in pairs), *(ids[i].tobytes() for i in some)], [*(p[1] for p in pairs)] + [None] * len(some)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array([None] * len(pairs) + count[some].tolist(), pa.int64())], ["a", "b", "n"])
