"""Harmonic packing of token ids into sequences of a fixed capacity.

The piece lengths of a document are cut to *reciprocal-capacity classes*: class k takes pieces of
exactly capacity/k ids (k = 1, 2, 4, ..., 32) and closes a bin after k pieces, so a full bin of these
classes has no padding at all. What is left of a document (fewer than capacity/32 ids) is a piece of
the class k = capacity // length, whose bins close after k pieces. Every worker fills the bins of each
class alone, without seeing any other worker; its unfinished bins are laid together, largest pieces
first, when its input ends.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import id_text, slices

CAPACITY = 1024
SMALLEST_SHARE = 32
VOCABULARY = "byte_bpe_50k.json"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_length long"

#: Texts with other characters, or with what may be a special token, go to the tokenizers library itself.
_PLAIN = re.compile(r"[\x20-\x7E\n\t¡-ſ–-…€]*")


class ByteBpe:
    """Ids exactly as ``tokenizers`` gives them; plain Latin text takes the quicker encoder of the same vocabulary."""

    def __init__(self, path: str, ranks_path: str | None = None, specials: tuple[str, ...] = ("<|",)):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.exact = Tokenizer.from_file(path)
        self.exact.no_truncation()
        self.exact.no_padding()
        self.quick, self.specials = None, specials
        if ranks_path and os.path.exists(ranks_path):
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.quick = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if self.quick and not any(s in text for s in self.specials) and _PLAIN.fullmatch(text):
            return self.quick.encode_ordinary(text)
        return self.exact.encode(text, add_special_tokens=False).ids


def shares(n: int, capacity: int = CAPACITY, smallest: int = SMALLEST_SHARE) -> list[int]:
    """Lengths of the pieces of a document of n ids: whole capacities, then capacity/2, /4, ... and the rest."""
    out = [capacity] * (n // capacity)
    rest, k = n % capacity, 2
    while k <= smallest:
        if rest >= capacity // k:
            out.append(capacity // k)
            rest -= capacity // k
        k *= 2
    return out + [rest] * (rest > 0)


class HarmonicBins:
    """The open bin of every class of one worker."""

    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.next_id = capacity, first_id
        self.open: dict[int, list] = {}

    def add(self, piece: tuple) -> list[tuple[int, list]]:
        """piece = (length, ...); returns the bins that it closes."""
        k = self.capacity // piece[0]
        held = self.open.setdefault(k, [])
        held.append(piece)
        return [self._close(self.open.pop(k))] if len(held) == k else []

    def _close(self, pieces: list) -> tuple[int, list]:
        self.next_id += 1
        return self.next_id - 1, pieces

    def flush(self) -> Iterator[tuple[int, list]]:
        """Unfinished bins together, largest pieces first, each into the open sequence or a new one."""
        left = sorted((p for held in self.open.values() for p in held), key=lambda p: -p[0])
        self.open, held, used = {}, [], 0
        for p in left:
            if used + p[0] > self.capacity:
                yield self._close(held)
                held, used = [], 0
            held.append(p)
            used += p[0]
        if held:
            yield self._close(held)


def padded(n: int, capacity: int = CAPACITY) -> int:
    return n if n & (n - 1) == 0 else capacity


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece of a document, with its place in a sequence; ``with_ids`` adds its token ids.

    Every document (null or empty text too) has its ids followed by ``end_id``, so it has a piece at least.
    Repeated rows and null ids are documents of their own. An empty table gives an empty result. Columns
    other than doc_id and text are not read. ``capacity`` is a power of two of 32 or more.
    """
    if capacity < SMALLEST_SHARE or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two of at least 32")
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken") if vocabulary is None else None
    names = [x.split()[0] for x in SCHEMA.split(",")]
    types = [pa.int64()] * len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(path, ranks)
        bins = HarmonicBins(capacity, TaskContext.get().partitionId() << 40)
        rows: list[tuple] = []
        ids_out: list[np.ndarray] = []

        def put(closed: tuple[int, list]) -> None:
            sequence, pieces = closed
            at, whole = 0, padded(sum(p[0] for p in pieces), capacity)
            for n, doc, start, crc, total, ids in pieces:
                rows.append((doc, start, n, crc, total, sequence, at, whole))
                if with_ids:
                    ids_out.append(ids)
                at += n

        def batch() -> pa.RecordBatch:
            cols = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(names), types)]
            if with_ids:
                offsets = np.r_[0, np.cumsum([len(x) for x in ids_out])].astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids_out or [np.zeros(0, np.uint32)]).astype(np.int32))))
            rows.clear()
            ids_out.clear()
            return pa.RecordBatch.from_arrays(cols, names + ["ids"] * with_ids)

        for big in batches:
            for part in slices(big):
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = np.asarray([*bpe.encode(text), end_id], dtype="<u4")
                    start = 0
                    for n in shares(len(ids), capacity):
                        own = ids[start : start + n]
                        for closed in bins.add((n, doc, start, zlib.crc32(own.tobytes()), len(ids), own if with_ids else None)):
                            put(closed)
                        start += n
                if len(rows) > 20_000:
                    yield batch()
        for closed in bins.flush():
            put(closed)
        yield batch()

    return id_text(docs).mapInArrow(run, SCHEMA + ", ids array<int>" * with_ids)
