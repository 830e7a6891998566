"""BPE encoding and decoding over a table of distinct words.

One pass splits texts into the words that the tokenizer's merges never cross, and deals out two kinds of rows in a
single exchange: the distinct words of a *block* of texts (by a hash of the word, so that each distinct word of the
corpus meets itself in one bucket and is encoded once there), and the block's texts as positions in its own list of
words. Buckets send the ids of its words back to each block, where they are joined by position.
A block is a bounded amount of text, the same whenever its task runs; decoding joins ids to the vocabulary's pieces, word by word.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import gather, id_text, labels, shuffle_partitions
from .suffix import squeeze, unsqueeze

VOCABULARY = "word_bpe_49k.json"
BLOCK_BYTES = 24 << 20
#: Buckets of words, at most: a block sends a row to each, so rows grow with the blocks alone.
MAX_BUCKETS = 4096
WORDS, TEXTS = 0, 1
ROWS = "label int, block long, kind int, body binary"

#: The split of the vocabulary file's pre-tokenizer; checked against the file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Texts of these characters only are their own normal form but for case, and split alike in every library.
_PLAIN = re.compile(r"[\x20-\x7E\n\t¡-ſ–-…€]*")


class Splitter:
    """Texts into words, exactly as the tokenizer's normalizer and pre-tokenizer do; special tokens stand alone."""

    def __init__(self, path: str):
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path) as f:
            spec = json.load(f)
        own = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.find = regex.compile(PATTERN).findall if own == PATTERN else None
        self.exact = pre_tokenizers.Split(Regex(own), "removed", invert=True)
        specials = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("(" + "|".join(map(re.escape, specials)) + ")") if specials else None

    def words(self, text: str) -> list[str]:
        if "<|" in text and self.special and len(parts := self.special.split(text)) > 1:
            return [w for i, p in enumerate(parts) for w in ([p] if i % 2 else self._words(p))]
        return self._words(text)

    def _words(self, text: str) -> list[str]:
        if self.find and _PLAIN.fullmatch(text):
            return self.find(text.lower())
        return [w for w, _ in self.exact.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text))] if text else []


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = zip(*rows) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int32(), pa.binary()))], ["label", "block", "kind", "body"])


class Coder:
    def __init__(self, path: str, n: int):
        self.path, self.n, self.label = path, n, labels(n)
        self.buckets = min(n, MAX_BUCKETS)

    def split(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of both kinds for every block of texts. Texts come sorted, so a task that runs again makes the same blocks."""
        splitter, count = Splitter(self.path), 0
        ids: dict[str, int] = {}
        docs: list[int | None] = []
        sizes: list[int] = []
        places: list[np.ndarray] = []
        total = 0

        def close() -> pa.RecordBatch:
            block = (TaskContext.get().partitionId() << 24) + count
            home = self.label[(TaskContext.get().partitionId() + count * 7919) % self.n]  # neighbours on parts of their own
            words = list(ids)
            bucket = np.array([xxhash.xxh64_intdigest(w.encode(), 3) % self.buckets for w in words], np.int64)
            order = np.argsort(bucket, kind="stable")
            bounds = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
            rows = [(home, block, TEXTS, zstandard.ZstdCompressor(level=3).compress(self._texts(docs, sizes, places)))]
            for b in range(self.buckets):
                own = order[bounds[b] : bounds[b + 1]]
                if len(own):
                    rows.append((self.label[b * self.n // self.buckets], block, WORDS, squeeze(np.array([home], np.int32), own.astype(np.uint32), "\n".join(words[i] for i in own).encode())))
            return _batch(rows)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = splitter.words(text)
                places.append(np.array([ids.setdefault(w, len(ids)) for w in own], np.uint32))
                docs.append(doc)
                sizes.append(len(own))
                total += len(text)
                if total >= BLOCK_BYTES:
                    yield close()
                    count, total, ids, docs, sizes, places = count + 1, 0, {}, [], [], []
        if docs:
            yield close()

    @staticmethod
    def _texts(docs: list, sizes: list, places: list) -> bytes:
        null = np.array([d is None for d in docs], np.uint8)
        flat = np.concatenate(places)
        planes = flat.view(np.uint8).reshape(-1, 4).T.tobytes()  # byte planes: the high ones are almost empty
        head = np.array([len(docs), len(flat)], np.int64).tobytes()
        return head + np.array([d or 0 for d in docs], np.int64).tobytes() + null.tobytes() + np.array(sizes, np.int64).tobytes() + planes

    def encode(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each distinct word of a bucket once; its ids to every block that has it."""
        table: dict[str, int] = {}
        asked: list[tuple[int, int, bytes, np.ndarray]] = []
        for batch in batches:
            for block, kind, body in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                if kind == WORDS:
                    home, places, words = unsqueeze(body)
                    at = np.array([table.setdefault(w, len(table)) for w in words.decode().split("\n")], np.int64)
                    asked.append((int(np.frombuffer(home, np.int32)[0]), block, places, at))
        if not asked:
            return
        tokenizer, words = Splitter(self.path).tokenizer, list(table)
        size, flat = np.empty(len(words), np.int64), []
        for i in range(0, len(words), 20_000):
            for j, e in enumerate(tokenizer.encode_batch_fast(words[i : i + 20_000], add_special_tokens=False)):
                size[i + j] = len(e.ids)
                flat.append(np.array(e.ids, np.uint32))
        flat, begin = np.concatenate(flat), np.cumsum(size) - size
        for home, block, places, at in asked:
            n = size[at]
            yield _batch([(home, block, WORDS, squeeze(places, n.astype(np.uint32), flat[gather(begin[at], n)].astype(np.uint32)))])

    def finish(self, held: pa.Table, answers: pa.Table) -> Iterator[tuple]:
        """(doc_id, ids, decoded text) of every text of the blocks of one label."""
        pieces = self.pieces()
        own: dict[int, list[bytes]] = {}
        for block, body in zip(answers.column("block").to_pylist(), answers.column("body").to_pylist()):
            own.setdefault(block, []).append(body)
        for i in range(held.num_rows):
            if held.column("kind")[i].as_py() != TEXTS:
                continue
            raw = zstandard.ZstdDecompressor().decompress(held.column("body")[i].as_py())
            n, m = np.frombuffer(raw, np.int64, 2)
            docs, null = np.frombuffer(raw, np.int64, n, 16), np.frombuffer(raw, np.uint8, n, 16 + 8 * n)
            sizes = np.frombuffer(raw, np.int64, n, 16 + 9 * n)
            flat = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * m, 16 + 17 * n).reshape(4, -1).T).view(np.uint32)[:, 0]
            got = [[np.frombuffer(x, np.uint32) for x in unsqueeze(b)] for b in own.pop(held.column("block")[i].as_py(), [])]
            place, count, ids = (np.concatenate(x) for x in zip(*got)) if got else (np.zeros(0, np.uint32),) * 3
            begin, length = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
            begin[place], length[place] = np.cumsum(count, dtype=np.int64) - count, count
            spelt = np.empty(len(place), object)
            for w, (a, c) in enumerate(zip(begin.tolist(), length.tolist())):
                spelt[w] = " ".join(pieces[x] for x in ids[a : a + c].tolist())
            at = 0
            for d, z, s in zip(docs.tolist(), null.tolist(), sizes.tolist()):
                words = flat[at : at + s]
                at += s
                n_ids = length[words]
                text = " ".join(x for x in spelt[words] if x)
                yield None if z else d, ids[gather(begin[words], n_ids)].astype("<u4"), text

    def pieces(self) -> list[str]:
        """The vocabulary by id: as many entries as it has, whatever the input."""
        with open(self.path) as f:
            spec = json.load(f)
        by_id = {i: p for p, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        return [by_id.get(i, "") for i in range(max(by_id) + 1)]


def _coded(docs: DataFrame, vocabulary: str | None, schema: str, row) -> DataFrame:
    n = shuffle_partitions(docs.sparkSession)
    coder = Coder(vocabulary or public_tokenizers.path(VOCABULARY), n)
    dealt = id_text(docs).sortWithinPartitions("doc_id", "text").mapInArrow(coder.split, ROWS).repartition(n, "label")
    answers = dealt.mapInArrow(coder.encode, ROWS)
    names, types = zip(*(x.split() for x in schema.split(", ")))
    arrow = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}

    def finish(held: pa.Table, own: pa.Table) -> pa.Table:
        rows = [row(*x) for x in coder.finish(held, own)]
        cols = zip(*rows) if rows else [()] * len(names)
        return pa.table([pa.array(c, arrow[t]) for c, t in zip(cols, types)], names=list(names))

    return dealt.groupBy("label").cogroup(answers.groupBy("label")).applyInArrow(finish, schema)


def encode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded): token ids as ``tokenizers`` gives them without special tokens added, and their decoded text.

    A null or empty text has no ids and decodes to the empty string. Null ids and repeated rows each come back;
    an empty table gives no rows.
    """
    return _coded(docs, vocabulary, "doc_id long, ids array<int>, decoded string", lambda d, ids, text: (d, ids.astype(np.int32), text))


def digest(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of ``encode``, digested where the ids are joined."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _coded(docs, vocabulary, schema, lambda d, ids, text: (d, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
