"""Repetition quality rules: rolling hashes of several n-gram lengths over whole texts, in numpy.

A slice of documents is split into words once (Arrow kernels); every word gets a 64-bit code, and the code of an
n-gram is the polynomial ``sum code[i+j] * B**(n-1-j) mod 2**64``, so the codes of length n+1 roll on from those
of length n. For each length, the characters inside n-grams found twice or more in the same text are counted
once each, first occurrences included; likewise for lines. A text is rejected where such a share passes its limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import all_columns, id_text, mix64, runs, slices

BASE_N, MIN_WORDS, BASE_PERCENT = 5, 10, 20
#: n-gram length -> largest share of word characters inside repeated n-grams. Prose repeats short n-grams here and there,
#: so only texts made of them pass the first two; the base rule has rejected most of what the others look for.
LIMITS = {3: 0.75, 4: 0.70, 5: 0.35, 6: 0.34, 7: 0.33, 8: 0.32, 9: 0.31, 10: 0.30}
#: Largest share of a text's characters inside repeated lines, and of symbols for each word.
LINE_LIMIT, SYMBOL_LIMIT = 0.65, 0.30
SYMBOLS = r"[#*$%&|<>]"
MULT = np.uint64(0x9E3779B97F4A7C15)
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, dup_line_chars long, " + ", ".join(f"dup_chars_{n} long" for n in LIMITS)


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """Row of each element, and the elements, without empty ones."""
    rows, values = pc.list_parent_indices(lists), pc.list_flatten(lists)
    full = pc.greater(pc.binary_length(values), 0)
    return np.asarray(rows.filter(full)).astype(np.int64), values.filter(full)


def repeated(rows: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Mask of the elements whose (row, code) is found twice or more."""
    key = mix64(codes + mix64(rows.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key)
    first, count = runs(key[order])
    out = np.zeros(len(key), bool)
    out[order] = np.repeat(count > 1, count)
    return out


def covered(mask: np.ndarray, n: int, total: int) -> np.ndarray:
    """Mask of the words inside the windows of n words that start where mask is set."""
    edge = np.zeros(total + 1, np.int32)
    edge[: len(mask)] += mask
    edge[n : n + len(mask)] -= mask
    return np.cumsum(edge[:total]) > 0


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """All figures of a slice of whole texts, by name."""
    n_docs = len(texts)
    rows, words = _flat(pc.ascii_split_whitespace(texts))
    total = len(words)
    chars = np.asarray(pc.utf8_length(words), dtype=np.int64)
    per = lambda weights, r=rows: np.bincount(r, weights, minlength=n_docs).astype(np.int64)
    out = {"n_words": np.bincount(rows, minlength=n_docs).astype(np.int64), "word_chars": per(chars)}
    out["n_symbols"] = np.asarray(pc.count_substring_regex(texts, SYMBOLS), dtype=np.int64)
    code = mix64(np.asarray(pc.dictionary_encode(words).indices).astype(np.uint64) + np.uint64(0x51ED27)) if total else np.zeros(0, np.uint64)
    rolled = code.copy()
    for n in range(2, max(LIMITS) + 1):
        m = max(0, total - n + 1)
        rolled = rolled[:m] * MULT + code[n - 1 : n - 1 + m]
        if n not in LIMITS and n != BASE_N:
            continue
        inside = rows[:m] == rows[n - 1 : n - 1 + m]
        hit = np.zeros(m, bool)
        hit[inside] = repeated(rows[:m][inside], rolled[inside])
        cover = covered(hit, n, total)
        if n == BASE_N:
            out["n_repeat_words"] = per(cover)
        if n in LIMITS:
            out[f"dup_chars_{n}"] = per(cover * chars)
    lrows, lines = _flat(pc.split_pattern(texts, "\n"))
    worded = pc.match_substring_regex(lines, r"[^\x20\x09-\x0D]")
    lrows, lines = lrows[np.asarray(worded)], lines.filter(worded)
    lcode = np.asarray(pc.dictionary_encode(lines).indices).astype(np.uint64) if len(lines) else np.zeros(0, np.uint64)
    twice = repeated(lrows, lcode)
    kinds = np.unique(lrows[twice].astype(np.uint64) << np.uint64(32) | lcode[twice])
    out["n_dup_lines"] = per(twice, lrows) - np.bincount((kinds >> np.uint64(32)).astype(np.int64), minlength=n_docs)
    out["dup_line_chars"] = per(twice * np.asarray(pc.utf8_length(lines), dtype=np.int64), lrows)
    out["text_chars"] = np.asarray(pc.utf8_length(texts), dtype=np.int64)
    return out


def verdict(x: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    failed = (x["n_words"] < MIN_WORDS) | (100 * x["n_repeat_words"] > BASE_PERCENT * x["n_words"])
    kept = ~failed & (x["dup_line_chars"] <= LINE_LIMIT * x["text_chars"]) & (x["n_symbols"] <= SYMBOL_LIMIT * x["n_words"])
    for n, limit in LIMITS.items():
        kept &= x[f"dup_chars_{n}"] <= limit * x["word_chars"]
    return failed, kept


def assess(docs: DataFrame) -> DataFrame:
    """Word, line and repetition figures of every whole text, and whether it is kept.

    Map only: no shuffle; memory is that of one slice of texts. A null or empty text has no words and fails
    (fewer than ten words). Repeated rows and null ids are assessed one by one; other columns aren't read.
    """
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for part in slices(big):
                x = measure(part.column(1))
                x["base_failed"], x["kept"] = verdict(x)
                yield pa.RecordBatch.from_arrays([part.column(0)] + [pa.array(x[k]) for k in names[1:]], names)

    return id_text(docs).mapInArrow(run, SCHEMA)


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that ``assess`` keeps, with all their columns. Map only: texts aren't exchanged."""
    told = all_columns(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for part in slices(big):
                yield part.filter(pa.array(verdict(measure(part.column(part.schema.get_field_index("text"))))[1]))

    return told.mapInArrow(run, told.schema)
