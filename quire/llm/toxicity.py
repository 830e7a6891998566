"""Toxicity by a factorization machine over hashed terms.

A text is its set of lower-cased terms, hashed to 64 bits. The machine adds the weights of its terms and, for every
pair of terms, the product of their factor vectors, so a pair (an insult with a group mention, say) can count for
more or less than its parts. It is fitted on at most MAX_SAMPLE labelled rows. Of their terms those are in that tell something
of the label alone or beside another one, so what a corpus adds in rare words doesn't blur a score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gather, id_text, runs, slices
from .components import Shelf

#: Labelled rows that a model is fitted on, and their distinct terms in all, at most.
MAX_SAMPLE, MAX_TERMS = 16_384, 8 << 20
#: Chosen by recall at THRESHOLD on a quarter of the training rows, after fitting on the others.
FACTORS, EPOCHS, BATCH, RATE, SLOWER, DECAY = 8, 60, 256, 0.3, 0.2, 3e-6
MIN_ROWS, MIN_Z = 5, 3.5
ANCHOR_SHARE, PAIR_ROWS, MIN_PAIR_Z = 0.05, 20, 8.0
THRESHOLD = 0.3
TERM = re.compile(r"\w+")


def terms(text: str) -> np.ndarray:
    """Distinct hashed terms of a whole text, sorted."""
    digest = xxhash.xxh64_intdigest
    return np.sort(np.array([digest(t) for t in set(TERM.findall(text.lower()))], np.uint64))


class FactorizationMachine:
    """score = sigmoid(bias + sum w_i + sum_{i<j} <v_i, v_j>) over the known terms of a text."""

    def __init__(self, known: np.ndarray, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.known, self.bias, self.weights, self.factors = known, bias, weights, factors

    def places(self, hashed: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.known, hashed), len(self.known) - 1)
        return at[self.known[at] == hashed]

    def logit(self, places: np.ndarray) -> float:
        v = self.factors[places]
        return self.bias + self.weights[places].sum() + 0.5 * float((v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum())

    def score(self, hashed: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(self.places(hashed)), -30, 30))))

    @classmethod
    def fit(cls, rows: list[np.ndarray], y: np.ndarray, seed: int = 7, epochs: int = EPOCHS, rate: float = RATE, decay: float = DECAY) -> FactorizationMachine:
        """AdaGrad on the logistic loss with decay; rows are the hashed terms of texts. The terms that ``telling`` finds are in."""
        y = np.asarray(y, np.float64)
        n, n1 = len(y), float(y.sum())
        prior = float(np.log((n1 + 1) / (n - n1 + 1)))
        if not n1 or n1 == n:
            return cls(np.zeros(0, np.uint64), prior, np.zeros(0), np.zeros((0, FACTORS)))
        model = cls(telling(rows, y > 0), prior, np.zeros(0), np.zeros(0))
        d, rng = len(model.known), np.random.default_rng(seed)
        w, v, bias = np.zeros(d), rng.normal(0, 0.01, (d, FACTORS)), prior
        g_w, g_v, g_b = np.full(d, 1e-6), np.full((d, FACTORS), 1e-6), 1e-6
        order = rng.permutation(n)
        batches = [_Batch([model.places(rows[k]) for k in order[i : i + BATCH]], y[order[i : i + BATCH]]) for i in range(0, n, BATCH)]
        for _ in range(epochs):
            for k in rng.permutation(len(batches)):
                b = batches[k]
                own = v[b.terms]
                total = b.by_row(own[b.at])
                logit = bias + b.by_row(w[b.terms][b.at]) + 0.5 * ((total**2).sum(axis=1) - b.by_row((own**2).sum(axis=1)[b.at]))
                err = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - b.y) / len(b.y)
                each = err[b.row]
                dw = b.by_term(each)
                dv = b.by_term(each[:, None] * total[b.row]) - dw[:, None] * own
                dw, dv, db = dw + decay * w[b.terms], dv + decay * own, err.sum()
                g_w[b.terms] += dw**2
                g_v[b.terms] += dv**2
                g_b += db**2
                w[b.terms] -= rate * dw / np.sqrt(g_w[b.terms])
                v[b.terms] -= rate * SLOWER * dv / np.sqrt(g_v[b.terms])
                bias -= rate * db / np.sqrt(g_b)
        model.weights, model.factors, model.bias = w, v, float(bias)
        return model


def z_scores(ones: np.ndarray, zeros: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """How far the shares of terms in n1 rows of label 1 and n0 of label 0 are apart, in standard deviations."""
    share = (ones + zeros) / (n1 + n0)
    return (ones / n1 - zeros / n0) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n1 + 1 / n0))


def telling(rows: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """The terms that tell something of the label, alone or beside another term, sorted.

    Alone: a term of MIN_ROWS rows whose share differs between the labels by MIN_Z. In a pair: two terms, one of which (the anchor)
    ANCHOR_SHARE of all rows have and which PAIR_ROWS rows have together, where what one tells beside the other and what it tells
    without it are MIN_PAIR_Z apart. So an insult and a group mention that are each as common in clean texts are found by their pair.
    """
    n, n1 = len(rows), int(toxic.sum())
    row = np.repeat(np.arange(n, dtype=np.int32), [len(r) for r in rows])
    vocab, term, count = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    often = count >= MIN_ROWS
    keep = often[term]
    row, term = row[keep], (np.cumsum(often) - 1)[term[keep]].astype(np.int32)
    vocab, count, d = vocab[often], count[often].astype(np.float64), int(often.sum())
    ones = np.bincount(term[toxic[row]], minlength=d).astype(np.float64)
    found = np.abs(z_scores(ones, count - ones, n1, n - n1)) >= MIN_Z
    begin = np.searchsorted(row, np.arange(n + 1))
    order = np.argsort(term, kind="stable")
    bounds = np.searchsorted(term[order], np.arange(d + 1))
    for a in np.flatnonzero((count >= ANCHOR_SHARE * n) & (count <= (1 - ANCHOR_SHARE) * n)).tolist():
        of = row[order[bounds[a] : bounds[a + 1]]]  # the rows that have the anchor
        with1, without1 = float(toxic[of].sum()), n1 - float(toxic[of].sum())
        with0, without0 = len(of) - with1, n - n1 - len(of) + with1
        if min(with1, with0, without1, without0) < MIN_ROWS:
            continue
        beside = lambda which: np.bincount(term[gather(begin[which], begin[which + 1] - begin[which])], minlength=d).astype(np.float64)
        both1 = beside(of[toxic[of]])
        both = both1 + beside(of[~toxic[of]])
        near = z_scores(both1, both - both1, with1, with0)
        far = z_scores(ones - both1, count - both - ones + both1, without1, without0)
        expected = count * len(of) / n  # two terms that avoid each other tell as much as two that meet
        hit = (np.maximum(both, expected) >= PAIR_ROWS) & (np.abs(near - far) >= MIN_PAIR_Z * np.sqrt(2))
        hit[a] = False
        if hit.any():
            found |= hit
            found[a] = True
    return vocab[found]


class _Batch:
    """The known terms of some rows: which, and the order in which a term's rows lie together."""

    def __init__(self, places: list[np.ndarray], y: np.ndarray):
        self.y = y
        self.terms, at = np.unique(np.concatenate(places), return_inverse=True)
        self.at = at.astype(np.int32)
        self.row = np.repeat(np.arange(len(places), dtype=np.int32), [len(p) for p in places])
        self.order = np.argsort(self.at, kind="stable").astype(np.int32)
        self.first = np.searchsorted(self.at[self.order], np.arange(len(self.terms)))
        self.full, self.row_first = runs_of(self.row)

    def by_row(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.y), *x.shape[1:]))
        if len(x):
            out[self.full] = np.add.reduceat(x, self.row_first)
        return out

    def by_term(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x[self.order], self.first) if len(x) else x[:0]


def runs_of(sorted_rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows there are, and where each begins."""
    first, _ = runs(sorted_rows)
    return sorted_rows[first], first


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_sample: int = MAX_SAMPLE) -> FactorizationMachine:
    """Fitted on labelled documents that aren't held out: all of them, or as many by a hash of their ids as ``max_sample`` rows and
    MAX_TERMS terms allow (a row that doesn't fit is passed over).

    A document labelled more than once is toxic if one label says so; null labels and ids are left out, and repeated rows count once.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic")).where(~held_out())
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for part in slices(big):
                own = [terms(t).tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(own, pa.binary())], ["doc_id", "toxic", "terms"])

    texts = id_text(docs).join(F.broadcast(sample), "doc_id")  # at most max_sample ids
    got = texts.select("doc_id", "text", F.col("toxic").cast("long")).mapInArrow(run, "doc_id long, toxic long, terms binary")
    shelf = Shelf(docs.sparkSession, "toxicity")
    told = shelf.keep(got.dropDuplicates(["doc_id", "terms"]).withColumn("key", F.xxhash64("doc_id", "terms")))
    left, chosen = MAX_TERMS, []
    for r in told.select("doc_id", "key", F.length("terms").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id", "key").limit(max_sample).collect():
        if r.n // 8 <= left:
            left -= r.n // 8
            chosen.append((r.doc_id, r.key))
    wanted = docs.sparkSession.createDataFrame(chosen, "doc_id long, key long")
    rows = sorted((r.doc_id, r.key, r.toxic, bytes(r.terms)) for r in told.join(F.broadcast(wanted), ["doc_id", "key"]).toLocalIterator())
    shelf.drop(told)
    return FactorizationMachine.fit([np.frombuffer(t, np.uint64) for *_, t in rows], np.array([min(1, max(0, y)) for _, _, y, _ in rows]))


def score(docs: DataFrame, model: FactorizationMachine, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text, by its terms alone.

    A null or empty text, or one without known terms, has the score of the bias. Map only. A null id isn't held out.
    """
    state = docs.sparkSession.sparkContext.broadcast(model)  # its terms are bounded by those of the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = state.value
        for big in batches:
            for part in slices(big):
                own = [machine.score(terms(t)) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own, pa.float64())], ["doc_id", "score"])

    found = id_text(docs).mapInArrow(run, "doc_id long, score double")
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
