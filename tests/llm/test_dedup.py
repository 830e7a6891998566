"""Operators across documents, against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import embed, simhash, suffix
from quire.llm.components import Shelf, components


def union(n, pairs):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return [root(i) for i in range(n)]


@pytest.mark.parametrize("links", [[], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)], [(9, i) for i in range(1, 9)] + [(20, 21), (21, 20), (22, 20)]])
def test_components(spark, links):
    df = spark.createDataFrame(links + [(None, 3)], "a long, b long")
    got = {r.node: r.component for r in components(df, Shelf(spark, "t")).collect()}
    want = union(50, links)
    assert got == {i: want[i] for e in links if e[0] != e[1] for i in e}


def test_components_random(spark):
    rng = random.Random(5)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(350)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), Shelf(spark, "t")).collect()}
    want = union(400, links)
    assert all(got[i] == want[i] for i in got)


# ---- simhash


def plain_fingerprint(text):
    w = text.encode().lower().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@given(st.lists(st.text(alphabet="aB é\n", max_size=40), min_size=1, max_size=6))
@settings(deadline=None)
def test_fingerprints(texts):
    assert simhash.fingerprints_of([simhash.shingle_hashes(t) for t in texts]).tolist() == [plain_fingerprint(t) for t in texts]


@given(st.lists(st.integers(0, 255), unique=True, min_size=1, max_size=60), st.integers(0, 255), st.integers(0, 4))
def test_bk_tree(values, query, radius):
    tree = simhash.BKTree(values)
    near = {v for v in values if (v ^ query).bit_count() <= radius}
    assert {tree.values[i] for i in tree.near(query, radius)} == near
    assert {tree.values[i] for i, _ in tree.near_all(np.array([query], np.uint64), radius)} == near


@pytest.mark.parametrize("tile, blocks", [(4096, None), (8, None), (8, 5), (16, 6)])
def test_links(spark, tile, blocks, monkeypatch):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(25)]
    fps = list({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5))) & (1 << 64) - 1 for b in base for _ in range(12)})
    if blocks:
        monkeypatch.setattr(simhash, "SCHEMES", ((1 << 62, blocks),))
    df = spark.createDataFrame([(simhash._signed(f), i) for i, f in enumerate(fps)], "fp long, rep long")
    pairs = [(r.a, r.b) for r in simhash.links(df, len(fps), tile=tile).collect()]
    true = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    assert all((fps[a] ^ fps[b]).bit_count() <= 3 for a, b in pairs) and union(len(fps), pairs) == union(len(fps), true)


def test_near_duplicates(spark, make_docs, edge_docs):
    words = [f"w{i}" for i in range(400)]
    near = " ".join(words[:200] + ["other"] + words[201:])
    texts = [" ".join(words), near, " ".join(words), "quite another text of its own words", None, "", " ".join(reversed(words))]
    got = simhash.near_duplicates(make_docs(texts)).collect()
    fps = [plain_fingerprint(t or "") for t in texts]
    want = union(len(texts), [(i, j) for i in range(7) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    assert {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in got} == {i: (fps[i], want[i]) for i in range(7)} and want[2] == 0 and want[5] == 4
    kept = simhash.keep_one(make_docs(texts)).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(want))
    edge = simhash.near_duplicates(edge_docs).collect()
    assert len(edge) == 8 and {r.component_id for r in edge if r.doc_id is None} == {None} and {r.component_id for r in edge if r.doc_id in (1, 2, 3)} == {1}
    once = simhash.keep_one(edge_docs)
    assert once.columns == edge_docs.columns and sorted(str(r.doc_id) for r in once.collect()) == ["1", "4", "7", "8", "None"]
    assert simhash.near_duplicates(edge_docs.limit(0)).count() == 0


# ---- repeated passages


def plain_removal(rows, m=50):
    """(id, text) -> masks; ids None come last."""
    least = {}
    raw = [((d if d is not None else suffix.NO_ID), (t or "").encode()) for d, t in rows]
    for d, b in raw:
        for i in range(len(b) - m + 1):
            s = b[i : i + m]
            least[s] = min(d, least.get(s, d))
    out = []
    for d, b in raw:
        mask = np.zeros(len(b), bool)
        for i in range(len(b) - m + 1):
            if least[b[i : i + m]] < d:
                mask[i : i + m] = True
        out.append(mask)
    return out


def expect(rows):
    out = []
    for (d, t), mask in zip(rows, plain_removal(rows)):
        b = (t or "").encode()
        spans = int((np.diff(np.r_[0, mask.astype(int)]) == 1).sum())
        out.append((str(d), len(b), int(mask.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~mask].tobytes()).hexdigest()))
    return sorted(out)


def removed(df):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.remove_repeats(df).collect())


def mixed_texts(seed, n=40):
    rng = random.Random(seed)
    chunk = lambda k: "".join(rng.choice("abcdé ") for _ in range(k))
    pool = [chunk(rng.choice((30, 49, 50, 51, 80, 200))) for _ in range(8)] + ["a" * 120, "ab" * 60]
    return ["".join(rng.choice(pool) if rng.random() < 0.6 else chunk(rng.randrange(40)) for _ in range(rng.randrange(7))) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_removal(make_docs, seed):
    texts = mixed_texts(seed)
    texts += [texts[0], None, "", texts[1] + texts[2]]
    assert removed(make_docs(texts)) == expect(list(enumerate(texts)))


def test_removal_of_long_texts_and_hot_keys(make_docs, monkeypatch):
    """Blocks, sets of contexts and keys dealt window by window: all forced. Workers run the functions as they are sent."""
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefgh") for _ in range(700_000))
    texts = [long[100_000:100_300] + "x", long, "y" + long[262_100:262_400], long[:60] + long[690_000:]]
    assert removed(make_docs(texts)) == expect(list(enumerate(texts)))


@pytest.mark.parametrize("hot", [False, True])
def test_passes_in_one_process(hot, monkeypatch):
    """The three passes without Spark, with every shared key hot or none."""
    import pyarrow as pa

    if hot:
        monkeypatch.setattr(suffix, "HOT_SHARE", 1 << 40)
    monkeypatch.setattr(suffix, "SUB_CONTEXTS", 7)
    monkeypatch.setattr(suffix, "BLOCK", 150)
    texts, n = mixed_texts(4, 30), 3
    passes = suffix.Passes(50, 24, n)
    tables = [pa.table({"doc_id": pa.array(range(p, len(texts), n), pa.int64()), "text": pa.array(texts[p::n]), "part": pa.array([p] * len(texts[p::n]), pa.int32())}) for p in range(n)]

    def meet(blobs):
        rows = sorted((r for b in blobs for r in b.to_pylist()), key=lambda r: r["bucket"])
        return [suffix._blobs([(r["bucket"], r["part"], r["blob"]) for r in rows])]

    def of(p, blobs):
        rows = [r for b in blobs for r in b.to_pylist() if r["part"] == p]
        return pa.Table.from_batches([suffix._blobs([(r["bucket"], r["part"], r["blob"]) for r in rows])])

    shared = list(passes.shared_keys(iter(meet([b for t in tables for b in passes.keys(iter(t.to_batches()))]))))
    assert hot == any(len(suffix.unsqueeze(r["blob"])[1]) for b in shared for r in b.to_pylist())
    met = meet([b for p, t in enumerate(tables) for b in passes.contexts(t, of(p, shared)).to_batches()])
    marks = list(passes.marks(iter(met)))
    got = {}
    for p, t in enumerate(tables):
        for r, text, mask in passes.covered(t, of(p, marks)):
            got[p + r * n] = np.zeros(len(text), bool) if mask is None else mask
    want = plain_removal(list(enumerate(texts)))
    assert all((got[i] == want[i]).all() for i in range(len(texts)))


def test_edges_of_removal(edge_docs):
    assert removed(edge_docs) == expect([(r.doc_id, r.text) for r in edge_docs.collect()])
    left = suffix.without_repeats(edge_docs)
    assert left.columns == edge_docs.columns and left.count() == 8
    assert suffix.remove_repeats(edge_docs.limit(0)).count() == 0


def test_whole_characters(make_docs):
    a = "é" * 60
    r = {x.doc_id: x for x in suffix.remove_repeats(make_docs(["x" + a, "y" + a + "z", a[:24] + "ü"]), with_text=True).collect()}
    assert r[1].text == "yz" and r[0].text == "x" + a
    kept = {x.doc_id: x for x in suffix.without_repeats(make_docs(["x" + a, "y" + a + "z"])).collect()}
    assert kept[1].text == "yz" and kept[1].n_chars == 2 and kept[1].lang == "en"


def distinct_contexts(rng, n=30, of=b"ab", sizes=(12, 25)):
    return list({bytes([255]) + bytes(rng.choice(of) for _ in range(rng.randrange(*sizes))) for _ in range(n)})


def test_suffix_array_and_tree():
    """Every right-maximal string of a set of contexts is an interval of the tree, with its places and their left bytes."""
    rng = random.Random(2)
    ctx, m = distinct_contexts(rng), 10
    array = suffix.SuffixArray(np.frombuffer(b"".join(ctx), np.uint8), np.array([len(c) for c in ctx]), m)
    wins = [(i, j, ctx[i][1 + j :]) for i in range(len(ctx)) for j in range(len(ctx[i]) - m)]
    by = {}
    for place, g in zip(array.order, array.top()):
        by.setdefault(g, []).append(wins[place][2][:m])
    assert all(len(set(v)) == 1 for v in by.values()) and len(by) == len({w[2][:m] for w in wins})
    assert [v[0] for _, v in sorted(by.items())] == sorted({w[2][:m] for w in wins})
    place, lcp = array.full()
    assert [wins[p][2] for p in place] == sorted(wins[p][2] for p in place)
    left = array.left[place].astype(np.int64)
    tree = suffix.IntervalTree(lcp, array.owner[place], left, left)
    found = {wins[place[a]][2][:d]: (b - a + 1, least, lo, hi) for a, b, d, least, lo, hi in zip(tree.first, tree.last, tree.depth, tree.least, tree.lo, tree.hi)}
    occ = {}
    for i, j, tail in wins:
        for k in range(m, len(tail) + 1):
            occ.setdefault(tail[:k], []).append((i, j, tail))
    for s, places in occ.items():
        right = {t[len(s)] if len(t) > len(s) else (i, j) for i, j, t in places}
        lefts = [ctx[i][j] for i, j, _ in places]
        assert (s in found) == (len(places) > 1 and len(right) > 1)
        if s in found:
            assert found[s] == (len(places), min(i for i, _, _ in places), min(lefts), max(lefts))


@pytest.mark.parametrize("seed, of, sizes", [(1, b"ab", (10, 30)), (2, b"abc", (10, 12)), (3, b"a", (10, 40)), (4, bytes([0, 97]), (11, 45))])
def test_spans_of_contexts(seed, of, sizes):
    """What the spans cover, for a document of any rank, is what windows of smaller documents cover."""
    rng = random.Random(seed)
    ctx, m = distinct_contexts(rng, 40, of, sizes), 10
    least = np.array([rng.randrange(12) for _ in ctx], np.int64)
    array = suffix.SuffixArray(np.frombuffer(b"".join(ctx), np.uint8), np.array([len(c) for c in ctx]), m)
    spans = list(zip(*(x.tolist() for x in array.spans(least))))
    first = {}
    for c, d in zip(ctx, least):
        for j in range(1, len(c) - m + 1):
            first[c[j : j + m]] = min(d, first.get(c[j : j + m], d))
    assert len(spans) <= sum(len(c) - m for c in ctx) * 3
    for rank in range(13):
        for i, c in enumerate(ctx):
            want, got = np.zeros(len(c), bool), np.zeros(len(c), bool)
            for j in range(1, len(c) - m + 1):
                want[j : j + m] |= first[c[j : j + m]] < rank
            for own, offset, length, doc in spans:
                if own == i and doc < rank:
                    got[1 + offset : 1 + offset + length] = True
            assert (want == got).all()


def test_labels_name_their_partitions(spark):
    from pyspark.sql import functions as F

    from quire.llm.common import label_column, labels

    for n in (1, 2, 7, 211):
        df = spark.range(n).select("id", label_column(F.col("id"), n).alias("label")).selectExpr("id", "label", f"pmod(hash(label), {n}) AS place")
        assert [(r.id, r.label) for r in df.orderBy("id").collect()] == list(enumerate(labels(n))) and df.where("id <> place").count() == 0


def test_maximal_repeats(make_docs):
    rng = random.Random(8)
    p = "".join(rng.choice("abcdefghij") for _ in range(60))
    q = "".join(rng.choice("abcdefghij") for _ in range(55))
    texts = ["1" + p + "2", "3" + p + "4" + q, "5" + q + "6" + p, "nothing"]
    got = {}
    for r in suffix.maximal_repeats(make_docs(texts)).collect():
        got.setdefault((r.group_id, r.length), set()).add((r.doc_id, r.start))
    sets = list(got.values())
    assert {(1, 1), (0, 1), (2, 57)} in sets and {(1, 62), (2, 1)} in sets
    assert all(len({texts[d][s : s + n] for d, s in v}) == 1 and len(v) > 1 for (_, n), v in got.items())


def plain_repeats(texts, m):
    """{string: places} of all maximal repeats: what two places with different left sides have in common."""
    raw = [t.encode() for t in texts]
    by, out = {}, {}
    for d, t in enumerate(raw):
        for i in range(len(t) - m + 1):
            by.setdefault(t[i : i + m], []).append((d, i))
    for places in by.values():
        for k, (d, i) in enumerate(places):
            for e, j in places[:k]:
                if i and j and raw[d][i - 1] == raw[e][j - 1]:
                    continue
                n = m
                while i + n < len(raw[d]) and j + n < len(raw[e]) and raw[d][i + n] == raw[e][j + n]:
                    n += 1
                out[raw[d][i : i + n]] = None
    for s in out:
        out[s] = sorted((d, i) for d, i in by[s[:m]] if raw[d][i : i + len(s)] == s)
    return out


@pytest.mark.parametrize("case", ["copies", "three", "long", "within", "nested", "blocks"])
def test_maximal_repeats_whole(make_docs, case):
    rng = random.Random(case)
    word = lambda n, of="abcdefghij": "".join(rng.choice(of) for _ in range(n))
    p, q = word(300), word(120)
    texts = {
        "copies": [q, q, word(80)],
        "three": [p, p, p, "1" + p],
        "long": ["1" + p + "2" + word(90), word(70) + "3" + p + "4", "5" + p + "2", word(99)],
        "within": ["1" + q + "2" + q + "3", "a" * 70, word(60)],
        "nested": ["1" + p, "2" + p[:200] + "3", "4" + p[100:], p[100:200] + "5ü" + q, p + "ü" + q, "", None],
        "blocks": [word(suffix.BLOCK - 100) + p + q + p, "x" + q + p + word(suffix.BLOCK), p + p],
    }[case]
    got = {}
    for r in suffix.maximal_repeats(make_docs(texts)).collect():
        got.setdefault((r.group_id, r.length), []).append((r.doc_id, r.start))
    plain = plain_repeats([t or "" for t in texts], 50)
    assert plain and {(xxhash.xxh64_intdigest(s) - (xxhash.xxh64_intdigest(s) >> 63 << 64), len(s)): v for s, v in plain.items()} == {k: sorted(v) for k, v in got.items()}


# ---- embeddings


def plain_links(vectors, t=0.95):
    def ok(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    n = len(vectors)
    pairs = []
    for i in range(n):
        for j in range(i):
            a, b = vectors[i], vectors[j]
            if ok(a) and ok(b) and len(a) == len(b):
                a, b = np.array(a, float), np.array(b, float)
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= t:
                    pairs.append((i, j))
    return pairs


def near(df, **kw):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed.near_duplicates(df, **kw).collect()}


@pytest.mark.parametrize("tile, cell", [(8192, 512), (16, 8), (5, 200)])
def test_links_of_vectors(spark, tile, cell, monkeypatch):
    monkeypatch.setattr(embed, "CELL", cell)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    v = [(c + rng.normal(size=16) * 0.24).tolist() for c in centres for _ in range(12)]
    v += [v[0], v[0], [2 * x for x in v[5]], [0.0] * 16, None, [float("nan")] * 16, [None] * 16, [], [1e300] * 16, [1.0] * 16, [1.0, 2.0], [2.0, 4.0], [-0.0] * 16]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "vec_id long, embedding array<double>").selectExpr("*", "1 AS cell", "2 AS rep")
    pairs = plain_links(v)
    assert len(pairs) > 100
    root = union(len(v), pairs)
    degree = np.bincount(np.array(pairs).ravel(), minlength=len(v))
    for visitors in (16_384, 40):
        assert near(df, tile=tile, visitors=visitors) == {i: (int(degree[i]), root[i], root[i] == i) for i in range(len(v))}


@pytest.mark.parametrize("spread", [0.02, 0.12, 0.3])
def test_links_of_one_large_cell(spark, spread, monkeypatch):
    """Shells of a cell that many tiles hold, and centroids that lie badly."""
    monkeypatch.setattr(embed, "MAX_CELLS", 3)
    monkeypatch.setattr(embed, "CELL", 10)
    rng = np.random.default_rng(9)
    v = [(c + rng.normal(size=6) * spread).tolist() for c in rng.normal(size=(2, 6)) for _ in range(150)]
    pairs = plain_links(v)
    root, degree = union(len(v), pairs), np.bincount(np.array(pairs).ravel(), minlength=len(v))
    df = spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<double>")
    assert near(df, tile=20, visitors=70) == {i: (int(degree[i]), root[i], root[i] == i) for i in range(len(v))}


def test_vectors_with_one_id_and_many_dimensions(spark, monkeypatch):
    monkeypatch.setattr(embed, "SAMPLE", 3)  # most dimensions have no centroid
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01])] + [(10 * d + i, [1.0] * d + [0.01 * i]) for d in range(3, 9) for i in range(3)]
    far = embed.near_duplicates(spark.createDataFrame([(-5, [1.0, 0.0]), (7, [1.0, 0.1]), (-(1 << 63), [0.0, 1.0]), ((1 << 63) - 1, [0.1, 1.0])], "vec_id long, embedding array<double>"))
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in far.collect()) == [(-(1 << 63), 1, -(1 << 63), True), (-5, 1, -5, True), (7, 1, -5, False), ((1 << 63) - 1, 1, -(1 << 63), False)]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embed.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(1, 0, 1), (1, 1, 1), (2, 1, 1)] + [(10 * d + i, 2, 10 * d) for d in range(3, 9) for i in range(3)]


def test_vectors_of_the_table(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    v = np.array([r.embedding for r in df.orderBy("vec_id").collect()], float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    hit = v @ v.T >= 0.95
    got = near(df)
    assert [got[i][0] for i in sorted(got)] == (hit.sum(axis=1) - 1).tolist()


def test_edges_of_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert near(spark.createDataFrame([], schema)) == {}
    rows = spark.createDataFrame([(3, [1.0, 0.0]), (3, [1.0, 0.0]), (None, [1.0, 0.0])], schema)
    got = sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in embed.near_duplicates(rows).collect())
    assert got == [("3", 1, 3, True), ("3", 1, 3, True), ("None", 0, None, False)]
