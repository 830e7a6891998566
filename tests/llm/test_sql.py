"""Queries against their DuckDB SQL, on the smallest tables and on planted rows."""

import random

import duckdb
import numpy as np
import pytest

from quire.llm import embed, htmltree, queries, repetition, sql, suffix

FIT = {"op2_repetition_rules": "documents", "op3_interval_tree_dedup": "documents", "op7_url_automaton": "pages", "op9_kmeans_embeddings": "embeddings"}


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(str(v) if v is not None and v == v else "" for v in r) for r in df[cols].astype(object).itertuples(index=False))


def test_names():
    assert set(queries.oracle_sql()) == set(FIT)


@pytest.mark.parametrize("name", sorted(FIT))
def test_query(spark, sf, name):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW {FIT[name]} AS SELECT * FROM '{sf}/{FIT[name]}.parquet'")
    assert rows(queries.queries()[name](spark, sf).toPandas()) == rows(c.execute(queries.oracle_sql()[name]).df())


def planted(make_docs):
    rng = random.Random(6)
    words = ["".join(rng.choice("abé") for _ in range(rng.randrange(1, 5))) for _ in range(12)]
    line = lambda k: " ".join(rng.choice(words) for _ in range(k))
    some = [line(14) for _ in range(6)]
    return make_docs(["\n".join(rng.choice([*some, line(9), "", "# $ %"]) for _ in range(rng.randrange(8))) for _ in range(60)] + [None, ""])


def test_planted_texts(make_docs):
    df = planted(make_docs)
    c = duckdb.connect()
    c.register("documents", df.toPandas())
    got = repetition.assess(df).toPandas()
    assert got.kept.nunique() == 2 and (got.n_dup_lines > 0).any() and (got.n_repeat_words > 0).any()
    assert rows(got) == rows(c.execute(sql.repetition()).df())
    cut = suffix.remove_repeats(df).toPandas()
    assert (cut.n_removed > 0).sum() > 10 and (cut.n_spans > 1).any()
    assert rows(cut) == rows(c.execute(sql.removal()).df())


def test_planted_vectors(spark):
    rng = np.random.default_rng(8)
    v = [(c + rng.normal(size=8) * 0.22).tolist() for c in rng.normal(size=(9, 8)) for _ in range(7)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate([*v, v[3], [0.0] * 8, None, [float("inf")] * 8])], "vec_id long, embedding array<double>")
    c = duckdb.connect()
    c.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[])")
    c.executemany("INSERT INTO embeddings VALUES (?, ?)", [(r.vec_id, r.embedding) for r in df.collect()])
    got = embed.near_duplicates(df).toPandas()
    assert got.n_links.max() > 2
    assert rows(got) == rows(c.execute(sql.links()).df())


def test_style_tree_without_broadcast(spark, monkeypatch):
    page = "<html><body><div class='x'><p>Written by the house</p></div><div class='y'><p>Story {} of its own</p></div></body></html>"
    df = spark.createDataFrame([(i, "http://h.example/a", page.format(i)) for i in range(30)], "page_id long, url string, html string")
    want = sorted(map(tuple, htmltree.extract(df).collect()))
    monkeypatch.setattr(htmltree, "BROADCAST_ROWS", -1)
    assert sorted(map(tuple, htmltree.extract(df).collect())) == want and want[0][2] == "Story 0 of its own"
