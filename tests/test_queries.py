"""Every registered query of the engine runs, and equals its DuckDB SQL on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from quire.plans.queries import QUERIES
from quire.plans.sql import ORACLE

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return ""
    if str(type(v)).find("bool") >= 0:
        return str(bool(v))
    try:
        return repr(round(float(v), 6))
    except (TypeError, ValueError):
        return str(v)


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(map(plain, r)) for r in df[cols].itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name in ORACLE:
        assert rows(got) == rows(duck.execute(ORACLE[name]).df())
    else:
        assert len(got)


@pytest.mark.parametrize("name", ["html_book_rollup", "apply_targets", "html_block_stats", "html_leaf_blocks"])
def test_references_without_semicolon(spark, tmp_path, name):
    cut = "<body><h1>Ores &amp;&amp</h1><p>a &quot;b&quot</p><p>&amp;quot; &quo</p><p>&amp</p><p>1 &ampx; &am</p></body>"
    pages = pd.DataFrame({"page_id": [1, 2], "url": ["http://a.example/en/1", "http://a.example/de/2"], "html": [cut, cut]})
    pages.to_parquet(tmp_path / "pages.parquet")
    c = duckdb.connect()
    c.register("pages", pages)
    assert rows(QUERIES[name](spark, str(tmp_path)).toPandas()) == rows(c.execute(ORACLE[name]).df())


def test_every_oracle_has_its_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
