"""Driver contract: entry runs; every oracle has a query; a sample of
queries agrees with DuckDB on sf0.001."""
import duckdb

import __spark_entry__ as E
from tests.conftest import SF


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 3 and set(df.columns) == {"group_variable", "level", "count", "mean", "std", "min", "max"}


def test_oracles_have_queries():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 60


def _norm(v):
    return None if v is None or (isinstance(v, float) and v != v) else (round(v, 6) if isinstance(v, float) else v)


def test_sample_against_duckdb(spark):
    con = duckdb.connect()
    for t in ["lineitem", "orders", "events", "part", "customer", "supplier", "labels", "documents", "embeddings"]:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name in ["describe_lineitem", "fill_linear", "fill_cubic", "anova_twoway", "kruskal", "chi_square_2x2",
                 "hist_price", "roc_auc", "label_encode_priority", "kmo"]:
        sp = E.queries()[name](spark, SF).toPandas()
        dk = con.sql(E.oracle_sql()[name]).df()
        cols = sorted(sp.columns)
        assert cols == sorted(dk.columns), name
        a = sorted(tuple(_norm(r[c]) for c in cols) for _, r in sp.iterrows())
        b = sorted(tuple(_norm(r[c]) for c in cols) for _, r in dk.iterrows())
        assert a == b, name
