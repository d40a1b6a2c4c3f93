"""Each catalogue query runs; those with SQL give the SQL's rows."""

import sys

import duckdb
import pytest

sys.path.insert(0, ".")
from quillspark.plans import catalogue, catalogue_sql  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, name):
    df = catalogue.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert len(set(columns)) == len(columns)
    if name in catalogue_sql.SQL:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        want = con.execute(f"SELECT {', '.join(columns)} FROM ({catalogue_sql.SQL[name]})").fetchall()
        assert rows == sorted((tuple(plain(v) for v in r) for r in want), key=repr)


def test_entry_names_match():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
