"""The driver contract: entry() and every registered query run on sf0.001;
those with oracle SQL agree with DuckDB."""

import re

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings conversations labels benchmark events".split()


def test_entry_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert set(df.columns) == {"label", "num_steps", "rank", "feature_index", "specificity", "mean_activation", "is_assigned"}


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 90


#: The training-data queries have tests of their own.
LIBRARY = sorted(n for n in entry.oracle_sql() if not re.match(r"op\d+_|pipeline", n))


@pytest.mark.parametrize("name", LIBRARY)
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    def key(row):
        return tuple((v is None, v if v is not None else 0) for v in row)

    df = entry.queries()[name](spark, SF)
    got = sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=key)
    res = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    want = sorted((tuple(r[i] for i in order) for r in res.fetchall()), key=key)
    assert sorted(df.columns) == sorted(cols)
    assert len(got) == len(want)

    def norm(v):
        return round(v, 6) if isinstance(v, float) else v

    assert [tuple(map(norm, r)) for r in got] == [tuple(map(norm, r)) for r in want]
