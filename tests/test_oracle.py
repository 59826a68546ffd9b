"""Every registered query of the reference operators against its DuckDB oracle on the smallest data set."""

import collections

import duckdb
import pytest

from pagelens.catalog import QUERIES
from pagelens.oracle import ORACLE

SF = "/root/testdata/sf0.001"
NAMES = sorted(set(QUERIES) & set(ORACLE))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def norm(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    sdf = QUERIES[name](spark, SF)
    cols = sorted(sdf.columns)
    s = collections.Counter(tuple(norm(r[c]) for c in cols) for r in sdf.collect())
    res = con.execute(ORACLE[name])
    dcols = [d[0] for d in res.description]
    assert sorted(dcols) == cols
    d = collections.Counter(tuple(norm(dict(zip(dcols, r))[c]) for c in cols) for r in res.fetchall())
    assert s == d
