"""Every query at the smallest scale against DuckDB on the same tables."""

import math
import os

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from vetlake import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
plans.load()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def cell(x):
    if hasattr(x, "tolist"):
        x = x.tolist()
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "NULL"
    return f"{x + 0.0:.5g}" if isinstance(x, float) else str(x)


def rows(df):
    df = df.astype(object).where(df.notna(), None)[sorted(df.columns)]
    return list(df.columns), sorted(tuple(map(cell, r)) for r in df.itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_sql(spark, duck, name):
    assert rows(plans.QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(plans.SQL[name]).df())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_query_has_rows(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0


@pytest.fixture(scope="module")
def copied(tmp_path_factory):
    """A folder with embeddings of which some are copies or nearly so, some of them without a label."""
    folder = tmp_path_factory.mktemp("copied")
    rng = np.random.default_rng(17)
    base = rng.normal(size=(60, 64))
    some = np.concatenate([base, base[:12], base[:5], np.where(rng.random((30, 64)) < 0.1, -base[:30], base[:30])]).astype(np.float32)
    labels = [None if i % 7 == 0 else i % 3 for i in range(len(some))]
    columns = {"vec_id": pa.array(rng.permutation(len(some)) * 3), "embedding": pa.array(some.tolist(), pa.list_(pa.float32())), "label": pa.array(labels, pa.int32())}
    pq.write_table(pa.table(columns), folder / "embeddings.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["near_duplicate_pairs", "near_pair_report", "connected_components"])
def test_near_queries_equal_sql_with_copies(spark, copied, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{copied}/embeddings.parquet'")
    assert rows(plans.QUERIES[name](spark, copied).toPandas()) == rows(con.sql(plans.SQL[name]).df())


def test_entry(spark):
    import __spark_entry__

    assert set(plans.QUERIES) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
