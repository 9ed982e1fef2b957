"""Each registered query of the core library against its SQL in DuckDB."""

import math
import os

import pytest

import __spark_entry__
from sunstride.plans import registry

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.isoformat() if hasattr(v, "isoformat") else v


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = df.collect()
    want = duck.execute(registry.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, got) == rows(names, want.fetchall())


def by_vector(spark, folder, name, vectors):
    """The query's and its SQL's values for each vector, as text: that tells a negative zero from zero."""
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"vec_id": pa.array(range(len(vectors)), pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32()))}), f"{folder}/embeddings.parquet")
    df = registry.QUERIES[name](spark, str(folder))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{folder}/embeddings.parquet')")
    return sorted(map(str, map(tuple, df.collect()))), sorted(map(str, con.execute(f"SELECT {', '.join(df.columns)} FROM ({registry.SQL[name]})").fetchall()))


#: 0, -0, what rounds to either, ties and large values.
ZEROS = [0.0, -0.0, 4e-7, -4e-7, 5e-7, -5e-7, 6e-7, -6e-7, 0.0078125, -0.0078125, -0.1, 1e30, -1e30, 3.0, -3.0, 1e-30]


def test_patches_keep_the_sign_of_zero(spark, tmp_path):
    got, want = by_vector(spark, tmp_path, "q_patchify", [ZEROS * 4, [-v for v in ZEROS] * 4, [float("nan"), float("-inf"), None] + ZEROS, [], None])
    assert got == want and "-0.0" in want[0]


def test_normalised_windows_keep_the_sign_of_zero(spark, tmp_path):
    low = [1.0, -1.0, -2e-6, 2e-6] * 16  # values just below and above the mean
    got, want = by_vector(spark, tmp_path, "q_revin", [low, [-1e-7, -2e-7] * 32, [-0.0] * 64, [float(k) for k in range(64)], [1.0, float("nan")], [1.0, float("inf")]])
    assert got == want and "-0.0" in want[0]


def test_scaled_vectors_keep_the_sign_of_zero(spark, tmp_path):
    got, want = by_vector(spark, tmp_path, "q_zscore_array", [[1.0, -1.0] * 32, [2e-6, -2e-6] * 32, ZEROS[:8] * 8])
    assert got == want and "-0.0" in want[1]


def test_scaled_vectors_that_lack_steps(spark, tmp_path):
    got, want = by_vector(spark, tmp_path, "q_zscore_array", [[1.0, -1.0] * 32, [3.0, None, -2.0], [float(k) for k in range(70)], [None], [], None])
    assert got == want and "None" in want[1]


def test_normalised_windows_that_miss_values(spark, tmp_path):
    got, want = by_vector(spark, tmp_path, "q_revin", [[1.0, None, 2.0, 4.0], [None, None], [], None])
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["site", "mean_monthly_acc_mae", "mean_monthly_acc_rmse"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
