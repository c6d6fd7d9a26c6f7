"""Every query of the vector engine against its SQL."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lodestar.operators import kmeans
from lodestar.operators.kmeans import SAMPLE_ROWS
from lodestar.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    return c


def test_every_query_has_sql():
    assert set(queries.queries()) == set(queries.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_matches_sql(spark, duck, name):
    mine = queries.queries()[name](spark, SF).toPandas()
    theirs = duck.execute(queries.oracle_sql()[name]).df()
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns)
    assert [str(mine[c].dtype) for c in columns] == [str(theirs[c].dtype) for c in columns]
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (mine, theirs))
    assert len(a) == len(b) > 0
    assert a.equals(b), a.compare(b).head()


def test_product_codes_of_more_rows_than_a_sample(spark, tmp_path):
    n = SAMPLE_ROWS + 4000
    x = np.random.default_rng(6).standard_normal((n, 64)).astype(np.float32)
    lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 64).cast(pa.list_(pa.float32()))
    table = pa.table({"vec_id": pa.array(np.arange(n)), "label": pa.array(np.arange(n) % 5, pa.int32()), "embedding": lists})
    pq.write_table(table, tmp_path / "embeddings.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    for name in ("pq_train", "pq_encode"):
        mine = queries.queries()[name](spark, str(tmp_path)).toPandas()
        theirs = c.execute(queries.oracle_sql()[name]).df()
        columns = sorted(theirs.columns)
        a, b = (t[columns].sort_values(columns).to_numpy() for t in (mine, theirs))
        assert len(a) == len(b) > 0 and np.abs(a - b).max() < 2e-6, name


def test_books_of_256_entries_learn_from_all_rows(spark, tmp_path, monkeypatch):
    x = np.random.default_rng(7).standard_normal((SAMPLE_ROWS + 1000, 64)).astype(np.float32)
    lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 64).cast(pa.list_(pa.float32()))
    table = pa.table({"vec_id": pa.array(np.arange(len(x))), "label": pa.array(np.zeros(len(x)), pa.int32()), "embedding": lists})
    pq.write_table(table, tmp_path / "embeddings.parquet")
    want = []  # the SQL's rounds, which take DuckDB minutes for so many rows
    for m in range(8):
        sub = x[:, 8 * m : 8 * m + 8].astype(np.float64)
        c = sub[:256]
        for _ in range(20):
            near = ((c * c).sum(1) - 2 * sub @ c.T).argmin(1)
            n = np.bincount(near, minlength=256)
            total = np.stack([np.bincount(near, sub[:, j], 256) for j in range(8)], 1)
            c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
        want.append(c)
    for values in (kmeans.LOCAL_VALUES, 0):  # in the driver, and by passes over the table
        monkeypatch.setattr(kmeans, "LOCAL_VALUES", values)
        mine = queries.queries()["pq_train_256"](spark, str(tmp_path)).toPandas().sort_values(["m", "code", "pos"])
        assert len(mine) == 8 * 256 * 8 and np.abs(mine["value"].to_numpy() - np.ravel(want)).max() < 2e-6
