"""Every query against its SQL in another engine, on the smallest driver tables."""

import os

import duckdb
import pytest

from caselens.jobs import catalog

#: The smallest tables have samples in few bins.
MOST = 0.9
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows(df):
    df = df[sorted(df.columns)]
    clean = lambda v: None if v is None or v != v else bool(v) if type(v).__name__ in ("bool", "bool_") else round(float(v), 5) + 0.0 if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)
    return list(df.columns), sorted((tuple(map(clean, r)) for r in df.astype(object).values.tolist()), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events labels".split():
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("key", sorted(catalog.CHECKED))
def test_same(spark, duck, key):
    got, want = rows(catalog.CHECKED[key](spark, SF, MOST).toPandas()), rows(duck.sql(catalog.ALL_SQL[key].replace("/*most*/0.25", str(MOST))).df())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]


@pytest.mark.parametrize("key", ["ml_group_folds", "set_group_overlap", "ml_relative_features", "ml_dummy_baseline", "ml_paired_tests", "win_signed_rank", "ml_additivity"])
def test_same_models(spark, duck, key):
    got, want = rows(catalog.QUERIES[key](spark, SF).toPandas()), rows(duck.sql(catalog.ALL_SQL[key]).df())
    assert got == want
