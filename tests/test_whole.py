"""Queries over all samples: none leaves out what two cases are made to lack for the others."""

import datetime
import os
import shutil

import duckdb
import pytest

from caselens.jobs import catalog
from caselens.operators import folds as G

SF = "/root/testdata/sf0.001"
LACKING = [(5, "metric__svc1_error"), (6, "trace_latency__svc0_Put")]


def windowed(sf, case, kind, k):
    """The events of one column in its case's window, counted without the queries' SQL."""
    at = datetime.datetime(2024, 1, 7) + datetime.timedelta(days=2 * case)
    reach = datetime.timedelta(days=5)
    return duckdb.sql(f"select count(*) from '{sf}/events.parquet' where user_id % 8 = {case} and event_type = '{kind}' and {k} and ts >= '{at - reach}' and ts < '{at + reach}'").fetchall()[0][0]


def test_align_grid_has_all_columns(spark):
    got = catalog.QUERIES["agg_align_grid"](spark, "/root/testdata/sf0.01").groupBy("case_no", "column_name").sum("sample_count").collect()
    got = {(r[0], r[1]): r[2] for r in got}
    k = "cast(json_extract_string(props, '$.k') as bigint)"
    assert got[LACKING[0]] == windowed("/root/testdata/sf0.01", 5, "error", f"{k} % 2 = 1") > 0
    assert got[LACKING[1]] == windowed("/root/testdata/sf0.01", 6, "purchase", f"{k} % 4 = 2") > 0


def test_densify_has_all_bins(spark):
    got = catalog.QUERIES["jn_grid_densify"](spark, SF).groupBy("case_no", "column_name").count().collect()
    got = {(r[0], r[1]): r[2] for r in got}
    assert [got.get(x) for x in LACKING] == [40, 40]


def event_rows():
    """An event of every kind in each bin of every case, with these holes: case 5's only metric is one error of svc1, case 6's only purchases are svc0's Put,
    and case 1 has no click in 3 of the 20 bins before its injection."""
    for case in range(8):
        start = datetime.datetime(2024, 1, 7) + datetime.timedelta(days=20 if case == 7 else 2 * case)
        for b in range(-21, 21):
            at = start + datetime.timedelta(hours=6 * b + 1)
            for kind in ("view", "error", "click", "purchase", "signup"):
                if case == 5 and kind in ("view", "error") and (kind, b) != ("error", 0) or case == 1 and kind == "click" and -4 < b < 0:
                    continue
                yield at, case, kind, 1 if case == 5 else 2


@pytest.fixture(scope="module")
def holes(tmp_path_factory):
    sf = tmp_path_factory.mktemp("holes")
    for t in ("lineitem", "orders", "part"):
        shutil.copy(os.path.join(SF, f"{t}.parquet"), sf)
    c = duckdb.connect()
    c.execute("create table e (event_id bigint, ts timestamp, user_id bigint, event_type varchar, value double, props varchar)")
    c.executemany("insert into e values (?, ?, ?, ?, ?, ?)", [(i, at, case, kind, 1.0, f'{{"k": {k}}}') for i, (at, case, kind, k) in enumerate(event_rows())])
    c.execute(f"copy e to '{sf}/events.parquet' (format parquet)")
    return str(sf)


def test_eligibility_by_all_samples(spark, holes):
    got = {r["case_no"]: r["uncovered"] for r in catalog.QUERIES["jn_eligibility"](spark, holes).collect()}
    assert got[5] == "metrics"
    assert got[6] == got[0] == ""


def test_excluded_runs_by_all_samples_and_the_own_limit(spark, holes):
    got = {r["case_no"]: r["reason"] for r in catalog.QUERIES["agg_excluded_runs"](spark, holes).where("stage = 'bins'").collect()}
    assert got == {1: "logs_baseline_missing_ratio=0.15", 5: "metrics_baseline_missing_ratio=1.00|metrics_incident_missing_ratio=0.95"}


def test_group_overlap_counts_all_cases(spark):
    placed = spark.createDataFrame([(0, 0, 1, "a"), (0, 1, 2, "a"), (0, 1, 3, "b"), (0, 2, 4, "c"), (0, 2, 5, "c")], "repeat int, fold int, case_id long, scenario string")
    got = {r["fold"]: (r["group_count"], r["case_count"], r["overlap"]) for r in G.fold_overlap(placed).collect()}
    assert got == {0: (3, 5, 1), 1: (3, 5, 1), 2: (3, 5, 0)}
    assert "lineitem" in catalog.ALL_SQL["set_group_overlap"]
