"""What larger tables bring out: sums beyond a long, joins of all pairs, fits over many rows."""

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from caselens.operators import attribution, folds, modeling, traces

AT = 800_000_000_000_000  # microseconds; a long holds the sum of 11,529 of these


def test_sums_of_starts_beyond_a_long(spark):
    first = spark.range(30_000).selectExpr("id % 2 as case_no", "if(id % 3 = 0, null, 'a') as service", f"{AT} + id as start_us")
    got = {(r.case_no, r.service): (r.n, int(r.s)) for r in traces.start_sums(first).collect()}
    want = {}
    for i in range(30_000):
        n, s = want.get(k := (i % 2, None if i % 3 == 0 else "a"), (0, 0))
        want[k] = n + 1, s + AT + i
    assert got == want and max(s for _, s in want.values()) < 2**63

    got = {r.service: int(r.s) for r in traces.start_sums(first.selectExpr("0 as case_no", "service", "start_us")).collect()}
    assert got == {k: want[0, k][1] + want[1, k][1] for k in (None, "a")} and got["a"] > 2**63


def test_sums_that_fit_stay_longs(spark):
    first = spark.range(4).selectExpr("id as case_no", "'a' as service", f"{AT} + id as start_us")
    out = traces.start_sums(first)
    assert dict(out.dtypes)["s"] == "bigint" and sorted(r.s for r in out.collect()) == [AT + i for i in range(4)]


def test_shares_add_up_where_values_are_missing_or_endless(spark):
    """Rows follow the forest's own way at values that aren't numbers or are without end, and are met by no join with all paths."""
    nan, end = float("nan"), float("inf")
    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 5), float(i % 3)], "ab"[i % 7 > 3]) for i in range(80)], "case_id long, values array<double>, y string")
    model = modeling.fit_forest(rows.withColumn("features", array_to_vector("values")), ["a", "b"], modeling.Forest(trees=3, depth=3))
    odd = spark.createDataFrame([(0, [nan, 1.0, 2.0]), (1, [-end, nan, 0.0]), (2, [end, end, -end]), (3, [nan, nan, nan])], "case_id long, values array<double>")
    found, base = attribution.attributions(model, odd, ["f0", "f1", "f2"], ["a", "b"])
    want = {r.case_id: r.proba for r in modeling.predicted(model, odd.withColumn("features", array_to_vector("values")), ["a", "b"]).collect()}
    sums, b = {r.case_id: (r.a, r.b) for r in found.groupBy("case_id").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect()}, base.first()
    for i, p in want.items():
        assert [sums[i][0] + b.a, sums[i][1] + b.b] == pytest.approx(p, abs=1e-9)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_rows_of_the_wide_table_need_no_join_of_all_pairs(spark):
    long = spark.createDataFrame([(i, f"f{k}", None if k == 1 else float(i + k)) for i in range(6) for k in range(3) if (i, k) != (5, 2)], "case_id long, feature_name string, value double")
    cases = spark.range(7).withColumnRenamed("id", "case_id")
    out = modeling.vectors(long, cases, ["f2", "f0", "f1"], modeling.medians(long, cases))
    got = {r.case_id: list(r["values"]) for r in out.collect()}
    assert got == {i: [i + 2.0, float(i), 0.0] for i in range(5)} | {5: [4.0, 5.0, 0.0], 6: [4.0, 2.5, 0.0]}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_relative_cells_equal_the_lookup(spark):
    names = ["metric__a_cpu__m", "metric__a_other__m", "log__a__error__m", "log__a__new_template_count", "trace_error__a_Get__m", "trace_error__a_Put_X__m", "trace_error__b_Get__m", "svc__depth", "log__all__new_template_count", "metric__c_cpu__m"]
    long = spark.createDataFrame([(i, n, None if (i + k) % 4 == 0 else float((i * 7 + k * 3) % 11)) for i in range(8) for k, n in enumerate(names) if (i * k) % 5 != 2], "case_id long, feature_name string, value double")
    header = modeling.feature_names(long)
    own, seen_by = modeling.relative_cells(long, header, ["a", "b"])
    rows = modeling.wide(long, header, "case_id").crossJoin(spark.createDataFrame([("a",), ("b",)], "service string"))
    got = {(r.case_id, r.service, n): v for r in rows.withColumn("seen", seen_by(F.col("service"))).collect() for n, v in zip(own, r.seen, strict=True) if v is not None}
    want = {(r.case_id, r.service, r.feature_name): r.value for r in modeling.relative_lookup(long, spark.createDataFrame([("a",), ("b",)], "service string")).collect()}
    assert got == want and len(want) > 30


def test_folds_of_two_stages_read_rows_by_no_join(spark, monkeypatch):
    """With many cases the joins of each fold took the time: a fit's rows come from one table without any shuffle or join."""
    cases, long = [], []
    for i in range(60):
        cases.append((i, f"s{i % 2}_{i % 12}", f"svc{i % 2}", "ab"[i % 4 > 1]))
        long += [(i, f"metric__svc{s}_cpu__m", float(i % 4 + s)) for s in range(2)] + [(i, f"metric__svc{s}_workload__m", 5.0 * (s == i % 2)) for s in range(2)]
    cases, long = spark.createDataFrame(cases, "case_id long, scenario string, service string, y string"), spark.createDataFrame(long, "case_id long, feature_name string, value double")
    plans, fit = [], modeling.fit_forest
    monkeypatch.setattr(modeling, "fit_forest", lambda rows, *a, **k: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or fit(rows, *a, **k))
    small = modeling.Forest(3, 3)
    by_row = modeling.cross_validate_two_stage(long, None, folds.group_folds(cases, 2, 1, 3), cases, small, small)
    assert len(plans) == 4 and not any("Join" in p or "Exchange" in p for p in plans)
    by_lookup = modeling.cross_validate_two_stage(long, modeling.relative_lookup(long, cases.select("service").distinct()), folds.group_folds(cases, 2, 1, 3), cases, small, small)
    assert sorted(map(str, by_row.select("case_id", "fold", "service").collect())) == sorted(map(str, by_lookup.select("case_id", "fold", "service").collect()))
    assert by_row.count() == 60


def test_a_kept_model_needs_no_lookup(spark, tmp_path, monkeypatch):
    """Fits and scores from wide rows, without rows by service, also of cases and features that weren't there at the fit."""
    cases, long = [], []
    for i in range(80):
        cases.append((i, f"svc{i % 2}", "ab"[i % 4 > 1]))
        long += [(i, f"metric__svc{s}_cpu__m", float(i % 4 + s)) for s in range(2)] + [(i, f"metric__svc{s}_workload__m", 5.0 * (s == i % 2)) for s in range(2) if (i + s) % 5]
        long += [(i, f"trace_error__svc{i % 2}_{'Late' if i > 69 else 'Get'}__m", float(i % 3))]
    cases, long = spark.createDataFrame(cases, "case_id long, service string, y string"), spark.createDataFrame(long, "case_id long, feature_name string, value double")
    seen, small = cases.where("case_id < 60"), modeling.Forest(3, 3)
    plans, fit = [], modeling.fit_forest
    monkeypatch.setattr(modeling, "fit_forest", lambda rows, *a, **k: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or fit(rows, *a, **k))
    modeling.save_two_stage(long, None, seen, str(tmp_path / "m"), small, small)
    assert len(plans) == 2 and not any("Join" in p or "Exchange" in p for p in plans)
    lookup = modeling.relative_lookup(long, cases.select("service").distinct())
    one, two = (modeling.score_two_stage(spark, str(tmp_path / "m"), long, x, cases).orderBy("case_id").collect() for x in (None, lookup))
    assert one == two and len(one) == 80
    assert sum(r.service == f"svc{r.case_id % 2}" for r in one) > 60
