"""Audits on rows that break their rules, and training sets that are published while others read."""

import pytest
from pyspark.sql import functions as F

from caselens.operators import attribution, features, quality, traces
from caselens.sources import training

SPAN = "case_no long, trace_id string, span_id string, parent_id string, service string, operation string, start_us long, duration double, status double"
LONG = "case_no long, feature_name string, value double"
MANIFEST = "feature_name string, modality string, config string, source_column string, statistic string, origin string, audit_status string"


def manifest_of(spark, names):
    audit = spark.createDataFrame([], "feature_name string, audit_status string")
    return features.feature_manifest(spark.createDataFrame([(0, n, 1.0) for n in names], LONG), audit)


def test_structure_counts_what_is_missing(spark):
    rows = [(0, "t", "1", None, "a", "x", 1, 1.0, 0.0), (0, None, "2", "1", None, "x", None, -1.0, None), (0, "u", None, "1", "a", None, 5, None, 0.0), (0, "u", "2", "1", "a", "x", 9, 1.0, 0.0), (1, "v", "1", None, None, None, 2, 0.0, None)]
    got = {r.case_no: r for r in traces.structure(traces.typed(spark.createDataFrame(rows, SPAN))).collect()}
    r = got[0]
    assert (r.span_count, r.unique_trace_count, r.unique_span_count, r.duplicate_span_id_count) == (4, 2, 2, 1)
    assert (r.missing_trace_id_count, r.missing_span_id_count, r.missing_service_count, r.missing_operation_count, r.missing_status_code_count) == (1, 1, 1, 1, 1)
    assert (r.invalid_timestamp_count, r.invalid_duration_count, r.negative_duration_count, r.start_us, r.end_us) == (1, 1, 1, 1, 9)
    assert r.status == "missing_trace_id|missing_span_id|invalid_timestamp|invalid_duration|negative_duration|duplicate_span_id"
    assert got[1].status == "valid"


def test_roots_that_lack_ids(spark):
    rows = [(0, None, "1", None, "a", "x", 1, 1.0, 0.0), (0, "t", None, None, "a", "x", 1, 1.0, 0.0), (1, None, "1", None, "a", "x", 1, 1.0, 0.0), (2, "t", "1", None, "a", "x", 1, 1.0, 0.0)]
    got = {r.case_no: r for r in traces.root_identity(traces.typed(spark.createDataFrame(rows, SPAN))).collect()}
    assert (got[0].root_missing_trace_id_count, got[0].root_missing_span_id_count, got[0].status) == (1, 1, "zero_root_trace|root_missing_trace_id|root_missing_span_id")
    assert (got[1].unique_trace_count, got[1].single_root_ratio, got[1].status) == (0, 0.0, "empty_trace_identity|root_missing_trace_id")
    assert got[2].status == "valid"


def test_series_status(spark):
    runs = spark.createDataFrame([(0, 100), (1, 100)], "case_no long, inject_s long")
    rows = [(0, "logs", "a", 90_000_000, 1.0), (0, "logs", "a", 90_000_000, None), (0, "logs", "b", None, 1.0), (0, "logs", "a", 130_500_000, 1.0), (1, "logs", "a", None, 1.0)]
    got = {r.case_no: r for r in quality.timeseries_quality(spark.createDataFrame(rows, "case_no long, data_name string, column_name string, ts_us long, value double"), runs, 10).collect()}
    r = got[0]
    assert (r.row_count, r.feature_count, r.invalid_timestamp_count, r.missing_feature_count, r.duplicate_timestamp_count) == (4, 2, 1, 1, 1)
    assert (r.seconds_before_injection, r.seconds_after_injection, r.window_covered, r.status) == (10.0, 30.5, True, "invalid_timestamp|missing_feature|duplicate_timestamp")
    assert (got[1].window_covered, got[1].status) == (False, "invalid_timestamp|insufficient_window")


def test_reconcile_sees_disagreement(spark):
    count = lambda n, share: spark.createDataFrame([(0, n, share)], "case_no long, span_count long, share double")
    structure, roots = spark.createDataFrame([(0, 5)], "case_no long, unique_span_count long"), spark.createDataFrame([(0, 2)], "case_no long, unique_root_span_count long")
    r = traces.reconcile(roots, count(2, 1.0), structure, count(5, 1.0)).first()
    assert r.roots_agree and r.spans_agree and r.shares_valid
    r = traces.reconcile(roots, count(3, 0.9), structure, count(4, 1.0)).first()
    assert not r.roots_agree and not r.spans_agree and not r.shares_valid


def test_leaks_by_configuration(spark):
    values = {"metric__a_cpu__m": (1.0, 2.0, 3.0), "log__a__error__m": (2.0, 1.0, 5.0), "svc__depth": (1.0, 1.0, 2.0), "svc__bad": (4.0, 5.0, 6.0)}
    long = spark.createDataFrame([(c, n, v) for n, vs in values.items() for c, v in enumerate(vs)], LONG)
    labels = spark.createDataFrame([(0, 2, 9, 9), (1, 1, 9, 9), (2, 5, 9, 9)], "case_no long, fcw long, sct long, severity_score long")
    audit = spark.createDataFrame([("svc__bad", "rejected"), ("svc__depth", "passed")], "feature_name string, decision string")
    got = {r.config: r for r in features.leakage_audit(long, manifest_of(spark, values), labels, audit).collect()}
    assert (got["E0"].clean, got["E0"].copies) == (True, "")
    assert (got["E1"].clean, got["E1"].copies) == (False, "log__a__error__m == fcw")
    assert got["E3"].rejected == "svc__bad"
    forbidden = manifest_of(spark, ["metric__a_cpu__m"]).unionByName(spark.createDataFrame([("severity", "metric", "E0", "", "", "", "n/a")], MANIFEST))
    told = features.leakage_audit(long.unionByName(spark.createDataFrame([(0, "severity", 1.0)], LONG)), forbidden, labels, audit).where("config = 'E0'").first()
    assert told.forbidden == "severity" and not told.clean


def test_numbers_by_configuration(spark):
    rows = [(0, "metric__a_cpu__m", 1.0), (1, "metric__a_cpu__m", None), (0, "metric__b_cpu__m", float("inf")), (1, "metric__b_cpu__m", 1.0), (0, "log__a__error__m", None), (0, "trace_error__a_Get__m", 2.0), (1, "trace_error__a_Get__m", 2.0)]
    long = spark.createDataFrame(rows, LONG)
    got = {r.config: r for r in features.configuration_quality(long, manifest_of(spark, {n for _, n, _ in rows})).collect()}
    assert (got["E0"].feature_count, got["E0"].infinite_count, got["E0"].missing_cell_count, got["E0"].features_with_missing, got["E0"].valid) == (2, 1, 1, 1, False)
    assert (got["E1"].empty_features, got["E1"].missing_cell_count) == (1, 3)
    assert (got["E2"].constant_features, got["E3"].feature_count) == (1, 4)


def test_tables_with_other_cases(spark):
    of = lambda *cases: spark.createDataFrame([(c,) for c in cases], "case_no long")
    labels = spark.createDataFrame([(0, "Low"), (1, "High"), (2, "Low")], "case_no long, severity string")
    metadata = spark.createDataFrame([(0, "x"), (1, "x"), (1, "x")], "case_no long, scenario string")
    got = {r.table: r for r in features.case_consistency({"a": of(0, 1), "b": of(0, 3)}, labels, metadata, "a").collect()}
    assert got["a"].consistent and (got["a"].case_count, got["a"].group_count, got["a"].n_low, got["a"].n_high) == (2, 1, 1, 1)
    assert (got["b"].missing_cases, got["b"].extra_cases, got["b"].consistent) == (1, 1, False)
    assert (got["labels"].extra_cases, got["metadata"].duplicate_cases) == (1, 1)


def test_merging_a_feature_twice_fails(spark):
    long = spark.createDataFrame([(0, "a__x", 1.0), (1, "a__x", 2.0)], LONG)
    none = spark.createDataFrame([], "feature_name string, decision string")
    with pytest.raises(Exception, match="more than one value"):
        features.merged_features(long, long, long.limit(0), none).collect()


def test_a_set_is_seen_when_it_is_whole(spark, tmp_path, monkeypatch):
    """A reader between two writers, or after one that failed, finds the last whole set; tables nest in the manifest's order."""
    folder = str(tmp_path / "sets")
    names = ["metric__b_cpu__m", "metric__a_cpu__m", "log__a__error__m", "trace_error__a_Get__m", "svc__depth"]
    long = spark.createDataFrame([(c, n, float(c + i)) for c in (3, 1, 2) for i, n in enumerate(names)], LONG)
    rest = (manifest_of(spark, names), spark.createDataFrame([(1, "Low")], "case_no long, severity string"), spark.createDataFrame([(1, "x")], "case_no long, scenario string"))
    with pytest.raises(FileNotFoundError):
        training.read_training(spark, folder, "labels")
    training.write_training(long, *rest, folder)
    tables = {c: training.read_training(spark, folder, f"features_{c}") for c in training.CONFIGS}
    assert tables["E0"].columns == ["case_no", "metric__a_cpu__m", "metric__b_cpu__m"]
    for a, b in zip("E0 E1 E2".split(), "E1 E2 E3".split()):
        assert tables[b].columns[: len(tables[a].columns)] == tables[a].columns and len(tables[b].columns) == len(tables[a].columns) + 1
    assert [r.case_no for r in tables["E3"].collect()] == [1, 2, 3]
    written, seen = [], []
    once = training.wide

    def watched(*args):
        seen.append(training.read_training(spark, folder, "features_E0").agg(F.max("metric__a_cpu__m")).first()[0])
        if written:
            raise OSError("stopped on the way")
        return once(*args)

    monkeypatch.setattr(training, "wide", watched)
    training.write_training(long.withColumn("value", F.col("value") + 100), *rest, folder)
    assert seen == [4.0] * 4
    written.append(True)
    with pytest.raises(OSError):
        training.write_training(long.withColumn("value", F.col("value") + 900), *rest, folder)
    assert training.read_training(spark, folder, "features_E0").agg(F.max("metric__a_cpu__m")).first()[0] == 104.0


def test_manifest_of_written_runs(spark, tmp_path):
    runs = spark.createDataFrame([(0, "a-1", "a", "1"), (1, "b-1", "b", "1")], "case_no long, case_id string, scenario string, run_number string")
    dense = spark.createDataFrame([(0, c, b, None if b == 1 else 1.0) for c in ("x", "y") for b in (-2, -1, 0, 1)], "case_no long, column_name string, bin_index int, value double")
    got = {r.case_no: r for r in training.write_aligned(dense, runs, str(tmp_path / "w")).collect()}
    assert tuple(got[0])[4:] == (4, 2, 2, 2, 2, "valid")
    assert (got[1].row_count, got[1].status) == (0, "alignment_error")


def test_attribution_reports(spark):
    found = spark.createDataFrame([(1, 0, 0, "f", 2.0, 0.2, -0.2), (1, 1, 0, "f", 4.0, 0.4, -0.4), (1, 0, 0, "g", 1.0, -0.1, 0.1), (2, 0, 0, "g", 1.0, 0.3, -0.3)], "case_id long, repeat int, fold int, feature_name string, value double, a double, b double")
    summary = attribution.attribution_summary(found, ["a", "b"])
    r = summary.where("case_id = 1 and feature_name = 'f' and class = 'a'").first()
    assert (round(r["mean"], 6), round(r["std"], 6), r.value) == (0.3, 0.141421, 3.0)
    order = attribution.global_importance(summary, ["a", "b"]).collect()
    assert [(x.feature_name, round(x.a, 6)) for x in order] == [("g", 0.2), ("f", 0.15)]
    top = attribution.top_features(summary, 1).where("class = 'b'").orderBy("case_id").collect()
    assert [(x.feature_name, x.direction) for x in top] == [("f", "lowers"), ("g", "lowers")]


def test_labels_that_break_rules(spark):
    from caselens.operators import labels as L

    schema = "case_id string, scenario string, fault_category string, fcw long, service_tier string, sct long, severity_score long, severity string"
    good = [("a-1", "a", "x", 2, "core", 3, 6, "High"), ("b-1", "b", "x", 1, "edge", 1, 1, "Low")]
    runs = spark.createDataFrame([("a-1", "cpu", "svc0"), ("b-1", "delay", "svc1")], "case_id string, fault_type string, service string")
    assert L.label_violations(spark.createDataFrame(good, schema), runs).count() == 0
    bad = [good[0], good[0], ("a-2", "a", "x", 1, "core", 3, 4, "Low"), ("c-1", "c", None, 1, "edge", 1, 1, "Low")]
    found = {tuple(r) for r in L.label_violations(spark.createDataFrame(bad, schema), runs).collect()}
    assert found == {("repeated_case", "a-1"), ("case_without_label", "b-1"), ("label_without_case", "a-2"), ("label_without_case", "c-1"), ("missing_field", "c-1"), ("score_is_no_product", "a-2"), ("severity_out_of_range", "a-2"), ("mixed_scenario", "a")}
    assert L.policy_violations(runs).count() == 0
    from dataclasses import replace

    assert L.policy_violations(runs.limit(0), L.DEFAULT_POLICY).count() == 0
    broken = L.policy_violations(runs, replace(L.DRIVER_POLICY, categories={"cpu": "idle", "disk": "network"}, tiers={"svc0": "core"}, classes=(("Low", 1, 6), ("High", 6, 9))))
    assert {tuple(r) for r in broken.collect()} == {("unmapped_fault", "delay"), ("unmapped_service", "svc1"), ("weight_not_positive", "cpu"), ("score_in_no_class", "0"), ("score_in_several_classes", "6")}


def test_texts_that_must_be_true_or_false(spark):
    from caselens.functions.predicates import checked_bool

    good = spark.createDataFrame([(" True\t",), ("FALSE",), (None,)], "c string")
    assert [r.c for r in checked_bool(good, "c").collect()] == [True, False, None]
    with pytest.raises(ValueError, match="'maybe', 'yes'"):
        checked_bool(spark.createDataFrame([("yes",), ("maybe",), ("true",), ("yes",)], "c string"), "c")
