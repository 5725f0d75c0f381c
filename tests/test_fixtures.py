"""Edge rules on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from caselens.functions import predicates as P
from caselens.operators import align, features, labels, quality, traces
from caselens.sources.adapters import Grid

SPAN = "case_no long, trace_id string, span_id string, parent_id string, service string, operation string, start_us long, duration double, status double, file_order long"
GRID = Grid(15, 20)


def spans(spark, *rows):
    return traces.typed(spark.createDataFrame([(0, t, s, p, svc, op, at, 1.0, status, i) for i, (t, s, p, svc, op, at, status) in enumerate(rows)], SPAN))


def test_the_first_row_of_a_span_counts(spark):
    s = spans(spark, ("t", "s1", None, "a", "x", 1, 0.0), ("t", "s1", None, "b", "x", 1, 0.0), ("t", "s2", "s1", "a", "x", 2, None))
    assert {(r.span_id, r.service) for r in traces.first_spans(s).collect()} == {("s1", "a"), ("s2", "a")}
    r = traces.structure(s).first()
    assert (r.span_count, r.unique_span_count, r.duplicate_span_id_count) == (3, 2, 1)


def test_blank_ids_are_missing_and_blank_parents_are_roots(spark):
    s = spans(spark, *(("t", f"s{i}", p, "a", "x", 1, 0.0) for i, p in enumerate(("  ", "\t", "", None))), ("t", " \n", "s0", "a", "x", 1, 0.0))
    assert s.where("parent_id is null").count() == 4 and s.where("span_id is null").count() == 1
    assert traces.root_identity(s).first().unique_root_span_count == 4


def test_traces_by_their_roots(spark):
    s = spans(spark, ("a", "1", "x", "s", "o", 1, 0.0), ("b", "2", None, "s", "o", 1, 0.0), ("c", "3", None, "s", "o", 1, 0.0), ("c", "4", " ", "s", "o", 1, 0.0))
    r = traces.root_identity(s).first()
    assert (r.zero_root_trace_count, r.single_root_trace_count, r.multiple_root_trace_count, r.identity_balance_valid) == (1, 1, 1, True)
    assert [x.trace_id for x in traces.traces_without_root(s).collect()] == ["a"]


def test_status_texts(spark):
    got = spark.createDataFrame([(x,) for x in (0.0, 14.0, 14.5, None)], "s double").select(P.status_text(F.col("s")).alias("t"), P.status_category(F.col("s")).alias("c")).collect()
    assert [tuple(r) for r in got] == [("0", "zero"), ("14", "nonzero"), ("14.5", "nonzero"), ("<missing>", "missing")]


def test_bins_of_the_window(spark):
    at = (-300, -0.5, 0, 299.9, 300)
    samples = spark.createDataFrame([(0, "metrics", "metric__a_cpu", int((1000 + t) * 1e6), float(i)) for i, t in enumerate(at)], "case_no long, data_name string, column_name string, ts_us long, value double")
    got = align.in_window(samples, spark.createDataFrame([(0, 1000)], "case_no long, inject_s long"), GRID).orderBy("value").collect()
    assert [(r.bin_index, r.window_type) for r in got] == [(-20, "baseline"), (-1, "baseline"), (0, "incident"), (19, "incident")]


def test_one_gap_empties_a_cell(spark):
    w = spark.createDataFrame([(0, "metrics", "metric__a_cpu", 1.0, 3), (0, "metrics", "metric__a_cpu", None, 3), (0, "logs", "log__a_1", 2.0, 3), (0, "logs", "log__a_1", 4.0, 3)], "case_no long, data_name string, column_name string, value double, bin_index int")
    assert {r.column_name: (r.value, r.sample_count) for r in align.align(w).collect()} == {"metric__a_cpu": (None, 2), "log__a_1": (6.0, 2)}


def filled(spark, column, values):
    rows = [(0, column, i, v) for i, v in enumerate(values)]
    return [r.filled for r in align.fill(spark.createDataFrame(rows, "case_no long, column_name string, bin_index int, value double")).orderBy("bin_index").collect()]


def test_gaps(spark):
    n = None
    assert filled(spark, "metric__a_cpu", [n, n, n, 1.0, n, 3.0, n, n, n]) == [n, 1.0, 1.0, 1.0, 2.0, 3.0, 3.0, 3.0, n]
    assert filled(spark, "log__a__error", [n, 2.0, n]) == [0.0, 2.0, 0.0]


def test_columns_that_a_case_lacks(spark):
    """Case 0 has a gauge and a count that case 1 lacks; a gauge of one case in three goes; the sum of two log ids of one meaning is one column."""
    cells = [(c, "metrics", n, b, 1.0, 1) for c, n in ((0, "metric__a_cpu"), (1, "metric__b_cpu"), (2, "metric__a_cpu"), (0, "metric__a_error"), (0, "metric__c_mem"), (1, "metric__b_error")) for b in (-1, 0)]
    cells += [(c, "logs", n, 0, 2.0, 1) for c in (0, 1, 2) for n in ("log__a_1", "log__a_2")]
    aligned = spark.createDataFrame(cells, "case_no long, data_name string, column_name string, bin_index int, value double, sample_count long")
    dictionary = spark.createDataFrame([(c, k, "request failed") for c in range(3) for k in (1, 2)], "case_no long, cluster_id long, template string")
    harmonised = align.harmonise(aligned, dictionary)
    assert {r.value for r in harmonised.where("column_name = 'log__a__error'").collect()} == {4.0}
    schema = align.feature_schema(harmonised)
    got = [(r.column_name, r.keep, r.drop_reason) for r in schema.orderBy("position").collect()]
    low = "gauge_coverage_below_threshold"
    assert got == [("metric__a_cpu", True, ""), ("metric__a_error", True, ""), ("metric__b_cpu", False, low), ("metric__b_error", True, ""), ("metric__c_mem", False, low), ("log__a__error", True, "")]
    cases = spark.createDataFrame([(0,), (1,)], "case_no long")
    out = align.fill(align.complete(harmonised, schema, cases, GRID)).cache()
    assert out.count() == 2 * 4 * 40
    log = {(r.case_no, r.column_name): r for r in align.cleaning_log(out).collect()}
    gauge, count = log[1, "metric__a_cpu"], log[1, "metric__a_error"]
    assert (gauge.column_absent_in_run, gauge.missing_before, gauge.method, gauge.filled_count, gauge.missing_after) == (True, 40, "linear_interpolate_edge_fill", 0, 40)
    assert (count.column_absent_in_run, count.missing_before, count.method, count.filled_count, count.missing_after) == (True, 40, "zero_fill", 40, 0)
    assert not log[0, "metric__a_cpu"].column_absent_in_run and (0, "metric__b_cpu") not in log
    valid = {r.case_no: r for r in align.validate_cleaned(out, schema, cases, GRID).collect()}
    assert all(r.valid and r.column_count == 4 for r in valid.values())
    broken = out.where("not (case_no = 0 and column_name = 'metric__a_cpu') and not (case_no = 1 and bin_index = 3 and column_name = 'metric__a_error')")
    broken = broken.unionByName(out.where("case_no = 0 and column_name = 'metric__a_cpu'").withColumn("column_name", F.lit("metric__z_cpu")))
    broken = broken.withColumn("filled", F.when((F.col("case_no") == 0) & (F.col("column_name") == "log__a__error"), None).otherwise(F.col("filled")))
    r = {x.case_no: x for x in align.validate_cleaned(broken, schema, cases, GRID).collect()}
    assert (r[0].lacking_columns, r[0].extra_columns, r[0].zero_policy_gaps, r[0].valid) == (1, 1, 1, False)
    assert (r[1].lacking_columns, r[1].wrong_bin_columns, r[1].valid) == (0, 1, False)


def statistics(spark, baseline, incident):
    rows = [(0, "c", i - len(baseline), v) for i, v in enumerate(baseline)] + [(0, "c", i, v) for i, v in enumerate(incident)]
    return align.feature_statistics(spark.createDataFrame(rows, "case_no long, column_name string, bin_index int, filled double")).first()


def test_z_of_constant_and_narrow_baselines(spark):
    for incident, z in ((5.0, 0.0), (6.0, 100.0), (4.0, -100.0), (None, None)):
        assert statistics(spark, [5.0] * 3, [incident] * 2).zscore_mean == z
    assert statistics(spark, [5.0, 5.000001], [9.0]).zscore_max == 100.0
    assert statistics(spark, [0.1] * 20, [0.1]).zscore_mean == 0.0
    assert statistics(spark, [None], [1.0]).zscore_mean is None


def test_lifecycle_before_error(spark):
    assert spark.range(1).select(P.template_category(F.lit("initializing, peers unavailable")).alias("c")).first().c == "lifecycle"


def test_services_of_trace_names(spark):
    names = {"trace_latency__checkoutservice_Place_Order__zscore_mean": "checkoutservice", "trace_error__cart_Get": "cart", "trace_latency__checkoutservice_PlaceOrder": "checkoutservice"}
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", P.trace_service(F.col("n")).alias("s")).collect()
    assert {r.n: r.s for r in got} == names


def test_client_calls(spark):
    at = 1000
    s = spans(spark, ("t", "1", None, "frontend", "shop.Cart/Get", at, 0.0), ("t", "2", "1", "cart", "shop.Cart/Get", at, 0.0), ("t", "3", "1", "cart", "other", at, 0.0))
    got = traces.call_volume(s, spark.createDataFrame([(0, at)], "case_no long, inject_us long"), 10).collect()
    assert [tuple(r) for r in got] == [(0, "frontend", "cart", 0, 1)]


def test_anomaly_rule(spark):
    rows = [("a", 3.1, 1.0, 0.6), ("b", 3.1, 1.0, 0.4), ("c", 0.5, 0.0, 1.0), ("d", None, 0.0, 1.0)]
    stats = spark.createDataFrame([(0, f"trace_latency__{s}_Place_Order", z, b, d) for s, z, b, d in rows], "case_no long, column_name string, zscore_mean double, baseline_mean double, delta_mean double")
    assert {r.service: r.magnitude for r in traces.service_anomalies(stats).collect()} == {"a": 3.1, "b": 0.0, "c": 0.5, "d": 0.0}


@pytest.mark.parametrize("edges, hot, depth", [
    ("ab bc ca", "abc", 3), ("ab", "abc", 2), ("ab ba", "abcd", 2), ("ab bc cd da ac", "abcd", 4), ("ab bc ce", "abe", 2), ("aa", "a", 1), ("", "a", 1), ("ab", "", 0), ("ab ac bd cd de ef fd", "abcdef", 5),
])
def test_longest_simple_chain(spark, edges, hot, depth):
    graph = spark.createDataFrame([tuple(e) for e in edges.split()] or [("x", "y")], "caller string, callee string")
    found = spark.createDataFrame([(0, "trace_latency", s, 1.0) for s in hot] + [(0, "trace_latency", "z", 0.0)], "case_no long, modality string, service string, magnitude double")
    assert traces.propagation_depth(found, graph).first().depth == depth


def test_volume_that_only_rises(spark):
    v = spark.createDataFrame([(0, "a", "b", 10, 15), (0, "a", "c", 10, 20), (1, "a", "b", 0, 4)], "case_no long, caller string, callee string, baseline_calls long, incident_calls long")
    got = {r.case_no: (r.edge_drop_share, r.max_drop, r.total_change) for r in traces.call_volume_change(v).collect()}
    assert got == {0: (0.0, -0.5, 0.75), 1: (0.0, 0.0, 0.0)}


def test_severity(spark):
    runs = spark.createDataFrame([(0, "svc0_delay-1", "svc0_delay", "svc0", "delay"), (1, "svc1_cpu-1", "svc1_cpu", "svc1", "cpu")], "case_no long, case_id string, scenario string, service string, fault_type string")
    assert {r.case_id: (r.severity_score, r.severity) for r in labels.severity_labels(runs).collect()} == {"svc0_delay-1": (6, "High"), "svc1_cpu-1": (1, "Low")}
    shop = spark.createDataFrame([(0, "a", "a", "checkoutservice", "delay"), (1, "b", "b", "emailservice", "cpu")], runs.schema)
    assert {r.case_id: (r.severity, r.label_status) for r in labels.severity_labels(shop, labels.DEFAULT_POLICY).collect()} == {"a": ("High", "candidate"), "b": ("Low", "candidate")}
    with pytest.raises(Exception, match="no label for"):
        labels.severity_labels(runs, labels.DEFAULT_POLICY).collect()


def test_coverage_is_closed_and_series_need_not_cover(spark):
    runs = spark.createDataFrame([(c, f"c{c}", 1000) for c in (0, 1, 2)], "case_no long, case_id string, inject_s long")
    at = [(0, 700), (0, 1300), (1, 701), (1, 1300), (2, 700), (2, 1300)]
    samples = spark.createDataFrame([(c, "logs", "log__a_1", t * 1_000_000, 1.0) for c, t in at], "case_no long, data_name string, column_name string, ts_us long, value double")
    q = quality.timeseries_quality(samples, runs, 300)
    assert {r.case_no: r.window_covered for r in q.collect()} == {0: True, 1: False, 2: True}
    ranges = spark.createDataFrame([(0, True), (1, True), (2, False)], "case_no long, trace_covered boolean")
    assert {r.case_no: (r.eligible, r.reason) for r in quality.eligibility(q, ranges, runs).collect()} == {0: (True, ""), 1: (True, ""), 2: (False, "trace_window_incomplete")}
    assert {r.case_no: r.reason for r in quality.eligibility(q, ranges, runs, True).collect()} == {0: "", 1: "timeseries_window_incomplete[logs]", 2: "trace_window_incomplete"}


def test_verdict_of_empty_bins(spark):
    rows = [(0, "logs", "incident", 3), (0, "metrics", "incident", 4), (0, "metrics", "baseline", 2), (1, "logs", "baseline", 0)]
    bins = spark.createDataFrame([(c, d, w, e, e / 20, e > 2) for c, d, w, e in rows], "case_no long, data_name string, window_type string, empty_bins int, ratio double, excluded boolean")
    assert {r.case_no: (r.eligible, r.exclusion_reason) for r in align.bin_verdict(bins).collect()} == {0: (False, "metrics_incident_missing_ratio=0.20|logs_incident_missing_ratio=0.15"), 1: (True, "")}


def test_leaking_copies(spark):
    lab = spark.createDataFrame([(c, 1 + c, 9, 3) for c in range(3)], "case_no long, fcw long, sct long, severity_score long")
    long = spark.createDataFrame([(c, "copy", 1.0 + c) for c in range(3)] + [(c, "gap", None if c == 1 else 1.0 + c) for c in range(3)], "case_no long, feature_name string, value double")
    assert {(r.feature_name, r.ingredient) for r in features.leakage(long, lab).where("copies").collect()} == {("copy", "fcw")}


def test_streaks_across_segments(spark):
    """Gaps by time: two before a border and three after it are five; values go before gaps of one time; rows without a time are last."""
    gaps = {0: "vv", 3598: "g", 3599: "g", 3600: "g", 3601: "g", 3602: "g", 3603: "vg", 7300: "g", 7301: "v", 99999: "g"}
    rows = [(0, "logs", "c", t * 1_000_000, 1.0 if k == "v" else None) for t, ks in gaps.items() for k in ks] + [(0, "logs", "c", None, None)] * 3 + [(0, "logs", "whole", t * 1_000_000, None) for t in range(0, 20000, 500)]
    s = spark.createDataFrame(rows, "case_no long, data_name string, column_name string, ts_us long, value double")
    runs = spark.createDataFrame([(0, 3600)], "case_no long, inject_s long")
    for width in (1, 60, 3600, 10**6):
        got = {r.column_name: r for r in quality.missing_by_column(s, runs, width).collect()}
        c = got["c"]
        assert (c.longest_missing_streak, c.missing_count, c.missing_before_injection, c.missing_after_injection, c.missing_on_invalid_timestamp) == (5, 11, 2, 6, 3), width
        assert got["whole"].longest_missing_streak == 40
