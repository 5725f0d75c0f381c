"""Rules on rows in which a wrong reading of them shows."""

import pytest
from pyspark.sql import functions as F

from caselens.functions import predicates as P
from caselens.operators import align, features, quality, traces


def test_families(spark):
    want = {
        "metric__cart_cpu": "continuous_resource", "metric__cart_mem": "continuous_resource", "metric__cart_socket": "continuous_resource", "metric__cart_diskio": "disk_activity", "metric__cart_error": "error_signal",
        "metric__cart_workload": "workload_signal", "metric__cart_latency-50": "latency_signal", "log__cart_3": "log_count", "trace_latency__cart_Get": "trace_latency", "trace_error__cart_Get": "trace_error",
    }
    got = spark.createDataFrame([(c,) for c in want], "c string").withColumn("f", P.feature_family(F.col("c"))).withColumn("p", P.fill_policy(F.col("f"))).collect()
    assert {r.c: r.f for r in got} == want
    assert {r.f for r in got if r.p == "zero"} == {"disk_activity", "error_signal", "log_count", "trace_error"}
    with pytest.raises(Exception, match="unknown column"):
        spark.createDataFrame([("metric__cart_other",)], "c string").select(P.feature_family(F.col("c"))).collect()


def test_template_categories(spark):
    rows = [("Tracing enabled, errors are sent", "lifecycle"), ("connection refused", "error"), ("bad statusCode 14", "error"), ("got a request", "routine"), ("server starting", "routine")]
    assert [r.c for r in spark.createDataFrame(rows, "t string, w string").select(P.template_category(F.col("t")).alias("c")).collect()] == [w for _, w in rows]


def test_absent_rows_are_missing_values(spark):
    long = spark.createDataFrame([(0, "a", 1.0), (1, "a", 1.0), (0, "b", 1.0), (0, "c", 1.0), (1, "c", None), (0, "d", 1.0), (1, "d", 2.0)], "case_no long, feature_name string, value double")
    assert {r.feature_name: (r.missing_count, r.constant) for r in align.constant_features(long).collect()} == {"a": (0, True), "b": (1, False), "c": (1, False), "d": (0, False)}
    assert {r.feature_name: r.missing_count for r in features.numeric_quality(long).collect()} == {"a": 0, "b": 1, "c": 1, "d": 0}
    labels = spark.createDataFrame([(0, 1, 1, 1), (1, 1, 1, 1)], "case_no long, fcw long, sct long, severity_score long")
    assert {r.feature_name for r in features.leakage(long, labels).where("copies").collect()} == {"a"}


def test_columns_of_one_row_are_no_duplicates(spark):
    runs = spark.createDataFrame([(0, 10)], "case_no long, inject_s long")
    rows = [(0, "metrics", c, t * 1_000_000, 1.0) for c in ("metric__x_cpu", "metric__x_mem") for t in range(20)]
    schema = "case_no long, data_name string, column_name string, ts_us long, value double"
    assert quality.timeseries_quality(spark.createDataFrame(rows, schema), runs, 5).first().duplicate_timestamp_count == 0
    assert quality.timeseries_quality(spark.createDataFrame([*rows, rows[3]], schema), runs, 5).first().duplicate_timestamp_count == 1


def test_service_anomalies(spark):
    # (z mean, z max, baseline mean, delta mean): anomalous by means alone
    rows = [("trace_latency__a_Get", 4.0, 9.0, 1.0, 1.0), ("trace_latency__b_Get", 2.0, 9.0, 1.0, 1.0), ("trace_latency__c_Get", 4.0, 9.0, 1.0, 0.2), ("trace_error__d_Get", 2.0, 9.0, 0.0, 1.0), ("trace_error__e_Get", None, 9.0, 0.0, 1.0), ("trace_error__health_Get", 9.0, 9.0, 0.0, 1.0)]
    stats = spark.createDataFrame([(0, *r) for r in rows], "case_no long, column_name string, zscore_mean double, zscore_max double, baseline_mean double, delta_mean double")
    got = {(r.modality, r.service): r.magnitude for r in traces.service_anomalies(stats).collect()}
    assert got == {("trace_latency", "a"): 4.0, ("trace_latency", "b"): 0.0, ("trace_latency", "c"): 0.0, ("trace_error", "d"): 2.0, ("trace_error", "e"): 0.0}


def test_a_feature_without_configuration_or_label_fails(spark):
    long = spark.createDataFrame([(0, "other__x__mean", 1.0)], "case_no long, feature_name string, value double")
    with pytest.raises(Exception, match="no configuration"):
        features.feature_manifest(long, spark.createDataFrame([], "feature_name string, audit_status string")).collect()
    with pytest.raises(Exception, match="no label"):
        features.aligned_labels(long, spark.createDataFrame([(1, "Low")], "case_no long, severity string")).collect()


def test_service_context_chain(spark):
    """a -> b -> c are anomalous in case 0, d isn't; in case 1 only d; in case 2 nothing is; in case 3 b and e call each other."""
    from caselens.operators import traces

    hot = {0: "abc", 1: "d", 2: "", 3: "be"}
    rows = [(case, "trace_latency", s, 4.0 if s in names else 0.0) for case, names in hot.items() for s in "abcde"] + [(0, "trace_error", "d", 2.0)]
    anomalies = spark.createDataFrame(rows, "case_no long, modality string, service string, magnitude double")
    graph = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("b", "e"), ("e", "b")], "caller string, callee string")
    volume = spark.createDataFrame([(0, "a", "b", 10, 5), (0, "b", "c", 0, 4)], "case_no long, caller string, callee string, baseline_calls long, incident_calls long")
    assert {r.case_no: r.depth for r in traces.propagation_depth(anomalies, graph).collect()} == {0: 3, 1: 1, 2: 0, 3: 2}
    assert {tuple(r) for r in traces.anomalous_edges(anomalies, graph).collect()} == {(0, "a", "b"), (0, "b", "c"), (3, "b", "e"), (3, "e", "b")}
    got = {r.case_no: {k.removeprefix("svc__"): v for k, v in r.asDict().items()} for r in traces.service_context(anomalies, graph, volume, "a").collect()}
    want = {"case_no": 0, "anomalous_service_count": 3, "anomalous_service_share": 0.6, "latency_anomaly_magnitude": 12.0, "error_service_count": 1, "anomalous_edge_count": 2, "anomalous_edge_share": 0.4, "propagation_depth": 3, "anomalous_root_count": 1,
            "contagion_ratio": (1 + 2 / 3 + 1 / 2) / 3, "frontend_anomalous": 1, "max_in_degree_anomalous": 2, "max_out_degree_anomalous": 2, "call_volume_drop_share": 0.5, "call_volume_max_drop": 0.5, "call_volume_total_change": -0.1}
    assert got[0] == want and got[2]["contagion_ratio"] == 0 and got[2]["max_in_degree_anomalous"] == 0 and got[3]["anomalous_root_count"] == 0
