"""File sources on hand-made run folders: different headers, gaps, defects."""

import json

import pytest

from caselens.sources import files as S

SPANS = "time,traceID,spanID,serviceName,methodName,operationName,startTimeMillis,startTime,duration,statusCode,parentSpanID\n"


@pytest.fixture
def root(tmp_path):
    for n, (scenario, service) in enumerate([("cart_service_cpu", "cart"), ("pay_delay", "pay")]):
        run = tmp_path / scenario / "1"
        run.mkdir(parents=True)
        for f in S.SERIES:
            (run / f).write_text(f"time,{service}_cpu,{service}_mem\n100,1.5,\n200,{n},7\n")
        (run / "traces.csv").write_text(SPANS + "x,t1,s1,a,m,o,1000,1,5,14,\nx,t1,s2,a,m,o,bad,1,x,,s1\n")
        (run / "cluster_info.json").write_text(json.dumps({"12": {"template": f"started {n}", "container": ["c"]}}))
        (run / "inject_time.txt").write_text("150\n")
    return tmp_path


def test_reads_all_runs(spark, root):
    meta = sorted(tuple(r) for r in S.run_metadata(spark, str(root)).collect())
    assert meta == [("cart_service_cpu-1", "cart_service_cpu", "cart_service", "cpu", "1"), ("pay_delay-1", "pay_delay", "pay", "delay", "1")]
    rows = S.timeseries(spark, str(root), "simple_metrics.csv").selectExpr("case_id", "column_name", "unix_seconds(ts) t", "value").collect()
    assert sorted(map(tuple, rows), key=repr) == sorted([("cart_service_cpu-1", "metric__cart_cpu", 100, 1.5), ("cart_service_cpu-1", "metric__cart_mem", 100, None), ("cart_service_cpu-1", "metric__cart_cpu", 200, 0.0), ("cart_service_cpu-1", "metric__cart_mem", 200, 7.0), ("pay_delay-1", "metric__pay_cpu", 100, 1.5), ("pay_delay-1", "metric__pay_mem", 100, None), ("pay_delay-1", "metric__pay_cpu", 200, 1.0), ("pay_delay-1", "metric__pay_mem", 200, 7.0)], key=repr)
    spans = S.spans(spark, str(root)).where("case_id = 'pay_delay-1'").selectExpr("spanID", "unix_millis(ts)", "duration", "statusCode", "parentSpanID").collect()
    assert sorted(map(tuple, spans)) == [("s1", 1000, 5, 14.0, None), ("s2", None, None, None, "s1")]
    assert sorted((r.case_id, r.cluster_id, r.template) for r in S.cluster_info(spark, str(root)).collect()) == [("cart_service_cpu-1", "12", "started 0"), ("pay_delay-1", "12", "started 1")]
    valid = S.validate_loaded(S.timeseries(spark, str(root), "logts.csv"), S.inject_time(spark, str(root)))
    assert {r.valid for r in valid.collect()} == {True}
    assert S.validate_files(spark, str(root)).count() == 0


def test_findings(spark, root):
    run = root / "pay_delay" / "1"
    (run / "logts.csv").unlink()
    (run / "tracets_err.csv").write_text("")
    (run / "tracets_lat.csv").write_text("time\n1\n")
    (run / "simple_metrics.csv").write_text("a,b\n1,2\n")
    (run / "traces.csv").write_text("time,traceID\n")
    (run / "inject_time.txt").write_text("-3\n")
    found = {(r.file, r.finding.split(":")[0]) for r in S.validate_files(spark, str(root)).collect()}
    assert found == {("logts.csv", "missing or empty"), ("tracets_err.csv", "missing or empty"), ("tracets_lat.csv", "no feature"), ("simple_metrics.csv", "no time column"), ("traces.csv", "missing columns"), ("inject_time.txt", "no positive integer")}
    want = spark.createDataFrame([("pay_delay", "1"), ("pay_delay", "2")], "scenario string, run_number string")
    runs = {tuple(r) for r in S.discover(S.run_metadata(spark, str(root)), want).collect()}
    assert runs == {("pay_delay", "2", "missing"), ("cart_service_cpu", "1", "extra")}


def test_bad_number_fails(spark, root):
    (root / "pay_delay" / "1" / "logts.csv").write_text("time,a\n1,x\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        S.timeseries(spark, str(root), "logts.csv").collect()


def test_sinks(spark, root, tmp_path):
    df = S.run_metadata(spark, str(root))
    S.write_partitioned(df, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    S.write_report(df, str(tmp_path / "report"), "case_id")
    assert [r.case_id for r in spark.read.option("header", "true").csv(str(tmp_path / "report")).collect()] == ["cart_service_cpu-1", "pay_delay-1"]
