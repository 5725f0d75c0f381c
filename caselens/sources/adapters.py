"""The driver's tables as incident telemetry: runs, samples, log templates, spans and labels' policies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = 86400
FIRST_INJECTION = 1704585600  # 2024-01-07 UTC


@dataclass(frozen=True)
class Grid:
    """Bins around the injection: `interval` seconds each, `half` before it and `half` from it on."""

    interval: int = 6 * 3600
    half: int = 20

    def __post_init__(self):
        if self.interval <= 0 or self.half <= 0:
            raise ValueError("interval and half must be positive")

    @property
    def reach(self) -> int:
        return self.interval * self.half


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def runs(spark: SparkSession) -> DataFrame:
    """One row a case; the size is fixed (8), so joins may broadcast it."""
    n = F.col("case_no")
    fault = F.when(n % 4 < 2, "cpu").otherwise("delay")
    service = F.concat(F.lit("svc"), F.floor(n / 4).cast("string"))
    inject = F.when(n == 7, FIRST_INJECTION + 20 * DAY).otherwise(FIRST_INJECTION + 2 * DAY * n)
    base = spark.range(8).select(F.col("id").alias("case_no")).select("case_no", service.alias("service"), fault.alias("fault_type"), (n % 2 + 1).cast("string").alias("run_number"), inject.cast("long").alias("inject_s"))
    scenario = F.concat_ws("_", "service", "fault_type")
    return base.withColumn("scenario", scenario).withColumn("case_id", F.concat_ws("-", "scenario", "run_number"))


#: A column that is filled by zeros, and a gauge, each of which one case doesn't have.
ABSENT = ((5, "metric__svc1_error"), (6, "trace_latency__svc0_Put"))


def samples(spark: SparkSession, sf_dir: str, lacking: tuple[tuple[int, str], ...] = ABSENT) -> DataFrame:
    """(case_no, data_name, column_name, ts_us, value), long form, without the columns that cases are made to lack; the filter and columns reach the scan."""
    k = F.get_json_object("props", "$.k").cast("long")
    kind = F.col("event_type")
    operation = F.when(F.col("k") % 4 < 2, "Get").otherwise("Put")
    data_name = F.when(kind.isin("view", "error"), "metrics").when(kind == "click", "logs").when(kind == "purchase", "trace_latency").otherwise("trace_error")
    prefix = F.when(kind.isin("view", "error"), "metric").when(kind == "click", "log").when(kind == "purchase", "trace_latency").otherwise("trace_error")
    suffix = F.when(kind == "view", "cpu").when(kind == "error", "error").when(kind == "click", (F.col("k") % 3).cast("string")).otherwise(operation)
    e = table(spark, sf_dir, "events").where(kind.isin("view", "error", "click", "purchase", "signup"))
    e = e.select((F.col("user_id") % 8).alias("case_no"), "event_type", micros("ts").alias("ts_us"), "value", k.alias("k"))
    name = F.concat(prefix, F.lit("__svc"), (F.col("k") % 2).cast("string"), F.lit("_"), suffix)
    out = e.select("case_no", data_name.alias("data_name"), name.alias("column_name"), "ts_us", F.when(F.col("k") % 23 != 0, F.nanvl("value", F.lit(None))).alias("value"))
    # headers differ by run: two cases lack a column that others have
    absent = F.lit(False)
    for case, column in lacking:
        absent = absent | ((F.col("case_no") == case) & (F.col("column_name") == column))
    return out.where(~absent)


FIRST_SPAN_INJECTION = 899_251_200_000_000  # 1998-07-01 UTC, in microseconds


def span_injections(spark: SparkSession) -> DataFrame:
    """(case_no, inject_us) in the time of the spans' table: a week after another."""
    return runs(spark).select("case_no", (F.col("case_no") * 7 * DAY * 1_000_000 + FIRST_SPAN_INJECTION).alias("inject_us"))


#: Log templates by what the cluster id of a case means.
TEMPLATES = ("server initializing on port", "request failed with error code", "handled request in time")


def clusters(spark: SparkSession) -> DataFrame:
    """(case_no, cluster_id, template): a cluster id means another template in another case."""
    t = F.array(*map(F.lit, TEMPLATES))
    base = spark.range(24).select(F.floor(F.col("id") / 3).alias("case_no"), (F.col("id") % 3).alias("cluster_id"))
    return base.withColumn("template", F.element_at(t, ((F.col("cluster_id") + F.col("case_no")) % 3 + 1).cast("int")))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw spans of all cases with the total order that stands for file order."""
    li, o, p = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    total = p.agg(F.count("*")).scalar()
    callee = p.select(F.col("p_partkey").alias("callee_key"), F.upper("p_type").alias("callee_type"))
    own = p.select("p_partkey", F.concat(F.lower("p_type"), F.lit("service")).alias("service"))
    s = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(own, F.col("l_partkey") == F.col("p_partkey")).join(callee, (F.col("l_suppkey") * 7) % total == F.col("callee_key"))
    n, key = F.col("l_linenumber"), F.col("l_orderkey").cast("string")
    parent = F.when((n == 1) | (F.col("l_partkey") % 40 == 0), F.lit(None)).when(n == 5, "  ").otherwise(F.concat(key, F.lit("-"), (n - 1).cast("string")))
    order = F.struct("o_orderdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    return s.select(
        (F.col("o_custkey") % 8).alias("case_no"), key.alias("trace_id"), F.concat(key, F.lit("-"), n.cast("string")).alias("span_id"), parent.alias("parent_id"), "service",
        F.concat(F.lit("shop."), "callee_type", F.lit("Service/Get")).alias("operation"), micros("o_orderdate").alias("start_us"), F.col("l_quantity").alias("duration"),
        F.when(F.col("l_suppkey") % 11 == 0, F.lit(None)).when(F.col("l_returnflag") == "R", 14.0).otherwise(0.0).alias("status"), order.alias("file_order"),
    )
