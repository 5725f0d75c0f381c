"""Cases by customer: many cases with features, an affected service, a severity and a scenario, from the driver's sales tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .adapters import table


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each customer's lines of a part type, as a service, come to."""
    li, o, p = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    lines = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(p, li["l_partkey"] == p["p_partkey"])
    own = lambda odd: F.max(F.when(F.col("l_suppkey") % 2 == odd, F.round(100 * F.col("l_tax")).cast("long")))
    return lines.groupBy(F.col("o_custkey").alias("case_id"), F.concat(F.lower("p_type"), F.lit("service")).alias("service")).agg(
        F.count("*").alias("lines"), F.round(F.sum("l_quantity")).cast("long").alias("quantity"), F.sum(F.round(100 * F.col("l_discount")).cast("long")).alias("discount"),
        F.count_if(F.col("l_returnflag") == "R").alias("returned"), own(0).alias("get"), own(1).alias("put"),
    )


def cases(cells_: DataFrame) -> DataFrame:
    """(case_id, scenario, service, y): the service with most lines, and a severity by its mean discount."""
    most = cells_.groupBy("case_id").agg(F.min(F.struct((-F.col("lines")).alias("m"), "service", "discount")).alias("x"))
    mean = F.col("x.discount") / -F.col("x.m")
    y = F.when(mean < 4.5, "Low").when(mean < 5.5, "Medium").otherwise("High")
    return most.select("case_id", F.concat_ws("_", "x.service", (F.col("case_id") % 20).cast("string")).alias("scenario"), F.col("x.service").alias("service"), y.alias("y"))


def features(cells_: DataFrame) -> DataFrame:
    """(case_id, feature_name, value) under the names of incident features; a service that a customer has no lines of leaves gaps."""
    named = lambda kind, rest, value: F.struct(F.concat(F.lit(f"{kind}__"), "service", F.lit(rest)).alias("feature_name"), value.cast("double").alias("value"))
    own = cells_.select("case_id", F.inline(F.array(
        named("metric", "_cpu__zscore_mean", F.col("quantity") / F.col("lines")), named("metric", "_mem__zscore_mean", F.col("discount") / F.col("lines")), named("metric", "_workload__baseline_mean", F.col("lines")),
        named("log", "__error__delta_mean", F.col("returned")), named("trace_latency", "_Get__zscore_max", F.col("get")), named("trace_latency", "_Put_Order__zscore_max", F.col("put")),
    )))
    shared = cells_.groupBy("case_id").agg(F.sum("returned").cast("double").alias("log__all__new_template_count"), F.count_if(F.col("lines") > 8).cast("double").alias("svc__anomalous_service_count"))
    return own.where("value is not null").unionByName(shared.unpivot("case_id", ["log__all__new_template_count", "svc__anomalous_service_count"], "feature_name", "value"))
