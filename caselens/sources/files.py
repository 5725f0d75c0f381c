"""Run folders `<scenario>/<run>/<file>` as tables, all runs at once, and the reports that jobs leave.

A row's case comes from its file's path. Files may have different headers: wide series are
read as text and joined with their own header line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The files of a run.
SERIES = {"simple_metrics.csv": "metrics", "logts.csv": "logs", "tracets_lat.csv": "trace_latency", "tracets_err.csv": "trace_error"}
FILES = (*SERIES, "traces.csv", "cluster_info.json", "inject_time.txt")
SPAN_SCHEMA = "time string, traceID string, spanID string, serviceName string, methodName string, operationName string, startTimeMillis string, startTime string, duration string, statusCode string, parentSpanID string"


def with_case(df: DataFrame, path: Column | None = None) -> DataFrame:
    """Adds scenario, service, fault_type, run_number and case_id; a scenario is split at its last underscore."""
    path = F.col("_metadata.file_path") if path is None else path
    part = lambda k: F.regexp_extract(path, "([^/]+)/([^/]+)/[^/]+$", k)
    out = df.withColumns({"scenario": part(1), "run_number": part(2)})
    split = lambda k: F.regexp_extract("scenario", "^(.*)_([^_]+)$", k)
    return out.withColumns({"service": split(1), "fault_type": split(2), "case_id": F.concat_ws("-", "scenario", "run_number")})


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(case columns, file, length) of all files, without their content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    return with_case(files, F.col("path")).withColumn("file", F.regexp_extract("path", "([^/]+)$", 1)).drop("path")


def run_metadata(spark: SparkSession, root: str) -> DataFrame:
    return listing(spark, root).select("case_id", "scenario", "service", "fault_type", "run_number").distinct()


def discover(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Runs (scenario, run_number) that are missing (an error) or extra (a warning)."""
    keys = ["scenario", "run_number"]
    missing = expected.select(keys).join(found, keys, "left_anti").withColumn("finding", F.lit("missing"))
    return missing.unionByName(found.select(keys).join(expected, keys, "left_anti").withColumn("finding", F.lit("extra")))


def _lines(spark: SparkSession, root: str, file: str) -> DataFrame:
    return with_case(spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", file).text(root).select("value", "_metadata"))


def headers(spark: SparkSession, root: str, file: str) -> DataFrame:
    """(case_id, names): each file's first line, which is the one that starts with the `time` column."""
    return _lines(spark, root, file).where(F.trim("value").rlike("^time(,|$)")).groupBy("case_id").agg(F.split(F.trim(F.first("value")), ",").alias("names"))


def timeseries(spark: SparkSession, root: str, file: str) -> DataFrame:
    """(case_id, data_name, column_name, ts, value), long; an empty cell is missing and a bad number is an error."""
    rows = _lines(spark, root, file).where(~F.trim("value").rlike("^time(,|$)") & (F.trim("value") != "")).select("case_id", F.split(F.trim("value"), ",").alias("cells"))
    j = rows.join(headers(spark, root, file), "case_id")
    long = j.select("case_id", F.element_at("cells", 1).alias("time"), F.posexplode("names").alias("k", "name"), "cells").where("k > 0")
    cell = F.get("cells", F.col("k"))
    value = F.nullif(F.trim(cell), F.lit("")).cast("double")
    name = F.concat(F.lit({"metrics": "metric", "logs": "log"}.get(SERIES[file], SERIES[file])), F.lit("__"), "name")
    return long.select("case_id", F.lit(SERIES[file]).alias("data_name"), name.alias("column_name"), F.timestamp_seconds(F.nullif(F.trim("time"), F.lit("")).cast("long")).alias("ts"), value.alias("value"))


def spans(spark: SparkSession, root: str) -> DataFrame:
    """Raw spans of all runs; ids stay text, and numbers that can't be read are missing."""
    raw = spark.read.schema(SPAN_SCHEMA).option("header", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "traces.csv").csv(root)
    number = lambda c, t: F.expr(f"try_cast({c} as {t})").alias(c)
    cased = with_case(raw.select("*", "_metadata"))
    return cased.select("case_id", "traceID", "spanID", "parentSpanID", "serviceName", "methodName", "operationName", F.timestamp_millis(F.expr("try_cast(startTimeMillis as bigint)")).alias("ts"), number("startTime", "bigint"), number("duration", "bigint"), number("statusCode", "double"))


def cluster_info(spark: SparkSession, root: str) -> DataFrame:
    """(case_id, cluster_id, template, container) of each run's dictionary; what is no object, or empty, is an error."""
    text = with_case(spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "cluster_info.json").text(root).select("value", "_metadata"))
    m = F.from_json("value", "map<string,struct<template:string,container:array<string>>>")
    checked = F.when(F.coalesce(F.size(m), F.lit(0)) < 1, F.raise_error(F.concat(F.lit("no log dictionary in "), "case_id"))).otherwise(m)
    return text.select("case_id", F.explode(checked).alias("cluster_id", "x")).select("case_id", "cluster_id", "x.template", "x.container")


def inject_time(spark: SparkSession, root: str) -> DataFrame:
    """(case_id, inject_s); null where the file holds no positive integer."""
    t = F.expr("try_cast(trim(value) as bigint)")
    return _lines(spark, root, "inject_time.txt").where(F.trim("value") != "").select("case_id", F.when(t > 0, t).alias("inject_s"))


def validate_files(spark: SparkSession, root: str) -> DataFrame:
    """(case_id, file, finding), one row a defect: missing or empty, no time column, no feature, missing span columns, bad injection.

    Spark doesn't list files without content, so an empty file and a missing one are one finding.
    """
    have = listing(spark, root)
    want = have.select("case_id").distinct().withColumn("file", F.explode(F.array(*map(F.lit, FILES))))
    good = have.select("case_id", "file")
    out = want.join(good, ["case_id", "file"], "left_anti").withColumn("finding", F.lit("missing or empty"))
    for file in SERIES:
        h = good.where(F.col("file") == file).join(headers(spark, root, file), "case_id", "left")
        finding = F.when(F.col("names").isNull(), "no time column").when(F.size("names") < 2, "no feature")
        out = out.unionByName(h.select("case_id", "file", finding.alias("finding")).where("finding is not null"))
    needed = F.array(*(F.lit(c.split()[0]) for c in SPAN_SCHEMA.split(", ")))
    t = good.where("file = 'traces.csv'").join(headers(spark, root, "traces.csv"), "case_id", "left")
    lacks = F.array_except(needed, F.coalesce("names", F.array().cast("array<string>")))
    out = out.unionByName(t.where(F.size(lacks) > 0).select("case_id", "file", F.concat(F.lit("missing columns: "), F.array_join(lacks, "|")).alias("finding")))
    bad = inject_time(spark, root).where("inject_s is null").select("case_id", F.lit("inject_time.txt").alias("file"), F.lit("no positive integer").alias("finding"))
    return out.unionByName(bad)


def validate_loaded(series: DataFrame, inject: DataFrame) -> DataFrame:
    """For each case and modality: whether its timestamps reach around the injection (closed)."""
    n = series.groupBy("case_id", "data_name").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    at = F.timestamp_seconds("inject_s")
    return n.join(inject, "case_id", "left").select("case_id", "data_name", F.coalesce((F.col("a") <= at) & (at <= F.col("b")), F.lit(False)).alias("valid"))


def write_partitioned(df: DataFrame, path: str) -> None:
    """One folder for each scenario and run; rows are dealt by run first, so that a run leaves few files."""
    keys = ["scenario", "run_number"]
    df.repartition(*keys).write.mode("overwrite").partitionBy(*keys).parquet(path)


def write_report(df: DataFrame, path: str, *order: str) -> None:
    df.orderBy(*order).write.mode("overwrite").option("header", "true").csv(path)
