"""Audits of raw samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timeseries_quality(samples: DataFrame, runs: DataFrame, reach_s: int) -> DataFrame:
    """For each case and modality: rows, columns, rows without a time, gaps, repeated times, range, seconds before and after the injection, whether the window is
    covered (closed), and a status.

    The columns of one row share their time, so a time has as many rows as its most frequent column has values there.
    """
    keys = ["case_no", "data_name"]
    cells = samples.groupBy(*keys, "column_name", "ts_us").agg(F.count("*").alias("n"), F.count_if(F.col("value").isNull()).alias("gaps"))
    rows = cells.groupBy(*keys, "ts_us").agg(F.sum("gaps").alias("gaps"), F.max("n").alias("rows"))
    timed = F.col("ts_us").isNotNull()
    s = rows.groupBy(*keys).agg(
        F.sum("rows").alias("row_count"), F.coalesce(F.sum(F.when(~timed, F.col("rows"))), F.lit(0)).alias("invalid_timestamp_count"), F.sum("gaps").alias("missing_feature_count"),
        F.coalesce(F.sum(F.when(timed, F.col("rows") - 1)), F.lit(0)).alias("duplicate_timestamp_count"), F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"),
    )
    names = samples.groupBy(*keys, "column_name").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.count("column_name").alias("feature_count"))
    j = s.join(names, keys).join(runs.select("case_no", "inject_s"), "case_no")
    before, after = F.col("inject_s") - F.col("start_us") / 1e6, F.col("end_us") / 1e6 - F.col("inject_s")
    covered = F.coalesce((before >= reach_s) & (after >= reach_s), F.lit(False))
    issues = F.concat_ws(
        "|", F.when(F.col("invalid_timestamp_count") > 0, "invalid_timestamp"), F.when(F.col("missing_feature_count") > 0, "missing_feature"),
        F.when(F.col("duplicate_timestamp_count") > 0, "duplicate_timestamp"), F.when(~covered, "insufficient_window"),
    )
    return j.select(
        "case_no", "data_name", "row_count", "feature_count", "invalid_timestamp_count", "missing_feature_count", "duplicate_timestamp_count", "start_us", "end_us", F.round(before, 3).alias("seconds_before_injection"),
        F.round(after, 3).alias("seconds_after_injection"), covered.alias("window_covered"), F.when(issues == "", "valid").otherwise(issues).alias("status"),
    )


def missing_by_column(samples: DataFrame, runs: DataFrame, segment_s: int = 3600) -> DataFrame:
    """Columns with gaps: counts, share, before and from the injection on, on rows without a time, first and last gap, longest streak in time order.

    Values go before gaps of the same time, and rows without a time come last. A series is cut into segments of time, each of which gives its length, its gaps at
    both ends and its longest streak; a streak over a border is put together from these, so no task orders a whole series.
    """
    keys = ["case_no", "data_name", "column_name"]
    s = samples.join(runs.select("case_no", "inject_s"), "case_no").withColumn("gap", F.col("value").isNull())
    early = F.col("gap") & (F.col("ts_us") < F.col("inject_s") * 1_000_000)
    row = F.struct(F.col("ts_us").alias("t"), F.col("gap").cast("int").alias("g"))
    part = s.groupBy(*keys, F.floor(F.col("ts_us") / (segment_s * 1_000_000)).alias("segment")).agg(
        F.array_sort(F.collect_list(row)).alias("rows"), F.count_if("gap").alias("gaps"), F.count_if(early).alias("early"), F.count_if(F.col("gap") & F.col("ts_us").isNull()).alias("untimed"),
        F.min(F.when(F.col("gap"), F.col("ts_us"))).alias("first"), F.max(F.when(F.col("gap"), F.col("ts_us"))).alias("last"), F.count("*").alias("n"),
    )
    zero = F.lit(0)
    within = F.aggregate("rows", F.struct(F.lit(True).alias("open"), zero.alias("head"), zero.alias("run"), zero.alias("best")), lambda x, r: F.struct(
        (x["open"] & (r["g"] == 1)).alias("open"), F.when(x["open"] & (r["g"] == 1), x["head"] + 1).otherwise(x["head"]).alias("head"),
        F.when(r["g"] == 1, x["run"] + 1).otherwise(zero).alias("run"), F.greatest(x["best"], F.when(r["g"] == 1, x["run"] + 1).otherwise(zero)).alias("best"),
    ))
    part = part.withColumn("x", within).drop("rows")
    ordered = F.array_sort(F.collect_list(F.struct(F.col("segment").isNull().alias("last"), "segment", F.col("n").cast("int").alias("n"), "x.head", "x.run", "x.best")))
    whole = part.groupBy(*keys).agg(
        F.sum("n").alias("row_count"), F.sum("gaps").alias("missing_count"), F.sum("early").alias("missing_before_injection"), F.sum("untimed").alias("missing_on_invalid_timestamp"),
        F.min("first").alias("first_missing_us"), F.max("last").alias("last_missing_us"), ordered.alias("segments"),
    )
    across = F.aggregate("segments", F.struct(zero.alias("run"), zero.alias("best")), lambda x, g: F.struct(
        F.when(g["run"] == g["n"], x["run"] + g["n"]).otherwise(g["run"]).alias("run"), F.greatest(x["best"], g["best"], x["run"] + g["head"]).alias("best"),
    ), lambda x: x["best"].cast("long"))
    out = whole.where("missing_count > 0").withColumn("longest_missing_streak", across).drop("segments")
    return out.withColumns({
        "missing_after_injection": F.col("missing_count") - F.col("missing_before_injection") - F.col("missing_on_invalid_timestamp"),
        "missing_percentage": F.round(100 * F.col("missing_count") / F.col("row_count"), 6),
    })


def eligibility(quality: DataFrame, trace_range: DataFrame, runs: DataFrame, series_required: bool = False) -> DataFrame:
    """For each case: are all modalities and the trace window covered; the reasons against it, joined by |.

    A case is eligible if nothing speaks against it: the trace window must be covered, the series only if `series_required`.
    """
    q = quality.groupBy("case_no").agg(F.bool_and("window_covered").alias("series_covered"), F.array_join(F.array_sort(F.collect_set(F.when(~F.col("window_covered"), F.col("data_name")))), "|").alias("uncovered"))
    j = runs.select("case_no", "case_id").join(q, "case_no", "left").join(trace_range, "case_no", "left")
    series, trace = F.coalesce("series_covered", F.lit(False)), F.coalesce("trace_covered", F.lit(False))
    names = F.coalesce("uncovered", F.lit(""))
    short = F.when(~series & F.lit(series_required), F.concat(F.lit("timeseries_window_incomplete["), names, F.lit("]")))
    reason = F.concat_ws("|", F.when(~trace, F.lit("trace_window_incomplete")), short)
    return j.select("case_no", "case_id", series.alias("series_covered"), names.alias("uncovered"), trace.alias("trace_covered"), (reason == "").alias("eligible"), reason.alias("reason"))
