"""Samples on a grid around the injection, filled and summarised; one shuffle by (case, column) carries all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import feature_family, fill_policy, modality
from ..sources.adapters import Grid

SUMMED = ("logs", "trace_error")


def in_window(samples: DataFrame, runs: DataFrame, grid: Grid) -> DataFrame:
    """Samples of the half-open window around their case's injection, with bin and baseline or incident."""
    r = runs.select("case_no", "inject_s")
    after = F.col("ts_us") - F.col("inject_s") * 1_000_000
    s = samples.join(r, "case_no").withColumn("after_us", after).where((F.col("after_us") >= -grid.reach * 1_000_000) & (F.col("after_us") < grid.reach * 1_000_000))
    return s.select("case_no", "data_name", "column_name", "value", F.floor(F.col("after_us") / (grid.interval * 1_000_000)).cast("int").alias("bin_index"), F.when(F.col("after_us") < 0, "baseline").otherwise("incident").alias("window_type"))


def align(windowed: DataFrame) -> DataFrame:
    """One cell for each case, column and bin that has samples: mean or sum, null if any sample is missing."""
    agg = windowed.groupBy("case_no", "data_name", "column_name", "bin_index").agg(F.avg("value").alias("a"), F.sum("value").alias("s"), F.count("value").alias("c"), F.count("*").alias("sample_count"))
    value = F.when(F.col("c") == F.col("sample_count"), F.when(F.col("data_name").isin(*SUMMED), F.col("s")).otherwise(F.col("a")))
    return agg.select("case_no", "data_name", "column_name", "bin_index", value.alias("value"), "sample_count")


def harmonise_logs(aligned: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Log columns of one service and template category are summed for each bin; null only if all are."""
    from .features import harmonised_name, with_templates

    known = with_templates(aligned, dictionary)
    return known.groupBy("case_no", harmonised_name().alias("column_name"), "bin_index").agg(F.sum("value").alias("value"), F.sum("sample_count").alias("sample_count"))


def harmonise(aligned: DataFrame, dictionary: DataFrame) -> DataFrame:
    """All cells under names that mean the same in every case: logs by service and category, the others as they are."""
    cells = ["case_no", "column_name", "bin_index", "value", "sample_count"]
    return aligned.where("data_name <> 'logs'").select(cells).unionByName(harmonise_logs(aligned, dictionary).select(cells))


def densify(aligned: DataFrame, grid: Grid) -> DataFrame:
    """Every bin of every column that a case has; empty bins have no value and no samples."""
    keys = aligned.select("case_no", "column_name").distinct()
    full = keys.withColumn("bin_index", F.explode(F.sequence(F.lit(-grid.half), F.lit(grid.half - 1))))
    cells = aligned.select("case_no", "column_name", "bin_index", "value", "sample_count")
    return full.join(cells, ["case_no", "column_name", "bin_index"], "left").withColumn("sample_count", F.coalesce("sample_count", F.lit(0)))


def complete(harmonised: DataFrame, schema: DataFrame, cases: DataFrame, grid: Grid) -> DataFrame:
    """Every bin of every kept column of the schema for every case, whether or not the case has the column (absent).

    cases and kept columns are what the cleaned tables have as rows and header; cells join them by one shuffle.
    """
    have = harmonised.select("case_no", "column_name").distinct().withColumn("there", F.lit(True))
    kept = schema.where("keep").select("column_name", "modality", "family", "fill_policy")
    full = cases.select("case_no").distinct().crossJoin(kept).join(have, ["case_no", "column_name"], "left").withColumn("absent", F.col("there").isNull()).drop("there")
    full = full.withColumn("bin_index", F.explode(F.sequence(F.lit(-grid.half), F.lit(grid.half - 1))))
    cells = harmonised.select("case_no", "column_name", "bin_index", "value", "sample_count")
    return full.join(cells, ["case_no", "column_name", "bin_index"], "left").withColumn("sample_count", F.coalesce("sample_count", F.lit(0)))


def fill(dense: DataFrame, edge: int = 2) -> DataFrame:
    """Gaps filled by policy: zero, or linear inside and the nearest value up to `edge` bins outside.

    dense: of `complete`, or any table with case_no, column_name, bin_index and value; its other columns stay.
    """
    w = Window.partitionBy("case_no", "column_name").orderBy("bin_index")
    back, on = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col("value").isNotNull(), F.col("bin_index"))
    policy = F.col("fill_policy") if "fill_policy" in dense.columns else fill_policy(feature_family(F.col("column_name")))
    d = dense.withColumns({
        "policy": policy, "pv": F.last("value", True).over(back), "pb": F.last(at, True).over(back),
        "nv": F.first("value", True).over(on), "nb": F.first(at, True).over(on),
    })
    b = F.col("bin_index")
    both = F.col("pb").isNotNull() & F.col("nb").isNotNull()
    inside = F.col("pv") + (F.col("nv") - F.col("pv")) * (b - F.col("pb")) / (F.col("nb") - F.col("pb"))
    edges = F.when(F.col("pb").isNotNull() & (b - F.col("pb") <= edge), F.col("pv")).when(F.col("nb").isNotNull() & (F.col("nb") - b <= edge), F.col("nv"))
    linear = F.when(both, inside).otherwise(edges)
    observed, zero = F.col("value").isNotNull(), F.col("policy") == "zero"
    filled = F.when(observed, F.col("value")).when(zero, 0.0).otherwise(linear)
    method = F.when(observed, "observed").when(zero, "zero").when(both, "linear").when(linear.isNotNull(), "edge").otherwise("none")
    others = [c for c in ("modality", "family", "absent") if c in dense.columns]
    return d.select("case_no", "column_name", "bin_index", "policy", "value", filled.alias("filled"), method.alias("method"), *others)


def feature_statistics(filled: DataFrame, cap: float = 100.0) -> DataFrame:
    """Baseline against incident for each case and column: five statistics, constant baselines by rule."""
    base, inc = F.when(F.col("bin_index") < 0, F.col("filled")), F.when(F.col("bin_index") >= 0, F.col("filled"))
    s = filled.groupBy("case_no", "column_name").agg(F.avg(base).alias("baseline_mean"), F.stddev_pop(base).alias("sd"), F.min(base).alias("lo"), F.max(base).alias("hi"), F.avg(inc).alias("im"), F.max(inc).alias("incident_max"))

    def z(x):
        delta = x - F.col("baseline_mean")
        constant = F.when(delta > 0, cap).when(delta < 0, -cap).when(delta == 0, 0.0)
        return F.when(F.col("lo") == F.col("hi"), constant).otherwise(F.greatest(F.lit(-cap), F.least(F.lit(cap), delta / F.col("sd"))))

    z_of = lambda c: F.when(F.col(c).isNotNull() & F.col("baseline_mean").isNotNull(), z(F.col(c)))
    return s.select("case_no", "column_name", "baseline_mean", "incident_max", (F.col("im") - F.col("baseline_mean")).alias("delta_mean"), z_of("incident_max").alias("zscore_max"), z_of("im").alias("zscore_mean"))


#: The order of modalities in a schema, and of sources in a verdict.
MODALITIES = ("metric", "log", "trace_latency", "trace_error")
SOURCES = ("metrics", "logs", "trace_latency", "trace_error")


def feature_schema(harmonised: DataFrame, least: float = 0.5) -> DataFrame:
    """Columns over all aligned cases, in the order of the cleaned tables: coverage, family, policy, and whether and why they go.

    A column that is filled by zeros always stays; a gauge stays if at least `least` of the cases have it.
    """
    cols = harmonised.select("case_no", "column_name").distinct().groupBy("column_name").agg(F.count("*").alias("k"))
    family = feature_family(F.col("column_name"))
    out = cols.select("column_name", modality(F.col("column_name")).alias("modality"), family.alias("family"), fill_policy(family).alias("fill_policy"), (F.col("k") / case_count(harmonised)).alias("run_coverage"))
    out = out.withColumn("keep", (F.col("fill_policy") == "zero") | (F.col("run_coverage") >= least))
    rank = F.array_position(F.array(*map(F.lit, MODALITIES)), F.col("modality"))
    # a schema is as long as a table's header
    order = F.row_number().over(Window.orderBy(rank, "column_name"))
    return out.withColumns({"drop_reason": F.when(F.col("keep"), "").otherwise("gauge_coverage_below_threshold"), "position": order})


def bin_eligibility(windowed: DataFrame, runs: DataFrame, grid: Grid, most: float = 0.10) -> DataFrame:
    """Bins without samples for each case, modality and window, their share, and whether it is too large."""
    bins = windowed.groupBy("case_no", "data_name", "window_type").agg(F.countDistinct("bin_index").alias("n"))
    names, kinds = (F.explode(F.array(*map(F.lit, v))) for v in (SOURCES, ("baseline", "incident")))
    full = runs.select("case_no").withColumn("data_name", names).withColumn("window_type", kinds)
    empty = grid.half - F.coalesce("n", F.lit(0))
    return full.join(bins, ["case_no", "data_name", "window_type"], "left").select("case_no", "data_name", "window_type", empty.alias("empty_bins"), F.round(empty / grid.half, 4).alias("ratio"), (empty / grid.half > most).alias("excluded"))


def bin_verdict(bins: DataFrame) -> DataFrame:
    """For each case whether it is eligible by its empty bins, and the ratios that exclude it, by source and then window."""
    place = F.array_position(F.array(*map(F.lit, SOURCES)), F.col("data_name"))
    said = F.concat(F.col("data_name"), F.lit("_"), F.col("window_type"), F.format_string("_missing_ratio=%.2f", F.col("ratio")))
    reasons = F.array_sort(F.collect_list(F.when(F.col("excluded"), F.struct(place.alias("p"), F.col("window_type").alias("w"), said.alias("s")))))
    return bins.groupBy("case_no").agg((~F.bool_or("excluded")).alias("eligible"), F.array_join(F.transform(reasons, lambda x: x["s"]), "|").alias("exclusion_reason"))


def cleaning_log(filled: DataFrame) -> DataFrame:
    """What filling did, for each case and column that had gaps or that the case doesn't have."""
    keys = ["case_no", "column_name", "modality", "family", F.col("policy").alias("fill_policy"), F.col("absent").alias("column_absent_in_run")]
    n = filled.groupBy(*keys).agg(F.count_if(F.col("value").isNull()).alias("missing_before"), F.count_if(F.col("filled").isNull()).alias("missing_after"))
    method = F.when(F.col("missing_before") == 0, "none").when(F.col("fill_policy") == "zero", "zero_fill").otherwise("linear_interpolate_edge_fill")
    return n.where("missing_before > 0 or column_absent_in_run").withColumns({"method": method, "filled_count": F.col("missing_before") - F.col("missing_after")})


def validate_cleaned(filled: DataFrame, schema: DataFrame, cases: DataFrame, grid: Grid) -> DataFrame:
    """For each case the rules that its cleaned table breaks: schema columns it lacks, columns not in the schema, columns without
    exactly one cell for each bin on both sides, and gaps in columns that are filled by zeros. All are 0 in a valid table."""
    per = filled.groupBy("case_no", "column_name").agg(
        F.count("*").alias("n"), F.countDistinct("bin_index").alias("d"), F.count_if(F.col("bin_index") < 0).alias("before"), F.count_if(F.col("filled").isNull()).alias("gaps")
    )
    kept = schema.where("keep").select("column_name", F.col("fill_policy").alias("expected"))
    full = cases.select("case_no").distinct().crossJoin(kept).join(per, ["case_no", "column_name"], "full")
    wrong = (F.col("n") != 2 * grid.half) | (F.col("d") != 2 * grid.half) | (F.col("before") != grid.half)
    out = full.groupBy("case_no").agg(
        F.count("expected").alias("column_count"), F.count_if(F.col("n").isNull()).alias("lacking_columns"), F.count_if(F.col("expected").isNull()).alias("extra_columns"),
        F.count_if(wrong).alias("wrong_bin_columns"), F.count_if((F.col("expected") == "zero") & (F.col("gaps") > 0)).alias("zero_policy_gaps"),
    )
    return out.withColumn("valid", (F.col("lacking_columns") + F.col("extra_columns") + F.col("wrong_bin_columns") + F.col("zero_policy_gaps")) == 0)


def log_novelty(mapped: DataFrame, runs: DataFrame) -> DataFrame:
    """For each case and service the log templates that are silent before and seen after the injection, and their sum; all cases are there.

    mapped: the harmonisation map (case_no, service, baseline_sum, incident_sum).
    """
    new = mapped.where("baseline_sum = 0 and incident_sum > 0").groupBy("case_no", "service").agg(F.count("*").alias("n"))
    # services and cases are few
    full = runs.select("case_no").crossJoin(mapped.select("service").distinct())
    per = full.join(new, ["case_no", "service"], "left").select("case_no", "service", F.coalesce("n", F.lit(0)).alias("value"))
    every = runs.select("case_no").join(per.groupBy("case_no").agg(F.sum("value").alias("value")), "case_no", "left").select("case_no", F.lit("all").alias("service"), F.coalesce("value", F.lit(0)).alias("value"))
    return per.unionByName(every).select("case_no", F.concat(F.lit("log__"), "service", F.lit("__new_template_count")).alias("feature_name"), "value")


def constant_features(features: DataFrame) -> DataFrame:
    """For each feature its cases without a value, and whether it is constant: one value in all cases (long form: case_no, feature_name, value).

    A case without a row has no value.
    """
    n = features.groupBy("feature_name").agg(F.count("value").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    missing = case_count(features) - F.col("n")
    return n.select("feature_name", missing.alias("missing_count"), ((missing == 0) & (F.col("lo") == F.col("hi"))).alias("constant"))


def case_count(table: DataFrame) -> Column:
    """The number of cases in a table, as a scalar subquery."""
    return table.select("case_no").distinct().agg(F.count("*").alias("n")).scalar()


def long_features(stats: DataFrame) -> DataFrame:
    return stats.unpivot(["case_no", "column_name"], ["baseline_mean", "incident_max", "delta_mean", "zscore_max", "zscore_mean"], "statistic", "value").select("case_no", F.concat_ws("__", "column_name", "statistic").alias("feature_name"), "value")


def top_features(stats: DataFrame, k: int = 5) -> DataFrame:
    """The k columns of each case whose incident differs most."""
    w = Window.partitionBy("case_no").orderBy(F.abs("zscore_mean").desc_nulls_last(), "column_name")
    return stats.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("case_no", "rank", "column_name", "zscore_mean")


def first_case_top(stats: DataFrame, k: int = 5) -> DataFrame:
    """The k columns of the first case with the highest mean z: a report's limit."""
    first = stats.agg(F.min("case_no").alias("case_no"))
    return stats.join(first, "case_no").where("zscore_mean is not null").orderBy(F.col("zscore_mean").desc(), "column_name").limit(k).select("case_no", "column_name", "zscore_mean")
