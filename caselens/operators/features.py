"""Long feature tables: log templates, audits of cells and features, relative features, baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import log_column_parts, modality, template_category
from ..sources.adapters import Grid
from .align import case_count, constant_features

def with_templates(aligned: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Log cells with the template and category that their cluster id means in their own case; an unknown id fails."""
    service, cluster = log_column_parts(F.col("column_name"))
    logs = aligned.where("data_name = 'logs'").withColumn("service", service).withColumn("cluster_id", cluster.cast("long"))
    d = dictionary.select("case_no", "cluster_id", "template", template_category(F.col("template")).alias("category"))
    j = logs.join(d, ["case_no", "cluster_id"], "left")
    return j.withColumn("template", F.when(F.col("template").isNull(), F.raise_error(F.concat(F.lit("no template for "), "column_name"))).otherwise(F.col("template")))


def harmonised_name() -> Column:
    """The name of a log column by what it means, of its service and category."""
    return F.concat(F.lit("log__"), F.col("service"), F.lit("__"), F.col("category"))


def harmonisation_map(aligned: DataFrame, dictionary: DataFrame) -> DataFrame:
    """For each case and log column: its template, its name by category, and its sums before and after the injection."""
    part = lambda when: F.coalesce(F.sum(F.when(when, F.col("value"))), F.lit(0.0))
    m = with_templates(aligned, dictionary).groupBy("case_no", "column_name", "service", "cluster_id", "template", "category")
    m = m.agg(part(F.col("bin_index") < 0).alias("baseline_sum"), part(F.col("bin_index") >= 0).alias("incident_sum"))
    return m.withColumn("harmonized_column", harmonised_name())


def template_catalog(mapped: DataFrame) -> DataFrame:
    return mapped.select("case_no", "template", "category").distinct().groupBy("template", "category").agg(F.count("*").alias("run_count"))


def align_quality(windowed: DataFrame, aligned: DataFrame, grid: Grid) -> DataFrame:
    """Source rows, observed bins and missing cells for each case and modality."""
    keys = ["case_no", "data_name"]
    per = windowed.groupBy(*keys, "column_name").agg(F.count("*").alias("n"), F.count("value").alias("c"))
    source = per.groupBy(*keys).agg(F.sum("n").alias("source_rows"), F.count("*").alias("source_features"), F.sum(F.col("n") - F.col("c")).alias("source_missing_cells"))
    cells = aligned.groupBy(*keys).agg(F.countDistinct("bin_index").alias("observed_bins"), F.count_if(F.col("value").isNull()).alias("incomplete_cells"), F.count("value").alias("full"))
    out = source.join(cells, keys).withColumn("missing_bins", 2 * grid.half - F.col("observed_bins"))
    return out.withColumn("aligned_missing_cells", F.col("source_features") * 2 * grid.half - F.col("full")).drop("full")


def validate_aligned(dense: DataFrame, aligned: DataFrame, grid: Grid, sources: int = 4) -> DataFrame:
    """For each case: its columns and cells, its first and last bin, how many columns break the rule of `half` distinct bins on both sides, cells with a negative
    sample count, sources that it lacks, and whether all of that is as it should be."""
    per = dense.groupBy("case_no", "column_name").agg(
        F.count("*").alias("n"), F.countDistinct("bin_index").alias("d"), F.count_if(F.col("bin_index") < 0).alias("b"), F.min("bin_index").alias("lo"), F.max("bin_index").alias("hi"), F.count_if(F.col("sample_count") < 0).alias("negative")
    )
    good = (F.col("n") == 2 * grid.half) & (F.col("d") == 2 * grid.half) & (F.col("b") == grid.half)
    out = per.groupBy("case_no").agg(F.count("*").alias("column_count"), F.sum("n").alias("cell_count"), F.min("lo").alias("first_bin"), F.max("hi").alias("last_bin"), F.count_if(~good).alias("bad_column_count"), F.sum("negative").alias("negative_count_cells"))
    lacks = aligned.groupBy("case_no").agg((sources - F.countDistinct("data_name")).alias("missing_sources"))
    sound = (F.col("bad_column_count") + F.col("negative_count_cells") + F.col("missing_sources") == 0) & (F.col("first_bin") == -grid.half) & (F.col("last_bin") == grid.half - 1)
    return out.join(lacks, "case_no").withColumn("valid", sound)


def absent_columns(aligned: DataFrame) -> DataFrame:
    """For each case how many columns it has, how many of all cases' columns it lacks, and their names."""
    have = aligned.select("case_no", "column_name").distinct()
    # cases are few, and a column list is what the feature table has as its header
    full = have.select("column_name").distinct().crossJoin(have.select("case_no").distinct()).join(have.withColumn("there", F.lit(True)), ["case_no", "column_name"], "left")
    names = F.array_join(F.array_sort(F.collect_list(F.when(F.col("there").isNull(), F.col("column_name")))), "|")
    return full.groupBy("case_no").agg(F.count("there").alias("column_count"), F.count_if(F.col("there").isNull()).alias("missing_count"), names.alias("missing_columns"))


def numeric_quality(features: DataFrame) -> DataFrame:
    """Infinite and missing values of each feature (a case without a row counts as missing), and whether it is empty or constant."""
    v = F.col("value")
    n = features.groupBy("feature_name").agg(F.count_if(F.abs(v) == float("inf")).alias("infinite_count"), F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"))
    missing = case_count(features) - F.col("n")
    return n.select("feature_name", "infinite_count", missing.alias("missing_count"), (F.col("n") == 0).alias("all_missing"), F.coalesce((missing == 0) & (F.col("lo") == F.col("hi")), F.lit(False)).alias("constant"))


def by_configuration(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows with a feature_name once for each nested configuration (shows) that shows it."""
    configs = F.explode(F.array(*(F.lit(c) for c in sorted({c for _, c in CONFIGURATIONS})))).alias("shows")
    return rows.join(manifest.where("audit_status <> 'rejected'").select("feature_name", "config"), "feature_name").select("*", configs).where("config <= shows").drop("config").withColumnRenamed("shows", "config")


def configuration_quality(features: DataFrame, manifest: DataFrame) -> DataFrame:
    """For each configuration: features, infinite values, empty and constant features (these three are errors), missing cells and features that have any."""
    q = by_configuration(numeric_quality(features), manifest)
    out = q.groupBy("config").agg(
        F.count("*").alias("feature_count"), F.sum("infinite_count").alias("infinite_count"), F.count_if("all_missing").alias("empty_features"), F.count_if("constant").alias("constant_features"),
        F.sum("missing_count").alias("missing_cell_count"), F.count_if(F.col("missing_count") > 0).alias("features_with_missing"),
    )
    return out.withColumn("valid", (F.col("infinite_count") + F.col("empty_features") + F.col("constant_features")) == 0)


#: Columns that tell the label or what it is made of.
FORBIDDEN = ("severity", "severity_score", "fcw", "sct", "fault_category", "service_tier", "service", "fault_type", "scenario", "run_number", "inject_time")


def leakage_audit(features: DataFrame, manifest: DataFrame, labels: DataFrame, audit: DataFrame) -> DataFrame:
    """For each configuration what could tell a model its answer: forbidden columns, features that the audit rejects, and copies of an ingredient of the
    label, each joined by |, and clean if there are none. features: what is written, whether or not the manifest shows it rightly."""
    shown = by_configuration(features.select("feature_name").distinct(), manifest.withColumn("audit_status", F.lit("n/a")))
    copies = leakage(features, labels).where("copies").groupBy("feature_name").agg(F.array_sort(F.collect_list("ingredient")).alias("of"))
    j = shown.join(audit.where("decision = 'rejected'").select("feature_name", F.lit(True).alias("rejected")), "feature_name", "left").join(copies, "feature_name", "left")
    joined = lambda c, name: F.array_join(F.array_sort(F.collect_list(F.when(c, F.col("feature_name")))), "|").alias(name)
    same = F.array_join(F.array_sort(F.flatten(F.collect_list(F.transform("of", lambda x: F.concat("feature_name", F.lit(" == "), x))))), "|").alias("copies")
    out = j.groupBy("config").agg(joined(F.col("feature_name").isin(*FORBIDDEN), "forbidden"), joined(F.col("rejected"), "rejected"), same)
    return out.withColumn("clean", F.concat("forbidden", "rejected", "copies") == "")


def leakage(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Features that equal an ingredient of the label in all cases, a missing value only another missing one."""
    parts = labels.select("case_no", *(F.col(c).cast("double") for c in ("fcw", "sct", "severity_score"))).unpivot(["case_no"], ["fcw", "sct", "severity_score"], "ingredient", "x")
    same = features.join(parts, "case_no").groupBy("feature_name", "ingredient").agg(F.bool_and(F.col("value").eqNullSafe(F.col("x"))).alias("same"), F.count("*").alias("n"))
    # a case without a row has no value, and the label always has one
    return same.select("feature_name", "ingredient", (F.col("same") & (F.col("n") == case_count(features))).alias("copies"))


def excluded_runs(eligibility: DataFrame, verdict: DataFrame) -> DataFrame:
    """Cases that a stage excludes, with its reason: by the coverage of their window, or by empty bins."""
    first = eligibility.where("not eligible").select("case_no", F.lit("coverage").alias("stage"), "reason")
    return first.unionByName(verdict.where("not eligible").select("case_no", F.lit("bins").alias("stage"), F.col("exclusion_reason").alias("reason")))


def case_consistency(tables: dict[str, DataFrame], labels: DataFrame, metadata: DataFrame, reference: str) -> DataFrame:
    """For each table: its cases, those that come twice, those that the reference table has and it lacks, and the other way round; with the
    scenarios and the severities of its cases. tables, labels and metadata have a row for each case_no."""
    rows = None
    for name, table in [*tables.items(), ("labels", labels), ("metadata", metadata)]:
        part = table.select("case_no", F.lit(name).alias("table"))
        rows = part if rows is None else rows.unionByName(part)
    base = tables[reference].select("case_no").distinct()
    per = rows.groupBy("table", "case_no").agg(F.count("*").alias("n"))
    full = base.crossJoin(rows.select("table").distinct()).withColumn("expected", F.lit(True)).join(per, ["table", "case_no"], "full")
    full = full.join(labels.select("case_no", "severity").dropDuplicates(["case_no"]), "case_no", "left").join(metadata.select("case_no", "scenario").dropDuplicates(["case_no"]), "case_no", "left")
    here = F.col("n").isNotNull()
    out = full.groupBy("table").agg(
        F.count("n").alias("case_count"), F.count_if(F.col("n") > 1).alias("duplicate_cases"), F.count_if(~here).alias("missing_cases"), F.count_if(F.col("expected").isNull()).alias("extra_cases"),
        F.countDistinct(F.when(here, F.col("scenario"))).alias("group_count"), *(F.count_if(here & (F.col("severity") == c)).alias(f"n_{c.lower()}") for c in ("Low", "Medium", "High")),
    )
    return out.withColumn("consistent", (F.col("duplicate_cases") + F.col("missing_cases") + F.col("extra_cases")) == 0)


def as_long(wide: DataFrame) -> DataFrame:
    """(case_no, feature_name, value) of a table with a row for each case and numeric columns."""
    names = [c for c in wide.columns if c != "case_no"]
    return wide.select("case_no", *(F.col(c).cast("double").alias(c) for c in names)).unpivot("case_no", names, "feature_name", "value")


def merged_features(long: DataFrame, novelty: DataFrame, svc: DataFrame, audit: DataFrame) -> DataFrame:
    """All features of the cases that have statistics (long form), one value for each case and name: statistics, new templates, and the service context that
    the audit passes. Constant features go after the audit; a name that comes twice for a case fails."""
    passed = svc.join(audit.where("decision = 'passed'"), "feature_name", "left_semi")
    rows = long.unionByName(novelty.withColumn("value", F.col("value").cast("double"))).unionByName(passed)
    rows = rows.join(long.select("case_no").distinct(), "case_no", "left_semi")
    once = rows.groupBy("case_no", "feature_name").agg(F.count("*").alias("n"), F.max("value").alias("value"))
    once = once.withColumn("value", F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("more than one value of "), "feature_name"))).otherwise(F.col("value"))).drop("n")
    return once.join(constant_features(once).where("constant"), "feature_name", "left_anti").select("case_no", "feature_name", "value")


#: The first of the nested configurations that shows a modality.
CONFIGURATIONS = (("metric", "E0"), ("log", "E1"), ("trace_latency", "E2"), ("trace_error", "E2"), ("svc", "E3"))


def feature_manifest(features: DataFrame, audit: DataFrame) -> DataFrame:
    """For each feature (long form) its modality, first configuration, source column, statistic and audit status.

    audit: (feature_name, audit_status); features without one have n/a. New template counts come from the harmonisation map.
    """
    spark = features.sparkSession
    names = features.select("feature_name").distinct().join(audit, "feature_name", "left")
    modality, statistic = F.split_part("feature_name", F.lit("__"), F.lit(1)), F.split_part("feature_name", F.lit("__"), F.lit(-1))
    source = F.when(statistic == "new_template_count", "column_harmonization_map.csv").otherwise(F.regexp_extract("feature_name", "^(.*)__.*?$", 1))
    config = spark.createDataFrame(CONFIGURATIONS, "modality string, config string")
    m = names.select("feature_name", modality.alias("modality"), source.alias("source_column"), statistic.alias("statistic"), F.lit("derived").alias("origin"), F.coalesce("audit_status", F.lit("n/a")).alias("audit_status")).join(config, "modality", "left")
    return m.withColumn("config", F.when(F.col("config").isNull(), F.raise_error(F.concat(F.lit("no configuration for "), "feature_name"))).otherwise(F.col("config")))


def select_configuration(features: DataFrame, manifest: DataFrame, config: str) -> DataFrame:
    """The features (long form) that a configuration shows: its own and the smaller ones', none that the audit rejects."""
    shown = manifest.where((F.col("config") <= config) & (F.col("audit_status") != "rejected")).select("feature_name")
    return features.join(shown, "feature_name", "left_semi")


def configuration_counts(features: DataFrame, manifest: DataFrame) -> DataFrame:
    """For each nested configuration and case how many features it shows and how many have a value."""
    return by_configuration(features, manifest).groupBy("config", "case_no").agg(F.count("*").alias("feature_count"), F.count("value").alias("value_count"))


def case_metadata(runs: DataFrame, features: DataFrame) -> DataFrame:
    """What identifies the cases that have features."""
    return runs.join(features.select("case_no").distinct(), "case_no", "left_semi").select("case_no", "case_id", "scenario", "service", "fault_type", "run_number", "inject_s")


def aligned_labels(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Cases with features and their severity, which must be there; and the labels without features, by `featured`."""
    cases = features.select("case_no").distinct().withColumn("featured", F.lit(True))
    j = cases.join(labels.select("case_no", "severity", F.lit(True).alias("labelled")), "case_no", "full")
    severity = F.when(F.col("labelled").isNull(), F.raise_error(F.concat(F.lit("no label for case "), F.col("case_no").cast("string")))).otherwise(F.col("severity"))
    return j.select("case_no", severity.alias("severity"), F.coalesce("featured", F.lit(False)).alias("featured"))


def run_summaries(quality: DataFrame, statuses: DataFrame, filled: DataFrame, catalog: DataFrame, manifest: DataFrame) -> DataFrame:
    """(report, name, n): series by status, gaps by source, spans by status code, cells by policy and method, templates by category, features by configuration."""
    roll = lambda report, rows, name, n: rows.groupBy(name.alias("name")).agg(n.cast("long").alias("n")).select(F.lit(report).alias("report"), "name", "n")
    out = roll("series_by_status", quality, F.col("status"), F.count("*"))
    for part in (
        roll("gaps_by_source", quality, F.col("data_name"), F.sum("missing_feature_count")), roll("spans_by_status_code", statuses, F.col("status_code"), F.sum("span_count")),
        roll("cells_by_method", filled, F.concat_ws(":", "policy", "method"), F.count("*")), roll("templates_by_category", catalog, F.col("category"), F.count("*")), roll("features_by_configuration", manifest, F.col("config"), F.count("*")),
    ):
        out = out.unionByName(part)
    return out
