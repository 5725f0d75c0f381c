"""All queries over the driver's tables, by key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.storage import kept, new_path
from ..operators import align as A
from ..operators import audits as U
from ..operators import features as X
from ..operators import labels as L
from ..operators import quality as Q
from ..operators import traces as T
from ..sources import adapters as S
from ..sources import training as W
from . import modeling
from .oracle import ORACLE_SQL

GRID = S.Grid()
FLAGSHIP = "agg_feature_statistics"
#: Share of a window's bins that a source may lack. The driver's events are sparse: bins of six hours hold few of them.
MOST_EMPTY = 0.25
#: The operator's own limit, by which the list of excluded cases is whole.
FULL_LIMIT = 0.10


def _step(name: str, build: Callable[[Data], DataFrame]) -> property:
    """A step by name. Where the steps are shared, those in SHARED are written the first time that they are asked for."""

    def get(d: Data) -> DataFrame:
        if name not in d.made:
            df = build(d)
            if not (d.sharing and name in SHARED):
                return df
            d.made[name] = kept(df, name)
        return d.made[name]

    return property(get)


#: Steps that several branches of a query read.
SHARED = {"spans", "aligned", "verdict", "schema", "stats", "novelty", "svc", "proxy", "merged", "volume", "span_anomalies"}


class Data:
    """The inputs and the steps that several queries share, built when they are asked for; all are lazy but for those that `once` writes."""

    def __init__(self, spark: SparkSession, sf_dir: str, most_empty: float = MOST_EMPTY):
        self.spark, self.sf_dir, self.most_empty = spark, sf_dir, most_empty
        self.sharing, self.made, self.lacking = False, {}, S.ABSENT

    def once(self) -> Data:
        """These inputs with the shared steps computed once, for queries that read them in several branches."""
        self.sharing = True
        return self

    def whole(self, most_empty: float | None = None) -> Data:
        """These inputs with all samples, those too that two cases are made to lack elsewhere, and with a limit of its own."""
        self.lacking = ()
        self.most_empty = self.most_empty if most_empty is None else most_empty
        return self

    spans = _step("spans", lambda d: T.typed(S.spans(d.spark, d.sf_dir)))
    runs = _step("runs", lambda d: S.runs(d.spark))
    samples = _step("samples", lambda d: S.samples(d.spark, d.sf_dir, d.lacking))
    injections = _step("injections", lambda d: S.span_injections(d.spark))
    windowed = _step("windowed", lambda d: A.in_window(d.samples, d.runs, GRID))
    aligned = _step("aligned", lambda d: A.align(d.windowed))
    dense = _step("dense", lambda d: A.densify(d.aligned, GRID))
    harmonised = _step("harmonised", lambda d: A.harmonise(d.aligned, S.clusters(d.spark)))
    schema = _step("schema", lambda d: A.feature_schema(d.harmonised))
    bins = _step("bins", lambda d: A.bin_eligibility(d.windowed, d.runs, GRID, d.most_empty))
    verdict = _step("verdict", lambda d: A.bin_verdict(d.bins))
    cases = _step("cases", lambda d: d.verdict.where("eligible").select("case_no"))
    filled = _step("filled", lambda d: A.fill(A.complete(d.harmonised, d.schema, d.cases, GRID)))
    stats = _step("stats", lambda d: A.feature_statistics(d.filled))
    quality = _step("quality", lambda d: Q.timeseries_quality(d.samples, d.runs, GRID.reach))
    structure = _step("structure", lambda d: T.structure(d.spans))
    firsts = _step("firsts", lambda d: T.first_spans(d.spans))
    volume = _step("volume", lambda d: T.call_volume(d.spans, d.injections))
    span_anomalies = _step("span_anomalies", lambda d: T.service_anomalies(T.span_signals(d.spans, d.injections), z=0.0, ratio=1.0))
    long = _step("long", lambda d: A.long_features(d.stats))
    mapped = _step("mapped", lambda d: X.harmonisation_map(d.aligned.join(d.cases, "case_no", "left_semi"), S.clusters(d.spark)))
    novelty = _step("novelty", lambda d: A.log_novelty(d.mapped, d.cases))
    eligible = _step("eligible", lambda d: Q.eligibility(d.quality, T.range_covered(d.structure, d.injections), d.runs))
    context = _step("context", lambda d: T.service_context(d.span_anomalies, T.call_graph(d.volume), d.volume, "promoservice").join(d.cases, "case_no", "left_semi"))
    svc = _step("svc", lambda d: X.as_long(d.context))
    proxy = _step("proxy", lambda d: U.proxy_audit(d.svc, d.labels.select("case_no", "service", F.col("service_tier").alias("tier"))))
    merged = _step("merged", lambda d: X.merged_features(d.long, d.novelty, d.svc, d.proxy))
    audit = _step("audit", lambda d: d.proxy.select("feature_name", F.col("decision").alias("audit_status")))
    manifest = _step("manifest", lambda d: X.feature_manifest(d.merged, d.audit))
    labels = _step("labels", lambda d: L.severity_labels(d.runs))
    oof = _step("oof", lambda d: L.oof_from_labels(d.spark, d.sf_dir))


def rounded(df: DataFrame, *names: str) -> DataFrame:
    """Doubles at six places, so that two engines' sums compare."""
    return df.withColumns({c: F.round(c, 6) for c in names})


def _log_parts(d: Data) -> DataFrame:
    service, cluster = P.log_column_parts(F.col("column_name"))
    return d.samples.where("data_name = 'logs'").select("column_name").distinct().select("column_name", service.alias("service"), cluster.alias("cluster_id"))


def _training(d: Data) -> DataFrame:
    """The written training tables, read back: each configuration's cases, features, values and whether it holds all columns of the one before in the same order."""
    d, folder = d.once(), new_path(d.spark, "training")
    W.write_training(d.merged, d.manifest, d.labels.select("case_no", "severity"), X.case_metadata(d.runs, d.long), folder)
    out, before = None, ["case_no"]
    for config in W.CONFIGS:
        t = W.read_training(d.spark, folder, f"features_{config}")
        nested = t.columns[: len(before)] == before
        before = t.columns
        values = sum((F.count(f"`{c}`") for c in t.columns[1:]), F.lit(0))
        row = t.agg(F.count("*").alias("case_count"), values.cast("long").alias("value_count")).select(F.lit(config).alias("config"), F.lit(len(t.columns) - 1).alias("feature_count"), "case_count", "value_count", F.lit(nested).alias("nested"))
        out = row if out is None else out.unionByName(row)
    return out


def _consistency(d: Data) -> DataFrame:
    shown = kept(X.by_configuration(d.merged, d.manifest).select("config", "case_no").distinct(), "shown")
    tables = {f"features_{c}": shown.where(F.col("config") == c).select("case_no") for c in W.CONFIGS}
    labels = X.aligned_labels(d.merged, d.labels).where("featured")
    return X.case_consistency(tables, labels, X.case_metadata(d.runs, d.merged), "features_E0")


_BUILD: dict[str, Callable[[Data], DataFrame]] = {
    "src_run_metadata": lambda d: d.runs.select("case_no", "case_id", "scenario", "service", "fault_type", "run_number", "inject_s"),
    "flt_observation_window": lambda d: d.windowed.groupBy("case_no", "data_name", "window_type").agg(F.count("*").alias("n")),
    "prj_bin_index": lambda d: d.windowed.groupBy("case_no", "bin_index").agg(F.count("*").alias("n")),
    "prj_feature_family": lambda d: d.samples.select("column_name").distinct().withColumn("family", P.feature_family(F.col("column_name"))),
    "prj_log_column_split": _log_parts,
    "prj_callee": lambda d: d.spans.groupBy("operation", P.callee_of(F.col("operation")).alias("callee")).agg(F.count("*").alias("n")),
    "agg_align_grid": lambda d: rounded(d.whole().aligned, "value"),
    "jn_grid_densify": lambda d: rounded(d.whole().dense, "value"),
    "agg_harmonize_logs": lambda d: rounded(A.harmonise_logs(d.aligned, S.clusters(d.spark)), "value"),
    "win_linear_fill": lambda d: rounded(d.filled.select("case_no", "column_name", "bin_index", "policy", "filled"), "filled"),
    "agg_cleaning_log": lambda d: A.cleaning_log(d.filled),
    "agg_feature_statistics": lambda d: rounded(d.stats, "baseline_mean", "incident_max", "delta_mean", "zscore_max", "zscore_mean"),
    "agg_feature_schema": lambda d: rounded(d.schema, "run_coverage"),
    "agg_bin_eligibility": lambda d: d.bins.join(d.verdict, "case_no"),
    "agg_validate_cleaned": lambda d: A.validate_cleaned(d.filled, d.schema, d.cases, GRID),
    "agg_log_novelty": lambda d: d.novelty,
    "agg_constant_features": lambda d: A.constant_features(A.long_features(d.stats)),
    "win_topk_features": lambda d: rounded(A.top_features(d.stats), "zscore_mean"),
    "agg_timeseries_quality": lambda d: d.quality,
    "agg_missing_by_column": lambda d: Q.missing_by_column(d.samples, d.runs),
    "jn_eligibility": lambda d: d.whole().eligible,
    "agg_trace_structure": lambda d: d.structure,
    "agg_root_identity": lambda d: T.root_identity(d.spans),
    "agg_root_operations": lambda d: T.root_operations(d.firsts),
    "agg_span_status": lambda d: T.status_codes(d.firsts),
    "win_first_span": lambda d: T.start_sums(d.firsts),
    "jn_reconcile": lambda d: (d := d.once()) and T.reconcile(T.root_identity(d.spans), T.root_operations(d.firsts), d.structure, T.status_codes(d.firsts)),
    "agg_call_volume": lambda d: d.volume,
    "agg_call_graph": lambda d: T.call_graph(d.volume),
    "agg_call_volume_change": lambda d: T.call_volume_change(d.volume),
    "agg_service_anomalies": lambda d: rounded(T.service_anomalies(d.stats), "magnitude"),
    "jn_anomalous_edges": lambda d: (d := d.once()) and T.anomalous_edges(d.span_anomalies, T.call_graph(d.volume)),
    "agg_propagation_depth": lambda d: (d := d.once()) and T.propagation_depth(d.span_anomalies, T.call_graph(d.volume)),
    "agg_service_context": lambda d: (d := d.once()) and rounded(T.service_context(d.span_anomalies, T.call_graph(d.volume), d.volume, "promoservice"), "svc__anomalous_service_share", "svc__latency_anomaly_magnitude", "svc__anomalous_edge_share", "svc__contagion_ratio"),
    "jn_label_lookup": lambda d: d.labels,
    "agg_label_distribution": lambda d: L.label_distribution(d.labels),
    "agg_label_sensitivity": lambda d: L.label_sensitivity(d.runs),
    "ml_scores": lambda d: L.scores(d.oof),
    "ml_score_summary": lambda d: L.score_summary(L.scores(d.oof)),
    "ml_confusion": lambda d: L.confusion(d.oof),
    "ml_scenario_accuracy": lambda d: L.scenario_accuracy(d.oof),
    "win_majority_class": lambda d: L.majority_class(d.oof),
    "prj_trace_column_service": lambda d: d.samples.where("data_name like 'trace%'").select("column_name").distinct().withColumn("service", P.trace_service(F.col("column_name"))),
    "prj_blank_missing": lambda d: d.spans.groupBy("case_no").agg(*(F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in ("trace_id", "span_id", "parent_id"))),
    "jn_cluster_dictionary": lambda d: X.with_templates(d.aligned, S.clusters(d.spark)).groupBy("case_no", "column_name", "template", "category").agg(F.count("*").alias("n")),
    "jn_window_range": lambda d: T.in_windows(d.spans, d.injections).groupBy("case_no", "window_type").agg(F.count("*").alias("n")),
    "agg_harmonization_map": lambda d: rounded(d.mapped, "baseline_sum", "incident_sum"),
    "agg_template_catalog": lambda d: X.template_catalog(d.mapped),
    "agg_align_quality": lambda d: X.align_quality(d.windowed, d.aligned, GRID),
    "agg_validate_aligned": lambda d: X.validate_aligned(d.dense, d.aligned, GRID),
    "agg_run_summaries": lambda d: X.run_summaries((d := d.once()).quality, T.status_codes(d.firsts), d.filled, X.template_catalog(d.mapped), d.manifest),
    "win_edge_fill": lambda d: rounded(d.filled.where("method = 'edge'").select("case_no", "column_name", "bin_index", "filled"), "filled"),
    "win_zero_fill": lambda d: d.filled.where("method = 'zero'").groupBy("case_no", "column_name").agg(F.count("*").alias("n")),
    "set_missing_extra": lambda d: X.absent_columns(d.aligned),
    "set_traces_without_root": lambda d: T.traces_without_root(d.spans),
    "agg_numeric_quality": lambda d: X.configuration_quality((d := d.once()).merged, d.manifest),
    "agg_proxy_variance": lambda d: d.once().proxy.select("feature_name", "within_service_variance_ratio", "decision", "reason"),
    "agg_proxy_tree": lambda d: U.tier_accuracy(d.once().svc, d.labels.select("case_no", F.col("service_tier").alias("tier"))).withColumn("tier_balanced_accuracy", F.round("tier_balanced_accuracy", 6)),
    "agg_leakage_audit": lambda d: X.leakage_audit((d := d.once()).merged, d.manifest, d.labels, d.proxy),
    "agg_excluded_runs": lambda d: X.excluded_runs((d := d.whole(FULL_LIMIT)).eligible, d.verdict),
    "agg_case_consistency": lambda d: _consistency(d.once()),
    "jn_feature_merge": lambda d: rounded(d.once().merged, "value"),
    "prj_feature_manifest": lambda d: d.once().manifest,
    "prj_select_config": lambda d: X.configuration_counts((d := d.once()).merged, d.manifest),
    "sink_partitioned": lambda d: W.write_aligned(d.dense, d.runs, new_path(d.spark, "aligned")),
    "sink_training": _training,
    "srt_schema_order": lambda d: d.schema.where("keep").orderBy("position").select("position", "column_name"),
    "srt_case_order": lambda d: X.case_metadata(d.runs, d.long).orderBy("case_id").select("case_id", "scenario"),
    "srt_report_order": lambda d: T.root_operations(d.firsts).orderBy(F.col("span_count").desc(), "service", "operation", "case_no").select("case_no", "service", "operation", "span_count"),
    "top_features_first_case": lambda d: rounded(A.first_case_top(d.stats), "zscore_mean"),
    "jn_case_metadata": lambda d: X.case_metadata(d.runs, d.long),
    "jn_align_labels": lambda d: X.aligned_labels(d.long, d.labels),
}
#: Queries whose rows come from fixed policy literals alone; they are operators with tests and no queries.
_FIXED = {"src_run_metadata", "jn_label_lookup", "agg_label_distribution", "agg_label_sensitivity"}

QUERIES = {k: (lambda spark, sf_dir, f=f: f(Data(spark, sf_dir))) for k, f in _BUILD.items() if k not in _FIXED} | modeling.QUERIES
CHECKED = {k: (lambda spark, sf_dir, most_empty=MOST_EMPTY, f=f: f(Data(spark, sf_dir, most_empty))) for k, f in _BUILD.items()}
ALL_SQL = ORACLE_SQL = ORACLE_SQL | modeling.ORACLE_SQL
ORACLE_SQL = {k: v for k, v in ORACLE_SQL.items() if k in QUERIES}
