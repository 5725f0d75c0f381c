"""Span audits. Ids are blank-stripped first, and counts of distinct ids go by (case, id) before they go by case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import blank_to_null, callee_of, status_category, status_text, trace_service
from ..functions.storage import kept

YEAR_US = 365 * 86_400 * 1_000_000


def typed(spans: DataFrame) -> DataFrame:
    for c in ("trace_id", "span_id", "parent_id", "service", "operation"):
        spans = spans.withColumn(c, blank_to_null(F.col(c)))
    return spans


def _verdict(*issues: tuple[Column, str]) -> Column:
    """The names of the issues that hold, joined by |, or valid."""
    found = F.concat_ws("|", *(F.when(c, name) for c, name in issues))
    return F.when(found == "", "valid").otherwise(found)


def structure(spans: DataFrame) -> DataFrame:
    """For each case: spans, distinct traces and spans, rows that lack a field, bad times and durations, repeated span ids (rows over distinct ids), range, and a status.

    Ids are counted by (case, id) first; the counters are sums of these. The status doesn't look at missing services, operations and status codes.
    """
    lacks = {"service": "missing_service_count", "operation": "missing_operation_count", "status": "missing_status_code_count", "start_us": "invalid_timestamp_count", "duration": "invalid_duration_count"}
    counters = [F.count("*").alias("span_count"), F.count_if(F.col("trace_id").isNull()).alias("missing_trace_id_count"), *(F.count_if(F.col(c).isNull()).alias(name) for c, name in lacks.items()), F.count_if(F.col("duration") < 0).alias("negative_duration_count")]
    by_span = spans.groupBy("case_no", "span_id").agg(*counters, F.min("start_us").alias("start_us"), F.max("start_us").alias("end_us"))
    named = F.col("span_id").isNotNull()
    sums = ["span_count", "missing_trace_id_count", *lacks.values(), "negative_duration_count"]
    one = by_span.groupBy("case_no").agg(
        *(F.sum(c).alias(c) for c in sums), F.count("span_id").alias("unique_span_count"), F.coalesce(F.sum(F.when(~named, F.col("span_count"))), F.lit(0)).alias("missing_span_id_count"),
        F.coalesce(F.sum(F.when(named, F.col("span_count") - 1)), F.lit(0)).alias("duplicate_span_id_count"), F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"),
    )
    traces = spans.select("case_no", "trace_id").distinct().groupBy("case_no").agg(F.count("trace_id").alias("unique_trace_count"))
    some = lambda c: F.col(c) > 0
    status = _verdict(
        (some("missing_trace_id_count"), "missing_trace_id"), (some("missing_span_id_count"), "missing_span_id"), (some("invalid_timestamp_count"), "invalid_timestamp"),
        (some("invalid_duration_count"), "invalid_duration"), (some("negative_duration_count"), "negative_duration"), (some("duplicate_span_id_count"), "duplicate_span_id"),
    )
    return one.join(traces, "case_no").withColumn("status", status)


def range_covered(structure_: DataFrame, injections: DataFrame, reach_us: int = YEAR_US) -> DataFrame:
    """Whether a case's spans reach both ends of the window around its injection; injections: (case_no, inject_us)."""
    j = structure_.join(injections, "case_no")
    return j.select("case_no", ((F.col("start_us") <= F.col("inject_us") - reach_us) & (F.col("end_us") >= F.col("inject_us") + reach_us)).alias("trace_covered"))


def root_identity(spans: DataFrame) -> DataFrame:
    """Traces with no, one and several distinct roots (blank parents) for each case, roots that lack an id, whether the traces add up, and a status."""
    root = F.col("parent_id").isNull()
    t = spans.groupBy("case_no", "trace_id").agg(F.countDistinct(F.when(root, F.col("span_id"))).alias("roots"), F.count_if(root).alias("rows"), F.count_if(root & F.col("span_id").isNull()).alias("no_span"))
    named = F.col("trace_id").isNotNull()
    out = t.groupBy("case_no").agg(
        F.count("trace_id").alias("unique_trace_count"), F.coalesce(F.sum(F.when(named, F.col("roots"))), F.lit(0)).alias("unique_root_span_count"),
        F.count_if(named & (F.col("roots") == 0)).alias("zero_root_trace_count"), F.count_if(named & (F.col("roots") == 1)).alias("single_root_trace_count"), F.count_if(named & (F.col("roots") > 1)).alias("multiple_root_trace_count"),
        F.coalesce(F.sum(F.when(~named, F.col("rows"))), F.lit(0)).alias("root_missing_trace_id_count"), F.sum("no_span").alias("root_missing_span_id_count"),
    )
    n = F.col("unique_trace_count")
    balance = F.col("zero_root_trace_count") + F.col("single_root_trace_count") + F.col("multiple_root_trace_count") == n
    some = lambda c: F.col(c) > 0
    status = _verdict(
        (n == 0, "empty_trace_identity"), (some("zero_root_trace_count"), "zero_root_trace"), (some("multiple_root_trace_count"), "multiple_root_trace"),
        (some("root_missing_trace_id_count"), "root_missing_trace_id"), (some("root_missing_span_id_count"), "root_missing_span_id"), (~balance, "identity_balance_mismatch"),
    )
    return out.withColumns({"single_root_ratio": F.round(F.coalesce(F.try_divide(F.col("single_root_trace_count"), n), F.lit(0.0)), 6), "identity_balance_valid": balance, "status": status})


def first_spans(spans: DataFrame) -> DataFrame:
    """The first row of each span id in file order, with what the audits need of it; blank ids are left out before.

    The least row is found by partial aggregation, with no sort of all spans.
    """
    needed = [c for c in ("trace_id", "parent_id", "service", "operation", "start_us", "status") if c in spans.columns]
    least = spans.where("span_id is not null").groupBy("case_no", "span_id").agg(F.min_by(F.struct(*needed), "file_order").alias("x"))
    return least.select("case_no", "span_id", "x.*")


def start_sums(first: DataFrame) -> DataFrame:
    """(case_no, service, n, s): distinct spans and the sum of their starts, which a long holds for about ten thousand spans of today.

    s is a long where all sums fit, else a decimal of 38 digits for all rows; either is exact.
    """
    out = kept(first.groupBy("case_no", "service").agg(F.count("*").alias("n"), F.sum(F.col("start_us").cast("decimal(28,0)")).alias("s")), "sums")
    too_large = (F.col("s") > 2**63 - 1) | (F.col("s") < -(2**63))
    return out if not out.where(too_large).isEmpty() else out.withColumn("s", F.col("s").cast("long"))


def _share(counts: DataFrame) -> DataFrame:
    return counts.withColumn("share", F.round(F.col("span_count") / F.sum("span_count").over(Window.partitionBy("case_no")), 6))


def root_operations(first: DataFrame) -> DataFrame:
    """Distinct root spans for each service and operation, with their share of the case."""
    name = lambda c: F.coalesce(c, F.lit("<missing>")).alias(c)
    return _share(first.where("parent_id is null").groupBy("case_no", name("service"), name("operation")).agg(F.count("*").alias("span_count")))


def status_codes(first: DataFrame) -> DataFrame:
    """Distinct spans by root or child, service and status; distinct traces by pre-aggregation."""
    scope = F.when(F.col("parent_id").isNull(), "root").otherwise("child")
    keys = ["case_no", "scope", "service", "status_code", "status_category"]
    rows = first.select("case_no", scope.alias("scope"), F.coalesce("service", F.lit("<missing>")).alias("service"), status_text(F.col("status")).alias("status_code"), status_category(F.col("status")).alias("status_category"), "trace_id")
    per = rows.groupBy(*keys, "trace_id").agg(F.count("*").alias("n"))
    return _share(per.groupBy(*keys).agg(F.sum("n").alias("span_count"), F.count("trace_id").alias("trace_count")))


def reconcile(roots: DataFrame, operations: DataFrame, structure_: DataFrame, statuses: DataFrame) -> DataFrame:
    """For each case whether two audits agree: distinct roots with root operations, distinct spans with status counts, and shares that sum to 1.

    Shares are rounded to six places, so their sum may be off by half a millionth for each row."""
    one = lambda df, n: df.groupBy("case_no").agg(F.sum("span_count").alias(n), (F.abs(F.sum("share") - 1) <= F.count("*") * 5e-7 + 1e-9).alias(f"{n}_shares"))
    j = structure_.select("case_no", "unique_span_count").join(roots.select("case_no", "unique_root_span_count"), "case_no").join(one(operations, "operation_roots"), "case_no", "left").join(one(statuses, "status_spans"), "case_no", "left")
    agree = lambda a, b: F.col(a).eqNullSafe(F.coalesce(b, F.lit(0)))
    return j.select(
        "case_no", "unique_span_count", "unique_root_span_count", "operation_roots", "status_spans", agree("unique_root_span_count", "operation_roots").alias("roots_agree"), agree("unique_span_count", "status_spans").alias("spans_agree"),
        (F.coalesce("operation_roots_shares", F.lit(True)) & F.coalesce("status_spans_shares", F.lit(True))).alias("shares_valid"),
    )


def traces_without_root(spans: DataFrame) -> DataFrame:
    t = spans.where("trace_id is not null").select("case_no", "trace_id", F.col("parent_id").isNull().alias("root"))
    return t.groupBy("case_no", "trace_id").agg(F.bool_or("root").alias("rooted")).where("not rooted").select("case_no", "trace_id")


def in_windows(spans: DataFrame, injections: DataFrame, reach_us: int = YEAR_US) -> DataFrame:
    """Spans of the half-open window around their own case's injection, with baseline or incident; injections has a row a case."""
    after = F.col("start_us") - F.col("inject_us")
    # the bounds of all cases, which need no join, come first: they reach the side of a view's joins that has the time
    near = (F.col("start_us") >= injections.agg(F.min("inject_us")).scalar() - reach_us) & (F.col("start_us") < injections.agg(F.max("inject_us")).scalar() + reach_us)
    s = spans.where(near).join(injections, "case_no").where((after >= -reach_us) & (after < reach_us))
    return s.withColumn("window_type", F.when(after < 0, "baseline").otherwise("incident")).drop("inject_us")


def call_volume(spans: DataFrame, injections: DataFrame, reach_us: int = YEAR_US) -> DataFrame:
    """Client calls for each caller and callee before and from the injection on; windows are half-open."""
    s = in_windows(spans.select("case_no", "service", "operation", "start_us"), injections, reach_us)
    s = s.select("case_no", F.col("service").alias("caller"), callee_of(F.col("operation")).alias("callee"), "window_type").where("callee is not null and caller <> callee")
    return s.groupBy("case_no", "caller", "callee").agg(F.count_if(F.col("window_type") == "baseline").alias("baseline_calls"), F.count_if(F.col("window_type") == "incident").alias("incident_calls"))


def call_graph(volume: DataFrame) -> DataFrame:
    return volume.groupBy("caller", "callee").agg(F.count("*").alias("run_count"), F.sum(F.col("baseline_calls") + F.col("incident_calls")).alias("total_calls"))


def call_volume_change(volume: DataFrame, drop: float = 0.2) -> DataFrame:
    """For each case: share of edges that fall by more than `drop`, the largest fall (below 0 if all rise), and the total change."""
    fall = F.when(F.col("baseline_calls") > 0, (F.col("baseline_calls") - F.col("incident_calls")) / F.col("baseline_calls")).otherwise(0.0)
    out = volume.groupBy("case_no").agg(F.avg(F.when(fall > drop, 1.0).otherwise(0.0)).alias("s"), F.max(fall).alias("m"), F.sum("baseline_calls").alias("b"), F.sum("incident_calls").alias("i"))
    return out.select("case_no", F.round("s", 6).alias("edge_drop_share"), F.round("m", 6).alias("max_drop"), F.round(F.coalesce(F.try_divide(F.col("i") - F.col("b"), F.col("b")), F.lit(0.0)), 6).alias("total_change"))


#: Services that are no part of the shop.
EXCLUDED = ("health", "traceservice")


def service_anomalies(stats: DataFrame, z: float = 3.0, ratio: float = 1.5) -> DataFrame:
    """For each case, modality and service the largest mean z of its anomalous operations, else 0.

    An operation is anomalous if its mean z is above `z` and its incident mean above `ratio` times its baseline mean; with a
    baseline of 0, if its incident mean is above 0. A null z is no anomaly.
    """
    kind, service = F.split_part("column_name", F.lit("__"), F.lit(1)), trace_service(F.col("column_name"))
    s = stats.where(F.col("column_name").rlike("^trace_(latency|error)__")).select("case_no", kind.alias("modality"), service.alias("service"), "zscore_mean", "baseline_mean", (F.col("baseline_mean") + F.col("delta_mean")).alias("incident_mean"))
    large = F.when(F.col("baseline_mean") == 0, F.col("incident_mean") > 0).otherwise((F.col("zscore_mean") > z) & (F.col("incident_mean") / F.col("baseline_mean") > ratio))
    score = F.when(F.col("zscore_mean").isNotNull() & large, F.col("zscore_mean"))
    return s.where(~F.col("service").isin(*EXCLUDED)).groupBy("case_no", "modality", "service").agg(F.greatest(F.coalesce(F.max(score), F.lit(0.0)), F.lit(0.0)).alias("magnitude"))


def span_signals(spans: DataFrame, injections: DataFrame, reach_us: int = YEAR_US) -> DataFrame:
    """Latency and error statistics of each case's services from its spans: column_name, baseline_mean, delta_mean, zscore_mean."""
    s = in_windows(spans.select("case_no", "service", "start_us", "duration", F.coalesce((F.col("status") == 14).cast("double"), F.lit(0.0)).alias("failed")), injections, reach_us)
    before, after = (lambda c: F.when(F.col("window_type") == "baseline", F.col(c))), (lambda c: F.when(F.col("window_type") == "incident", F.col(c)))
    kinds = {"trace_latency": "duration", "trace_error": "failed"}
    one = s.groupBy("case_no", "service").agg(*(f.alias(f"{c}_{n}") for c in kinds.values() for n, f in (("b", F.avg(before(c))), ("s", F.stddev_pop(before(c))), ("i", F.avg(after(c))))))
    rows = [F.struct(F.concat(F.lit(f"{k}__"), "service", F.lit("_Get")).alias("column_name"), F.col(f"{c}_b").alias("baseline_mean"), (F.col(f"{c}_i") - F.col(f"{c}_b")).alias("delta_mean"), F.try_divide(F.col(f"{c}_i") - F.col(f"{c}_b"), F.col(f"{c}_s")).alias("zscore_mean")) for k, c in kinds.items()]
    return one.select("case_no", F.inline(F.array(*rows)))


def _anomalous(anomalies: DataFrame, graph: DataFrame) -> DataFrame:
    """For each case its services of anomalous latency (hot), the graph's edges, and those between hot services.

    Arrays are bounded by the services of a system and the edges between them, whatever the number of cases and spans.
    """
    edges = graph.select(F.sort_array(F.collect_set(F.struct("caller", "callee")))).scalar()
    latency = F.col("modality") == "trace_latency"
    found = anomalies.groupBy("case_no").agg(
        F.collect_set(F.when(latency & (F.col("magnitude") > 0), F.col("service"))).alias("hot"), F.coalesce(F.sum(F.when(latency, F.col("magnitude"))), F.lit(0.0)).alias("latency"),
        F.count_if((F.col("modality") == "trace_error") & (F.col("magnitude") > 0)).alias("errors"),
    ).withColumn("edges", edges)
    return found.withColumn("between", F.filter("edges", lambda e: F.array_contains("hot", e["caller"]) & F.array_contains("hot", e["callee"])))


def _depth() -> Column:
    """Services in the longest chain of calls between hot ones that meets no service twice.

    Chains grow by one call a step. Those that have met the same services and stand at the same one go on as one, so what is kept
    is bounded by the sets of a case's hot services and not by the orders in which calls can meet them.
    """
    first = F.transform("hot", lambda s: F.struct(s.alias("at"), F.array(s).alias("met")))
    start = F.struct(first.alias("chains"), F.lit(0).alias("depth"))

    def longer(chain):
        onward = F.filter("between", lambda e: (e["caller"] == chain["at"]) & ~F.array_contains(chain["met"], e["callee"]))
        return F.transform(onward, lambda e: F.struct(e["callee"].alias("at"), F.array_sort(F.array_append(chain["met"], e["callee"])).alias("met")))

    def step(x, _):
        onward = F.array_distinct(F.flatten(F.transform(x["chains"], longer)))
        return F.struct(onward.alias("chains"), (x["depth"] + F.when(F.size(x["chains"]) > 0, 1).otherwise(0)).alias("depth"))

    return F.aggregate("hot", start, step, lambda x: x["depth"])


def anomalous_edges(anomalies: DataFrame, graph: DataFrame) -> DataFrame:
    return _anomalous(anomalies, graph).select("case_no", F.inline("between"))


def propagation_depth(anomalies: DataFrame, graph: DataFrame) -> DataFrame:
    return _anomalous(anomalies, graph).select("case_no", _depth().alias("depth"))


def service_context(anomalies: DataFrame, graph: DataFrame, volume: DataFrame, frontend: str = "frontendservice") -> DataFrame:
    """Fifteen features a case: how many services are anomalous, how they lie in the call graph, and how calls change."""
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    calls = lambda side, s: F.filter("edges", lambda e: e[side] == s)
    nodes = F.array_distinct(F.concat(F.transform("edges", lambda e: e["caller"]), F.transform("edges", lambda e: e["callee"])))
    near = lambda s: F.array_distinct(F.concat(F.transform(calls("caller", s), lambda e: e["callee"]), F.transform(calls("callee", s), lambda e: e["caller"])))
    spread = F.filter(F.transform("hot", lambda s: F.try_divide(F.size(F.array_intersect(near(s), F.col("hot"))).cast("double"), F.size(near(s)))), lambda x: x.isNotNull())
    most = lambda side: F.coalesce(F.array_max(F.transform("hot", lambda s: F.size(calls(side, s)))), F.lit(0)).cast("long")
    out = _anomalous(anomalies, graph).select(
        "case_no", F.size("hot").cast("long").alias("svc__anomalous_service_count"), share(F.size("hot"), F.size(nodes)).alias("svc__anomalous_service_share"),
        F.col("latency").alias("svc__latency_anomaly_magnitude"), F.col("errors").alias("svc__error_service_count"), F.size("between").cast("long").alias("svc__anomalous_edge_count"),
        share(F.size("between"), F.size("edges")).alias("svc__anomalous_edge_share"), _depth().alias("svc__propagation_depth"),
        F.size(F.filter("hot", lambda s: ~F.exists("between", lambda e: e["callee"] == s))).cast("long").alias("svc__anomalous_root_count"),
        share(F.aggregate(spread, F.lit(0.0), lambda a, x: a + x), F.size(spread)).alias("svc__contagion_ratio"), F.array_contains("hot", frontend).cast("long").alias("svc__frontend_anomalous"),
        most("callee").alias("svc__max_in_degree_anomalous"), most("caller").alias("svc__max_out_degree_anomalous"),
    )
    change = call_volume_change(volume).withColumnsRenamed({"edge_drop_share": "svc__call_volume_drop_share", "max_drop": "svc__call_volume_max_drop", "total_change": "svc__call_volume_total_change"})
    return out.join(change, "case_no", "left").fillna(0.0, [c for c in change.columns if c != "case_no"])
