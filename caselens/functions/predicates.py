"""Scalar rules: blank text, strict numbers, column names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def blank_to_null(c: Column) -> Column:
    """Text without the white space around it (tabs and line feeds too); blank is null."""
    return F.nullif(F.regexp_replace(c, r"^\s+|\s+$", ""), F.lit(""))


def parse_bool(c: Column) -> Column:
    """true or false in any case; all else is null."""
    t = F.lower(blank_to_null(c))
    return F.when(t == "true", True).when(t == "false", False)


def checked_bool(rows: DataFrame, name: str) -> DataFrame:
    """Rows with a text column as true or false; any other text fails, and the first ten of them by name are told. Null stays null."""
    bad = rows.where(F.col(name).isNotNull() & parse_bool(F.col(name)).isNull()).select(name).distinct().orderBy(name).limit(10)
    found = [r[0] for r in bad.collect()]
    if found:
        raise ValueError(f"{name} holds values that are neither true nor false: {found}")
    return rows.withColumn(name, parse_bool(F.col(name)))


def status_text(c: Column) -> Column:
    return F.when(c.isNull(), "<missing>").when(c == F.floor(c), c.cast("bigint").cast("string")).otherwise(c.cast("string"))


def status_category(c: Column) -> Column:
    return F.when(c.isNull(), "missing").when(c == 0, "zero").otherwise("nonzero")


def modality(name: Column) -> Column:
    return F.split_part(name, F.lit("__"), F.lit(1))


#: How the gaps of a family are filled.
POLICIES = {
    "continuous_resource": "interpolate", "workload_signal": "interpolate", "latency_signal": "interpolate", "trace_latency": "interpolate",
    "disk_activity": "zero", "error_signal": "zero", "log_count": "zero", "trace_error": "zero",
}
#: Endings of gauges, and patterns of log templates; a lifecycle pattern goes before an error one.
GAUGES = ("_cpu", "_mem", "_socket")
LIFECYCLE = "(?i)initializing|listening on port|profil(er|ing) disabled|tracing enabled|stats enabled|catalog address|env platform|metadata server"
FAILURE = "(?i)error|fail|exception|unavailable|deadline|timeout|refused|panic|raise|statuscode"


def feature_family(name: Column) -> Column:
    """The family of a column by its modality, and of a metric by the end of its name; any other column fails."""
    kind, rest = modality(name), F.lower(F.regexp_extract(name, "^.*?__(.*)$", 1))
    gauge = F.lit(False)
    for end in GAUGES:
        gauge = gauge | rest.endswith(end)
    metric = F.when(gauge, "continuous_resource").when(rest.endswith("_diskio"), "disk_activity").when(rest.endswith("_error"), "error_signal").when(rest.endswith("_workload"), "workload_signal").when(rest.contains("latency"), "latency_signal")
    family = F.when(kind == "log", "log_count").when(kind.isin("trace_latency", "trace_error"), kind).when(kind == "metric", metric)
    return F.when(family.isNull(), F.raise_error(F.concat(F.lit("unknown column "), name))).otherwise(family)


def fill_policy(family: Column) -> Column:
    return F.when(family.isin(*(k for k, v in POLICIES.items() if v == "zero")), "zero").otherwise("interpolate")


def template_category(t: Column) -> Column:
    """lifecycle before error, else routine."""
    return F.when(t.rlike(LIFECYCLE), "lifecycle").when(t.rlike(FAILURE), "error").otherwise("routine")


def log_column_parts(name: Column) -> tuple[Column, Column]:
    """log__svc_12 gives svc and 12, split at the last underscore."""
    return F.regexp_extract(name, r"^log__(.*)_([^_]+)$", 1), F.regexp_extract(name, r"^log__(.*)_([^_]+)$", 2)


def trace_service(name: Column) -> Column:
    """trace_latency__svc_Place_Order__zscore_mean gives svc: what follows the first double underscore, up to an underscore."""
    return F.split_part(F.split_part(name, F.lit("__"), F.lit(2)), F.lit("_"), F.lit(1))


def callee_of(operation: Column, package: str = "shop") -> Column:
    """The service that an operation <package>.<Name>/... calls, in lower case; null for other operations, and for packages whose name only ends so."""
    return F.lower(F.nullif(F.regexp_extract(operation, rf"\b{package}\.([A-Za-z]+)/", 1), F.lit("")))
