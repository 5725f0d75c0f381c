"""Severity labels from policy tables, and evaluation of predictions."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LabelPolicy:
    """Weights by fault category and service tier, and the classes of their product; short tables that whoever agrees on labels sets."""

    version: str
    frozen: bool
    categories: dict[str, str]
    category_weights: dict[str, int]
    tiers: dict[str, str]
    tier_weights: dict[str, int]
    classes: tuple[tuple[str, int, int], ...]

    @property
    def faults(self) -> list[tuple[str, str, int]]:
        return [(f, c, self.category_weights.get(c, 0)) for f, c in self.categories.items()]

    @property
    def services(self) -> list[tuple[str, str, int]]:
        return [(s, t, self.tier_weights.get(t, 0)) for s, t in self.tiers.items()]


#: Classes by score, and the default policy.
CLASSES = (("Low", 1, 2), ("Medium", 3, 4), ("High", 5, 6))
DEFAULT_POLICY = LabelPolicy(
    version="fcw_sct_v2",
    frozen=False,
    categories={"cpu": "resource", "mem": "resource", "disk": "resource", "delay": "network", "loss": "network", "socket": "resource"},
    category_weights={"resource": 1, "network": 2},
    tiers={"checkoutservice": "A", "productcatalogservice": "A", "currencyservice": "B", "recommendationservice": "C", "emailservice": "C"},
    tier_weights={"A": 3, "B": 2, "C": 1},
    classes=CLASSES,
)
#: The policy of the driver's two services, and other tiers for them.
DRIVER_POLICY = replace(DEFAULT_POLICY, tiers={"svc0": "core", "svc1": "edge"}, tier_weights={"core": 3, "edge": 1})
SCHEMES = {"default": DRIVER_POLICY, "flat": replace(DRIVER_POLICY, tiers={"svc0": "core", "svc1": "core"}, tier_weights={"core": 1}), "reversed": replace(DRIVER_POLICY, tiers={"svc0": "edge", "svc1": "core"})}


def severity_labels(runs: DataFrame, policy: LabelPolicy = DRIVER_POLICY) -> DataFrame:
    """fcw x sct in a class's range gives the severity; what no policy row maps raises an error. Policy version and status stand beside it."""
    spark = runs.sparkSession
    f = spark.createDataFrame(policy.faults, "fault_type string, fault_category string, fcw long")
    t = spark.createDataFrame(policy.services, "service string, service_tier string, sct long")
    c = spark.createDataFrame(list(policy.classes), "severity string, lo long, hi long")
    j = runs.join(f, "fault_type", "left").join(t, "service", "left").withColumn("severity_score", F.col("fcw") * F.col("sct")).join(c, (F.col("severity_score") >= F.col("lo")) & (F.col("severity_score") <= F.col("hi")), "left")
    severity = F.when(F.col("severity").isNull(), F.raise_error(F.concat(F.lit("no label for "), "case_id"))).otherwise(F.col("severity"))
    return j.select(
        "case_no", "case_id", "scenario", "service", "fault_type", "fault_category", "fcw", "service_tier", "sct", "severity_score", severity.alias("severity"),
        F.lit(policy.version).alias("label_policy_version"), F.lit("final" if policy.frozen else "candidate").alias("label_status"),
    )


def label_distribution(labels: DataFrame) -> DataFrame:
    """Counts overall, by service and by fault; every class is there, with 0 if it has no case."""
    spark = labels.sparkSession
    classes = F.broadcast(spark.createDataFrame([(c,) for c, _, _ in CLASSES], "severity string"))
    parts = []
    for kind, key in (("all", F.lit("all")), ("service", F.col("service")), ("fault", F.col("fault_type"))):
        keys = labels.select(key.alias("name")).distinct()
        n = labels.groupBy(key.alias("name"), "severity").agg(F.count("*").alias("n"))
        parts.append(keys.crossJoin(classes).join(n, ["name", "severity"], "left").select(F.lit(kind).alias("kind"), "name", "severity", F.coalesce("n", F.lit(0)).alias("case_count")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def label_sensitivity(runs: DataFrame) -> DataFrame:
    """Classes under other tier schemes."""
    out = None
    for name, policy in SCHEMES.items():
        part = severity_labels(runs, policy).groupBy("severity").agg(F.count("*").alias("case_count"), F.countDistinct("scenario").alias("scenario_count")).select(F.lit(name).alias("scheme"), "severity", "case_count", "scenario_count")
        out = part if out is None else out.unionByName(part)
    return out


def label_violations(labels: DataFrame, runs: DataFrame) -> DataFrame:
    """(rule, name): what breaks a rule of derived labels: cases that come twice, that have no label or no run, with a missing field, with a
    score that isn't fcw times sct or lies outside its severity's range, and scenarios of several severities. Valid labels give no rows."""
    spark = labels.sparkSession
    ranges = spark.createDataFrame(CLASSES, "severity string, lo long, hi long")
    by = lambda rule, rows, name="case_id": rows.select(F.lit(rule).alias("rule"), F.col(name).cast("string").alias("name"))
    fields = ("fault_category", "fcw", "service_tier", "sct", "severity_score", "severity")
    empty = F.lit(False)
    for c in fields:
        empty = empty | F.col(c).isNull()
    placed = labels.join(ranges, "severity", "left")
    out_of_range = F.col("lo").isNull() | (F.col("severity_score") < F.col("lo")) | (F.col("severity_score") > F.col("hi"))
    parts = [
        by("repeated_case", labels.groupBy("case_id").agg(F.count("*").alias("n")).where("n > 1")),
        by("case_without_label", runs.join(labels, "case_id", "left_anti")),
        by("label_without_case", labels.join(runs, "case_id", "left_anti")),
        by("missing_field", labels.where(empty)),
        by("score_is_no_product", labels.where("severity_score <> fcw * sct")),
        by("severity_out_of_range", placed.where(out_of_range & F.col("severity").isNotNull())),
        by("mixed_scenario", labels.groupBy("scenario").agg(F.countDistinct("severity").alias("n")).where("n > 1"), "scenario"),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def policy_violations(runs: DataFrame, policy: LabelPolicy = DRIVER_POLICY) -> DataFrame:
    """(rule, name): faults and services of the runs that the policy doesn't map, weights that aren't positive, and products of weights that
    fall in no severity's range or in several. A sound policy gives no rows; policy tables are short."""
    spark = runs.sparkSession
    f = spark.createDataFrame(policy.faults, "fault_type string, fault_category string, fcw long")
    t = spark.createDataFrame(policy.services, "service string, service_tier string, sct long")
    c = spark.createDataFrame(list(policy.classes), "severity string, lo long, hi long")
    by = lambda rule, rows, name: rows.select(F.lit(rule).alias("rule"), F.col(name).cast("string").alias("name"))
    scores = f.select("fcw").crossJoin(t.select("sct")).select((F.col("fcw") * F.col("sct")).alias("score")).distinct()
    fits = scores.join(c, (F.col("score") >= F.col("lo")) & (F.col("score") <= F.col("hi")), "left").groupBy("score").agg(F.count("severity").alias("n"))
    parts = [
        by("unmapped_fault", runs.select("fault_type").distinct().join(f, "fault_type", "left_anti"), "fault_type"), by("unmapped_service", runs.select("service").distinct().join(t, "service", "left_anti"), "service"),
        by("weight_not_positive", f.where("fcw <= 0"), "fault_type"), by("weight_not_positive", t.where("sct <= 0"), "service"),
        by("score_in_no_class", fits.where("n = 0"), "score"), by("score_in_several_classes", fits.where("n > 1"), "score"),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def oof_from_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, repeat, scenario, y_true, y_pred): the labels table as out-of-fold predictions of three repeats."""
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", (F.col("quality") + F.col("toxic")).alias("t"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("repeat"))
    names = F.array(*map(F.lit, ("High", "Low", "Medium")))
    wrong = F.when(F.pmod(F.col("doc_id") * 31 + F.col("repeat") * 17, F.lit(7)) < 2, 1).otherwise(0)
    return rows.select(F.col("doc_id").alias("case_id"), "repeat", (F.col("doc_id") % 30).alias("scenario"), F.element_at(names, (F.col("t") + 1).cast("int")).alias("y_true"), F.element_at(names, ((F.col("t") + wrong) % 3 + 1).cast("int")).alias("y_pred"))


def scores(oof: DataFrame, classes: tuple[str, ...] = ("Low", "Medium", "High")) -> DataFrame:
    """Accuracy, balanced accuracy, macro F1 and recalls for each repeat; a division by zero gives 0."""
    n = oof.groupBy("repeat").agg(F.count("*").alias("n"), F.count_if(F.col("y_true") == F.col("y_pred")).alias("right"), *(x for c in classes for x in (F.count_if((F.col("y_true") == c) & (F.col("y_pred") == c)).alias(f"tp_{c}"), F.count_if(F.col("y_true") == c).alias(f"t_{c}"), F.count_if(F.col("y_pred") == c).alias(f"p_{c}"))))
    part = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    recall = {c: part(F.col(f"tp_{c}"), F.col(f"t_{c}")) for c in classes}
    f1 = {c: part(2 * F.col(f"tp_{c}"), F.col(f"t_{c}") + F.col(f"p_{c}")) for c in classes}
    there = sum((F.when(F.col(f"t_{c}") > 0, 1).otherwise(0) for c in classes), F.lit(0))
    return n.select("repeat", F.round(F.col("right") / F.col("n"), 6).alias("accuracy"), F.round(sum(recall.values(), F.lit(0.0)) / there, 6).alias("balanced_accuracy"), F.round(sum(f1.values(), F.lit(0.0)) / len(classes), 6).alias("macro_f1"), *(F.round(recall[c], 6).alias(f"recall_{c.lower()}") for c in classes))


def score_summary(per_repeat: DataFrame) -> DataFrame:
    return per_repeat.agg(F.round(F.avg("macro_f1"), 6).alias("macro_f1_mean"), F.round(F.stddev_samp("macro_f1"), 6).alias("macro_f1_std"), F.round(F.avg("accuracy"), 6).alias("accuracy_mean"))


def confusion(oof: DataFrame) -> DataFrame:
    return oof.groupBy("y_true").pivot("y_pred", ["Low", "Medium", "High"]).agg(F.count("case_id")).select("y_true", *(F.coalesce(c, F.lit(0)).alias(f"pred_{c.lower()}") for c in ("Low", "Medium", "High")))


def scenario_accuracy(oof: DataFrame) -> DataFrame:
    case = oof.groupBy("scenario", "case_id").agg(F.avg(F.when(F.col("y_true") == F.col("y_pred"), 1.0).otherwise(0.0)).alias("a"))
    return case.groupBy("scenario").agg(F.round(F.avg("a"), 6).alias("accuracy"), F.count("*").alias("case_count"))


def majority_class(oof: DataFrame) -> DataFrame:
    """The class predicted most often for each case; ties go to the first name."""
    n = oof.groupBy("case_id", "y_pred").agg(F.count("*").alias("n"))
    best = n.groupBy("case_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "y_pred")).alias("x"))
    return best.select("case_id", F.col("x.y_pred").alias("majority"), (-F.col("x.m")).alias("votes"))
