"""Whether features of the call graph only tell which service or tier a case has."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _best_split(values: DataFrame, keys: list[str], k: int) -> DataFrame:
    """For each group the threshold that leaves the purest two sides: x is at most it on the left; of equals the smallest one.

    values: keys, x and counts c0..c{k-1} of its classes, a row for each distinct x. Class counts of both sides are running sums over x.
    """
    to_here = Window.partitionBy(*keys).orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    v = values
    for i in range(k):
        v = v.withColumns({f"l{i}": F.sum(f"c{i}").over(to_here), f"t{i}": F.sum(f"c{i}").over(whole)})
    left, right = [F.col(f"l{i}") for i in range(k)], [F.col(f"t{i}") - F.col(f"l{i}") for i in range(k)]
    add = lambda xs: sum(xs, F.lit(0))
    # least impurity: the sum over both sides of squared class counts by the side's size is largest
    purity = F.try_divide(add(x * x for x in left).cast("double"), add(left)) + F.try_divide(add(x * x for x in right).cast("double"), add(right))
    v = v.withColumn("purity", F.round(purity, 9)).where("purity is not null")
    return v.groupBy(*keys).agg(F.min(F.struct((-F.col("purity")).alias("m"), "x"))["x"].alias("threshold"))


def tier_accuracy(features: DataFrame, cases: DataFrame) -> DataFrame:
    """(feature_name, tier_balanced_accuracy): how well a tree of depth 2 on this feature alone tells the tier of the cases it is grown on.

    features: (case_no, feature_name, value), cases: (case_no, tier). Values that are missing take no part. Both levels take the purest split; a side of one value isn't split; a leaf names its
    most frequent tier, of equals the first by name. Tiers are few.
    """
    tiers = [r[0] for r in cases.select("tier").distinct().orderBy("tier").collect()]
    k = len(tiers)
    rows = features.where("value is not null").join(cases.select("case_no", "tier"), "case_no")
    counts = [F.count_if(F.col("tier") == t).alias(f"c{i}") for i, t in enumerate(tiers)]
    values = rows.groupBy("feature_name", F.col("value").alias("x")).agg(*counts)
    root = _best_split(values, ["feature_name"], k).withColumnRenamed("threshold", "root")
    sided = values.join(root, "feature_name", "left").withColumn("right", F.coalesce(F.col("x") > F.col("root"), F.lit(False)))
    second = _best_split(sided, ["feature_name", "right"], k)
    leaf = F.coalesce(F.col("x") > F.col("threshold"), F.lit(False)).alias("upper")
    leaves = sided.join(second, ["feature_name", "right"], "left").groupBy("feature_name", "right", leaf).agg(*(F.sum(f"c{i}").alias(f"c{i}") for i in range(k)))
    named = F.array_min(F.array(*(F.struct((-F.col(f"c{i}")).alias("m"), F.lit(i).alias("i")) for i in range(k))))["i"]
    hits = leaves.withColumn("named", named).groupBy("feature_name").agg(
        *(F.sum(F.when(F.col("named") == i, F.col(f"c{i}")).otherwise(0)).alias(f"h{i}") for i in range(k)), *(F.sum(f"c{i}").alias(f"c{i}") for i in range(k))
    )
    recalls = F.array(*(F.try_divide(F.col(f"h{i}").cast("double"), F.col(f"c{i}")) for i in range(k)))
    there = F.filter(recalls, lambda x: x.isNotNull())
    return hits.select("feature_name", (F.aggregate(there, F.lit(0.0), lambda s, x: s + x) / F.size(there)).alias("tier_balanced_accuracy"))


def proxy_audit(features: DataFrame, cases: DataFrame, most: float = 0.85, least: float = 0.05) -> DataFrame:
    """For each feature whether it may be used: rejected if it is constant, if a small tree on it tells the tier (`most`), or if it hardly
    varies within a service against all cases (`least`). cases: (case_no, service, tier)."""
    f = features.join(cases, "case_no")
    within = f.groupBy("feature_name", "service").agg(F.var_pop("value").alias("v")).groupBy("feature_name").agg(F.avg("v").alias("within"))
    total = f.groupBy("feature_name").agg(F.var_pop("value").alias("total"), (F.min("value") == F.max("value")).alias("constant"))
    j = total.join(within, "feature_name").join(tier_accuracy(features, cases), "feature_name", "left")
    varies = lambda c: F.when(~F.col("constant"), F.round(c, 4))
    ratio = F.try_divide(F.col("within"), F.col("total"))
    reason = F.when(F.col("constant"), "constant").otherwise(F.concat_ws("|", F.when(F.col("tier_balanced_accuracy") >= most, "encodes_tier"), F.when(ratio < least, "service_identifier")))
    out = j.select("feature_name", varies(F.col("tier_balanced_accuracy")).alias("tier_balanced_accuracy"), varies(ratio).alias("within_service_variance_ratio"), reason.alias("reason"))
    return out.withColumn("decision", F.when(F.col("reason") == "", "passed").otherwise("rejected"))
