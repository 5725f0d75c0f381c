"""What each feature adds to a forest's probabilities: exact path-dependent Shapley shares, by the leaf paths that rows follow."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import kept, new_path


def node_table(model: RandomForestClassificationModel, spark) -> DataFrame:
    """(tree, node, left, right, feature, threshold, cover, p): the forest's nodes as it saves them; p are a leaf's class shares."""
    path = new_path(spark, "forest")
    model.write().save(path)
    n = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    cover = F.aggregate("impurityStats", F.lit(0.0), lambda s, x: s + x)
    return n.select(
        F.col("treeID").alias("tree"), F.col("id").alias("node"), F.col("leftChild").alias("left"), F.col("rightChild").alias("right"),
        F.col("split.featureIndex").alias("feature"), F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
        cover.alias("cover"), F.transform("impurityStats", lambda x: x / cover).alias("p"),
    )


def leaf_paths(nodes: DataFrame) -> DataFrame:
    """(path, p, weight, steps): each leaf with the features met on its way, once each: the range (low, high] that leads on, and the share of
    the rows there that do so (rest). weight is the leaf's share of its tree's rows. The way down is a join a level; a forest's size is set by its parameters."""
    below = nodes.select("tree", F.col("node").alias("next"), F.col("cover").alias("next_cover"))
    split = nodes.where("left >= 0").select("tree", "node", "feature", "threshold", "cover", F.explode(F.array(F.struct(F.lit(True).alias("is_left"), F.col("left").alias("next")), F.struct(F.lit(False).alias("is_left"), F.col("right").alias("next")))).alias("c"))
    edges = split.select("*", "c.*").drop("c").join(below, ["tree", "next"])
    low, high = F.when(F.col("is_left"), F.lit(float("-inf"))).otherwise(F.col("threshold")), F.when(F.col("is_left"), F.col("threshold")).otherwise(F.lit(float("inf")))
    step = F.struct("feature", low.alias("low"), high.alias("high"), (F.col("next_cover") / F.col("cover")).alias("rest"))
    edges = kept(edges.select("tree", "node", "next", step.alias("step")), "edges")
    at = nodes.where("node = 0").select("tree", "node", F.col("cover").alias("all"), F.from_json(F.lit("[]"), "array<struct<feature:int,low:double,high:double,rest:double>>").alias("steps"))
    leaves, found = nodes.where("left < 0").select("tree", "node", "cover", "p"), None
    while True:
        here = at.join(leaves, ["tree", "node"])
        found = here if found is None else found.unionByName(here)
        at = kept(at.join(edges, ["tree", "node"]).select("tree", F.col("next").alias("node"), "all", F.array_append("steps", F.col("step")).alias("steps")), "level")
        if at.isEmpty():
            break
    whole = lambda f: F.filter("steps", lambda s: s["feature"] == f)
    merged = F.transform(F.array_sort(F.array_distinct(F.transform("steps", lambda s: s["feature"]))), lambda f: F.struct(
        f.alias("feature"), F.array_max(F.transform(whole(f), lambda s: s["low"])).alias("low"), F.array_min(F.transform(whole(f), lambda s: s["high"])).alias("high"),
        F.aggregate(whole(f), F.lit(1.0), lambda a, s: a * s["rest"]).alias("rest"),
    ))
    return kept(found.select(F.concat_ws(":", "tree", "node").alias("path"), "p", (F.col("cover") / F.col("all")).alias("weight"), merged.alias("steps")), "paths")


def _shares(rest: np.ndarray, met: np.ndarray) -> np.ndarray:
    """For each step of a path the Shapley share of its feature, given which steps a row meets: the sum over subsets of the
    other steps, by their size, whose weights are the coefficients of the product of (rest + met * t)."""
    k, out = len(rest), np.empty(len(rest))
    weights = np.array([math.factorial(s) * math.factorial(k - 1 - s) / math.factorial(k) for s in range(k)])
    for j in range(k):
        c = np.ones(1)
        for i in range(k):
            if i != j:
                c = np.append(c * rest[i], 0.0) + np.append(0.0, c * met[i])
        out[j] = (met[j] - rest[j]) * (c @ weights)
    return out


def _added(leaves: list[tuple], used: list[int], classes: list[str]):
    """The task that sums up shares by row: from batches of (case_id, values) to (case_id, feature, value, a column for each class)."""
    place = {f: i for i, f in enumerate(used)}
    paths = [(np.array(f), np.array(low), np.array(high), np.array(rest), np.array(p)) for f, low, high, rest, p in leaves]

    def run(batches):
        known: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = batch.column("values").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            total = np.zeros((len(used), len(classes), n))
            for at, (features, low, high, rest, p) in enumerate(paths):
                v = x[:, features]
                # as the forest goes: left at most the threshold, else right, NaN too
                met = ((low == -np.inf) | ~(v <= low)) & ((high == np.inf) | (v <= high))
                codes, which = np.unique(met @ (1 << np.arange(len(features))), return_inverse=True)
                for code in codes:
                    if (at, code) not in known:
                        known[at, code] = _shares(rest, (code >> np.arange(len(features)) & 1).astype(float))
                share = np.array([known[at, code] for code in codes])[which]
                for j, f in enumerate(features):
                    total[place[f]] += p[:, None] * share[:, j]
            ids = batch.column("case_id").take(pa.array(np.tile(np.arange(n), len(used))))
            columns = [ids, pa.array(np.repeat(np.array(used, dtype=np.int32), n)), pa.array(x[:, used].T.ravel())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(total[:, i].ravel()) for i in range(len(classes))], ["case_id", "feature", "value", *classes])

    return run


def attributions(model: RandomForestClassificationModel, rows: DataFrame, names: list[str], classes: list[str]) -> tuple[DataFrame, DataFrame]:
    """(case_id, feature_name, value, a column for each class) of rows (case_id, values), and a row of the base values.

    A row meets each path's steps in one of few patterns; a task works out each pattern's shares once and adds them up row by row, with no
    shuffle. Features that no path meets have no row. Paths are as many as the forest's leaves, whatever the number of rows: they go
    to the tasks as the forest itself does for predictions.
    """
    spark = rows.sparkSession
    paths, trees = leaf_paths(node_table(model, spark)), float(model.getNumTrees)
    leaves = []
    for r in paths.where(F.size("steps") > 0).select("p", "steps").collect():
        p = [(r["p"][i] if i < len(r["p"]) else 0.0) / trees for i in range(len(classes))]
        leaves.append((*([s[c] for s in r["steps"]] for c in ("feature", "low", "high", "rest")), p))
    used = sorted({f for leaf in leaves for f in leaf[0]})
    kind = rows.schema["case_id"].dataType.simpleString()
    schema = ", ".join([f"case_id {kind}", "feature int", "value double", *(f"`{c}` double" for c in classes)])
    found = rows.select("case_id", "values").mapInArrow(_added(leaves, used, classes), schema)
    header = F.broadcast(spark.createDataFrame(list(enumerate(names)), "feature int, feature_name string"))
    out = found.join(header, "feature").select("case_id", "feature_name", "value", *classes)
    base = paths.agg(*((F.sum(F.col("weight") * F.coalesce(F.get("p", F.lit(i)), F.lit(0.0))) / trees).alias(c) for i, c in enumerate(classes)))
    return out, base


def out_of_fold(collected: list, names: list[str], classes: list[str]) -> tuple[DataFrame, DataFrame]:
    """Attributions of all test rows by the models that didn't see them, with repeat and fold, and the models' base values; collected: of `cross_validate`."""
    out, bases = None, None
    for r, f, model, rows in collected:
        a, b = (x.withColumns({"repeat": F.lit(r), "fold": F.lit(f)}) for x in attributions(model, rows, names, classes))
        out, bases = (a, b) if out is None else (out.unionByName(a), bases.unionByName(b))
    return kept(out, "attributions"), kept(bases, "bases")


def additivity(found: DataFrame, bases: DataFrame, oof: DataFrame, classes: list[str]) -> DataFrame:
    """For each repeat the largest difference between a probability and the sum of its base and its features' shares."""
    total = found.groupBy("case_id", "repeat").agg(*(F.sum(c).alias(f"s_{c}") for c in classes))
    j = oof.join(total, ["case_id", "repeat"], "left").join(bases.withColumnsRenamed({c: f"b_{c}" for c in classes}), ["repeat", "fold"])
    gap = F.greatest(*(F.abs(F.get("proba", F.lit(i)) - F.coalesce(f"s_{c}", F.lit(0.0)) - F.col(f"b_{c}")) for i, c in enumerate(classes)))
    return j.groupBy("repeat").agg(F.count("*").alias("case_count"), F.max(gap).alias("largest_gap"))


def attribution_summary(found: DataFrame, classes: list[str]) -> DataFrame:
    """(case_id, class, feature_name, mean, std, value): over repeats the mean and sample deviation of each share, and the feature's mean value."""
    one = found.groupBy("case_id", "feature_name").agg(F.avg("value").alias("value"), *(F.struct(F.lit(c).alias("class"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std")).alias(f"class_{i}") for i, c in enumerate(classes)))
    return one.select("case_id", F.inline(F.array(*(f"class_{i}" for i in range(len(classes))))), "feature_name", "value").select("case_id", "class", "feature_name", "mean", "std", "value")


def global_importance(summary: DataFrame, classes: list[str]) -> DataFrame:
    """(feature_name, total, a column for each class): mean absolute share over cases, the largest total first."""
    cases = summary.select("case_id").distinct().agg(F.count("*").alias("n")).scalar()
    per = summary.groupBy("feature_name").pivot("class", classes).agg(F.sum(F.abs("mean")))
    per = per.select("feature_name", *((F.coalesce(F.col(c), F.lit(0.0)) / cases).alias(c) for c in classes))
    total = sum((F.col(c) for c in classes), F.lit(0.0))
    return per.withColumn("total", total).orderBy(F.col("total").desc(), "feature_name")


def top_features(summary: DataFrame, k: int = 5) -> DataFrame:
    """The k features of each case and class with the largest share, with rank and direction."""
    from pyspark.sql import Window

    w = Window.partitionBy("case_id", "class").orderBy(F.abs("mean").desc(), "feature_name")
    out = summary.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return out.withColumn("direction", F.when(F.col("mean") > 0, "raises").when(F.col("mean") < 0, "lowers").otherwise("none"))
