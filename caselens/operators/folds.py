"""Folds of whole groups with even classes, baselines over folds, and tests between configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def class_names(cases: DataFrame, label: str = "y") -> list[str]:
    """The classes of a label, by name; they are few."""
    return [r[0] for r in cases.select(label).distinct().orderBy(label).collect()]


def group_folds(cases: DataFrame, folds: int = 5, repeats: int = 10, seed: int = 42) -> DataFrame:
    """(repeat, fold, case_id, scenario, y): each repeat deals whole scenarios to folds so that all folds have like class shares.

    cases: (case_id, scenario, y). Scenarios go one after another, large ones first (by powers of two, and within a power in an order that
    the seed and the repeat shuffle), each to the fold that lacks its classes most: the one with the least sum over the scenario's
    cases of the shares that the fold already has of their classes; then to the smaller fold, then to the first. The table of scenarios, not of cases, is
    folded as one array for each repeat; cases are joined to the result.
    """
    names = class_names(cases)
    counts = F.array(*(F.count_if(F.col("y") == c).cast("double") for c in names))
    groups = cases.groupBy("scenario").agg(F.count("*").alias("size"), counts.alias("counts"))
    totals = cases.agg(counts.alias("totals"))
    weighed = groups.crossJoin(totals).withColumn("weight", F.zip_with("counts", "totals", lambda c, t: c / (t * t))).drop("totals")
    order = lambda r: F.struct((-F.floor(F.log2("size"))).alias("large"), F.xxhash64("scenario", r + seed).alias("mixed"))
    dealt = weighed.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("order", order(F.col("repeat")))
    rows = dealt.groupBy("repeat").agg(F.array_sort(F.collect_list(F.struct("order", "scenario", "size", "counts", "weight"))).alias("groups"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    empty = F.transform(F.sequence(F.lit(1), F.lit(folds)), lambda i: F.struct(F.lit(0).cast("long").alias("n"), F.array(*(F.lit(0.0) for _ in names)).alias("counts")))
    start = F.struct(empty.alias("folds"), F.slice(F.array(F.struct(F.lit("").alias("scenario"), F.lit(0).alias("fold"))), 1, 0).alias("placed"))

    def place(state: Column, g: Column) -> Column:
        best = F.array_min(F.transform(state["folds"], lambda f, i: F.struct(F.round(dot(f["counts"], g["weight"]), 12).alias("has"), f["n"].alias("n"), i.alias("i"))))["i"]
        more = lambda f, i: F.when(i == best, F.struct((f["n"] + g["size"]).alias("n"), F.zip_with(f["counts"], g["counts"], lambda x, y: x + y).alias("counts"))).otherwise(f)
        put = F.struct(g["scenario"].cast("string").alias("scenario"), best.cast("int").alias("fold"))
        return F.struct(F.transform(state["folds"], more).alias("folds"), F.array_append(state["placed"], put).alias("placed"))

    placed = rows.select("repeat", F.inline(F.aggregate("groups", start, place, lambda s: s["placed"])))
    return placed.join(cases.select("case_id", F.col("scenario").cast("string").alias("scenario"), "y"), "scenario").select("repeat", "fold", "case_id", "scenario", "y")


def fold_invariants(placed: DataFrame, cases: DataFrame, folds: int) -> DataFrame:
    """For each repeat what must hold of its folds: cases, those not tested exactly once, scenarios in several folds, (fold, class) pairs
    that the train rows lack, and pairs whose class count is further from an even share than the class' largest scenario."""
    total = cases.count()
    once = placed.groupBy("repeat", "case_id").agg(F.count("*").alias("n")).groupBy("repeat").agg(F.count("*").alias("c"), F.count_if(F.col("n") > 1).alias("m"))
    once = once.select("repeat", F.lit(total).cast("long").alias("case_count"), (F.lit(total) - F.col("c") + F.col("m")).alias("not_tested_once"))
    split = placed.groupBy("repeat", "scenario").agg(F.countDistinct("fold").alias("n")).groupBy("repeat").agg(F.count_if(F.col("n") > 1).alias("split_scenarios"))
    whole = cases.groupBy("y").agg(F.count("*").alias("total"))
    largest = cases.groupBy("scenario", "y").agg(F.count("*").alias("n")).groupBy("y").agg(F.max("n").alias("largest"))
    per = placed.groupBy("repeat", "fold", "y").agg(F.count("*").alias("n"))
    grid = placed.select("repeat").distinct().withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).crossJoin(whole.join(largest, "y"))
    grid = grid.join(per, ["repeat", "fold", "y"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    shares = grid.groupBy("repeat").agg(
        F.count_if(F.col("n") == F.col("total")).alias("classes_not_in_train"),
        F.count_if(F.abs(F.col("n") - F.col("total") / folds) > F.col("largest")).alias("uneven_classes"),
    )
    return once.join(split, "repeat").join(shares, "repeat")


def fold_overlap(placed: DataFrame) -> DataFrame:
    """For each repeat and fold the scenarios and cases of its test and train rows together, and the scenarios that are in both; none should be."""
    per = placed.groupBy("repeat", "fold", "scenario").agg(F.count("*").alias("n"))
    grid = placed.select("repeat", "fold").distinct().withColumnRenamed("fold", "tested")
    # each scenario of a repeat is in the test rows of its own folds and in the train rows of the others
    sides = per.join(grid, "repeat").groupBy("repeat", F.col("tested").alias("fold"), "scenario").agg(F.sum("n").alias("n"), F.bool_or(F.col("fold") == F.col("tested")).alias("test"), F.bool_or(F.col("fold") != F.col("tested")).alias("train"))
    return sides.groupBy("repeat", "fold").agg(F.count("*").alias("group_count"), F.sum("n").alias("case_count"), F.count_if(F.col("test") & F.col("train")).alias("overlap"))


def train_shares(placed: DataFrame) -> DataFrame:
    """(repeat, fold, y, n_train, before, n_all): each class' train rows and those of the classes named before it."""
    per = placed.groupBy("repeat", "fold", "y").agg(F.count("*").alias("n"))
    grid = placed.select("repeat", "fold").distinct().crossJoin(placed.select("y").distinct()).join(per, ["repeat", "fold", "y"], "left")
    # a class that a fold lacks still counts in its train rows
    grid = grid.withColumn("n_train", F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("repeat", "y")) - F.coalesce("n", F.lit(0)))
    fold = Window.partitionBy("repeat", "fold")
    before = F.coalesce(F.sum("n_train").over(fold.orderBy("y").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return grid.select("repeat", "fold", "y", "n_train", before.alias("before"), F.sum("n_train").over(fold).alias("n_all"))


def uniform_draw(*key: Column, seed: int = 42) -> Column:
    """A number in [0, 1) from a key and a seed: the first 32 bits of an MD5."""
    text = F.concat_ws(":", *(k.cast("string") for k in key), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(1 << 32)


def dummy_predictions(placed: DataFrame, strategy: str, seed: int = 42) -> DataFrame:
    """(case_id, repeat, fold, y_true, y_pred) without features: the train rows' most frequent class (the first by name of equals), or a class
    drawn by their shares, the same for a seed each time."""
    shares = train_shares(placed)
    rows = placed.select("case_id", "repeat", "fold", F.col("y").alias("y_true"))
    if strategy == "majority":
        best = shares.groupBy("repeat", "fold").agg(F.min(F.struct((-F.col("n_train")).alias("m"), "y"))["y"].alias("y_pred"))
        return rows.join(best, ["repeat", "fold"]).select("case_id", "repeat", "fold", "y_true", "y_pred")
    if strategy != "stratified":
        raise ValueError(strategy)
    drawn = rows.withColumn("u", uniform_draw(F.col("case_id"), F.col("repeat"), seed=seed))
    steps = shares.where("n_train > 0").groupBy("repeat", "fold").agg(F.array_sort(F.collect_list(F.struct((F.col("before") / F.col("n_all")).alias("from"), "y"))).alias("steps"))
    chosen = F.element_at(F.filter("steps", lambda s: s["from"] <= F.col("u")), -1)["y"]
    return drawn.join(steps, ["repeat", "fold"]).select("case_id", "repeat", "fold", "y_true", chosen.alias("y_pred"))


def signed_ranks(diffs: DataFrame, keys: list[str]) -> DataFrame:
    """Nonzero differences with the rank of their size, equals at their average rank; keys tell tests apart."""
    size = F.abs("diff")
    ties = F.count("*").over(Window.partitionBy(*keys, size))
    return diffs.where("diff <> 0").withColumn("rank", F.rank().over(Window.partitionBy(*keys).orderBy(size)) + (ties - 1) / 2)


def paired_tests(accuracy: DataFrame, pairs: list[tuple[str, str]], exact: int = 50) -> DataFrame:
    """For each pair (a, b) of configurations, over the scenarios that both have: mean difference b - a, scenarios better, worse and tied, and
    the two-sided p of a signed rank test.

    accuracy: (config, scenario, accuracy). Zero differences are left out; p is null if all are zero. For up to `exact` differences p is that of all
    2**n signs: doubled ranks are whole numbers, so the sums' counts are an array, folded rank by rank. Beyond it, p is the normal
    approximation with corrected ties. Scenarios are few (groups, not cases), so a test is one row.
    """
    spark = accuracy.sparkSession
    wanted = spark.createDataFrame(pairs, "a string, b string")
    one = lambda side, value: accuracy.select(F.col("config").alias(side), "scenario", F.col("accuracy").alias(value))
    d = wanted.join(one("a", "x"), "a").join(one("b", "y"), ["b", "scenario"]).withColumn("diff", F.round(F.col("y") - F.col("x"), 9))
    base = d.groupBy("a", "b").agg(
        F.round(F.avg("diff"), 6).alias("mean_diff_accuracy"), F.count_if(F.col("diff") > 0).alias("scenarios_better"),
        F.count_if(F.col("diff") < 0).alias("scenarios_worse"), F.count_if(F.col("diff") == 0).alias("scenarios_tied"),
    )
    r = signed_ranks(d, ["a", "b"]).groupBy("a", "b").agg(
        F.sort_array(F.collect_list((2 * F.col("rank")).cast("int"))).alias("doubled"), (2 * F.coalesce(F.sum(F.when(F.col("diff") > 0, F.col("rank"))), F.lit(0.0))).cast("int").alias("w"), F.count("*").alias("n")
    )
    n, total = F.col("n"), F.aggregate("doubled", F.lit(0), lambda s, x: s + x)
    start = F.transform(F.sequence(F.lit(0), total), lambda j: F.when(j == 0, 1.0).otherwise(0.0))
    shifted = lambda s, x: F.concat(F.array_repeat(F.lit(0.0), x), F.slice(s, F.lit(1), F.size(s) - x))
    ways = F.aggregate("doubled", start, lambda s, x: F.zip_with(s, shifted(s, x), lambda p, q: p + q))
    add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    tail = F.least(add(F.slice("ways", F.lit(1), F.col("w") + 1)), add(F.slice("ways", F.col("w") + 1, F.size("ways"))))
    small = r.where(n <= exact).withColumn("ways", ways).select("a", "b", F.least(F.lit(1.0), 2 * tail / F.pow(F.lit(2.0), n)).alias("p"))
    # sums of r^2 / 4 hold the correction of ties
    spread = F.sqrt(F.aggregate("doubled", F.lit(0.0), lambda s, x: s + x * x / 4.0) / 4)
    z = F.abs((F.col("w") / 2.0 - n * (n + 1) / 4.0) / spread)
    large = r.where(n > exact).select("a", "b", z.alias("z"))
    p = small.unionByName(large.select("a", "b", normal_tail(F.col("z")).alias("p")))
    return base.join(p, ["a", "b"], "left").select(F.concat("b", F.lit(" vs "), "a").alias("comparison"), "mean_diff_accuracy", "scenarios_better", "scenarios_worse", "scenarios_tied", F.round("p", 6).alias("wilcoxon_p"))


def normal_tail(z: Column, steps: int = 400, far: float = 12.0) -> Column:
    """Two-sided tail of the normal distribution from |z| on, by Simpson's rule up to `far`."""
    h = F.greatest(F.lit(far) - z, F.lit(0.0)) / steps
    weight = lambda i: F.when((i == 0) | (i == steps), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
    terms = F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: weight(i) * F.exp(-F.pow(z + i * h, F.lit(2.0)) / 2))
    return F.least(F.lit(1.0), 2 * F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) * h / 3 / F.sqrt(2 * F.pi()))
