"""Forests over long feature tables: cross-validation in folds of whole groups, two-stage models, fits that are kept."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import kept
from .folds import class_names


@dataclass(frozen=True)
class Forest:
    """A forest's parameters; classes weigh n / (k * n_class) in its train rows if `balanced`."""

    trees: int = 500
    depth: int = 30
    seed: int = 42
    balanced: bool = True


def feature_names(long: DataFrame) -> list[str]:
    """The header of the wide table: the features' names in order."""
    return [r[0] for r in long.select("feature_name").distinct().orderBy("feature_name").collect()]


def medians(long: DataFrame, cases: DataFrame) -> DataFrame:
    """Each feature's median over the cases given; features without values there have none. Equal values are counted first, so few rows meet in a task."""
    counts = long.join(cases.select("case_id"), "case_id", "left_semi").groupBy("feature_name", "value").agg(F.count("*").alias("n"))
    return counts.groupBy("feature_name").agg(F.percentile("value", 0.5, F.col("n")).alias("median"))


def wide(long: DataFrame, names: list[str], *keys: str) -> DataFrame:
    """(*keys, cells): each key's row of the wide table, in the order of names, with nulls for gaps."""
    header = F.broadcast(long.sparkSession.createDataFrame(list(enumerate(names)), "pos int, feature_name string"))
    got = long.join(header, "feature_name").groupBy(*keys).agg(F.collect_list(F.struct("pos", "value")).alias("got"))
    lacks = F.array_except(F.expr(f"slice(sequence(0, {len(names)}), 1, {len(names)})"), F.col("got")["pos"])
    row = F.array_sort(F.concat("got", F.transform(lacks, lambda i: F.struct(i.alias("pos"), F.lit(None).cast("double").alias("value")))))
    return got.select(*keys, F.transform(row, lambda x: x["value"]).alias("cells"))


def gaps(rows: DataFrame, cells: Column, size: int) -> Column:
    """What fills the gaps of the rows' cells: each place's median over the rows, or 0. The driver reads it once; it is as long as the header."""
    counts = rows.select(F.posexplode(cells).alias("pos", "value")).where("value is not null").groupBy("pos", "value").agg(F.count("*").alias("n"))
    found = {r[0]: r[1] for r in counts.groupBy("pos").agg(F.percentile("value", 0.5, F.col("n"))).collect()}
    return F.array(*(F.lit(found.get(i, 0.0)) for i in range(size)))


def with_features(rows: DataFrame, cells: Column, imputed: Column) -> DataFrame:
    """The rows with values and features of their cells; rows without cells are all gaps."""
    values = F.when(cells.isNull(), imputed).otherwise(F.zip_with(cells, imputed, lambda v, m: F.coalesce(v, m)))
    return rows.withColumn("values", values).withColumn("features", array_to_vector("values"))


def vectors(long: DataFrame, cases: DataFrame, names: list[str], imputed: DataFrame) -> DataFrame:
    """(case_id, values, features): each case's row of the wide table, in the order of names; gaps get the imputed median, or 0."""
    found = {r["feature_name"]: r["median"] for r in imputed.collect()}
    rows = cases.select("case_id").join(wide(long, names, "case_id"), "case_id", "left")
    return with_features(rows, F.col("cells"), F.array(*(F.lit(0.0 if (m := found.get(n)) is None else m) for n in names))).drop("cells")


def _index(classes: list[str], y: str) -> Column:
    return (F.array_position(F.array(*map(F.lit, classes)), F.col(y)) - 1).cast("double")


def fit_forest(rows: DataFrame, classes: list[str], params: Forest, y: str = "y", seed: int = 0) -> RandomForestClassificationModel:
    """A forest on rows with features and y; its class numbers follow `classes`."""
    weight = F.lit(1.0)
    if params.balanced:
        n = {r[y]: r["count"] for r in rows.where(F.col(y).isNotNull()).groupBy(y).count().collect()}
        weight = F.coalesce(*(F.when(F.col(y) == c, sum(n.values()) / (len(n) * k)) for c, k in n.items()))
    rows = rows.withColumn("weight", weight)
    forest = RandomForestClassifier(
        labelCol="class_index", featuresCol="features", weightCol="weight", numTrees=params.trees, maxDepth=params.depth, featureSubsetStrategy="sqrt", seed=params.seed + seed,
    )
    return forest.fit(rows.withColumn("class_index", _index(classes, y)).select("class_index", "features", "weight"))


def predicted(model: RandomForestClassificationModel, rows: DataFrame, classes: list[str], name: str = "y_pred", proba: str = "proba") -> DataFrame:
    """The most probable class and the probabilities in the order of `classes`; classes after the model's last one have 0."""
    p = vector_to_array("probability")
    whole = F.array(*(F.coalesce(F.get(p, F.lit(i)), F.lit(0.0)) for i in range(len(classes))))
    out = model.transform(rows).withColumn(proba, whole)
    best = F.get(F.array(*map(F.lit, classes)), F.col("prediction").cast("int")).alias(name)
    return out.select(*rows.columns, best, proba)


def _splits(placed: DataFrame) -> list[tuple[int, int]]:
    """Pairs of repeat and fold: a list as short as the fits that follow."""
    return [tuple(r) for r in placed.select("repeat", "fold").distinct().orderBy("repeat", "fold").collect()]


def cross_validate(long: DataFrame, placed: DataFrame, params: Forest, classes: list[str] | None = None, collect: list | None = None) -> DataFrame:
    """(case_id, repeat, fold, y_true, y_pred, proba): each case's prediction, in each repeat, by a forest that its fold took no part in.

    long: (case_id, feature_name, value); placed: of `group_folds`. Medians for gaps and class weights come from the train rows. collect gets (repeat, fold,
    model, test rows) of each fit.
    """
    long, placed = kept(long, "features"), kept(placed, "folds")
    names, classes = feature_names(long), classes or class_names(placed)
    table = kept(placed.select("case_id", "repeat", "fold", "y").join(wide(long, names, "case_id"), "case_id", "left"), "wide", "repeat")
    out = None
    for r, f in _splits(placed):
        here = table.where(F.col("repeat") == r)
        rows = with_features(here, F.col("cells"), gaps(here.where(F.col("fold") != f), F.col("cells"), len(names)))
        model = fit_forest(rows.where(F.col("fold") != f), classes, params, seed=97 * r + f)
        tested = rows.where(F.col("fold") == f).select("case_id", "repeat", "fold", F.col("y").alias("y_true"), "values", "features")
        if collect is not None:
            collect.append((r, f, model, tested.select("case_id", "values")))
        part = predicted(model, tested, classes).select("case_id", "repeat", "fold", "y_true", "y_pred", "proba")
        out = part if out is None else out.unionByName(part)
    return kept(out, "predictions")


#: Metrics that all services have, and columns that belong to no service.
METRICS = ("cpu", "mem", "diskio", "socket", "latency-50", "latency-90", "workload")
GLOBAL = ("log__all__new_template_count",)


def _own_names(long: DataFrame, names: list[str]) -> DataFrame:
    """(feature_name, whole, service, own): for each name whether it belongs to no service, else its service and what it is called without it."""
    name = F.col("feature_name")
    part = lambda i: F.split_part(name, F.lit("__"), F.lit(i))
    kind, statistic = part(1), part(-1)
    traced, metric, log = kind.startswith("trace_"), kind == "metric", kind == "log"
    service = F.when(log, part(2)).otherwise(F.split_part(part(2), F.lit("_"), F.lit(1)))
    measure = F.expr("substring(split_part(feature_name, '__', 2), length(split_part(split_part(feature_name, '__', 2), '_', 1)) + 2)")
    own = (
        F.when(traced, F.concat(F.lit("self_"), kind, F.lit("__max__"), statistic))
        .when(metric & measure.isin(*METRICS), F.concat(F.lit("self__"), measure, F.lit("__"), statistic))
        .when(log & (statistic == "new_template_count"), F.lit("self_log__new_template_count"))
        .when(log, F.concat(F.lit("self_log__"), part(3), F.lit("__"), statistic))
    )
    whole = name.isin(*GLOBAL) | (kind == "svc")
    return long.sparkSession.createDataFrame([(n,) for n in names], "feature_name string").select("feature_name", whole.alias("whole"), service.alias("service"), own.alias("own"))


def relative_lookup(long: DataFrame, services: DataFrame) -> DataFrame:
    """(case_id, service, feature_name, value): for every candidate service a case's features under names that don't tell the service.

    A metric or log feature is the candidate's own; trace features are the largest of its operations. Features of no service (new
    templates of all logs, service context) are the same for all candidates. services: (service), few; a candidate for which a case has no value has no row.
    """
    # names are worked out once for the header, not for each row
    header = _own_names(long, feature_names(long))
    valued = long.where(F.col("value").isNotNull())
    mine = valued.join(F.broadcast(header.where("not whole and own is not null").join(services, "service", "left_semi")), "feature_name")
    mine = mine.groupBy("case_id", "service", F.col("own").alias("feature_name")).agg(F.max("value").alias("value"))
    shared = valued.join(F.broadcast(header.where("whole").select("feature_name").crossJoin(services)), "feature_name")
    return mine.unionByName(shared.select("case_id", "service", "feature_name", "value"))


def relative_cells(long: DataFrame, names: list[str], services: list[str]) -> tuple[list[str], Callable[[Column], Column]]:
    """The names of relative features, and for a column of services the cells that these see of a wide row (cells in the order of names): `relative_lookup` within the row."""
    places: dict[str, dict[str, list[int]]] = {s: {} for s in services}
    at = {n: i for i, n in enumerate(names)}
    for r in _own_names(long, names).collect():
        for s in services if r["whole"] else [r["service"]] if r["own"] and r["service"] in places else []:
            places[s].setdefault(r["feature_name"] if r["whole"] else r["own"], []).append(at[r["feature_name"]])
    own_names = sorted({n for of in places.values() for n in of})
    cell = lambda i: F.get("cells", F.lit(i))
    gap = F.lit(None).cast("double")
    row = {s: F.array(*(F.greatest(*map(cell, of[n])) if len(of.get(n, [])) > 1 else cell(of[n][0]) if n in of else gap for n in own_names)) for s, of in places.items()}
    return own_names, lambda service: F.coalesce(*(F.when(service == s, r) for s, r in row.items()))


def take_relative(lookup: DataFrame, assigned: DataFrame) -> DataFrame:
    """The long features of each case as its assigned service sees them; assigned: (case_id, service)."""
    return lookup.join(assigned.select("case_id", "service"), ["case_id", "service"]).select("case_id", "feature_name", "value")


def cross_validate_two_stage(long: DataFrame, lookup: DataFrame | None, placed: DataFrame, service_true: DataFrame, locator: Forest, params: Forest, classes: list[str] | None = None, collect: list | None = None) -> DataFrame:
    """(case_id, repeat, fold, y_true, service_true, service, locator_confidence, y_pred, proba) by two forests a fold.

    The first learns the affected service from absolute features of the train rows. The second learns the class from relative features:
    train cases by their true service, test cases by the one that the first predicts for them, right or wrong. lookup: of
    `relative_lookup`; if it is None, relative features are taken from each case's wide row, which needs no rows by service.
    """
    long, placed, service_true = kept(long, "features"), kept(placed, "folds"), kept(service_true.select("case_id", F.col("service").alias("service_true")), "services")
    names, classes, services = feature_names(long), classes or class_names(placed), class_names(service_true, "service_true")
    # folds join nothing: a case's row holds all that they need
    table = placed.select("case_id", "repeat", "fold", "y").join(service_true, "case_id").join(wide(long, names, "case_id"), "case_id", "left")
    if lookup is None:
        own_names, seen_by = relative_cells(long, names, services)
    else:
        lookup = kept(lookup, "lookup")
        own_names, seen_by = feature_names(lookup), lambda service: F.try_element_at("seen", service)
        seen = wide(lookup, own_names, "case_id", "service").groupBy("case_id").agg(F.map_from_entries(F.collect_list(F.struct("service", "cells"))).alias("seen"))
        table = table.join(seen, "case_id", "left")
    table, out = kept(table, "wide", "repeat"), None
    for r, f in _splits(placed):
        here = table.where(F.col("repeat") == r)
        train, test = here.where(F.col("fold") != f), here.where(F.col("fold") == f)
        imputed = gaps(train, F.col("cells"), len(names))
        first = fit_forest(with_features(train, F.col("cells"), imputed), services, locator, "service_true", 97 * r + f)
        own = seen_by(F.col("service_true"))
        own_imputed = gaps(train, own, len(own_names))
        second = fit_forest(with_features(train, own, own_imputed), classes, params, seed=97 * r + f)
        found = predicted(first, with_features(test, F.col("cells"), imputed), services, "service", "p").withColumn("locator_confidence", F.array_max("p"))
        tested = with_features(found, seen_by(F.col("service")), own_imputed)
        if collect is not None:
            collect.append((r, f, second, tested.select("case_id", "values", "service")))
        tested = tested.select("case_id", "repeat", "fold", F.col("y").alias("y_true"), "service_true", "service", "locator_confidence", "features")
        part = predicted(second, tested, classes).drop("features")
        out = part if out is None else out.unionByName(part)
    return kept(out, "predictions")


def prediction_invariants(oof: DataFrame, placed: DataFrame) -> DataFrame:
    """For each repeat what must hold of out-of-fold predictions: cases without exactly one, rows whose probabilities don't sum to 1 or
    whose class isn't the most probable one's, rows of a fold that the case isn't in; and whether they beat the most frequent class."""
    add = F.aggregate("proba", F.lit(0.0), lambda s, x: s + x)
    bad = (F.abs(add - 1) > 1e-6) | (F.array_min("proba") < -1e-12) | F.col("y_pred").isNull()
    wrong = placed.select("repeat", "case_id", F.col("fold").alias("placed_in"))
    rows = wrong.join(oof, ["repeat", "case_id"], "left").withColumn("n", F.when(F.col("fold").isNotNull(), 1).otherwise(0))
    per = rows.groupBy("repeat", "case_id").agg(F.sum("n").alias("n"), F.count_if(F.col("fold") != F.col("placed_in")).alias("elsewhere"), F.count_if(bad).alias("bad"), F.count_if(F.col("y_true") == F.col("y_pred")).alias("right"))
    out = per.groupBy("repeat").agg(
        F.count("*").alias("case_count"), F.count_if(F.col("n") != 1).alias("not_predicted_once"), F.sum("elsewhere").alias("out_of_place"), F.sum("bad").alias("bad_probabilities"), F.sum("right").alias("right")
    )
    most = placed.groupBy("repeat", "y").agg(F.count("*").alias("n")).groupBy("repeat").agg(F.max("n").alias("most"))
    return out.join(most, "repeat").select("repeat", "case_count", "not_predicted_once", "out_of_place", "bad_probabilities", (F.col("right") > F.col("most")).alias("beats_majority"))


def locator_confidence(oof: DataFrame, reliable: float = 0.7) -> DataFrame:
    """For each case the service predicted most often (of equals the one of the earliest repeat), the mean of its largest probabilities, and whether that is reliable."""
    votes = oof.groupBy("case_id", "service").agg(F.count("*").alias("n"), F.min("repeat").alias("first"))
    modal = votes.groupBy("case_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "first", "service"))["service"].alias("service"))
    mean = oof.groupBy("case_id").agg(F.avg("locator_confidence").alias("confidence"))
    return modal.join(mean, "case_id").withColumn("reliable", F.col("confidence") >= reliable)


def uncertain_cases(confidence: DataFrame, k: int = 10) -> DataFrame:
    """The k unreliable cases that the locator is least sure of: a report's limit."""
    return confidence.where("not reliable").orderBy("confidence", "case_id").limit(k)


def save_two_stage(long: DataFrame, lookup: DataFrame | None, cases: DataFrame, path: str, locator: Forest, params: Forest) -> None:
    """Fits both stages on all cases (case_id, service, y) and keeps them in a folder with names, classes and medians. lookup: as for `cross_validate_two_stage`."""
    spark, long = long.sparkSession, kept(long, "features")
    names = feature_names(long)
    rows = cases.select("case_id", "service", "y").join(wide(long, names, "case_id"), "case_id", "left")
    if lookup is None:
        own_names, seen_by = relative_cells(long, names, class_names(cases, "service"))
        rows = kept(rows, "wide").withColumn("seen", seen_by(F.col("service")))
    else:
        seen = kept(take_relative(lookup, cases), "features")
        own_names = feature_names(seen)
        rows = kept(rows.join(wide(seen, own_names, "case_id").withColumnRenamed("cells", "seen"), "case_id", "left"), "wide")
    for name, cells, header, y, forest in (("locator", "cells", names, "service", locator), ("severity", "seen", own_names, "y", params)):
        classes, median = class_names(cases, y), gaps(rows, F.col(cells), len(header))
        fit_forest(with_features(rows, F.col(cells), median), classes, forest, y).write().save(f"{path}/{name}/model")
        spark.range(1).select(F.inline(F.arrays_zip(F.array(*map(F.lit, header)).alias("feature_name"), median.alias("median")))).coalesce(1).write.parquet(f"{path}/{name}/medians")
        spark.createDataFrame([("feature", i, n) for i, n in enumerate(header)] + [("class", i, c) for i, c in enumerate(classes)], "kind string, pos int, name string").coalesce(1).write.parquet(f"{path}/{name}/names")


def score_two_stage(spark: SparkSession, path: str, long: DataFrame, lookup: DataFrame | None, cases: DataFrame) -> DataFrame:
    """(case_id, service, y_pred, proba) of cases that needn't have been there at the fit, by the models in a folder."""

    def header(name):
        return {k: [r["name"] for r in spark.read.parquet(f"{path}/{name}/names").where(F.col("kind") == k).orderBy("pos").collect()] for k in ("feature", "class")}

    def medians_of(name, names):
        found = {r["feature_name"]: r["median"] for r in spark.read.parquet(f"{path}/{name}/medians").collect()}
        return F.array(*(F.lit(0.0 if (m := found.get(n)) is None else m) for n in names))

    def model(name):
        return RandomForestClassificationModel.load(f"{path}/{name}/model")

    first, second, here = header("locator"), header("severity"), feature_names(long)
    # features that came after the fit are no part of the locator's row, but relative features may be theirs
    names = first["feature"] + [n for n in here if n not in set(first["feature"])]
    rows = cases.select("case_id").join(wide(long, names, "case_id"), "case_id", "left")
    known = F.slice("cells", 1, len(first["feature"]))
    found = predicted(model("locator"), with_features(rows, known, medians_of("locator", first["feature"])), first["class"], "service", "p")
    if lookup is None:
        own_names, seen_by = relative_cells(long, names, first["class"])
        seen = seen_by(F.col("service"))
        place = {n: i for i, n in enumerate(own_names)}
        cells = F.transform(F.array(*(F.lit(place.get(n, -1)) for n in second["feature"])), lambda i: F.when(i >= 0, F.get(seen, i)))
        own = found.select("case_id", "service", F.when(seen.isNotNull(), cells).alias("seen"))
    else:
        found = kept(found.select("case_id", "service"), "located")
        own = found.join(wide(take_relative(lookup, found), second["feature"], "case_id").withColumnRenamed("cells", "seen"), "case_id", "left")
    scored = predicted(model("severity"), with_features(own, F.col("seen"), medians_of("severity", second["feature"])), second["class"], "y_pred", "proba")
    return scored.select("case_id", "service", "y_pred", "proba")
