"""Queries of folds, models and their tests over the customers' cases, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import kept, new_path
from ..operators import attribution as T
from ..operators import folds as G
from ..operators import labels as L
from ..operators import modeling as M
from ..sources import shop as S

#: Three folds twice and small forests keep the queries short; the operators' own defaults are 5 folds, 10 repeats and 500 trees.
FOLDS, REPEATS, SEED = 3, 2, 42
LOCATOR, FOREST = M.Forest(trees=20, depth=6, balanced=False), M.Forest(trees=20, depth=6)
EXPLAINED = M.Forest(trees=6, depth=4)
SEVERITIES = ["High", "Low", "Medium"]
CONFIGURATIONS = ("E0", "E1", "E2", "E3")
PAIRS = [("E0", "E1"), ("E1", "E2"), ("E2", "E3"), ("E0", "E3")]


class Shop:
    """The customers' cases with what several queries share; tables that several fits read are written once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.cells = kept(S.cells(spark, sf_dir), "cells")
        self.cases = kept(S.cases(self.cells), "cases")
        self.features = S.features(self.cells)

    services = property(lambda d: d.cases.select("service").distinct())
    folds = property(lambda d: G.group_folds(d.cases.select("case_id", "scenario", "y"), FOLDS, REPEATS, SEED))
    lookup = property(lambda d: M.relative_lookup(d.features, d.services))


def ml_group_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Shop(spark, sf_dir)
    return G.fold_invariants(kept(d.folds, "folds"), d.cases, FOLDS)


def set_group_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.fold_overlap(kept(Shop(spark, sf_dir).folds, "folds"))


def ml_rf_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invariants of severity forests on relative features of the true service, in which the signal lies."""
    d = Shop(spark, sf_dir)
    placed = kept(d.folds, "folds")
    return M.prediction_invariants(M.cross_validate(M.take_relative(d.lookup, d.cases), placed, FOREST), placed)


def _two_stage(d: Shop, repeats: int = 1) -> tuple[DataFrame, DataFrame]:
    placed = kept(d.folds.where(F.col("repeat") < repeats), "folds")
    return M.cross_validate_two_stage(d.features, None, placed, d.cases, LOCATOR, FOREST), placed


def ml_two_stage_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invariants of the two stages, and whether the locator is right more often than the most frequent service."""
    oof, placed = _two_stage(d := Shop(spark, sf_dir), REPEATS)
    most = d.cases.groupBy("service").agg(F.count("*").alias("n")).agg(F.max("n").alias("n"))
    located = oof.groupBy("repeat").agg(F.count_if(F.col("service") == F.col("service_true")).alias("hits")).crossJoin(most)
    return M.prediction_invariants(oof, placed).join(located.select("repeat", (F.col("hits") > F.col("n")).alias("locates")), "repeat")


def _attributed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, list[str]]:
    """Attributions, base values and predictions of the two forests of one repeat, on relative features."""
    d = Shop(spark, sf_dir)
    placed, long, collected = kept(G.group_folds(d.cases.select("case_id", "scenario", "y"), 2, 1, SEED), "folds"), kept(M.take_relative(d.lookup, d.cases), "relative"), []
    oof = M.cross_validate(long, placed, EXPLAINED, SEVERITIES, collected)
    return *T.out_of_fold(collected, M.feature_names(long), SEVERITIES), oof, SEVERITIES


def ml_tree_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, repeat, fold, feature_name, value, a share for each class) of every case by the forest that didn't see it."""
    return _attributed(spark, sf_dir)[0]


def ml_additivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether base values and shares add up to the probabilities within a millionth."""
    out = T.additivity(*_attributed(spark, sf_dir))
    return out.select("repeat", "case_count", (F.col("largest_gap") < 1e-6).alias("adds_up"))


def ml_attribution_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _, _, classes = _attributed(spark, sf_dir)
    return T.attribution_summary(found, classes)


def ml_global_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.global_importance(kept(ml_attribution_summary(spark, sf_dir), "summary"), SEVERITIES)


def ml_locator_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each case its service by vote, the mean confidence and whether it is reliable."""
    return M.locator_confidence(_two_stage(Shop(spark, sf_dir))[0])


def top_uncertain_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.uncertain_cases(ml_locator_confidence(spark, sf_dir))


def ml_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The service as the target of the same cross-validation, on absolute features."""
    d = Shop(spark, sf_dir)
    placed = kept(G.group_folds(d.cases.select("case_id", "scenario", F.col("service").alias("y")), FOLDS, REPEATS, SEED), "folds")
    return M.prediction_invariants(M.cross_validate(d.features, placed, LOCATOR), placed)


def ml_final_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both stages fitted on four fifths of the cases, kept, loaded and asked for all: by part, cases, cases scored, and those scored otherwise a second time."""
    d = Shop(spark, sf_dir)
    part = (F.col("case_id") % 5 == 0).alias("unseen")
    path, long = new_path(spark, "models"), kept(d.features, "features")
    M.save_two_stage(long, None, d.cases.where(~part), path, LOCATOR, FOREST)
    one, two = (kept(M.score_two_stage(spark, path, long, None, d.cases), "scores") for _ in range(2))
    again = two.select("case_id", F.col("y_pred").alias("y2"), F.col("proba").alias("p2"))
    rows = d.cases.join(one.join(again, "case_id"), "case_id", "left")
    differs = (F.col("y_pred") != F.col("y2")) | (F.col("proba") != F.col("p2"))
    return rows.groupBy(part).agg(F.count("*").alias("case_count"), F.count("y_pred").alias("scored"), F.count_if(differs).alias("changed"))


def ml_relative_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Shop(spark, sf_dir).lookup.withColumn("value", F.round("value", 6))


def _rotating(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels' cases in folds by scenario and repeat, which another engine can tell too."""
    oof = L.oof_from_labels(spark, sf_dir)
    return oof.select("case_id", "repeat", ((F.col("scenario") + F.col("repeat")) % 5).cast("int").alias("fold"), F.col("y_true").alias("y"))


def ml_dummy_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both baselines by repeat and fold: their test rows, how many are right, and how many of each class they name."""
    rows = _rotating(spark, sf_dir)
    both = [G.dummy_predictions(rows, s).withColumn("strategy", F.lit(s)) for s in ("majority", "stratified")]
    named = (F.count_if(F.col("y_pred") == c).alias(f"named_{c.lower()}") for c in ("Low", "Medium", "High"))
    return both[0].unionByName(both[1]).groupBy("strategy", "repeat", "fold").agg(F.count("*").alias("test_count"), F.count_if(F.col("y_true") == F.col("y_pred")).alias("right"), *named)


def by_configuration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(config, scenario, accuracy): the labels' cases as predicted under four configurations, each a little better."""
    oof = L.oof_from_labels(spark, sf_dir).where("repeat = 0")
    config = F.posexplode(F.array(*map(F.lit, CONFIGURATIONS))).alias("i", "config")
    right = F.when(F.pmod(F.col("case_id") * 31 + F.col("i") * 17, F.lit(11)) < 5 - F.col("i"), 0.0).otherwise(1.0)
    return oof.select("case_id", "scenario", config).groupBy("config", "scenario").agg(F.avg(right).alias("accuracy"))


def ml_paired_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.paired_tests(by_configuration(spark, sf_dir), PAIRS)


def win_signed_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of all pairs' differences."""
    acc = by_configuration(spark, sf_dir)
    wanted = spark.createDataFrame(PAIRS, "a string, b string")
    d = wanted.join(acc.select(F.col("config").alias("a"), "scenario", F.col("accuracy").alias("x")), "a").join(acc.select(F.col("config").alias("b"), "scenario", F.col("accuracy").alias("y")), ["b", "scenario"])
    return G.signed_ranks(d.select("a", "b", "scenario", F.round(F.col("y") - F.col("x"), 9).alias("diff")), ["a", "b"]).withColumn("diff", F.round("diff", 6))


QUERIES = {f.__name__: f for f in (
    ml_group_folds, set_group_overlap, ml_rf_cv, ml_two_stage_cv, ml_locator_confidence, top_uncertain_cases, ml_probe, ml_final_fit, ml_relative_features, ml_dummy_baseline, ml_paired_tests, win_signed_rank,
    ml_tree_attribution, ml_additivity, ml_attribution_summary, ml_global_importance,
)}

_SHOP = """with cells as (select o_custkey as case_id, lower(p_type) || 'service' as service, count(*) as lines, cast(round(sum(l_quantity)) as bigint) as quantity, cast(sum(cast(round(100 * l_discount) as bigint)) as bigint) as discount,
    count(*) filter (l_returnflag = 'R') as returned, max(cast(round(100 * l_tax) as bigint)) filter (l_suppkey % 2 = 0) as g, max(cast(round(100 * l_tax) as bigint)) filter (l_suppkey % 2 = 1) as p
    from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey group by all),
  most as (select * from cells qualify row_number() over (partition by case_id order by lines desc, service) = 1),
  cases as (select case_id, service || '_' || (case_id % 20) as scenario, service, case when discount / lines < 4.5 then 'Low' when discount / lines < 5.5 then 'Medium' else 'High' end as y from most)"""
_LABELS = """with oof as (select doc_id as case_id, cast(r as integer) as repeat, doc_id % 30 as scenario, list_extract(['High','Low','Medium'], quality + toxic + 1) as y from labels cross join range(3) t(r)),"""
_CONFIGS = """ acc as (select config, scenario, avg(case when (case_id * 31 + i * 17) % 11 < 5 - i then 0.0 else 1.0 end) as accuracy from oof cross join (values (0,'E0'),(1,'E1'),(2,'E2'),(3,'E3')) v(i, config) where repeat = 0 group by all),
  pairs as (select * from (values ('E0','E1'),('E1','E2'),('E2','E3'),('E0','E3')) v(a, b)),
  d as (select a, b, x.scenario, round(y.accuracy - x.accuracy, 9) as diff from pairs join acc x on x.config = a join acc y on y.config = b and y.scenario = x.scenario),
  ranked as (select a, b, scenario, diff, rank() over (partition by a, b order by abs(diff)) + (count(*) over (partition by a, b, abs(diff)) - 1) / 2 as rank from d where diff <> 0)"""
_ONCE = "0 as not_predicted_once, 0 as out_of_place, 0 as bad_probabilities, true as beats_majority"
ORACLE_SQL = {
    "ml_group_folds": f"{_SHOP} select cast(r as integer) as repeat, (select count(*) from cases) as case_count, 0 as not_tested_once, 0 as split_scenarios, 0 as classes_not_in_train, 0 as uneven_classes from range({REPEATS}) t(r)",
    "set_group_overlap": f"{_SHOP} select cast(r as integer) as repeat, cast(f as integer) as fold, (select count(distinct scenario) from cases) as group_count, (select count(*) from cases) as case_count, 0 as overlap from range({REPEATS}) a(r) cross join range({FOLDS}) b(f)",
    "ml_rf_cv": f"{_SHOP} select cast(r as integer) as repeat, (select count(*) from cases) as case_count, {_ONCE} from range({REPEATS}) t(r)",
    "ml_probe": f"{_SHOP} select cast(r as integer) as repeat, (select count(*) from cases) as case_count, {_ONCE} from range({REPEATS}) t(r)",
    "ml_two_stage_cv": f"{_SHOP} select cast(r as integer) as repeat, (select count(*) from cases) as case_count, {_ONCE}, true as locates from range({REPEATS}) t(r)",
    "ml_additivity": f"{_SHOP} select 0 as repeat, count(*) as case_count, true as adds_up from cases",
    "ml_final_fit": f"{_SHOP} select case_id % 5 = 0 as unseen, count(*) as case_count, count(*) as scored, 0 as changed from cases group by all",
    "ml_relative_features": f"""{_SHOP}, own as (select case_id, service, unnest(['self__cpu__zscore_mean', 'self__mem__zscore_mean', 'self__workload__baseline_mean', 'self_log__error__delta_mean', 'self_trace_latency__max__zscore_max']) as feature_name,
      unnest([quantity / lines, discount / lines, lines, returned, greatest(g, p)]) as value from cells where service in (select service from cases)),
      shared as (select case_id, unnest(['log__all__new_template_count', 'svc__anomalous_service_count']) as feature_name, unnest([sum(returned), count(*) filter (lines > 8)]) as value from cells group by case_id)
      select case_id, service, feature_name, round(value, 6) as value from own where value is not null union all select case_id, s.service, feature_name, value from shared cross join (select distinct service from cases) s""",
    "ml_dummy_baseline": f"""{_LABELS} f as (select *, cast((scenario + repeat) % 5 as integer) as fold from oof), k as (select repeat, fold, y, count(*) as n from f group by all),
      g as (select a.repeat, a.fold, c.y, coalesce(n, 0) as n from (select distinct repeat, fold from f) a cross join (select distinct y from f) c left join k on k.repeat = a.repeat and k.fold = a.fold and k.y = c.y),
      t as (select *, sum(n) over (partition by repeat, y) - n as tr from g), u as (select *, coalesce(sum(tr) over (partition by repeat, fold order by y rows between unbounded preceding and 1 preceding), 0) as lo, sum(tr) over (partition by repeat, fold) as al from t),
      mj as (select repeat, fold, y from u qualify row_number() over (partition by repeat, fold order by tr desc, y) = 1),
      pr as (select 'majority' as strategy, f.repeat, f.fold, f.y as y_true, mj.y as y_pred from f join mj using (repeat, fold) union all
        select 'stratified', f.repeat, f.fold, f.y, u.y from f join u on u.repeat = f.repeat and u.fold = f.fold and u.tr > 0 and ('0x' || substr(md5(f.case_id || ':' || f.repeat || ':42'), 1, 8))::bigint / 4294967296 >= u.lo / u.al and ('0x' || substr(md5(f.case_id || ':' || f.repeat || ':42'), 1, 8))::bigint / 4294967296 < (u.lo + u.tr) / u.al)
      select strategy, repeat, fold, count(*) as test_count, count(*) filter (y_true = y_pred) as right, count(*) filter (y_pred = 'Low') as named_low, count(*) filter (y_pred = 'Medium') as named_medium, count(*) filter (y_pred = 'High') as named_high from pr group by all""",
    "win_signed_rank": f"{_LABELS}{_CONFIGS} select a, b, scenario, round(diff, 6) as diff, rank from ranked",
    # all 2 ** n signs by adding one scenario after another: how many ways lead to each sum
    "ml_paired_tests": f"""{_LABELS}{_CONFIGS}, base as (select a, b, round(avg(diff), 6) as m, count(*) filter (diff > 0) as up, count(*) filter (diff < 0) as down, count(*) filter (diff = 0) as tied from d group by a, b),
      v as (select a, b, list(cast(2 * rank as integer)) as w, cast(sum(2 * rank) as integer) as total, coalesce(cast(sum(2 * rank) filter (diff > 0) as integer), 0) as s, count(*) as n from ranked group by a, b),
      ways as (select *, list_reduce(list_transform(w, lambda x: [cast(x as double)]), lambda st, x: list_transform(range(len(st)), lambda j: st[j + 1] + case when j >= x[1] then st[cast(j - x[1] as integer) + 1] else 0 end),
        list_transform(range(total + 1), lambda j: case when j = 0 then cast(1 as double) else cast(0 as double) end)) as c from v)
      select b || ' vs ' || a as comparison, m as mean_diff_accuracy, up as scenarios_better, down as scenarios_worse, tied as scenarios_tied,
        round(least(1.0, 2 * least(list_sum(c[1:s + 1]), list_sum(c[s + 1:total + 1])) / pow(2, n)), 6) as wilcoxon_p from base left join ways using (a, b)""",
}
