"""Folds, models, tests and attributions against brute force and planted signals."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from caselens.operators import attribution, audits, folds, modeling

rng = np.random.default_rng(5)
SMALL = modeling.Forest(trees=8, depth=4)


def planted(n=120):
    """Cases whose own service's metric tells the class; the services' loads tell which service is affected."""
    cases, long = [], []
    for i in range(n):
        own, y = i % 3, ("High", "Low", "Medium")[(i // 3) % 3]
        cases.append((i, f"s{own}_{i % 12}", f"svc{own}", y))
        for s in range(3):
            level = {"High": 9.0, "Low": 1.0, "Medium": 5.0}[y] if s == own else float(rng.integers(0, 11))
            long += [(i, f"metric__svc{s}_cpu__zscore_mean", level + rng.normal(0, 0.3)), (i, f"metric__svc{s}_workload__baseline_mean", 8.0 * (s == own) + rng.normal(0, 1))]
            long.append((i, f"trace_latency__svc{s}_Get__zscore_max", None if i % 7 == 0 else float(i % 5)))
            long.append((i, f"trace_latency__svc{s}_Put_Order__zscore_max", 2.0))
        long.append((i, "svc__anomalous_service_count", float(i % 2)))
    return cases, long


@pytest.fixture(scope="module")
def shop(spark):
    cases, long = planted()
    return spark.createDataFrame(cases, "case_id long, scenario string, service string, y string"), spark.createDataFrame(long, "case_id long, feature_name string, value double")


@pytest.fixture(scope="module")
def placed(shop):
    return folds.group_folds(shop[0], 3, 2, 7).cache()


def test_folds(spark, shop, placed):
    for r in folds.fold_invariants(placed, shop[0], 3).collect():
        assert (r.case_count, r.not_tested_once, r.split_scenarios, r.classes_not_in_train, r.uneven_classes) == (120, 0, 0, 0, 0)
    assert {r.overlap for r in folds.fold_overlap(placed).collect()} == {0}
    again = folds.group_folds(shop[0].repartition(5), 3, 2, 7)
    assert again.exceptAll(placed).isEmpty()
    per = {r.repeat: {(x.case_id, x.fold) for x in placed.where(F.col("repeat") == r.repeat).collect()} for r in placed.select("repeat").distinct().collect()}
    assert per[0] != per[1]


def test_uneven_groups_share_classes(spark):
    """Scenarios of 1 to 40 cases with a class of their own each: folds are as even as the largest scenario allows."""
    rows = [(1000 * g + i, f"g{g}", "ab"[g % 2]) for g in range(25) for i in range(1 + g * g % 40)]
    cases = spark.createDataFrame(rows, "case_id long, scenario string, y string")
    out = folds.fold_invariants(folds.group_folds(cases, 5, 3, 1), cases, 5)
    assert {(r.split_scenarios, r.uneven_classes, r.classes_not_in_train) for r in out.collect()} == {(0, 0, 0)}


def test_overlap_is_seen(spark):
    bad = spark.createDataFrame([(0, 0, 1, "a", "x"), (0, 1, 2, "a", "x"), (0, 1, 3, "b", "y")], "repeat int, fold int, case_id long, scenario string, y string")
    assert sum(r.overlap for r in folds.fold_overlap(bad).collect()) == 2
    assert folds.fold_invariants(bad, bad.select("case_id", "scenario", "y"), 2).first().split_scenarios == 1


def test_baselines(spark, shop, placed):
    share = {"majority": 0, "stratified": 0}
    for strategy in share:
        out = folds.dummy_predictions(placed, strategy, 3)
        assert out.exceptAll(folds.dummy_predictions(placed.repartition(4), strategy, 3)).isEmpty()
        assert out.count() == 240
    drawn = folds.dummy_predictions(spark.range(6000).select(F.lit(0).alias("repeat"), (F.col("id") % 2).cast("int").alias("fold"), F.col("id").alias("case_id"), F.when(F.col("id") % 10 < 7, "a").when(F.col("id") % 10 < 9, "b").otherwise("c").alias("y")), "stratified")
    n = {r.y_pred: r["count"] / 6000 for r in drawn.groupBy("y_pred").count().collect()}
    assert abs(n["a"] - 0.7) < 0.03 and abs(n["b"] - 0.2) < 0.03 and abs(n["c"] - 0.1) < 0.03


def test_cross_validation_learns_from_train_rows_alone(spark, shop, placed):
    cases, long = shop
    services = cases.select("service").distinct()
    lookup = modeling.relative_lookup(long, services)
    own = modeling.take_relative(lookup, cases)
    oof = modeling.cross_validate(own, placed, SMALL)
    for r in modeling.prediction_invariants(oof, placed).collect():
        assert (r.case_count, r.not_predicted_once, r.out_of_place, r.bad_probabilities, r.beats_majority) == (120, 0, 0, 0, True)
    # a value that only test rows of fold 0 have can't reach that fold's medians
    train = placed.where("repeat = 0 and fold <> 0")
    assert modeling.medians(long, train).count() == len(modeling.feature_names(long))
    gap = modeling.vectors(long.where("case_id < 5"), cases.where("case_id < 6"), ["metric__svc0_cpu__zscore_mean", "never"], modeling.medians(long, cases)).orderBy("case_id").collect()
    assert len(gap) == 6 and all(len(r["values"]) == 2 and r["values"][1] == 0.0 for r in gap)
    assert gap[5]["values"][0] == pytest.approx(np.median([r.value for r in long.where("feature_name = 'metric__svc0_cpu__zscore_mean'").collect()]))


def test_relative_lookup(spark):
    rows = [(1, "metric__a_cpu__m", 1.0), (1, "metric__a_other__m", 9.0), (1, "log__a__error__m", 2.0), (1, "log__a__new_template_count", 3.0), (1, "trace_error__a_Get__m", 4.0), (1, "trace_error__a_Put_X__m", 5.0), (1, "trace_error__b_Get__m", 7.0), (1, "svc__depth", 6.0), (1, "log__all__new_template_count", 8.0), (1, "metric__c_cpu__m", 0.0)]
    long = spark.createDataFrame(rows, "case_id long, feature_name string, value double")
    got = {(r.service, r.feature_name): r.value for r in modeling.relative_lookup(long, spark.createDataFrame([("a",), ("b",)], "service string")).collect()}
    shared = {(s, n): v for s in "ab" for n, v in (("svc__depth", 6.0), ("log__all__new_template_count", 8.0))}
    assert got == shared | {("a", "self__cpu__m"): 1.0, ("a", "self_log__error__m"): 2.0, ("a", "self_log__new_template_count"): 3.0, ("a", "self_trace_error__max__m"): 5.0, ("b", "self_trace_error__max__m"): 7.0}


def test_two_stages_use_the_predicted_service(spark, shop, placed):
    """The loads of some cases point at another service: their rows must be that service's, although the true one is known."""
    cases, long = shop
    wrong = long.withColumn("value", F.when((F.col("case_id") % 10 == 1) & F.col("feature_name").contains("workload"), 0.0).otherwise(F.col("value")))
    wrong = wrong.withColumn("value", F.when((F.col("case_id") % 10 == 1) & (F.col("feature_name") == F.concat(F.lit("metric__svc"), ((F.col("case_id") + 1) % 3).cast("string"), F.lit("_workload__baseline_mean"))), 8.0).otherwise(F.col("value")))
    lookup = modeling.relative_lookup(wrong, cases.select("service").distinct())
    seen = []
    oof = modeling.cross_validate_two_stage(wrong, lookup, placed.where("repeat = 0"), cases, modeling.Forest(8, 5, balanced=False), SMALL, collect=seen)
    rows = {r.case_id: r for r in oof.collect()}
    assert len(rows) == 120
    missed = [i for i, r in rows.items() if r.service != r.service_true]
    assert len(missed) >= 6 and all(0 < r.locator_confidence <= 1 for r in rows.values())
    names = modeling.feature_names(lookup)
    cpu = {(r.case_id, r.service): r.value for r in lookup.where("feature_name = 'self__cpu__zscore_mean'").collect()}
    used = {r.case_id: r["values"][names.index("self__cpu__zscore_mean")] for _, _, _, t in seen for r in t.collect()}
    assert all(used[i] == cpu[i, rows[i].service] for i in rows)
    assert any(used[i] != cpu[i, rows[i].service_true] for i in missed)
    votes = {r.case_id: r for r in modeling.locator_confidence(oof).collect()}
    assert all(votes[i].service == rows[i].service and votes[i].reliable == (votes[i].confidence >= 0.7) for i in rows)


def test_a_kept_model_scores_as_before(spark, shop, tmp_path):
    cases, long = shop
    lookup = modeling.relative_lookup(long, cases.select("service").distinct())
    modeling.save_two_stage(long, lookup, cases.where("case_id < 90"), str(tmp_path / "m"), modeling.Forest(8, 5, balanced=False), SMALL)
    one = modeling.score_two_stage(spark, str(tmp_path / "m"), long, lookup, cases)
    other = spark.newSession()
    two = modeling.score_two_stage(other, str(tmp_path / "m"), long, lookup, cases)
    a, b = ({r.case_id: (r.service, r.y_pred, tuple(r.proba)) for r in x.collect()} for x in (one, two))
    assert a == b and len(a) == 120
    truth = {r.case_id: r for r in cases.collect()}
    assert sum(a[i][1] == truth[i].y for i in range(90, 120)) >= 20


def brute_p(d):
    d = [x for x in d if x]
    if not d:
        return None
    order = sorted(abs(x) for x in d)
    rank = [np.mean([i + 1 for i, v in enumerate(order) if v == abs(x)]) for x in d]
    w = sum(r for r, x in zip(rank, d) if x > 0)
    sums = [sum(r for r, s in zip(rank, signs) if s) for signs in itertools.product((0, 1), repeat=len(d))]
    return min(1.0, 2 * min(np.mean([s <= w + 1e-9 for s in sums]), np.mean([s >= w - 1e-9 for s in sums])))


def test_paired_tests(spark):
    tests = {"b": [0.1, 0.2, -0.1, 0.0, 0.3, 0.1, 0.1, -0.2, 0.4], "c": [0.0] * 9, "d": [0.1] * 9, "e": [-0.1, 0.2, -0.3, 0.4, -0.5, 0.6, 0.7, 0.0, 0.1]}
    rows = [("a", f"s{i}", 0.5) for i in range(9)] + [(k, f"s{i}", 0.5 + x) for k, v in tests.items() for i, x in enumerate(v)]
    acc = spark.createDataFrame(rows, "config string, scenario string, accuracy double")
    got = {r.comparison: r for r in folds.paired_tests(acc, [("a", k) for k in tests] + [("a", "absent")]).collect()}
    assert set(got) == {f"{k} vs a" for k in tests}
    for k, v in tests.items():
        r, p = got[f"{k} vs a"], brute_p(v)
        assert (r.scenarios_better, r.scenarios_worse, r.scenarios_tied) == (sum(x > 0 for x in v), sum(x < 0 for x in v), sum(x == 0 for x in v))
        assert r.wilcoxon_p == (None if p is None else pytest.approx(p, abs=1e-6))
    near = folds.paired_tests(acc, [("a", "b")], exact=0).first().wilcoxon_p
    assert abs(near - brute_p(tests["b"])) < 0.06
    z = spark.range(1).select(*(folds.normal_tail(F.lit(x)).alias(f"z{i}") for i, x in enumerate((0.0, 1.0, 1.96, 5.0)))).first()
    assert [z[i] for i in range(4)] == pytest.approx([math.erfc(x / math.sqrt(2)) for x in (0.0, 1.0, 1.96, 5.0)], rel=1e-6)


def brute_tree(x, y):
    """Balanced accuracy of the depth-two tree, by trying all thresholds of the root and of both sides."""
    def best(rows):
        cuts = sorted({v for v, _ in rows})[:-1]
        pure = lambda part: sum(sum(t == c for _, t in part) ** 2 for c in set(y)) / len(part)
        return max(cuts, key=lambda c: (round(pure([r for r in rows if r[0] <= c]) + pure([r for r in rows if r[0] > c]), 9), -c), default=None)

    def split(rows, depth):
        c = best(rows) if depth else None
        if c is None:
            names = sorted({t for _, t in rows})
            return [(rows, max(names, key=lambda n: (sum(t == n for _, t in rows), [-ord(ch) for ch in n])))]
        return split([r for r in rows if r[0] <= c], depth - 1) + split([r for r in rows if r[0] > c], depth - 1)

    leaves = split(list(zip(x, y)), 2)
    return np.mean([sum(sum(t == c == named for _, t in rows) for rows, named in leaves) / y.count(c) for c in set(y)])


def test_proxy_trees(spark):
    tiers = [("A", "B", "C")[i % 3] for i in range(40)]
    columns = {f"svc__f{k}": [float(v) for v in np.random.default_rng(k).integers(0, 4 + 3 * k, 40)] for k in range(6)} | {"svc__tier": [float("ABC".index(t)) for t in tiers], "svc__same": [2.0] * 40, "svc__two": [float(t == "A") for t in tiers]}
    long = spark.createDataFrame([(i, n, v[i]) for n, v in columns.items() for i in range(40)], "case_no long, feature_name string, value double")
    cases = spark.createDataFrame([(i, f"s{i % 6}", t) for i, t in enumerate(tiers)], "case_no long, service string, tier string")
    got = {r.feature_name: r.tier_balanced_accuracy for r in audits.tier_accuracy(long, cases).collect()}
    assert got == pytest.approx({n: brute_tree(v, tiers) for n, v in columns.items()})
    verdict = {r.feature_name: (r.decision, r.reason) for r in audits.proxy_audit(long, cases).collect()}
    assert verdict["svc__same"] == ("rejected", "constant")
    assert verdict["svc__tier"] == ("rejected", "encodes_tier|service_identifier")
    assert verdict["svc__f0"] == ("passed", "")


def test_attributions_equal_all_subsets(spark):
    n = 60
    x = np.random.default_rng(9).normal(size=(n, 4)).round(2)
    y = ["abc"[int(v)] for v in np.clip(np.floor(x[:, 0] + x[:, 1] * (x[:, 2] > 0) + 1), 0, 2)]
    rows = spark.createDataFrame([(i, [float(v) for v in x[i]], y[i]) for i in range(n)], "case_id long, values array<double>, y string")
    from pyspark.ml.functions import array_to_vector

    rows = rows.withColumn("features", array_to_vector("values"))
    classes = ["a", "b", "c"]
    model = modeling.fit_forest(rows, classes, modeling.Forest(trees=3, depth=3))
    asked = rows.where("case_id < 12")
    found, base = attribution.attributions(model, asked.select("case_id", "values"), [f"f{i}" for i in range(4)], classes)
    got = {(r.case_id, r.feature_name): np.array([r.a, r.b, r.c]) for r in found.collect()}
    nodes = {}
    for r in attribution.node_table(model, spark).collect():
        nodes.setdefault(r.tree, {})[r.node] = r

    def value(tree, node, row, known):
        r = tree[node]
        if r.left < 0:
            return np.array(r.p)
        if r.feature in known:
            return value(tree, r.left if row[r.feature] <= r.threshold else r.right, row, known)
        return sum(tree[c].cover / r.cover * value(tree, c, row, known) for c in (r.left, r.right))

    for i in range(12):
        v = {s: np.mean([value(t, 0, x[i], s) for t in nodes.values()], axis=0) for k in range(5) for s in itertools.combinations(range(4), k)}
        for f in range(4):
            rest = [g for g in range(4) if g != f]
            want = sum(math.factorial(len(s)) * math.factorial(3 - len(s)) / 24 * (v[tuple(sorted((*s, f)))] - v[s]) for k in range(4) for s in itertools.combinations(rest, k))
            assert got.get((i, f"f{f}"), np.zeros(3)) == pytest.approx(want, abs=1e-9)
        assert base.first().a == pytest.approx(v[()][0])
