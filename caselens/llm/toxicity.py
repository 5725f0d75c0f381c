"""7. Toxicity: cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Slice, lists, slices, spans_hash, written, tidy

BUCKETS = 1 << 20
PREFIXES = (4, 5, 6, 7)  # in bytes
TRAIN_ROWS = 20_000  # the most labelled rows that the model is fitted on
GRADES = 3
# word characters: letters, digits and all bytes of longer characters
LETTER = np.array([48 <= i <= 57 or 65 <= i <= 90 or 97 <= i <= 122 or i >= 128 for i in range(256)])


def features(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words (letters and digits, A-Z lower-cased) and of their PREFIXES, and each text's first one."""
    n = len(s.data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(s.n + 1, np.int64)
    solid = LETTER[s.data]
    edge = np.zeros(n + 1, bool)
    edge[s.offsets] = True
    start, end = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1] | edge[1:-1]
    end[:-1] &= ~solid[1:] | edge[1:-1]
    a, b = np.flatnonzero(start), np.flatnonzero(end) + 1
    sums = s.sums(lower=True)
    # a word's own length stands for its whole; prefixes are told apart from words by an odd constant
    each = [spans_hash(sums, a, b)] + [spans_hash(sums, a, np.minimum(a + k, b)) ^ np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1) for k in PREFIXES]
    return (np.stack(each, axis=1).ravel() % np.uint64(BUCKETS)).astype(np.int64), np.searchsorted(a, s.offsets) * len(each)


def _sets(batches):
    for x in batches:
        for s in slices(x.column(1)):
            f, first = features(s)
            each = [np.unique(f[first[i] : first[i + 1]]) for i in range(s.n)]
            yield pa.RecordBatch.from_arrays([x.column(0).slice(s.first, s.n), lists(np.concatenate(each).astype(np.int32), [len(u) for u in each], pa.int32())], names=["grade", "words"])


@dataclass
class OrdinalModel:
    """P(grade > k) = sigmoid(w . x - cut[k]): one weight vector for all ordered thresholds.

    x has the scales of a text's features, brought to length 1; weights are the products of w and the scales.
    """

    weights: np.ndarray
    scale: np.ndarray
    cuts: np.ndarray
    reject: float = 0.5  # P(grade > 0) from which a text counts as toxic

    def above(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - z[:, None], -40, 40)))


ROWS = 500  # rows that a fitting task holds features and slopes of at once


def _some_rows(batches):
    for x in batches:
        for i in range(0, x.num_rows, ROWS):
            yield x.slice(i, ROWS)


def _lists(c: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of a (sliced) list column."""
    return c.flatten().to_numpy(), np.diff(c.offsets.to_numpy())


def scales(sample: DataFrame, rate: float) -> np.ndarray:
    """How many standard deviations each feature's rows above grade 0 are off what chance gives; 0 for features of fewer than two rows.

    sample: (grade, words); rate: the share of rows above grade 0. Under one penalty for all, a feature of small scale is shrunk more.
    """

    def count(batches):
        seen, bad = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for x in _some_rows(batches):
            flat, size = _lists(x.column(1))
            np.add.at(seen, flat, 1)
            np.add.at(bad, flat[np.repeat(x.column(0).to_numpy() > 0, size)], 1)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some]), pa.array(bad[some])], names=["f", "seen", "bad"])

    n = sample.mapInArrow(tidy(count), "f long, seen long, bad long").groupBy("f").agg(F.sum("seen").alias("seen"), F.sum("bad").alias("bad")).where("seen > 1")
    got = n.select("f", (F.abs(F.col("bad") - F.col("seen") * rate) / F.sqrt(F.col("seen") * (rate * (1 - rate)) + 1)).cast("float").alias("scale")).toArrow()
    out = np.zeros(BUCKETS, np.float32)
    out[got.column("f").to_numpy()] = got.column("scale").to_numpy()
    return out


def likelihood(z: np.ndarray, cuts: np.ndarray, grades: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Sum of the rows' negative log likelihoods, and its slopes by z and by the cuts."""
    n, k = len(z), len(cuts)
    p = np.hstack([np.ones((n, 1)), 1 / (1 + np.exp(np.clip(cuts[None] - z[:, None], -40, 40))), np.zeros((n, 1))])
    lo, hi = p[np.arange(n), grades], p[np.arange(n), grades + 1]
    mass = np.maximum(lo - hi, 1e-9)
    slope = p[:, 1:-1] * (1 - p[:, 1:-1])
    by_cut = np.array([(np.where(grades == j, -slope[:, j], 0) + np.where(grades == j + 1, slope[:, j], 0)) @ (1 / mass) for j in range(k)])
    return float(-np.log(mass).sum()), -(lo * (1 - lo) - hi * (1 - hi)) / mass, by_cut


def descend(f, p: np.ndarray, steps: int = 60, memory: int = 6) -> np.ndarray:
    """L-BFGS steps from p; f gives value and gradient."""
    v, g = f(p)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, shares = -g, []
        for a, b in reversed(past):
            shares.append((a @ d) / (a @ b))
            d = d - shares[-1] * b
        d = d * ((past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(1e-12, np.linalg.norm(d)))
        for (a, b), r in zip(past, reversed(shares)):
            d = d + (r - (b @ d) / (a @ b)) * a
        step = 1.0
        while True:
            q = p + step * d
            value, slope = f(q)
            if value <= v + 1e-4 * step * (g @ d) or step < 1e-4:
                break
            step /= 4
        if value >= v - 1e-6 * abs(v):
            break
        if (q - p) @ (slope - g) > 1e-12:
            past = [*past, (q - p, slope - g)][-memory:]
        p, v, g = q, value, slope
    return p


def fit(sample: DataFrame, scale: np.ndarray, n: int, cuts: np.ndarray, tasks: int = 16, penalty: float = 1e-4) -> OrdinalModel:
    """Fits the weights of all features with a scale and the cuts together, with an L2 penalty on the weights.

    sample: (grade, words), n rows. Each step's gradient is summed up on the executors: a
    task gives one vector, and there are at most `tasks` tasks, so the driver's memory doesn't follow the rows.
    """
    sc, chosen, k = sample.sparkSession.sparkContext, np.flatnonzero(scale), len(cuts)
    scale_held = sc.broadcast(scale)
    sample = sample.coalesce(tasks)

    def rows(held):
        """(grades, row, feature, x, z) of the batches."""
        scale, w = scale_held.value, held.value[0]

        def of(x):
            flat, size = _lists(x.column(1))
            row, v = np.repeat(np.arange(len(size)), size), scale[flat].astype(np.float64)
            v /= np.sqrt(np.maximum(np.bincount(row, v * v, len(size)), 1e-12))[row]
            return np.maximum(x.column(0).to_numpy(), 0), row, flat, v, np.bincount(row, w[flat] * v, len(size))

        return of

    def placed(p):
        whole = np.zeros(BUCKETS, np.float32)
        whole[chosen] = p[:-k]
        return sc.broadcast((whole, p[-k:]))

    def step(p):
        held = placed(p)

        def slopes(batches):
            of, value, g, gc = rows(held), 0.0, np.zeros(BUCKETS), np.zeros(k)
            for x in _some_rows(batches):
                grades, row, flat, v, z = of(x)
                one, dz, dc = likelihood(z, held.value[1], grades)
                value, gc = value + one, gc + dc
                np.add.at(g, flat, dz[row] * v)
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([[value], gc]).tobytes()]), pa.array([g[scale_held.value != 0].astype(np.float32).tobytes()])], names=["cuts", "weights"])

        value, g = 0.5e-4 * float(((p[-k:] - cuts) ** 2).sum()) + penalty / 2 * float(p[:-k] @ p[:-k]), np.concatenate([penalty * p[:-k], 1e-4 * (p[-k:] - cuts)])
        for r in sample.mapInArrow(tidy(slopes), "cuts binary, weights binary").toArrow().to_pylist():
            c = np.frombuffer(r["cuts"])
            value += c[0] / n
            g[-k:] += c[1:] / n
            g[:-k] += np.frombuffer(r["weights"], np.float32) / n
        held.unpersist()
        return value, g

    p = descend(step, np.append(np.zeros(len(chosen)), cuts))
    held = placed(p)

    def scored(batches):
        of = rows(held)
        for x in _some_rows(batches):
            grades, _, _, _, z = of(x)
            yield pa.RecordBatch.from_arrays([pa.array(grades > 0), pa.array(z)], names=["bad", "z"])

    model = OrdinalModel(held.value[0] * scale, scale, np.maximum.accumulate(p[-k:]))
    got = sample.mapInArrow(tidy(scored), "bad boolean, z double").toArrow()
    model.reject = best_cut(model.above(got.column("z").to_numpy())[:, 0], np.array(got.column("bad").to_pylist(), bool))
    return model


def best_cut(p: np.ndarray, bad: np.ndarray) -> float:
    """The probability from which rejecting gives the highest F1 on the rows fitted."""
    values, at = np.unique(-p, return_inverse=True)
    hit, all_ = np.cumsum(np.bincount(at, bad)), np.cumsum(np.bincount(at))
    k = int(np.argmax(2 * hit / (all_ + bad.sum())))
    return float(-(values[k] + values[min(k + 1, len(values) - 1)]) / 2)


def train(docs: DataFrame, graded: DataFrame, rows: int = TRAIN_ROWS, grades: int = GRADES) -> OrdinalModel:
    """Fits on the `rows` graded documents with the least hash of their id (all, if there are fewer).

    graded: (doc_id, grade); rows without id or grade don't count. Of several rows for one id the highest grade holds.
    """
    sample = graded.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.max("grade").alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    held = written(docs.join(F.broadcast(sample), "doc_id").select(F.least("grade", F.lit(grades - 1)).cast("int").alias("grade"), "text").mapInArrow(tidy(_sets), "grade int, words array<int>"), "graded")
    n, bad = held.agg(F.count("*"), F.count_if(F.col("grade") > 0)).first()
    # cuts from smoothed shares, so that a grade without rows keeps a finite one
    above = held.agg(*(F.count_if(F.col("grade") > j) for j in range(grades - 1))).first()
    share = np.array([(above[j] + 0.5 / (j + 1)) / (n + 1) if n else 0.02 / (j + 1) for j in range(grades - 1)])
    share = np.minimum(share, 1 - 1e-6)
    cuts = np.maximum.accumulate(np.log(1 - share) - np.log(share))
    if not 0 < bad < n:
        return OrdinalModel(np.zeros(BUCKETS), np.zeros(BUCKETS), cuts)
    return fit(held, scales(held, bad / n), n, cuts)


def grades_of(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of the labels table: 0 not toxic, 1 toxic, 2 toxic and of low quality too."""
    return labels.select(F.col("doc_id").cast("long"), (F.col("toxic") * (F.lit(2) - F.coalesce("quality", F.lit(1)))).cast("int").alias("grade"))


def score(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", names: tuple[str, str, str] = ("expected_severity", "grade", "toxic")) -> DataFrame:
    """The input rows with expected_severity, grade and toxic, under the names given; columns of these names are replaced, others stay.

    expected_severity is the sum over thresholds of P(grade > k), grade the most likely one, toxic
    whether P(grade > 0) is above the model's reject cut. Null and blank texts have no feature and get the thresholds' own shares. Rows are
    scored one by one: repeated ones alike, texts of any length by the set of their words, no rows give no rows.
    """
    docs = docs.drop(*names)
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        m = held.value
        for x in batches:
            z = np.zeros(x.num_rows)
            for s in slices(x.column(at)):
                f, first = features(s)
                live = np.flatnonzero(m.scale[f])
                row = np.searchsorted(first, live, side="right") - 1
                # a word counts once a text
                pair = np.unique(row * BUCKETS + f[live])
                z[s.first : s.first + s.n] = np.bincount(pair // BUCKETS, m.weights[pair % BUCKETS], s.n) / np.sqrt(np.maximum(np.bincount(pair // BUCKETS, m.scale[pair % BUCKETS].astype(np.float64) ** 2, s.n), 1e-12))
            p = m.above(z)
            mass = -np.diff(np.hstack([np.ones((len(z), 1)), p, np.zeros((len(z), 1))]), axis=1)
            yield pa.RecordBatch.from_arrays([*x.columns, pa.array(p.sum(axis=1)), pa.array(mass.argmax(axis=1).astype(np.int32)), pa.array(p[:, 0] > m.reject)], names=[*x.schema.names, *names])

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return docs.mapInArrow(tidy(run), f"{schema}, `{names[0]}` double, `{names[1]}` int, `{names[2]}` boolean")


def model_for(spark: SparkSession, docs: DataFrame, sf_dir: str) -> OrdinalModel:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return train(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), grades_of(labels))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs.select("doc_id", "text"), model_for(spark, docs, sf_dir)).drop("text")


QUERIES = {"op7_toxicity": op7_toxicity}
ORACLE_SQL: dict[str, str] = {}
