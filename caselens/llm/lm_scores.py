"""9. LM scoring: a log-bilinear model trained by noise-contrastive estimation.

The model predicts a token's class from the tokens before it: the most frequent words and the
end token are classes of their own, all other words fall into classes by their last two bytes.
Within such a class a word has its smoothed share of the training counts. So every word, known
or not, has a normalised probability, while the matrices keep a fixed size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Slice, as_long, lists, mix, slices, spans_hash, written, tidy

CLASSES, ENDINGS = 128, 48  # classes in all; those of rare words. Class 0 is the end token
CONTEXT, WIDTH, NOISE, BATCH, RATE = 4, 16, 32, 4096, 0.2
FREQUENT = 200_000  # words whose counts are held by each task; the others are joined
END = 0
SMOOTH = 0.1


def tokens(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, ending classes and each text's first word."""
    a, b, first = s.words()
    h = spans_hash(s.sums(lower=True), a, b)
    low = np.where((s.data >= 65) & (s.data <= 90), s.data + 32, s.data).astype(np.uint64)
    pair = low[b - 1] * np.uint64(256) + np.where(b - a > 1, low[np.maximum(b - 2, 0)], 0)
    return h, (mix(pair) % np.uint64(ENDINGS)).astype(np.int64), first


class Classes:
    """Class of each word: own is the sorted hashes of the words with classes of their own."""

    def __init__(self, own: np.ndarray):
        self.own = np.sort(own)

    def of(self, h: np.ndarray, ending: np.ndarray) -> np.ndarray:
        if not len(self.own):
            return 1 + ending
        k = np.minimum(np.searchsorted(self.own, h), len(self.own) - 1)
        return np.where(self.own[k] == h, 1 + ENDINGS + k, 1 + ending)

    def sequence(self, s: Slice):
        """Classes of all tokens with ends, contexts, where texts end, and the words' hashes and classes."""
        h, ending, first = tokens(s)
        c = self.of(h, ending)
        n = np.diff(first) + 1
        stop = np.cumsum(n)
        y = np.zeros(int(stop[-1]) if len(stop) else 0, np.int64)
        word = np.ones(len(y), bool)
        word[stop - 1] = False
        y[word] = c
        at = np.arange(len(y)) - np.repeat(stop - n, n)  # place in the text
        ctx = np.zeros((CONTEXT, len(y)), np.int64)
        for i in range(CONTEXT):
            ctx[i, i + 1 :] = y[: max(0, len(y) - i - 1)]
            ctx[i][at <= i] = 0
        return y, ctx, stop, n, h, c, word


def start(share: np.ndarray) -> list[np.ndarray]:
    """Context tables, output vectors and biases before training."""
    rng = np.random.default_rng(5)
    return [rng.normal(0, 0.1, (CONTEXT, CLASSES, WIDTH)).astype(np.float32), rng.normal(0, 0.1, (CLASSES, WIDTH)).astype(np.float32), np.log(share).astype(np.float32)]


def _sums_by(k: np.ndarray, x: np.ndarray, into: np.ndarray) -> None:
    order = np.argsort(k.astype(np.int16), kind="stable")
    k = k[order]
    new = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    into[k[new]] += np.add.reduceat(x[order], new, axis=0)


class Trainer:
    """Minibatch AdaGrad on the noise-contrastive loss; a batch's tokens share their noise samples."""

    def __init__(self, share: np.ndarray, seed: int):
        self.share, self.p = share, start(share)
        self.g = [np.full(x.shape, 1e-2, np.float32) for x in self.p]
        self.rng, self.log_noise, self.seen = np.random.default_rng(seed), np.log(NOISE * share).astype(np.float32), 0

    def learn(self, y: np.ndarray, ctx: np.ndarray) -> None:
        t, q, b = self.p
        self.seen += len(y)
        r = t[0][ctx[0]]
        for i in range(1, CONTEXT):
            r = r + t[i][ctx[i]]
        z = self.rng.choice(CLASSES, NOISE, p=self.share)
        clip = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
        pos = clip((r * q[y]).sum(axis=1) + b[y] - self.log_noise[y]) - 1
        neg = clip(r @ q[z].T + b[z] - self.log_noise[z])
        dr = pos[:, None] * q[y] + neg @ q[z]
        grads = [np.zeros_like(x) for x in self.p]
        _sums_by(y, pos[:, None] * r, grads[1])
        np.add.at(grads[1], z, neg.T @ r)
        grads[2] += np.bincount(y, pos, CLASSES).astype(np.float32)
        np.add.at(grads[2], z, neg.sum(axis=0))
        for i in range(CONTEXT):
            _sums_by(ctx[i], dr, grads[0][i])
        for x, g, s in zip(self.p, grads, self.g):
            g /= len(y)
            s += g * g
            x -= RATE * g / np.sqrt(s)


def log_probs(p: list[np.ndarray], y: np.ndarray, ctx: np.ndarray) -> np.ndarray:
    """Normalised natural log-probabilities of the classes y."""
    t, q, b = p
    out = np.empty(len(y))
    for i in range(0, len(y), BATCH):
        c = ctx[:, i : i + BATCH]
        r = t[0][c[0]]
        for k in range(1, CONTEXT):
            r = r + t[k][c[k]]
        x = r @ q.T
        x += b
        own = x[np.arange(len(x)), y[i : i + BATCH]].astype(np.float64)
        top = float(x.max())
        out[i : i + BATCH] = own - top - np.log(np.exp(x - np.float32(top)).sum(axis=1, dtype=np.float64))
    return out


def word_counts(texts: DataFrame) -> DataFrame:
    """(hash, ending, c) of all words of the one text column."""

    def count(batches):
        held: list[tuple] = []
        size = 0

        def flush():
            h, e, c = (np.concatenate([x[k] for x in held]) for k in range(3))
            u, first, inverse = np.unique(h, return_index=True, return_inverse=True)
            return u, e[first], np.bincount(inverse, c).astype(np.int64)

        def rows(x):
            return pa.RecordBatch.from_arrays([pa.array(as_long(x[0])), pa.array(x[1]), pa.array(x[2])], names=["hash", "ending", "c"])

        for x in batches:
            for s in slices(x.column(0)):
                h, ending, _ = tokens(s)
                u, first, c = np.unique(h, return_index=True, return_counts=True)
                held.append((u, ending[first], c))
                size += len(u)
                if size > 1_500_000:
                    held = [flush()]
                    if len(held[0][0]) > 750_000:
                        yield rows(held[0])
                        held = []
                    size = sum(len(z[0]) for z in held)
        if held:
            yield rows(flush())

    return texts.mapInArrow(tidy(count), "hash long, ending long, c long").groupBy("hash").agg(F.min("ending").alias("ending"), F.sum("c").alias("c"))


def train(texts: DataFrame, classes: Classes, share: np.ndarray) -> list[np.ndarray]:
    """Every partition learns from all of its tokens, from one start; parameters are averaged by tokens."""
    held = texts.sparkSession.sparkContext.broadcast((classes.own, share))

    def learn(batches):
        from pyspark import TaskContext

        own, share = held.value
        c, model = Classes(own), Trainer(share, TaskContext.get().partitionId())
        for x in batches:
            for s in slices(x.column(0)):
                y, ctx, *_ = c.sequence(s)
                for i in range(0, len(y), BATCH):
                    model.learn(y[i : i + BATCH], ctx[:, i : i + BATCH])
        if model.seen:
            flat = np.concatenate([p.ravel() for p in model.p]).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat * model.seen), pa.array(np.full(len(flat), float(model.seen)))], names=["i", "x", "w"])

    got = texts.mapInArrow(tidy(learn), "i long, x double, w double").groupBy("i").agg((F.sum("x") / F.sum("w")).alias("x")).toPandas().sort_values("i")
    p = start(share)
    if not len(got):
        return p
    flat, out = got["x"].to_numpy(np.float32), []
    for x in p:
        out.append(flat[: x.size].reshape(x.shape))
        flat = flat[x.size :]
    return out


def score_documents(docs: DataFrame, held_out: str = "pmod(crc32(coalesce(cast(doc_id as string), '')), 10) = 0", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words (A-Z lower-cased, runs of non-space bytes) and one end for each text;
    null and blank texts have the end alone. Learns from the rows that `held_out` doesn't hold
    out: counts of all words, and the model from all tokens. base_score: log10 of smoothed
    unigrams; score: the model's log10 probability of the text. Repeated and null ids are rows of their own.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("held_out", F.expr(held_out))
    learned = rows.where("not held_out").select("text")
    words = written(word_counts(learned), "words")
    n_docs = learned.count()
    most = CLASSES - 1 - ENDINGS
    own = [r["hash"] for r in words.orderBy(F.desc("c"), "hash").limit(most).collect()]
    classes = Classes(np.array(own, np.int64).view(np.uint64))
    # sums of the ending classes, words with classes of their own left out
    by = words.withColumn("own", F.col("hash").isin(own)).groupBy("ending", "own").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    n, v = sum(r["n"] for r in by) + n_docs, sum(r["v"] for r in by) + (n_docs > 0)
    in_class = np.full(CLASSES, SMOOTH)
    mass = np.full(CLASSES, 1.0)
    mass[0] += n_docs
    for r in by:
        if not r["own"]:
            in_class[1 + r["ending"]] += r["n"] + SMOOTH * r["v"]
            mass[1 + r["ending"]] += r["n"]
    own_counts = {r["hash"]: r["c"] for r in words.where(F.col("hash").isin(own)).collect()}
    for k, h in enumerate(as_long(classes.own)):
        mass[1 + ENDINGS + k] += own_counts[int(h)]
    model = train(learned, classes, mass / mass.sum())

    # counts of the frequent words go to each task: those above the power of two that lets FREQUENT through
    level = F.floor(F.log2("c")).alias("level")
    floor, room = 0, FREQUENT
    for r in words.groupBy(level).count().orderBy(F.desc("level")).collect():
        room -= r["count"]
        if room < 0:
            floor = 2 << r["level"]
            break
    top = words.where(F.col("c") >= floor).select("hash", "c").toPandas()
    order = np.argsort(top["hash"].to_numpy(np.int64).view(np.uint64))
    held = spark.sparkContext.broadcast((classes.own, model, top["hash"].to_numpy(np.int64).view(np.uint64)[order], top["c"].to_numpy(np.int64)[order]))
    z, z_class = np.log10(n + SMOOTH * (v + 1)) if n else np.log10(SMOOTH), np.log10(in_class)

    def score(batches):
        from pyspark import TaskContext

        own, model, known, counts = held.value
        c, part, done = Classes(own), TaskContext.get().partitionId(), 0
        for x in batches:
            for s in slices(x.column(1)):
                y, ctx, stop, n_tok, h, cls, word = c.sequence(s)
                lp = log_probs(model, y, ctx) / np.log(10)
                rare = (cls > 0) & (cls <= ENDINGS)
                lp[word] -= np.where(rare, z_class[cls], 0)
                k = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
                hit = known[k] == h if len(known) else np.zeros(len(h), bool)
                log_c = np.zeros(len(h))
                log_c[hit] = np.log10(counts[k[hit]] + SMOOTH)
                lp[word] += np.where(rare, log_c, 0)
                base = np.full(len(y), np.log10(n_docs + SMOOTH))
                base[word] = log_c
                ok = np.ones(len(y), np.int64) * (n_docs > 0)
                ok[word] = hit
                # the rest of the words, by text, with how often
                text = np.repeat(np.arange(s.n), n_tok - 1)[~hit]
                far = h[~hit]
                o = np.lexsort((far, text))
                text, far = text[o], far[o]
                new = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (far[1:] != far[:-1]))) if len(far) else np.zeros(0, np.int64)
                times = np.diff(np.append(new, len(far)))
                per = np.bincount(text[new], minlength=s.n) if len(new) else np.zeros(s.n, np.int64)
                begin = stop - n_tok
                ids = x.column(0).slice(s.first, s.n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((part << 36) + done + np.arange(s.n)), ids, x.column(2).slice(s.first, s.n), pa.array(n_tok), pa.array(np.add.reduceat(ok, begin)), pa.array(np.add.reduceat(base, begin) - n_tok * z), pa.array(np.add.reduceat(lp, begin)), lists(as_long(far[new]), per, pa.int64()), lists(times, per, pa.int64())],
                    names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "far", "times"],
                )
                done += s.n

    scored = written(rows.select("doc_id", "text", "held_out").mapInArrow(tidy(score), "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, far array<long>, times array<long>"), "scored")
    # a word of an ending class that isn't frequent adds the same log count to both scores
    far = scored.select("row", F.explode(F.arrays_zip("far", "times")).alias("x")).select("row", F.col("x.far").alias("hash"), F.col("x.times").alias("times"))
    add = far.join(words.where(F.col("c") < floor).select("hash", "c"), "hash", "left").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + SMOOTH)).alias("more"), F.sum(F.when(F.col("c").isNotNull(), F.col("times"))).alias("found"))
    out = scored.drop("far", "times").join(add, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("found", F.lit(0))).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("score") + more).alias("score"))


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every document by the model and by smoothed unigrams."""
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op9_lm_scores": op9_lm_scores}
ORACLE_SQL: dict[str, str] = {}
