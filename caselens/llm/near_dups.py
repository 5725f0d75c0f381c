"""1. MinHash near-dedup by a signature-coordinate inverted join."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_long, lists, mix, only_maybe, shingles, slices, word_hashes, written, tidy
from .links import SKETCH, alike, confirmed, in_cells, link_components, sketch, sketch_columns

PAIRED = 8  # sets of a posting up to which all their pairs are met at once
CROSSED = 128  # members of a meeting from which on its pairs are met in cells
_seeds = np.random.default_rng(71)
FACTOR = _seeds.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
OFFSET = _seeds.integers(1, 1 << 63, 256, dtype=np.uint64)


def match_threshold(coordinates: int, similarity: float, miss: float = 1e-6) -> int:
    """The most matches that a pair of this similarity misses with a chance of `miss` at most."""
    below, t = 0.0, 0
    while t < coordinates:
        below += math.comb(coordinates, t) * similarity**t * (1 - similarity) ** (coordinates - t)
        if below > miss:
            break
        t += 1
    return max(1, t)


def coordinates_of(u: np.ndarray, k: int) -> np.ndarray:
    """MinHash coordinates of a set; each holds its number in the low byte."""
    low = np.full(k, np.uint64((1 << 64) - 1))
    for i in range(0, len(u), 1 << 14):
        low = np.minimum(low, (u[i : i + (1 << 14), None] * FACTOR[:k] + OFFSET[:k]).min(axis=0))
    return (mix(low) & np.uint64(0x7FFFFFFFFFFFFF00)) | np.arange(k, dtype=np.uint64)


def _sets(n: int, column: pa.Array):
    for s in slices(column):
        words, first = word_hashes(s)
        for i in range(s.n):
            yield np.unique(shingles(words[first[i] : first[i + 1]], n))


def _set_key(u: np.ndarray) -> int:
    return int(mix(np.array([np.sum(mix(u ^ np.uint64(0xA5A5A5A5A5A5A5A5)), dtype=np.uint64) + np.uint64(len(u))]))[0].view(np.int64))


def set_signatures(docs: DataFrame, n: int, k: int) -> DataFrame:
    """(doc_id, n_shingles, item, coords): item names the shingle set; null where it is empty."""

    def of(batches):
        for x in batches:
            sizes, keys, coords = [], [], []
            for u in _sets(n, x.column(1)):
                sizes.append(len(u))
                keys.append(_set_key(u) if len(u) else None)
                coords.append(coordinates_of(u, k) if len(u) else u)
            flat = np.concatenate(coords) if coords else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), lists(as_long(flat), [len(c) for c in coords], pa.int64())], names=["doc_id", "n_shingles", "item", "coords"])

    return docs.mapInArrow(tidy(of), "doc_id long, n_shingles long, item long, coords array<long>")


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, k: int = 32, crossed: int = CROSSED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, n_shingles, component_id, kept.

    Documents link if their sets of n-word shingles (A-Z lower-cased, words of non-space bytes)
    have a Jaccard similarity of percent/100 or more. Each set gets k MinHash coordinates, posted
    as coordinate-value pairs. A linked pair shares at least t coordinates (match_threshold), so
    a set is a candidate only if t of its postings meet another; its t - 1 most frequent
    postings are skipped, the rarer ones are merged, and all coordinates are counted for the pairs met.
    Pairs at the threshold are confirmed on the full sets.

    Null or blank texts have an empty set, link with nothing and are kept. Texts of fewer than n
    words count as one shingle. Equal sets are one item, so copies cost no comparison. Rows with
    a null id take part; component_id is the least id that isn't null. Repeated ids are rows of their own.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    t = match_threshold(k, percent / 100)
    sig = written(set_signatures(docs, n, k), "signatures")
    classes = sig.where("item is not null").groupBy("item").agg(F.min("doc_id").alias("low"), F.first("coords").alias("coords"))
    posted = classes.select("item", F.explode("coords").alias("key"))
    met = posted.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    lists_of = posted.join(met, "key").groupBy("item").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("p")).where(F.size("p") >= t)
    postings = written(lists_of.select("item", F.explode(F.expr(f"slice(p, 1, size(p) - {t - 1})")).alias("p")).select(F.col("p.key").alias("key"), "item"), "postings")

    live = postings.select("item").distinct()
    firsts = written(sig.where("item is not null").groupBy("item").agg(F.min("doc_id").alias("low")), "classes")
    lows = firsts.join(live, "item").select("low")

    def full(batches):
        for x in batches:
            keys, elems, sketches = [], [], []
            for u in _sets(n, x.column(1)):
                if len(u):
                    keys.append(_set_key(u))
                    elems.append(coordinates_of(u, k).tobytes() + u.tobytes())
                    sketches.append(sketch(u))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(elems, pa.binary()), *sketch_columns(sketches)], names=["item", "elems", "size", "bits0", "bits1"])

    sets = only_maybe(docs, "doc_id", lows).join(lows.distinct(), F.col("doc_id").eqNullSafe(F.col("low")), "left_semi").mapInArrow(tidy(full), f"item long, elems binary, {SKETCH}")
    sets = written(sets.join(live, "item", "left_semi").dropDuplicates(["item"]), "sets")

    members = postings.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    comp = link_components(
        postings.join(members, "key"), sets.drop("elems"), alike(percent, 100), lambda need: sets.join(need, "item", "left_semi"),
        lambda pairs, sets: confirmed(pairs, sets, percent, 100, k, t), lambda p, sets: in_cells(p, sets, percent, 100, k, t), paired=PAIRED, crossed=crossed,
    )
    whole = firsts.join(comp, firsts["item"] == comp["node"], "left").select("item", "low", F.coalesce("component", "item").alias("component"))
    least = whole.groupBy("component").agg(F.min("low").alias("component_id"))
    named = whole.join(least, "component").select("item", "component_id")
    out = sig.select("doc_id", "n_shingles", "item").join(named, "item", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op1_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=3, percent=85)


QUERIES = {"op1_near_dups": op1_near_dups}
ORACLE_SQL: dict[str, str] = {}
