"""11. N-gram Jaccard join: prefixes of token combinations for frequent tokens, of single tokens for rare ones."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_long, lists, only_maybe, tidy, written
from .links import SKETCH, alike, confirmed, in_cells, link_components, sketch, sketch_columns
from .near_dups import _set_key, _sets

CELL_BITS, BLOCK_BITS = 22, 12  # places in which tokens are counted for their order, and of a block of them
RARE = 8  # documents of a token up to which it is a key by itself
MOST = 16  # frequent tokens of a prefix up to which they are combined
CROSSED = 128  # members of a meeting from which on its pairs are met in cells
SIGMAS = 8.0


def frequency_classes(docs: DataFrame, n: int, bits: int = CELL_BITS) -> np.ndarray:
    """The binary logarithm of how many documents' shingles fall into each of 2**bits places, counted over all documents.

    It only sets the order of tokens, in which any order gives the same result, so that places may be shared; its size
    doesn't follow the input.
    """
    cells, width = 1 << bits, 1 << min(bits, BLOCK_BITS)

    def counted(batches):
        total = np.zeros(cells, np.uint32)
        for x in batches:
            for u in _sets(n, x.column(0)):
                np.add.at(total, (u & np.uint64(cells - 1)).astype(np.int64), 1)
        blocks = total.reshape(-1, width)
        live = np.flatnonzero(blocks.any(axis=1))
        for i in range(0, len(live), 64):
            yield pa.RecordBatch.from_arrays([pa.array(live[i : i + 64], pa.int32()), pa.array([blocks[k].tobytes() for k in live[i : i + 64]], pa.binary())], names=["block", "counts"])

    def summed(batches):
        total: dict[int, np.ndarray] = {}
        for x in batches:
            for k, v in zip(x.column(0).to_pylist(), x.column(1)):
                total[k] = total.get(k, 0) + np.frombuffer(v.as_buffer(), np.uint32).astype(np.int64)
        for k, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.ceil(np.log2(v + 1)).astype(np.uint8).tobytes()], pa.binary())], names=["block", "classes"])

    found = docs.select("text").mapInArrow(tidy(counted), "block int, counts binary").repartition("block").mapInArrow(tidy(summed), "block int, classes binary")
    out = np.zeros((cells // width, width), np.uint8)
    for r in found.collect():
        out[r["block"]] = np.frombuffer(r["classes"], np.uint8)
    return out.ravel()


def prefix_length(n: int, percent: int, k: int) -> int:
    """Tokens of a set of n that stand first in any common order, of which every linked partner shares k (if they share k at all)."""
    return min(n, n - (percent * n + 99) // 100 + k)


def _combinations(keys: Column, k: int) -> Column:
    """Hashes of the combinations of k of an array's elements, in their order."""
    found = F.transform(keys, lambda x, i: F.struct(i.alias("at"), x.alias("h")))
    for _ in range(k - 1):
        later = lambda a: F.transform(F.slice(keys, a["at"] + 2, F.size(keys)), lambda x, i: F.struct((a["at"] + 1 + i).alias("at"), F.xxhash64(a["h"], x).alias("h")))
        found = F.flatten(F.transform(found, later))
    return F.transform(found, lambda a: a["h"])


def candidate_keys(met: DataFrame, percent: int, k: int, rare: int = RARE, most: int = MOST) -> DataFrame:
    """(key, item, n) under which every linked pair meets; n is a key's number of items.

    met: (key, item, df, n_tokens), the tokens of each item's prefix that others have too. A linked pair shares k tokens of the prefixes. If
    one of them is rare (df up to `rare`), the pair meets there. If not, all are frequent, and the pair meets in a combination of k
    frequent tokens. An item with more than `most` frequent tokens, or too small a set to share k, is dense: its
    combinations aren't made, and each of its frequent tokens is a key by itself, for whoever has it.
    """
    single = met.where(F.col("df") <= rare).select("key", "item", F.col("df").alias("n"))
    hot = met.where(F.col("df") > rare)
    per = hot.groupBy("item", "n_tokens").agg(F.count("*").alias("m"), F.sort_array(F.collect_list("key")).alias("keys"))
    dense = (F.col("m") > most) | (F.floor((percent * F.col("n_tokens") + 99) / 100) < k)
    per = written(per.withColumn("dense", dense), "hot_items")
    combined = per.where(~F.col("dense") & (F.col("m") >= k)).select("item", F.explode(_combinations(F.col("keys"), k)).alias("key"))
    combined = combined.join(combined.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key").select("key", "item", "n")
    kept = per.where("dense").select(F.explode("keys").alias("key")).distinct()
    alone = hot.join(kept, "key", "left_semi").select("key", "item", F.col("df").alias("n"))
    return single.unionByName(combined).unionByName(alone)


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, k: int = 2, rare: int = RARE, most: int = MOST, crossed: int = CROSSED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, n_shingles, component_id.

    Documents link if their sets of n-word shingles (A-Z lower-cased, words of non-space bytes) have a Jaccard similarity of
    percent/100 or more. Tokens (shingles) have one order, by counts over all documents, rarest first; an item's prefix is the part of
    its set, in this order, of which any linked partner shares k tokens. Prefix tokens are counted exactly; those of one item fall
    out, rare ones are keys, and of frequent ones combinations of k are (see `candidate_keys`). Pairs under a key are screened by
    sizes and by 128 sketch bits at 8 standard deviations (a linked pair is lost with a chance below 1e-9), and confirmed on their full sets.

    Null or blank texts have an empty set and link with nothing. Texts of fewer than n words count as one shingle. Equal sets are
    one item, so copies and repeated rows cost no comparison. Rows with a null id take part; component_id is the least id that
    isn't null. Repeated ids are rows of their own; no rows give no rows. Columns other than id and text are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    classes = docs.sparkSession.sparkContext.broadcast(frequency_classes(docs, n))

    def prefixes(batches):
        place = np.uint64(len(classes.value) - 1)
        for x in batches:
            keys, found, sketches = [], [], []
            for u in _sets(n, x.column(1)):
                keys.append(_set_key(u) if len(u) else None)
                sketches.append(sketch(u) if len(u) else (0, 0, 0))
                order = np.argsort(classes.value[(u & place).astype(np.int64)], kind="stable")
                found.append(u[order[: prefix_length(len(u), percent, k)]])
            flat = np.concatenate(found) if found else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(keys, pa.int64()), lists(as_long(flat), [len(c) for c in found], pa.int64()), *sketch_columns(sketches)], names=["doc_id", "item", "prefix", "size", "bits0", "bits1"])

    sig = written(docs.mapInArrow(tidy(prefixes), f"doc_id long, item long, prefix array<long>, {SKETCH}"), "prefixes")
    one = (F.first(c).alias(c) for c in ("size", "bits0", "bits1", "prefix"))
    items = written(sig.where("item is not null").groupBy("item").agg(F.min("doc_id").alias("low"), *one), "items")
    posted = items.select("item", F.col("size").cast("long").alias("n_tokens"), F.explode("prefix").alias("key"))
    df = posted.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    met = written(posted.join(df, "key"), "met_tokens")
    postings = written(candidate_keys(met, percent, k, rare, most), "postings")

    def full(batches):
        for x in batches:
            keys, elems = [], []
            for u in _sets(n, x.column(0)):
                if len(u):
                    keys.append(_set_key(u))
                    elems.append(u.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(elems, pa.binary())], names=["item", "elems"])

    def fetch(need: DataFrame) -> DataFrame:
        """The sets of items, from the texts of their first rows; rows that repeat an id bring a few sets that aren't asked for."""
        lows = items.join(need, "item").select("low")
        of = only_maybe(docs, "doc_id", lows).withColumns({"named": F.xxhash64("doc_id"), "content": F.xxhash64("text")})
        of = of.join(lows.select(F.xxhash64("low").alias("named")).distinct(), "named", "left_semi").dropDuplicates(["named", "content"])
        return written(of.select("text").mapInArrow(tidy(full), "item long, elems binary"), "sets")

    comp = link_components(
        postings, items.select("item", "size", "bits0", "bits1"), alike(percent, 100, sigmas=SIGMAS), fetch,
        lambda pairs, sets: confirmed(pairs, sets, percent, 100), lambda p, sets: in_cells(p, sets, percent, 100, sigmas=SIGMAS), paired=rare, crossed=crossed,
    )
    whole = items.select("item", "low").join(comp, items["item"] == comp["node"], "left").select("item", "low", F.coalesce("component", "item").alias("component"))
    least = whole.groupBy("component").agg(F.min("low").alias("component_id"))
    named = whole.join(least, "component").select("item", "component_id")
    out = sig.select("doc_id", F.col("size").cast("long").alias("n_shingles"), "item").join(named, "item", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents by 4-word shingles at a Jaccard similarity of 0.85."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=4, percent=85)


QUERIES = {"op11_ngram_join": op11_ngram_join}
ORACLE_SQL: dict[str, str] = {}
