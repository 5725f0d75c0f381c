"""6. Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ODD, as_long, bounded_batches, mix, slices, word_hashes, tidy

SEED = 3
MATCH, MISMATCH, GAP = 2, -1, -1
COMMON = 8
BLOCK_BYTES = 8 << 20  # benchmark text that a task holds at once; more of it is taken in blocks


def grams(words: np.ndarray, n: int = SEED) -> np.ndarray:
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out += words[k : len(words) - n + 1 + k] * ODD[k]
    return mix(out)


def align(item: np.ndarray, passage: np.ndarray) -> tuple[float, int, int]:
    """Smith-Waterman score of word sequences as a share of the item's full score, and the passage's range."""
    m = len(passage)
    j = np.arange(m + 1)
    h, begin = np.zeros(m + 1), j.copy()
    best, at = 0.0, (0, 0)
    for w in item:
        diagonal = h[:-1] + np.where(passage == w, MATCH, MISMATCH)
        up = h[1:] + GAP
        take = diagonal >= up
        cand = np.append(0.0, np.maximum(np.where(take, diagonal, up), 0))
        origin = np.append(0, np.where(take, begin[:-1], begin[1:]))
        origin = np.where(cand > 0, origin, j)
        # a gap in the item: the best cell to the left, less its distance
        run = cand - GAP * j
        far = np.maximum.accumulate(run)
        source = np.maximum.accumulate(np.where(run == far, j, 0))
        h = far + GAP * j
        begin = np.where(h > 0, origin[source], j)
        k = int(h.argmax())
        if h[k] > best:
            best, at = float(h[k]), (int(begin[k]), k)
    return best / (MATCH * len(item)), *at


class Seeds:
    """A block of benchmark items: word hashes, and their seeds sorted by hash."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.items = [(i, w) for i, w in items if len(w)]
        # items shorter than a seed are seeded by their first word
        rows = [(g, k, q) for k, (_, w) in enumerate(self.items) for q, g in enumerate(grams(w) if len(w) >= SEED else w[:1])]
        self.short = np.unique(np.array([r[0] for r in rows if len(self.items[r[1]][1]) < SEED], np.uint64))
        self.rows = [r for r in rows if len(self.items[r[1]][1]) >= SEED] + [r for r in rows if len(self.items[r[1]][1]) < SEED]
        self.keep(np.ones(len(self.rows), bool))

    def keep(self, which: np.ndarray) -> None:
        rows = sorted((r for r, w in zip(self.rows, which) if w), key=lambda r: r[0])
        self.hash = np.array([r[0] for r in rows], np.uint64)
        self.item, self.q = (np.array([r[c] for r in rows], np.int64) for c in (1, 2))
        self.unique, self.first = np.unique(self.hash, return_index=True)
        self.last = np.append(self.first[1:], len(rows))
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.unique >> np.uint64(44)).astype(np.int64)] = True

    def hits(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in the words a seed stands, and the number of its hash; seeds don't cross texts."""
        found = []
        for h, n in ((grams(words), SEED), (words, 1)) if len(self.short) else ((grams(words), SEED),):
            at = np.flatnonzero(self.filter[(h >> np.uint64(44)).astype(np.int64)])
            k = np.searchsorted(self.unique, h[at])
            ok = k < len(self.unique)
            ok[ok] = self.unique[k[ok]] == h[at[ok]]
            at, k = at[ok], k[ok]
            if n == 1:
                ok = np.isin(h[at], self.short)
                at, k = at[ok], k[ok]
            row = np.searchsorted(first, at, side="right") - 1
            ok = at + n <= first[row + 1]
            found.append((at[ok], k[ok]))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def find(seeds: Seeds, column: pa.Array, least: float) -> Iterator[tuple[int, int, float, int, int, int]]:
    """(row, item_id, score, first word, end word, seeds met) of each text and item aligned at `least` or more."""
    for s in slices(column):
        words, first = word_hashes(s)
        at, k = seeds.hits(words, first)
        if not len(at):
            continue
        times = seeds.last[k] - seeds.first[k]
        at, each = np.repeat(at, times), np.repeat(seeds.first[k], times) + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        item, row = seeds.item[each], np.searchsorted(first, at, side="right") - 1
        begin = at - seeds.q[each]
        order = np.lexsort((begin, item, row))
        item, row, begin = item[order], row[order], begin[order]
        length = np.array([len(w) for _, w in seeds.items])[item]
        new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (begin[1:] - begin[:-1] > length[1:] // 2 + 1)))
        best: dict[tuple[int, int], tuple] = {}
        for a, b in zip(new, np.append(new[1:], len(row))):
            r, i = int(row[a]), int(item[a])
            own = seeds.items[i][1]
            pad = len(own) // 2 + 1
            lo, hi = max(int(begin[a]) - pad, first[r]), min(int(begin[b - 1]) + len(own) + pad, first[r + 1])
            score, p, q = align(own, words[lo:hi])
            was = best.get((r, i), (0.0, 0, 0, 0))
            if score >= (least if len(own) >= SEED else 1):
                here = (score, int(lo - first[r]) + p, int(lo - first[r]) + q, was[3] + int(b - a))
                best[r, i] = here if score > was[0] else (*was[:3], here[3])
        for (r, i), (score, p, q, n) in best.items():
            yield s.first + r, seeds.items[i][0], score, p, q, n


def blocks_of(benchmark: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> Iterator:
    """Broadcast blocks of items with their rare seeds: the benchmark's size is checked, and a larger one is taken in more blocks.

    A seed is rare if no more documents hold it than COMMON times what the item's median seed has; so half of
    an item's seeds stay at least, and a leak's own copies make none common. Counts cover all documents.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    items = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null")
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, math.ceil(size / BLOCK_BYTES))
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()
        got = []
        for s in slices(pa.array([r["t"] for r in rows], pa.string())):
            w, first = word_hashes(s)
            got += [(rows[s.first + j]["i"], w[first[j] : first[j + 1]]) for j in range(s.n)]
        seeds = Seeds(got)
        if not seeds.rows:
            continue
        held = spark.sparkContext.broadcast(seeds)

        def count(batches, held=held):
            seeds = held.value
            total = np.zeros(len(seeds.unique), np.int64)
            for x in batches:
                for s in slices(x.column(0)):
                    words, first = word_hashes(s)
                    at, k = seeds.hits(words, first)
                    row = np.searchsorted(first, at, side="right") - 1
                    total += np.bincount(np.unique(row * len(total) + k) % max(1, len(total)), minlength=len(total))
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(as_long(seeds.unique[some])), pa.array(total[some])], names=["h", "n"])

        df = {r["h"]: r["n"] for r in docs.select("text").mapInArrow(tidy(count), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).collect()}
        freq = np.array([df.get(int(np.uint64(r[0]).view(np.int64)), 0) for r in seeds.rows])
        item = np.array([r[1] for r in seeds.rows])
        rare = np.zeros(len(freq), bool)
        for i in np.unique(item):
            own = np.flatnonzero(item == i)
            rare[own] = freq[own] <= COMMON * (np.median(freq[own]) + 1)
        seeds.keep(rare)
        yield spark.sparkContext.broadcast(seeds)


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, score, first_word, end_word, seeds): documents that hold a copy of a test item, edited ones too.

    Words are runs of non-space bytes, A-Z lower-cased. Documents join items on rare seeds of SEED words;
    the passage around the seeds is aligned word by word (match 2, mismatch and gap -1), and score is
    the share of the item's full score; pairs below `least` are left (items of fewer than SEED words need all of it). Null and blank texts
    and items match nothing. Repeated rows and ids give a row for each.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, item_id long, score double, first_word int, end_word int, seeds int"
    out = None
    for held in blocks_of(benchmark, docs, item_col, item_text):

        def run(batches, held=held):
            for x in batches:
                got = list(zip(*find(held.value, x.column(1), least))) or [[]] * 6
                yield pa.RecordBatch.from_arrays([x.column(0).take(pa.array(got[0], pa.int64())), *(pa.array(c, t) for c, t in zip(got[1:], (pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32())))], names=["doc_id", "item_id", "score", "first_word", "end_word", "seeds"])

        part = docs.mapInArrow(tidy(run), schema)
        out = part if out is None else out.union(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.5, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs whose text holds no copy of a test item, all columns as they are."""
    texts, at = docs.select(F.col(text_col).cast("string").alias("text")), docs.columns.index(text_col)
    for held in blocks_of(benchmark, texts, item_col, item_text):

        def run(batches, held=held):
            for x in batches:
                clean = np.ones(x.num_rows, bool)
                clean[[r[0] for r in find(held.value, x.column(at), least)]] = False
                if clean.any():
                    yield x.filter(pa.array(clean))

        docs = docs.mapInArrow(tidy(run), docs.schema)
    return docs


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op6_decontamination": op6_decontamination}
ORACLE_SQL: dict[str, str] = {}
