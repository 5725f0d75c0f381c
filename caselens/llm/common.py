"""What the text operators share: shared-folder tables, byte-level words, components of links.

Texts are handled as the UTF-8 bytes of Arrow columns, in slices of about SLICE bytes, so that a
task's memory follows the slice (or the longest single text) and not the partition.
"""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE = 1 << 18
BATCH_BYTES = "4m"
KEPT = 1 << 19  # powers that a worker keeps between tasks; longer slices have their own for as long as they last
M64 = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)

_rng = np.random.default_rng(20240607)
BYTE = _rng.integers(1, M64, 256, dtype=np.uint64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOW_BYTE = BYTE[LOWER]
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
ODD = _rng.integers(1, M64, 64, dtype=np.uint64) | np.uint64(1)

#: What to call, by module, so that a worker forgets what the module's tasks keep for one another.
held_by: dict[str, Callable] = {}
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or one of our own where it is unset and the master is local (tests)."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(folder)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches by bytes, where the session doesn't say otherwise: ten thousand long texts are too many for a worker."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def trim() -> None:
    """Gives freed memory back: a worker lives on for other tasks, idle ones beside it."""
    pa.default_memory_pool().release_unused()
    call = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if call:
        call(0)


def leave_to(module: str) -> None:
    """Frees what other modules' tasks have kept in this worker."""
    for name, forget in held_by.items():
        if name != module:
            forget()


def tidy(f: Callable) -> Callable:
    """f, before whose batches a worker forgets other operators' caches, and after which it gives freed memory back."""
    module = f.__module__

    def run(batches):
        leave_to(module)
        yield from f(batches)
        trim()

    return run


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse mod 2**64 for i < n."""
    if len(_powers[0]) >= n:
        return _powers[0], _powers[1]
    made = []
    for b in (BASE, BASE_INV):
        step = np.full(max(n, min(2 * n, KEPT)), b, np.uint64)
        step[0] = 1
        made.append(np.multiply.accumulate(step))
    if len(made[0]) <= KEPT:
        _powers[:] = made
    return made[0], made[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(32))


class Slice:
    """Some rows' texts: data (bytes one after another), ends of rows, and the rows' range in the batch."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first, self.n = data, offsets, first, len(offsets) - 1

    def sums(self, lower: bool = False) -> np.ndarray:
        """Prefix sums of the polynomial hash; hash of [a, b) is (s[b] - s[a]) * inverse power of a."""
        n = len(self.data)
        out = np.zeros(n + 1, np.uint64)
        np.cumsum((LOW_BYTE if lower else BYTE)[self.data] * powers(n)[0][:n], out=out[1:])
        return out

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words, and for each row the number of the first word."""
        n = len(self.data)
        if not n:
            z = np.zeros(0, np.int64)
            return z, z, np.zeros(self.n + 1, np.int64)
        solid = ~SPACE[self.data]
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        start = solid.copy()
        start[1:] &= ~solid[:-1] | edge[1:-1]
        end = solid.copy()
        end[:-1] &= ~solid[1:] | edge[1:-1]
        a, b = np.flatnonzero(start), np.flatnonzero(end) + 1
        return a, b, np.searchsorted(a, self.offsets)


def slices(column: pa.Array, most: int = SLICE) -> Iterator[Slice]:
    """The column's texts (null: empty) in slices of about `most` bytes, one text at least."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"").cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1))
        yield Slice(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], i)
        i = j


def spans_hash(sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges [a, b), which don't depend on where they stand."""
    inverse = powers(len(sums))[1]
    return mix((sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64))


def word_hashes(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, A-Z lower-cased, and for each row the number of its first word."""
    a, b, first = s.words()
    return spans_hash(s.sums(lower=True), a, b), first


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the sequences of n words; with fewer words, of the whole sequence; of no word, none."""
    if not len(words):
        return words
    m = min(n, len(words))
    out = np.full(len(words) - m + 1, m, np.uint64)
    for k in range(m):
        out += words[k : len(words) - m + 1 + k] * ODD[k]
    return mix(out)


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def only_maybe(df: DataFrame, key: str, ids: DataFrame, bits: int = 23) -> DataFrame:
    """Rows whose key may be in ids (one column of the key's type): all that are, and a few others.

    ids become a bitmap of 2**bits hash places, broadcast as words of 64 places: 2**(bits - 6) rows at most, whatever the
    input. With many ids it only lets more others through, and whoever uses it must join with the ids afterwards.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits))
    words = ids.select(place(ids.columns[0]).alias("p")).groupBy(F.shiftright("p", 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("_bits"))
    placed = df.withColumn("_place", place(key))
    met = placed.join(F.broadcast(words), F.shiftright("_place", 6) == F.col("_word"))
    return met.where("bit_get(_bits, cast(_place & 63 as int)) = 1").select(df.columns)


def _stars(e: DataFrame) -> bool:
    """Whether each node of the edges (u, v) has one v at most, and none if it is a v itself."""
    ends = e.select(F.col("u").alias("n"), F.lit(1).alias("below")).union(e.select("v", F.lit(0)))
    return ends.groupBy("n").agg(F.sum("below").alias("s"), F.count("*").alias("c")).where("s > 1 or s > 0 and s < c").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b); component is the smallest node reachable.

    Alternates large-star and small-star steps until only stars are left; all steps are joins and
    aggregations with partial sums, so a node with very many edges is no group in one task.
    """
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not _stars(e):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        e = written(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
