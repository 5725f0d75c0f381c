"""5. Best-fit packing: hierarchical residual packing of token sequences."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Slice, held_by, slices, spans_hash, tidy, trim, written

END = 2
ROUND_ROWS = 8192  # items that a task of the first round packs, about
MEMBERS = "array<struct<doc_id: long, piece: int, start: long, length: long, ids_crc32: long>>"
_tokenizers: dict[str, "ChunkTokenizer"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class ChunkTokenizer:
    """Token ids of texts, tokenizing each distinct chunk once.

    A chunk starts at a space or newline behind a character that is no white space. There the
    tokenizer's pattern always starts a new pre-token, so a text's ids are its chunks' ids.
    """

    MOST, RECENT = 1_500_000, 1 << 15  # chunks kept (about 60 bytes each, three times that while they are merged), and those of them that are sorted in at each slice

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        none = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.known, self.recent = none, none
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each chunk's ids start, -1 for a new one, and how many they are."""
        at, size = np.full(len(h), -1), np.zeros(len(h), np.int64)
        for hashes, a, n in (self.known, self.recent):
            if len(hashes):
                k = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                hit = hashes[k] == h
                at[hit], size[hit] = a[k[hit]], n[k[hit]]
        return at, size

    def add(self, h: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        def merged(x, y):
            both = [np.concatenate(c) for c in zip(x, y)]
            order = np.argsort(both[0], kind="stable")
            return tuple(c[order] for c in both)

        self.recent = merged(self.recent, (h, self.used + np.cumsum(size) - size, size))
        if len(self.recent[0]) > self.RECENT:
            self.known, self.recent = merged(self.known, self.recent), tuple(c[:0] for c in self.recent)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.append(self.ids, np.zeros(len(self.ids), np.uint32))
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    @staticmethod
    def starts(s: Slice) -> np.ndarray:
        d = s.data
        cut = np.zeros(len(d), bool)
        cut[1:] = (d[1:] == 32) | (d[1:] == 10)
        i = np.flatnonzero(cut)
        p = d[i - 1]
        blank = ((p >= 9) & (p <= 13)) | ((p >= 28) & (p <= 32))
        # behind a byte of a longer character, look whether that is white space
        high = np.flatnonzero(p >= 128)
        q, r = d[np.maximum(i[high] - 2, 0)], d[np.maximum(i[high] - 3, 0)]
        blank[high] = (q == 0xC2) | ((r == 0xE1) & (q == 0x9A)) | ((r == 0xE2) & ((q == 0x80) | (q == 0x81))) | ((r == 0xE3) & (q == 0x80))
        cut[i[blank]] = False
        lengths = np.diff(s.offsets)
        cut[s.offsets[:-1][lengths > 0]] = True
        return np.flatnonzero(cut)

    def of(self, s: Slice) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the slice's texts, and where each text's ids start."""
        if not len(s.data):
            return self.ids[:0], np.zeros(s.n + 1, np.int64)
        a = self.starts(s)
        b = np.append(a[1:], len(s.data))
        h, first, inverse = np.unique(spans_hash(s.sums(), a, b), return_index=True, return_inverse=True)
        at, size = self.find(h)
        new = np.flatnonzero(at < 0)
        if len(new):
            if len(self.known[0]) + len(self.recent[0]) + len(new) > self.MOST:
                self.forget()
                new = np.arange(len(h))
            raw = s.data.tobytes()
            found, own = [], np.zeros(len(new), np.int64)
            for k in range(0, len(new), 2000):  # what the tokenizer returns is large
                got = [e.ids for e in self.tokenizer.encode_batch_fast([raw[a[i] : b[i]].decode() for i in first[new[k : k + 2000]]], add_special_tokens=False)]
                own[k : k + 2000] = [len(g) for g in got]
                found.append(np.fromiter((x for g in got for x in g), np.uint32, int(own[k : k + 2000].sum())))
            self.add(h[new], own, np.concatenate(found))
            at, size = self.find(h)
        at, size = at[inverse], size[inverse]
        ends = np.cumsum(size)
        ids = self.ids[np.repeat(at - (ends - size), size) + np.arange(ends[-1])]
        before = np.append(0, ends)
        return ids, before[np.searchsorted(a, s.offsets)]


def forget_tokenizers() -> None:
    if _tokenizers:
        _tokenizers.clear()
        trim()


held_by[__name__] = forget_tokenizers


def tokenizer(path: str) -> ChunkTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = ChunkTokenizer(path)
    return _tokenizers[path]


def pieces(column: pa.Array, path: str, capacity: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, piece, start, length, crc32) of every text's ids, the end token included."""
    tok = tokenizer(path)
    for s in slices(column):
        ids, at = tok.of(s)
        for i in range(s.n):
            own = np.append(ids[at[i] : at[i + 1]], np.uint32(END)).astype("<u4")
            n = len(own)
            cut = n % capacity or capacity
            for k, (p, q) in enumerate(zip([0, *range(cut, n, capacity)], [*range(cut, n + 1, capacity)])):
                yield s.first + i, k, p, q - p, zlib.crc32(own[p:q].data)


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers: largest first, each into the fullest bin that takes it."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by the room they have left
    some = 0  # bit r is set if a bin has room r
    bins: list[list[int]] = []
    for i in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[i])
        fits = some >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                some ^= 1 << r
            bins[b].append(i)
        else:
            r, b = capacity, len(bins)
            bins.append([i])
        room[r - n].append(b)
        some |= 1 << (r - n)
    return bins


def _packed(capacity: int, full: int, last: bool, most: int):
    def pack(batches):
        from pyspark import TaskContext

        part, n, sizes, members = TaskContext.get().partitionId(), 0, [], []

        def flush(carried):
            """Bins of the items held; of the underfull ones, the `carried` emptiest stay as items for the next batch."""
            nonlocal n, sizes, members
            bins = [(sum(sizes[i] for i in b), [m for i in b for m in members[i]]) for b in best_fit(np.array(sizes, np.int64), capacity)] if sizes else []
            bins.sort(key=lambda b: b[0])
            stay = min(carried, sum(size < full for size, _ in bins))
            sizes, members = [b[0] for b in bins[:stay]], [b[1] for b in bins[:stay]]
            for size, own in bins[stay:]:
                yield last or size >= full, part << 32 | n, size, own
                n += 1

        def rows(found):
            found = list(found)
            return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.bool_()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64()), pa.array([f[3] for f in found], pa.list_(pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])))], names=["done", "bin", "size", "members"])

        for x in batches:
            sizes += x.column(0).to_pylist()
            members += x.column(1).to_pylist()
            if len(sizes) >= 2 * most:
                yield rows(flush(most))
        yield rows(flush(0))

    return pack


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = 1024, fan_in: int = 8, nearly: float = 0.999, most: int = 100_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A text's ids (null: none) and the end id 2 are one piece; longer ones are cut into pieces of
    `capacity` ids, the first of which may be shorter. Pieces go into sequences of at most `capacity` ids.
    Each partition of about ROUND_ROWS pieces packs them best-fit and emits the bins filled to `nearly` of the
    capacity; underfull bins go on as single items to `fan_in` times fewer partitions, until one
    is left. A task packs twice `most` items at a time, and passes on up to `most` underfull bins to the next
    batch, so its memory is bounded; as full bins leave in every round, the last partition gets a small share of the items. Repeated and null ids are
    rows of their own; an empty table gives no row.
    """
    path = path or default_path()
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    whole, full = capacity, int(np.ceil(capacity * nearly))

    def cut(batches):
        for x in batches:
            got = list(pieces(x.column(1), path, capacity))
            cols = list(zip(*got)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([x.column(0).take(pa.array(cols[0], pa.int64())), *(pa.array(c, t) for c, t in zip(cols[1:], (pa.int32(), pa.int64(), pa.int64(), pa.int64())))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    found = written(docs.mapInArrow(tidy(cut), "doc_id long, piece int, start long, length long, ids_crc32 long"), "pieces")
    member = F.struct("doc_id", "piece", "start", "length", "ids_crc32")
    done = [found.where(F.col("length") == whole).select(F.lit(0).alias("round"), F.monotonically_increasing_id().alias("bin"), F.array(member).alias("members"))]
    items = found.where(F.col("length") < whole).select(F.col("length").alias("size"), F.array(member).alias("members"))
    n, k = max(1, -(-items.count() // ROUND_ROWS)), 0
    while True:
        k += 1
        out = written(items.repartition(n).mapInArrow(tidy(_packed(capacity, full, n == 1, most)), f"done boolean, bin long, size long, members {MEMBERS}"), f"bins{k}")
        done.append(out.where("done").select(F.lit(k).alias("round"), "bin", "members"))
        items = out.where("not done").select("size", "members")
        if n == 1:
            break
        n = max(1, n // fan_in)
    bins = done[0]
    for d in done[1:]:
        bins = bins.unionByName(d)
    # a member's offset is the length of those before it
    at = F.transform(F.col("members"), lambda m, i: F.struct(m.alias("m"), F.aggregate(F.slice("members", 1, i), F.lit(0).cast("long"), lambda s, y: s + y["length"]).alias("offset")))
    rows = bins.select((F.shiftleft(F.col("round").cast("long"), 56) + F.col("bin")).alias("sequence_id"), F.explode(at).alias("x"))
    return rows.select("x.m.doc_id", "x.m.piece", "x.m.start", "x.m.length", "x.m.ids_crc32", "sequence_id", "x.offset")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op5_packing": op5_packing}
ORACLE_SQL: dict[str, str] = {}
