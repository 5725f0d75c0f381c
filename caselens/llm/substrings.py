"""4. Suffix-array dedup: long byte strings that occur more than once, by blockwise suffix sorting.

Every window of `length` bytes holds an anchor: the least of its k-gram hashes, leftmost. Equal
windows have equal anchors at equal places, so the windows around one anchor k-gram form a
suffix bucket, and only windows of one bucket can be equal. A run of windows with the same
anchor is a context. Contexts that occur twice are repeated as they are (counted by hash); the
other contexts of a bucket that has several are sorted, bucket by bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Slice, as_long, mix, only_maybe, slices, spans_hash, written, tidy

COVER = 64  # the difference cover's modulus
GRAM = 50
SEGMENT = 1 << 20  # longer texts are read in segments that overlap by a window
BUCKET = 4096  # contexts of a bucket; larger ones are split by what stands around the anchor
LARGE = 8192  # contexts sorted together after that
RANGES = 8  # into which the places of an anchor in its windows are divided at a time


@cache
def difference_cover(v: int) -> tuple[int, ...]:
    """A small set of residues whose differences give every residue mod v (greedy)."""
    chosen, have = [0, 1], {0, 1, v - 1}
    while len(have) < v:
        gain = lambda x: len({d % v for y in chosen for d in (x - y, y - x)} - have)
        x = max((y for y in range(v) if y not in chosen), key=gain)
        have |= {d % v for y in chosen for d in (x - y, y - x)}
        chosen.append(x)
    return tuple(sorted(chosen))


def contexts(s: Slice, length: int, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """row, anchor, first and last window start (from the row's start), anchor hash, context hash."""
    n, w = len(s.data), length - gram + 1
    if n < length:
        z = np.zeros(0, np.int64)
        return z, z, z, z, z.view(np.uint64), z.view(np.uint64)
    sums = s.sums()
    i = np.arange(n - gram + 1)
    g = spans_hash(sums, i, i + gram)
    key = (g & ~np.uint64((1 << 24) - 1)) | i.astype(np.uint64)
    m = -len(key) % w
    blocks = np.concatenate([key, np.full(m, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    start = np.arange(n - length + 1)
    row = np.searchsorted(s.offsets, start, side="right") - 1
    ok = start + length <= s.offsets[row + 1]
    start, row = start[ok], row[ok]
    at = (np.minimum(right[start], left[start + w - 1]) & np.uint64((1 << 24) - 1)).astype(np.int64)
    new = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.zeros(0, np.int64)
    first, last = start[new], start[np.append(new[1:], len(start)) - 1] if len(at) else start
    at, row = at[new], row[new]
    whole = mix(spans_hash(sums, first, last + length) + (at - first).astype(np.uint64))
    base = s.offsets[row]
    return row, at - base, first - base, last - base, g[at], whole


def segments(column: pa.Array, length: int) -> Iterator[tuple[Slice, int]]:
    """Slices with the place where their first text starts; a longer text comes in overlapping parts."""
    for s in slices(column):
        if len(s.data) <= SEGMENT:
            yield s, 0
            continue
        for x in range(0, len(s.data), SEGMENT):
            part = s.data[x : x + SEGMENT + length - 1]
            yield Slice(part, np.array([0, len(part)]), s.first), x


def refined(text: np.ndarray, at: np.ndarray, rank: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the suffixes at `at`, ordered by `rank` and then by their first `depth` bytes; ties share one."""
    words = np.ndarray((len(text) - 7,), ">u8", text, strides=(1,))
    rank = rank.copy()
    live = np.arange(len(at))
    for d in range(0, depth, 8):
        if not len(live):
            break
        key = words[at[live] + d].astype(np.uint64)
        order = np.lexsort((key, rank[live]))
        live, key = live[order], key[order]
        r = rank[live]
        outer = np.append(True, r[1:] != r[:-1])
        inner = outer | np.append(True, key[1:] != key[:-1])
        place = np.arange(len(live))
        rank[live] = r + (np.maximum.accumulate(np.where(inner, place, 0)) - np.maximum.accumulate(np.where(outer, place, 0)))
        alone = inner & np.append(inner[1:], True)
        live = live[~alone]
    return rank


def ranked(x: np.ndarray) -> np.ndarray:
    """For each value the number of smaller ones: ties share a rank, as refined() wants it."""
    order = np.argsort(x, kind="stable")
    v = x[order]
    new = np.append(True, v[1:] != v[:-1])
    out = np.empty(len(x), np.int64)
    out[order] = np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))
    return out


def sort_buckets(bucket: np.ndarray, lead: np.ndarray, count: np.ndarray, texts: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rank of every window among its bucket's suffixes, equal windows sharing one, with its context and start.

    bucket: number of each context's bucket; lead: bytes before its anchor; count: its windows.
    The first COVER bytes are compared directly. Ties, which are long, are resolved by the ranks
    of the next suffix in the difference cover sample, computed beforehand over length - COVER
    bytes, and by the last COVER bytes. Contexts are laid out with their anchors at multiples of COVER,
    so the windows of a bucket that are the same way before the anchor share their residue.
    """
    v = COVER
    sizes = np.array([len(t) for t in texts])
    room = (sizes + v) // v * v + v
    base = np.cumsum(room) - room + (-lead % v)
    text = np.zeros(int(room.sum()) + v, np.uint8)
    for b, t in zip(base, texts):
        text[b : b + len(t)] = t

    def spread(n):  # context and running number for n[i] items of each context
        c = np.repeat(np.arange(len(n)), n)
        return c, np.arange(len(c)) - np.repeat(np.cumsum(n) - n, n)

    cover = np.zeros(v, bool)
    cover[list(difference_cover(v))] = True
    c, k = spread(np.maximum(sizes - (length - v) + 1, 0))
    at = base[c] + k
    pick = cover[at % v]
    c, k, at = c[pick], k[pick], at[pick]
    sample = np.zeros(len(text), np.int32)
    place = lambda c, k: bucket[c] * (1 << 20) + (k - lead[c] + (1 << 19))  # noqa: E731  which suffixes can meet
    sample[at] = refined(text, at, ranked(place(c, k)), length - v)

    ahead = np.array([next(d for d in range(v) if cover[(r + d) % v]) for r in range(v)])
    c, k = spread(count)
    at = base[c] + k
    rank = refined(text, at, ranked(place(c, k)), v)
    pair = np.lexsort((sample[at + ahead[at % v]], rank))
    r, q = rank[pair], sample[(at + ahead[at % v])[pair]]
    outer = np.append(True, r[1:] != r[:-1])
    inner = outer | np.append(True, q[1:] != q[:-1])
    i = np.arange(len(pair))
    tied = np.empty(len(pair), np.int64)
    tied[pair] = r + np.maximum.accumulate(np.where(inner, i, 0)) - np.maximum.accumulate(np.where(outer, i, 0))
    # only what still ties needs its end compared
    many = np.bincount(tied, minlength=len(tied))[tied] > 1 if len(tied) else np.zeros(0, bool)
    end = refined(text, at[many] + length - v, ranked(tied[many]), v)
    out = np.full(len(tied), -1)
    out[many] = end
    return out, c, k


def _repeated(length: int):
    """Per partition sorted by bucket: ranges of repeated windows, and for split buckets all window hashes."""

    def work(batches):
        held: list[tuple] = []
        for x in batches:
            held += zip(*(x.column(i).to_pylist() for i in range(7)))
            if sum(len(h[5]) for h in held) > 2 << 20:
                cut = max((i for i in range(1, len(held)) if held[i][:2] != held[i - 1][:2]), default=0)
                if cut:
                    yield from blocks(held[:cut])
                    held = held[cut:]
        if held:
            yield from blocks(held)

    def blocks(rows):
        i = 0
        while i < len(rows):  # one block of whole buckets at a time
            j, size = i, 0
            while j < len(rows) and (size < 2 << 20 or rows[j][:2] == rows[j - 1][:2]):
                size, j = size + len(rows[j][5]), j + 1
            yield of(rows[i:j])
            i = j

    def of(rows):
        rows = list({r[:3]: r for r in rows}.values())  # a context once
        ids = {k: i for i, k in enumerate(dict.fromkeys(r[:2] for r in rows))}
        texts = [np.frombuffer(r[5], np.uint8) for r in rows]
        ch = np.array([r[2] for r in rows], np.int64)
        split = np.array([r[1] >= 0 for r in rows])
        rank, c, k = sort_buckets(np.array([ids[r[:2]] for r in rows]), np.array([r[3] for r in rows]), np.array([r[4] for r in rows]), texts, length)
        same = np.bincount(rank[rank >= 0], minlength=len(rank) + 1)[rank] > 1
        same &= rank >= 0
        # runs of repeated windows
        edge = same & ~np.append(False, same[:-1] & (c[1:] == c[:-1]))
        stop = same & ~np.append(same[1:] & (c[1:] == c[:-1]), False)
        a, b = np.flatnonzero(edge), np.flatnonzero(stop)
        k += np.array([r[6] for r in rows])[c]
        out = [ch[c[a]], k[a], k[b], np.full(len(a), None, object)]
        hot = np.flatnonzero(split[c])
        if len(hot):
            one = hot[np.unique(np.where(rank[hot] >= 0, rank[hot], -1 - hot), return_index=True)[1]]
            bytes_ = np.concatenate(texts)
            s = Slice(bytes_, np.append(0, np.cumsum([len(t) for t in texts])), 0)
            at = s.offsets[c[one]] + k[one] - np.array([r[6] for r in rows])[c[one]]
            h = as_long(spans_hash(s.sums(), at, at + length))
            out = [np.concatenate(z) for z in zip(out, (ch[c[one]], k[one], k[one], h.astype(object)))]
        return pa.RecordBatch.from_arrays([pa.array(z, t) for z, t in zip(out, (pa.int64(), pa.int32(), pa.int32(), pa.int64()))], names=["ch", "first", "last", "window"])

    return work


def _narrowed(length: int):
    """Each context as up to RANGES ones: by where in its windows the anchor stands, and by the bytes that all windows of such a range hold.

    Equal windows have their anchor at one place and hold equal bytes, so they stay in one bucket; contexts that only
    share the bytes near their anchor part.
    """

    def work(batches):
        for x in batches:
            out: list[tuple] = []
            for bucket, ch, lead, n, bytes_, skip, lo, hi in zip(*(c.to_pylist() for c in x.columns)):
                edges = [lo + (hi + 1 - lo) * i // RANGES for i in range(RANGES + 1)]
                for p, q in zip(edges, edges[1:]):
                    first, last = max(0, lead - q + 1), min(n - 1, lead - p)
                    if p < q and first <= last:
                        core = bytes_[lead - p : lead - q + 1 + length]
                        own = hashlib.blake2b(core, digest_size=8, salt=bucket.to_bytes(8, "little", signed=True), person=p.to_bytes(4, "little"))
                        out.append((int.from_bytes(own.digest(), "little", signed=True), ch, lead - first, last - first + 1, bytes_[first : last + length], skip + first, p, q - 1))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(_TYPES)], names=_NAMES)

    return work


CONTEXT = "bucket long, ch long, lead int, n int, bytes binary, skip int, lo int, hi int"
_NAMES = [c.split()[0] for c in CONTEXT.split(", ")]
_TYPES = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.int32())


def _cut(length: int):
    """The contexts' bytes, from (text, list of contexts)."""

    def work(batches):
        for x in batches:
            for i in range(x.num_rows):
                raw, c = x.column(0)[i].as_py().encode(), x.column(1)[i].as_py()
                cols = [[y["bucket"] for y in c], [y["ch"] for y in c], [y["at"] - y["first"] for y in c], [y["last"] - y["first"] + 1 for y in c], [raw[y["first"] : y["last"] + length] for y in c], [0] * len(c), [0] * len(c), [length - GRAM] * len(c)]
                yield pa.RecordBatch.from_arrays([pa.array(z, t) for z, t in zip(cols, _TYPES)], names=_NAMES)

    return work


def repeated_ranges(texts: DataFrame, length: int) -> DataFrame:
    """(tk, a, b): byte ranges [a, b) of the text named tk that repeated windows cover.

    texts: (tk, text), one row for each occurrence of a text.
    """

    def find(batches):
        for x in batches:
            for s, skip in segments(x.column(1), length):
                row, at, first, last, g, whole = contexts(s, length)
                yield pa.RecordBatch.from_arrays([x.column(0).take(pa.array(row + s.first)), *(pa.array(z + skip, pa.int32()) for z in (at, first, last)), pa.array(as_long(g)), pa.array(as_long(whole))], names=["tk", "at", "first", "last", "bucket", "ch"])

    found = written(texts.mapInArrow(tidy(find), "tk long, at int, first int, last int, bucket long, ch long"), "contexts")
    distinct = written(found.groupBy("ch").agg(F.count("*").alias("n"), F.first("bucket").alias("bucket"), F.min(F.struct("tk", "at", "first", "last")).alias("x")).select("ch", "n", "bucket", "x.*"), "distinct")
    twice = found.join(distinct.where("n > 1").select("ch"), "ch", "left_semi").select("tk", F.col("first").alias("a"), (F.col("last") + length).alias("b")).distinct()

    several = distinct.groupBy("bucket").agg(F.count("*").alias("m"), F.min("n").alias("rarest")).where("m > 1 and rarest = 1")
    asked = written(distinct.join(several, "bucket").select("tk", "bucket", "ch", "at", "first", "last", (F.col("m") > BUCKET).alias("hot")), "asked")

    def rows_of(some):
        lists = some.groupBy("tk").agg(F.collect_list(F.struct("bucket", "ch", "at", "first", "last")).alias("c"))
        return only_maybe(texts, "tk", some.select("tk").distinct()).dropDuplicates(["tk"]).join(lists, "tk").select("text", "c").mapInArrow(tidy(_cut(length)), CONTEXT)

    rows = rows_of(asked.where("not hot")).withColumn("part", F.lit(-1).cast("long"))
    if not asked.where("hot").isEmpty():
        hot, width = rows_of(asked.where("hot")), length - GRAM + 1
        while True:
            hot, width = written(hot.mapInArrow(tidy(_narrowed(length)), CONTEXT), "narrowed"), -(-width // RANGES)
            large = hot.groupBy("bucket").agg(F.count("*").alias("m")).where(F.col("m") > LARGE)
            if large.isEmpty():
                rows = rows.unionByName(hot.withColumn("part", F.lit(-1).cast("long")))
                break
            rows = rows.unionByName(hot.join(large, "bucket", "left_anti").withColumn("part", F.lit(-1).cast("long")))
            hot = hot.join(large, "bucket")
            if width <= RANGES:
                # contexts that share all but a few bytes: parts are sorted, and what they have in common is met by its hash
                rows = rows.unionByName(hot.withColumn("part", F.pmod(F.xxhash64("ch"), F.ceil(F.col("m") / LARGE)).cast("long")).drop("m"))
                break
            hot = hot.drop("m")
    rows = rows.select("bucket", "part", "ch", "lead", "n", "bytes", "skip").repartition("bucket", "part").sortWithinPartitions("bucket", "part")
    same = written(rows.mapInArrow(tidy(_repeated(length)), "ch long, first int, last int, window long"), "repeated")
    # parts of one split bucket meet here: windows of two parts that have the same hash
    hot = same.where("window is not null")
    across = hot.join(hot.groupBy("window").agg(F.count("*").alias("k")).where("k > 1"), "window", "left_semi")
    ranges = same.where("window is null").union(across.select(*same.columns))
    # of equal windows within a part one was sent; all of them are in a range already
    place = distinct.where("n = 1").select("ch", "tk", F.col("first").alias("base"))
    once = ranges.join(place, "ch").select("tk", (F.col("base") + F.col("first")).alias("a"), (F.col("base") + F.col("last") + length).alias("b"))
    return twice.union(once)


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, text, kept.

    Each byte goes that lies in a string of `length` UTF-8 bytes which starts at another place of
    any text as well; matches don't cross texts and are judged on the input. kept: the bytes left (null
    if nothing was removed, else binary); text: the same as a string, where a character of which a part is gone shows as U+FFFD. Null texts count as empty; shorter ones lose nothing.
    Equal texts are judged together, by a 64-bit hash; repeated and null ids are rows of their own.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    named = rows.select(F.xxhash64("text").alias("tk"), "text")
    ranges = written(repeated_ranges(named, length).distinct(), "ranges")
    lists = ranges.groupBy("tk").agg(F.collect_list(F.struct("a", "b")).alias("r"))
    hit = only_maybe(named, "tk", lists.select("tk")).dropDuplicates(["tk"]).join(lists, "tk").select("tk", "text", "r")

    def strip(batches):
        for x in batches:
            out = []
            for i in range(x.num_rows):
                raw = x.column(1)[i].as_py().encode()
                left, n, spans, end = [], 0, 0, 0
                for a, b in sorted((y["a"], y["b"]) for y in x.column(2)[i].as_py()):
                    if a > end or not spans:
                        left.append(raw[end:a])
                        spans += 1
                        n, end = n + b - a, b
                    elif b > end:
                        n, end = n + b - end, b
                kept = b"".join([*left, raw[end:]])
                out.append((x.column(0)[i].as_py(), n, spans, hashlib.sha256(kept).hexdigest(), kept, kept.decode("utf-8", "replace")))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()))], names=["tk", "n", "spans", "sha", "kept", "left"])

    cut = hit.mapInArrow(tidy(strip), "tk long, n long, spans long, sha string, kept binary, left string")
    every = rows.select("doc_id", "text", F.xxhash64("text").alias("tk"), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("own"))
    return every.join(cut, "tk", "left").select("doc_id", "n_bytes", F.coalesce("n", F.lit(0)).alias("n_removed"), F.coalesce("spans", F.lit(0)).alias("n_spans"), F.coalesce("sha", "own").alias("kept_sha256"), F.coalesce("left", "text").alias("text"), "kept")


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the bytes of repeated 400-byte strings, as a digest."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")


QUERIES = {"op4_substrings": op4_substrings}
ORACLE_SQL: dict[str, str] = {}
