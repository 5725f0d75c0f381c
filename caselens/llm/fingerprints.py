"""8. Document fingerprints: SimHash with a block search."""

from __future__ import annotations

import hashlib
from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, mix, shingles, slices, word_hashes, written, tidy

BITS = 256
_sign = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64) * 2 - 1)


def simhash(texts: pa.Array, n: int = 3) -> np.ndarray:
    """BITS / 8 bytes for each text: every distinct n-word term votes on each bit with the root of its count.

    A term's bit adds its weight if set and takes it away if not. A text without words has all bits 0.
    """
    out = np.zeros((len(texts), BITS // 8), np.uint8)
    for s in slices(texts):
        words, first = word_hashes(s)
        terms, weights, sizes = [], [], []
        for i in range(s.n):
            u, c = np.unique(shingles(words[first[i] : first[i + 1]], n), return_counts=True)
            terms.append(u)
            weights.append(np.sqrt(c))
            sizes.append(len(u))
        if not sum(sizes):
            continue
        row, t, w = np.repeat(np.arange(s.n), sizes) * 256, np.concatenate(terms), np.concatenate(weights)
        for word in range(BITS // 64):
            lanes = mix(t + np.uint64(word * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)).view(np.uint8).reshape(-1, 8)
            for lane in range(8):
                # how much weight has each value of this byte; then what it adds to the byte's 8 bits
                votes = np.bincount(row + lanes[:, lane], w, s.n * 256).reshape(s.n, 256) @ _sign
                out[s.first : s.first + s.n, word * 8 + lane] = np.packbits(votes > 0, axis=1)[:, 0]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bits."""
    return 1 - np.bitwise_count(a ^ b).sum(axis=-1) / BITS


def radius_for(similarity: float) -> int:
    """The Hamming distance to expect of two texts whose term sets have this Jaccard similarity (term counts alike)."""
    return int(BITS * np.arccos(2 * similarity / (1 + similarity)) / np.pi)


SIMILARITY = 0.8  # of the near copies that a class links: 38 of 256 bits
CELL, CELLS = (1 << 15, 1 << 20), 16  # fingerprints of a block, at least and at most; blocks while they aren't larger


def _tables(radius: int) -> tuple[int, list[tuple[int, int]]]:
    """(flips, [(first bit, width)]): two fingerprints within the radius differ by at most `flips` bits in one of the blocks.

    radius + 1 bits can't be dealt to radius // (flips + 1) + 1 blocks with more than `flips` in each. As few
    flips as blocks of 16 bits allow.
    """
    flips = next(t for t in range(BITS) if BITS // (radius // (t + 1) + 1) >= 16)
    m = radius // (flips + 1) + 1
    edges = np.arange(m + 1) * BITS // m
    return flips, [(int(p), int(min(q - p, 20))) for p, q in pairwise(edges)]


def _block(prints: np.ndarray, first: int, width: int) -> np.ndarray:
    low, high = first // 8, (first + width + 7) // 8
    v = np.zeros(len(prints), np.int64)
    for k in range(low, high):
        v = v << 8 | prints[:, k]
    return v >> (8 * high - first - width) & ((1 << width) - 1)


def _joined(comp: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """comp (each node's least known node) after the links (a, b)."""
    a, b = comp[a], comp[b]
    p = np.arange(len(comp))
    while len(a):
        live = a != b
        a, b = a[live], b[live]
        np.minimum.at(p, np.maximum(a, b), np.minimum(a, b))
        while (p[p] != p).any():
            p = p[p]
        a, b = p[a], p[b]
    return p[comp]


def near_in_cell(left: np.ndarray, right: np.ndarray, radius: int, most: int = 1 << 20) -> np.ndarray:
    """For each fingerprint of left and then of right the least number that links reach, by all pairs of left x right within the radius.

    A table for each block holds right sorted by the block's bits; left looks it up with up to `flips` bits
    changed, so that no pair within the radius is missed. Pairs known to be of one component aren't judged.
    """
    flips, blocks = _tables(radius)
    x, y, n = left.view(np.uint64), right.view(np.uint64), len(left)
    comp = np.arange(n + len(right))
    for first, width in blocks:
        own, other = _block(left, first, width), _block(right, first, width)
        order = np.argsort(other, kind="stable")
        start = np.append(0, np.cumsum(np.bincount(other, minlength=1 << width)))
        found, held = [], 0
        for mask in (sum(1 << k for k in c) for t in range(flips + 1) for c in combinations(range(width), t)):
            at = own ^ mask
            size = start[at + 1] - start[at]
            i = np.flatnonzero(size)
            ends = np.cumsum(size[i])
            low = 0
            while low < len(i):
                high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + most, side="right")))
                some = i[low:high]
                c = size[some]
                p = np.repeat(some, c)
                q = order[np.repeat(start[at[some]] - (np.cumsum(c) - c), c) + np.arange(len(p))]
                low = high
                apart = comp[p] != comp[n + q]
                p, q = p[apart], q[apart]
                close = np.bitwise_count(x[p] ^ y[q]).sum(axis=1) <= radius
                p, q = p[close], q[close]
                found.append((p, n + q))
                held += len(p)
                if held > 1 << 16:
                    comp, found, held = _joined(comp, *map(np.concatenate, zip(*found))), [], 0
        if held:
            comp = _joined(comp, *map(np.concatenate, zip(*found)))
    return comp


def within_radius(prints: DataFrame, radius: int) -> DataFrame:
    """(item, fingerprint, class_item): classes of fingerprints linked by a Hamming distance of `radius` or less.

    prints: (fingerprint) as hex; distinct ones become items. They are dealt into blocks, and every two
    blocks meet in a cell, whose task searches all their pairs by near_in_cell. A fingerprint goes to as many cells as there
    are blocks: CELLS, more only where blocks would pass CELL[1] fingerprints. A cell
    gives one link for each fingerprint, however many are near it.
    """
    items = written(prints.distinct().select("fingerprint", F.xxhash64("fingerprint").alias("item")), "prints")
    n = items.count()
    blocks = max(1, -(-n // min(max(-(-n // CELLS), CELL[0]), CELL[1])))
    dealt = items.select("item", F.unhex("fingerprint").alias("bits"), F.pmod(F.xxhash64("item", F.lit(5)), F.lit(blocks)).cast("int").alias("own"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.select((F.least("own", "other") * blocks + F.greatest("own", "other")).alias("cell"), (F.col("own") > F.col("other")).alias("right"), "item", "bits")

    def search(batches):
        now, parts = None, []

        def links():
            if now is None:
                return
            item, right, bits = (np.concatenate(c) for c in zip(*parts))
            same = not (now // blocks - now % blocks)
            order = np.argsort(right, kind="stable")
            item, bits, k = item[order], bits[order], len(item) - int(right.sum())
            comp = near_in_cell(bits, bits, radius) if same else near_in_cell(bits[:k], bits[k:], radius)
            if same:
                # a node and its second number are one
                comp = _joined(comp, np.arange(k), np.arange(k) + k)[:k]
            linked = np.flatnonzero(comp != np.arange(len(comp)))
            yield pa.RecordBatch.from_arrays([pa.array(item[comp[linked]]), pa.array(item[linked])], names=["a", "b"])

        for x in batches:
            cell = x.column(0).to_numpy()
            for p, q in pairwise([0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1), len(cell)]):
                if q > p:
                    if cell[p] != now:
                        yield from links()
                        now, parts = int(cell[p]), []
                    raw = b"".join(x.column(3).slice(p, q - p).to_pylist())
                    parts.append((x.column(2)[p:q].to_numpy(), x.column(1)[p:q].to_numpy(zero_copy_only=False), np.frombuffer(raw, np.uint8).reshape(-1, BITS // 8)))
        yield from links()

    found = dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(tidy(search), "a long, b long")
    comp = written(connected_components(found), "components")
    return items.join(comp, items["item"] == comp["node"], "left").select("item", "fingerprint", F.coalesce("component", "item").alias("class_item"))


def fingerprint_documents(docs: DataFrame, radius: int = radius_for(SIMILARITY), n: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, class_id.

    The edited text: the last n_chars // 2 code points replaced by the first as many (or all) of
    the next document, by descending id, rows of one id by their text's two hashes, null ids last; the
    first follows the last. A single row follows itself. class_id: the least id of the documents that chains of
    fingerprints within the radius reach. Null texts count as empty, with a fingerprint of zeros.
    Rows are range-partitioned by id; what stands at a partition's border is written with the
    results, and the borders are joined afterwards.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), F.crc32("text")]  # the driver samples these, so no text is among them
    kinds = "kind int, part long, doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, text string"
    types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string())
    names = [x.split()[0] for x in kinds.split(", ")]

    def batch(cols):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    def judged(part, ids, texts, nexts):
        """Result rows of texts and the texts that follow them."""
        edited = [t[: len(t) - len(t) // 2] + x[: len(t) // 2] for t, x in zip(texts, nexts)]
        own, other, after = (simhash(pa.array(z, pa.large_string()), n) for z in (texts, edited, nexts[-1:]))
        follow = np.concatenate([own[1:], after])
        k = len(ids)
        return batch([[0] * k, [part] * k, ids, [len(t) for t in texts], [hashlib.sha256(t.encode()).hexdigest() for t in edited], [x.tobytes().hex() for x in own], [x.tobytes().hex() for x in other], likeness(own, other), likeness(own, follow), [None] * k])

    def border(kind, part, doc_id, text):
        return batch([[kind], [part], [doc_id], [None], [None], [None], [None], [None], [None], [text]])

    def along(batches):
        from pyspark import TaskContext

        part, ids, texts = TaskContext.get().partitionId(), [], []
        size, any_ = 0, False
        for x in batches:
            for i, t in zip(x.column(0).to_pylist(), x.column(1)):
                t = t.as_py()
                if not any_:
                    yield border(1, part, i, t)
                    any_ = True
                ids.append(i)
                texts.append(t)
                size += len(t)
                if size > 1 << 20 and len(ids) > 1:
                    yield judged(part, ids[:-1], texts[:-1], texts[1:])
                    ids, texts, size = ids[-1:], texts[-1:], len(t)
        if any_:
            if len(ids) > 1:
                yield judged(part, ids[:-1], texts[:-1], texts[1:])
            yield border(2, part, ids[-1], texts[-1])

    found = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(tidy(along), kinds), "fingerprints")
    # one number for each partition: where its last row's next row is
    parts = sorted(r[0] for r in found.where("kind = 1").select("part").collect())
    spark = docs.sparkSession
    following = spark.createDataFrame([(p, q) for p, q in zip(parts, parts[1:] + parts[:1])], "part long, following long")
    tails, heads = found.where("kind = 2").select("part", "doc_id", "text"), found.where("kind = 1").select(F.col("part").alias("following"), F.col("text").alias("next_text"))

    def ends(batches):
        for x in batches:
            for i in range(x.num_rows):
                yield judged(0, [x.column(0)[i].as_py()], [x.column(1)[i].as_py()], [x.column(2)[i].as_py()])

    last = tails.join(following, "part").join(heads, "following").select("doc_id", "text", "next_text").mapInArrow(tidy(ends), kinds)
    every = written(found.where("kind = 0").unionByName(last).drop("kind", "part", "text"), "prints")
    classes = within_radius(every.select("fingerprint"), radius)
    low = every.groupBy("fingerprint").agg(F.min("doc_id").alias("low")).join(classes, "fingerprint")
    least = low.groupBy("class_item").agg(F.min("low").alias("class_id"))
    return every.join(low.join(least, "class_item").select("fingerprint", "class_id"), "fingerprint", "left").select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "class_id")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, with their likeness."""
    return fingerprint_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op8_fingerprints": op8_fingerprints}
ORACLE_SQL: dict[str, str] = {}
