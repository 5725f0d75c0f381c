"""Components of a similarity link, from postings of candidates, without all pairs of a group as rows."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, mix, written, tidy


def as_words(elems: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(v.as_buffer(), np.uint64) for v in elems]


def _unpacked(elems: pa.Array, unpack: Callable) -> list[np.ndarray]:
    """The sets of a column; equal entries are unpacked once."""
    coded = elems.dictionary_encode()
    found = unpack(coded.dictionary)
    return [found[i] for i in coded.indices.to_numpy()]


def _both(p: np.ndarray, q: np.ndarray) -> int:
    """How many elements two sets of distinct elements share."""
    x = np.concatenate((p, q))
    x.sort()
    return int(np.count_nonzero(x[1:] == x[:-1]))


def confirmed(pairs: DataFrame, sets: DataFrame, num: int, den: int, head: int = 0, least: int = 0, unpack: Callable = as_words) -> DataFrame:
    """Pairs (a, b) whose sets link: den * intersection >= num * union, judged on full sets.

    sets: (item, elems); `unpack` makes of elems `head` signature coordinates and then the sorted distinct
    element hashes, all as 64-bit words. Pairs with fewer than `least` equal coordinates are left
    before their sets are compared.
    """
    left = sets.select(F.col("item").alias("a"), F.col("elems").alias("ea"))
    right = sets.select(F.col("item").alias("b"), F.col("elems").alias("eb"))

    def judge(batches):
        for x in batches:
            a, b = _unpacked(x.column(2), unpack), _unpacked(x.column(3), unpack)
            good = np.zeros(x.num_rows, bool)
            for i in range(x.num_rows):
                p, q = a[i], b[i]
                if head and int((p[:head] == q[:head]).sum()) < least:
                    continue
                p, q = p[head:], q[head:]
                # one length bounds the other, so that most unlike pairs need no intersection
                if den * min(len(p), len(q)) < num * max(len(p), len(q)):
                    continue
                both = _both(p, q)
                good[i] = den * both >= num * (len(p) + len(q) - both) and both > 0
            if good.any():
                yield pa.RecordBatch.from_arrays([x.column(k).filter(pa.array(good)) for k in (0, 1)], names=["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "ea", "eb").mapInArrow(tidy(judge), "a long, b long")


BITS = 128
_seeds = np.random.default_rng(72)
_FACTOR = _seeds.integers(1, 1 << 32, BITS, dtype=np.uint32) | np.uint32(1)
_OFFSET = _seeds.integers(1, 1 << 32, BITS, dtype=np.uint32)
SKETCH = "size int, bits0 long, bits1 long"


def sketch(u: np.ndarray) -> tuple[int, int, int]:
    """Size and BITS one-bit MinHash values of a set of hashes: what pairs are screened by before they are met."""
    low, half = np.full(BITS, np.iinfo(np.uint32).max, np.uint32), (u >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(u), 1 << 10):
        low = np.minimum(low, (half[i : i + (1 << 10), None] * _FACTOR + _OFFSET).min(axis=0))
    bits = np.packbits((mix(low.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)).view(np.int64)
    return len(u), int(bits[0]), int(bits[1])


def sketch_columns(sketches: list[tuple[int, int, int]]) -> list[pa.Array]:
    return [pa.array([x[k] for x in sketches], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.int64()))]


def most_apart(num: int, den: int, bits: int, sigmas: float = 5.5) -> int:
    """Sketch bits in which a linked pair differs at most, but for one pair in ten million (at 5.5 standard deviations)."""
    p = (1 - num / den) / 2
    return math.ceil(bits * p + sigmas * math.sqrt(bits * p * (1 - p)))


def alike(num: int, den: int, bits: int = BITS, sizes: bool = True, sigmas: float = 5.5) -> str:
    """Condition under which sketches can be of a linked pair: by sizes, where they are exact, and by bits."""
    same = f"bit_count(bits0 ^ other_bits0) + bit_count(bits1 ^ other_bits1) <= {most_apart(num, den, bits, sigmas)}"
    return f"{den} * least(size, other_size) >= {num} * greatest(size, other_size) and {same}" if sizes else same


PAIRED = 32  # members of a key up to which all their pairs are met at once
CROSSED = 4096  # and up to which, after a pivot round, pairs of different components are met by a join; beyond it, in cells
SPARSE = 8
BLOCK, BLOCK_BYTES = 1024, 1 << 23  # members of a block and bytes of their sets, about


def _between(comp: np.ndarray, bits: np.ndarray, elems: pa.Array, num: int, den: int, head: int, least: int, unpack: Callable, most: int) -> list[tuple[int, int]]:
    """Links (i, j) that join the components of a cell as all of its linked pairs do; sets as in `confirmed`.

    bits: two longs of sketch bits a member; only the sets of members with a pair within `most` bits are unpacked. Up to SPARSE such
    pairs a member are judged one by one, more by matrix products.
    """
    names, comp, sizes = np.unique(comp, return_inverse=True, return_counts=True)
    if len(names) < 2:
        return []
    # two members of the most frequent component need no comparison
    rows = np.flatnonzero(comp != sizes.argmax())
    bits = bits.view(np.uint64)  # of a negative number bitwise_count counts the bits of its absolute value
    asked = np.zeros((len(rows), len(comp)), bool)
    for i in range(0, len(rows), 256):
        r = rows[i : i + 256]
        asked[i : i + 256] = (comp[r, None] != comp) & (np.bitwise_count(bits[r, None] ^ bits).sum(axis=2) <= most)
    live = np.union1d(rows[asked.any(axis=1)], np.flatnonzero(asked.any(axis=0)))
    if not len(live):
        return []
    picked = unpack(elems.take(pa.array(live)))
    elems = [picked[0][:0]] * len(comp)
    for i, e in zip(live, picked):
        elems[i] = e
    n = np.array([len(e) - head for e in elems])
    asked &= den * np.minimum(n[rows, None], n) >= num * np.maximum(n[rows, None], n)
    rows, asked = rows[asked.any(axis=1)], asked[asked.any(axis=1)]
    if head and len(rows):
        asked &= _shared([e[:head] for e in elems], rows, np.arange(len(n))) >= least
        rows, asked = rows[asked.any(axis=1)], asked[asked.any(axis=1)]
    columns = np.flatnonzero(asked.any(axis=0))
    if not len(rows):
        return []
    # a pair outside the most frequent component is asked for twice
    r, c = np.nonzero(asked & ((comp == sizes.argmax()) | (np.arange(len(comp)) > rows[:, None])))
    r = rows[r]
    if len(r) <= SPARSE * len(live):
        both = np.array([_both(elems[i][head:], elems[j][head:]) for i, j in zip(r, c)], np.int64)
        good = (both > 0) & (den * both >= num * (n[r] + n[c] - both))
        r, c = r[good], c[good]
    else:
        both = _shared([e[head:] for e in elems], rows, columns)
        r, c = np.nonzero(asked[:, columns] & (both > 0) & (den * both >= num * (n[rows, None] + n[columns] - both)))
        r, c = rows[r], columns[c]
    parent = np.arange(len(names))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for k in np.unique(comp[r] * len(names) + comp[c], return_index=True)[1]:
        p, q = root(comp[r[k]]), root(comp[c[k]])
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((int(r[k]), int(c[k])))
    return out


def _shared(sets: list[np.ndarray], rows: np.ndarray, columns: np.ndarray, width: int = 4096) -> np.ndarray:
    """How many elements the sets `rows` share with the sets `columns`: products of their incidence matrices."""
    used = np.unique(np.concatenate([rows, columns]))
    member = np.repeat(used, [len(sets[i]) for i in used])
    _, element, count = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True, return_counts=True)
    often = np.cumsum(count > 1) - 1  # an element of one set alone adds nothing
    keep = count[element] > 1
    member, element = member[keep], often[element[keep]]
    order = np.argsort(element, kind="stable")
    member, element = member[order], element[order]
    out = np.zeros((len(rows), len(columns)), np.int64)
    for low in range(0, int(element[-1]) + 1 if len(element) else 0, width):
        a, b = np.searchsorted(element, (low, low + width))
        m = np.zeros((len(sets), width), np.float32)
        m[member[a:b], element[a:b] - low] = 1
        out += (m[rows] @ m[columns].T).astype(np.int64)
    return out


def _near_another(at: np.ndarray, bits: np.ndarray, own: np.ndarray, most: int) -> np.ndarray:
    """Which rows differ from another row of their group `at` (sorted) that isn't their own in up to `most` bits."""
    good = np.zeros(len(at), bool)
    edge = np.append(np.flatnonzero(np.append(True, at[1:] != at[:-1])), len(at)) if len(at) else np.zeros(1, np.int64)
    size = np.diff(edge)
    i, d = np.flatnonzero(np.repeat(size <= BESIDE, size)), 1
    while len(i):  # small groups together, by the distance of two rows
        i = i[: np.searchsorted(i, len(at) - d)]
        i = i[at[i] == at[i + d]]
        met = i[(np.bitwise_count(bits[i] ^ bits[i + d]).sum(axis=1) <= most) & (own[i] != own[i + d])]
        good[met] = good[met + d] = True
        d += 1
    for g in np.flatnonzero(size > BESIDE):
        a, b = edge[g], edge[g + 1]
        for k in range(a, b, 256):
            r = slice(k, min(k + 256, b))
            good[r] = ((np.bitwise_count(bits[r, None] ^ bits[a:b]).sum(axis=2) <= most) & (own[r, None] != own[a:b])).any(axis=1)
    return good


BESIDE = 64


def with_candidate(p: DataFrame, by: str, most: int) -> DataFrame:
    """Rows of p (by, bits0, bits1 and others) that differ from another row of their group in up to `most` sketch bits; where
    p has a column comp, from one of another component. A group is held by a task: its rows have no sets."""
    names = p.columns

    def live(rows: pa.Table) -> pa.Table:
        at = rows.column(by).to_numpy()
        bits = np.stack([rows.column(c).to_numpy() for c in ("bits0", "bits1")], axis=1).view(np.uint64)
        own = rows.column("comp").to_numpy() if "comp" in names else np.arange(len(bits))
        return rows.filter(pa.array(_near_another(at, bits, own, most)))

    def work(batches):
        held: list[pa.RecordBatch] = []  # of the last group, which may go on
        for x in batches:
            at = x.column(names.index(by)).to_numpy()
            last = int(np.searchsorted(at, at[-1])) if len(at) else 0
            if held and len(at) and (last or held[0].column(names.index(by))[0].as_py() != at[0]):
                yield from live(pa.Table.from_batches([*held, x.slice(0, last)])).combine_chunks().to_batches()
                held = []
            elif last:
                yield from live(pa.Table.from_batches([x.slice(0, last)])).combine_chunks().to_batches()
            if len(at):
                held.append(x.slice(last))
        if held:
            yield from live(pa.Table.from_batches(held)).combine_chunks().to_batches()

    return p.repartition(by).sortWithinPartitions(by).mapInArrow(tidy(work), p.schema)


def in_cells(p: DataFrame, sets: DataFrame, num: int, den: int, head: int = 0, least: int = 0, unpack: Callable = as_words, width: int = BITS, sigmas: float = 5.5) -> DataFrame:
    """Links (a, b) between components of the postings p (key, item, comp and SKETCH's columns), without their pairs as rows.

    The members of a key outside its largest component (others) are dealt into blocks of about BLOCK members and
    BLOCK_BYTES of sets, and so are those inside. Every two blocks of others meet in a cell, and every block of others meets every block
    of the largest component; there one task counts all intersections as matrix products. Members of the largest
    component need no comparison with each other, so with few others a key's members go to one cell each.
    All pairs of different components are judged, first by their sketches (of `width` bits), then by the same rule as in `confirmed`.
    """
    per = p.groupBy("key", "comp").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    top = per.groupBy("key").agg(F.max(F.struct("n", "comp", "size")).alias("top"), F.sum("n").alias("n"), F.sum("size").alias("size"))
    number = lambda n, size: F.greatest(F.lit(1), F.ceil(n / BLOCK), F.ceil(8 * size / BLOCK_BYTES)).cast("int")
    top = top.select("key", F.col("top.comp").alias("most"), number(F.col("top.n"), F.col("top.size")).alias("inside"), number(F.col("n") - F.col("top.n"), F.col("size") - F.col("top.size")).alias("others"))
    p = p.join(top, "key").withColumn("main", F.col("comp") == F.col("most"))
    p = p.withColumn("own", F.pmod(F.xxhash64("item", F.lit(5)), F.when(F.col("main"), F.col("inside")).otherwise(F.col("others"))).cast("int"))
    # a cell is two blocks: of others (from 0 on) or of the largest component (from -1 down)
    met = F.sequence(F.lit(0), F.col("others") - 1)
    p = p.withColumn("other", F.explode(F.when(F.col("main"), met).otherwise(F.concat(met, F.transform(F.sequence(F.lit(0), F.col("inside") - 1), lambda i: -1 - i)))))
    own = F.when(F.col("main"), -1 - F.col("own")).otherwise(F.col("own"))
    cell = F.xxhash64("key", F.least(own, "other"), F.greatest(own, "other"))
    most = most_apart(num, den, width, sigmas)
    # only members with a candidate are met with their sets
    live = with_candidate(p.select(cell.alias("cell"), "item", "comp", "bits0", "bits1"), "cell", most)
    dealt = live.join(sets.select("item", "elems"), "item").select("cell", "item", "comp", "bits0", "bits1", "elems")

    def cells(batches):
        now, parts = None, []

        def judged():
            item, comp, b0, b1 = (np.concatenate([p[k] for p in parts]) for k in range(4))
            elems = pa.concat_arrays([p[4] for p in parts])
            found = np.array(_between(comp, np.stack([b0, b1], axis=1), elems, num, den, head, least, unpack, most), np.int64).reshape(-1, 2)
            x, y = item[found[:, 0]], item[found[:, 1]]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

        for x in batches:
            at = x.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1), len(at)]
            for a, b in zip(edges, edges[1:]):
                if b > a and at[a] != now:
                    if parts:
                        yield judged()
                    now, parts = at[a], []
                parts.append((*(x.column(k).to_numpy()[a:b] for k in range(1, 5)), x.column(5)[a:b]))
        if parts:
            yield judged()

    return dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(tidy(cells), "a long, b long")


def link_components(
    postings: DataFrame, sketches: DataFrame, screen: str, fetch: Callable[[DataFrame], DataFrame], confirm: Callable, cells: Callable | None = None, rounds: int = 1, paired: int = PAIRED, crossed: int | None = None,
    pairs: DataFrame | None = None, apart: int = 0,
) -> DataFrame:
    """(node, component) of the items that link with another one.

    postings: (key, item, n), n the key's members, null where a key has many; two items may link only if they share a key.
    sketches: item and SKETCH's columns; pairs that `screen` rules out aren't made. fetch gives the sets (item, elems) of
    the items asked for, confirm(pairs, sets) keeps the pairs (a, b) that link.

    Keys of up to `paired` members make all their pairs. For the others, each round compares the
    members of a key with one pivot and contracts what links, so that a large group of copies
    needs one comparison a member. Then only members of different components under one key are
    left, and all of those pairs are compared, for keys of more than CROSSED members by cells(postings with comp, sets) if given (see
    in_cells), else by a join: no link between components is lost.

    With `crossed`, keys with one pivot meet as one key before that, and those of more than `crossed` members go to cells. Copies share
    most of their keys, and keys with nearly the same members mostly have the same pivot, so that a pair is compared a few times and not under each key.

    With `pairs` (a, b), those of all keys but the ones with n null are made already, small keys' and pivots', and postings holds only large keys. All sets
    are then fetched at once, so before that pairs are judged by `screen`, and postings stay only with a candidate within `apart` sketch bits.
    """
    p = written(postings.join(sketches, "item").select("key", "item", "n", *(c for c in sketches.columns if c != "item")), "posted")
    sketch_of = [c for c in p.columns if c not in ("key", "n")]
    twin = lambda df: df.select("key", *(F.col(c).alias("other" if c == "item" else f"other_{c}") for c in sketch_of))
    wide = F.coalesce(F.col("n") > CROSSED, F.lit(True))
    ready = pairs is not None
    if ready:
        p = written(with_candidate(p.where("n is not null"), "key", apart).union(p.where("n is null")), "posted")
        of = sketches.select(F.col("item").alias("a"), *(c for c in sketch_of if c != "item"))
        other = sketches.select(F.col("item").alias("b"), *(F.col(c).alias(f"other_{c}") for c in sketch_of if c != "item"))
        pairs = pairs.distinct().join(of, "a").join(other, "b").where(screen).select("a", "b")
    large = (p if ready else p.where(F.coalesce(F.col("n") > paired, F.lit(True)))).withColumn("wide", wide if cells and crossed is None else F.lit(False))
    if not ready:
        small = p.where(F.col("n") <= paired).drop("n")
        pairs = small.join(twin(small), "key").where(f"item < other and {screen}").select(F.col("item").alias("a"), F.col("other").alias("b"))
    unmet, large = large.where("n is null") if ready else large, large.drop("n")
    pivots_of = lambda r: large.groupBy("key").agg(F.min(F.struct(F.xxhash64("item", F.lit(r)).alias("o"), *sketch_of)).alias("x")).select("key", *(f"x.{c}" for c in sketch_of))
    for r in range(rounds):
        met = unmet.join(twin(pivots_of(r)), "key").where(f"item <> other and {screen}")
        pairs = pairs.union(met.select(F.least("item", "other").alias("a"), F.greatest("item", "other").alias("b")))
    pairs = written(pairs.distinct(), "pairs")
    some = not large.isEmpty()
    need = pairs.select(F.col("a").alias("item")).union(pairs.select("b"))
    more = large if ready else large.where("wide")
    sets = fetch((need.union(more.select("item")) if some else need).distinct())
    again = (lambda _: sets) if ready else fetch
    comp = written(connected_components(written(confirm(pairs, sets), "links")), "components")
    if not some:
        return comp
    q = large.join(comp, large["item"] == comp["node"], "left").withColumn("comp", F.coalesce("component", "item")).drop("node", "component")
    mixed = q.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    q = q.join(mixed, "key")
    if crossed is not None:
        q = q.join(pivots_of(0).select("key", F.col("item").alias("meeting")), "key").drop("key", "wide").withColumnRenamed("meeting", "key").distinct()
        q = written(q, "meetings")
        q = q.join(q.groupBy("key").agg(F.count("*").alias("n")), "key").withColumn("wide", F.col("n") > crossed).drop("n")
    q = written(q, "crossing")
    joined = q.where("not wide")
    right = joined.select("key", F.col("comp").alias("other_comp"), *(F.col(c).alias("other" if c == "item" else f"other_{c}") for c in sketch_of))
    met = joined.join(right, "key").where(f"comp < other_comp and {screen}")
    met = written(met.select(F.least("item", "other").alias("a"), F.greatest("item", "other").alias("b")).distinct(), "met")
    new = None if met.isEmpty() else confirm(met, again(met.select(F.col("a").alias("item")).union(met.select("b")).distinct()))
    if cells and not q.where("wide").isEmpty():
        apart = cells(q.where("wide").drop("wide"), sets if crossed is None else again(q.where("wide").select("item").distinct()))
        new = apart if new is None else new.union(apart)
    if new is None:
        return comp
    new = written(new, "links")
    if new.isEmpty():
        return comp
    # components so far are stars, so they stand for all links that made them
    return written(connected_components(new.union(comp.where("node <> component").select("node", "component"))), "components")
