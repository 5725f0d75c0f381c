"""12. Conversation prefix trie: partial tries of partitions, merged by node, rolled up from below."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import tidy, written

WIDTH, FAN = 256, 16  # shards of partial tries, and how many of them a merge takes together
BLOCK = 1 << 16  # ids of an end list's block
NODE = ["k1", "k2"]


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, role, text): each conversation's turns from 1 on, by turn (null first), then role and text.

    Null roles and texts become empty; rows without a conv_id belong to no conversation and are left out.
    """
    d = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return d.where("conv_id is not null").select("conv_id", F.row_number().over(order).alias("pos"), "role", "text")


def turn_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, t1, t2, chars): what the trie needs of a turn, 128 bits of hash and its code points."""
    return turns.select("conv_id", "pos", F.xxhash64("role", "text").alias("t1"), F.xxhash64(F.lit(12), "role", "text").alias("t2"), F.char_length("text").cast("long").alias("chars"))


def with_shared_heads(turns: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """Rebuilt conversations, one row a turn and for each conversation a row at pos 0: the first h turns of conversation
    c - c % group, then c's own after its first h; h = crc32(decimal c) % most. turns: of `turn_hashes`."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    convs = turns.select("conv_id").distinct().select("conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), h.alias("h"))
    # a base has fewer than `most` turns here, and it is met by group conversations at most
    heads = turns.where((F.col("conv_id") % group == 0) & (F.col("pos") < most)).withColumnRenamed("conv_id", "base")
    first = convs.join(heads, "base").where("pos <= h")
    counts = first.groupBy("conv_id").agg(F.count("*").alias("kept"))
    own = turns.withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")).where("pos > h")
    own = own.join(counts, "conv_id", "left").withColumn("pos", F.col("pos") - F.col("h") + F.coalesce("kept", F.lit(0)))
    cols = ["conv_id", F.col("pos").cast("int").alias("pos"), "t1", "t2", "chars"]
    return first.select(cols).unionByName(own.select(cols)).unionByName(root_rows(convs))


def root_rows(convs: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    return convs.select("conv_id", F.lit(0).alias("pos"), zero.alias("t1"), zero.alias("t2"), zero.alias("chars"))


def _paths(turns: DataFrame) -> tuple[DataFrame, int]:
    """(conv_id, k1, k2, depth, chars, last, u0, v0, u1, v1...): the node that each turn of a conversation reaches, whether the
    conversation ends there, and the node's ancestors 1, 2, 4... steps above it; and the number of these strides.

    A node is named by 128 bits, the exclusive or of its turns' hashes with their places; the root by zeros.
    """
    strides = max(1, (turns.agg(F.max("pos").alias("d")).first()["d"] or 0).bit_length())
    order = Window.partitionBy("conv_id").orderBy("pos")
    placed = lambda *c: F.when(F.col("pos") > 0, F.xxhash64("pos", *c)).otherwise(F.lit(0))
    keyed = turns.select("conv_id", "pos", "chars", placed("t1", "t2").alias("x1"), placed("t2", "t1").alias("x2"))
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    keyed = keyed.withColumns({"k1": F.bit_xor("x1").over(run), "k2": F.bit_xor("x2").over(run), "last": F.lead("pos").over(order).isNull()})
    above = {f"{name}{j}": F.lag(key, 1 << j).over(order) for j in range(strides) for name, key in zip("uv", NODE)}
    return keyed.withColumns(above).withColumnRenamed("pos", "depth").drop("x1", "x2"), strides


def _merged(partial: DataFrame, keys: list[str], sums: list[Column], again: list[Column]) -> DataFrame:
    """Partial tables by keys, in rounds: FAN shards at a time meet under a node's hash, until one is left."""
    shard = (F.spark_partition_id() % WIDTH).alias("shard")
    now, width = partial.select("*", shard), WIDTH
    while width > 1:
        width = -(-width // FAN)
        now = now.withColumn("shard", F.expr(f"shard div {FAN}")).groupBy(*keys, "shard").agg(*sums)
        sums = again
    return now.drop("shard")


def _end_digests(ends: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) of end lists in blocks (k1, k2, block, ids); a node's blocks stream through its digest in order."""

    def digests(batches):
        now, h, some = None, None, False
        out: list[tuple[int, int, str]] = []

        def flushed():
            rows = list(zip(*out)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.string())], names=["k1", "k2", "ends_sha256"])

        for x in batches:
            for i in range(x.num_rows):
                key = (x.column(0)[i].as_py(), x.column(1)[i].as_py())
                if key != now:
                    if now is not None:
                        out.append((*now, h.hexdigest()))
                    now, h, some = key, hashlib.sha256(), False
                h.update((("," if some else "") + ",".join(map(str, x.column(2)[i].as_py()))).encode())
                some = True
            yield flushed()
            out.clear()
        if now is not None:
            out.append((*now, h.hexdigest()))
            yield flushed()

    order = ends.repartition(*NODE).sortWithinPartitions(*NODE, "block").select(*NODE, "ids")
    return order.mapInArrow(tidy(digests), "k1 long, k2 long, ends_sha256 string")


def _rolled_up(tree: DataFrame, strides: int) -> DataFrame:
    """n_leaves and saved_tokens of each node's own, summed over its subtree.

    After round j a node holds the sums of its subtree's first 2 ** (j + 1) levels: its own first 2 ** j, and those of the nodes
    2 ** j steps below it.
    """
    for j in range(strides):
        below = tree.where(F.col("depth") >= 1 << j).groupBy(F.col(f"u{j}").alias("k1"), F.col(f"v{j}").alias("k2")).agg(F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
        more = lambda c, x: (F.col(c) + F.coalesce(x, F.lit(0))).alias(c)
        sums = ("n_leaves", "saved_tokens")
        tree = tree.join(below, NODE, "left").select(*(c for c in tree.columns if c not in (*sums, f"u{j}", f"v{j}")), more("n_leaves", "l"), more("saved_tokens", "s"))
        tree = written(tree, "rolled")
    return tree


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row for each node of the trie of conversations: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    turns: (conv_id, pos, t1, t2, chars), places from 1 on without gaps, and a row at 0 for each conversation (see `root_rows`), so
    that one without turns is a member of the root. A node is told from others by 128 bits of hash. conv_id and depth name it: its
    last turn is the one at `depth` of conversation conv_id.

    Partitions combine their conversations into partial node tables before they shuffle; merges go by node and shard, so a
    node that many conversations share is never gathered from all of them at once. End lists go in blocks of ids. The rollup
    takes strides of 1, 2, 4... levels, so a conversation of n turns costs log2(n) rounds.

    No conversations give no nodes; equal conversations share all nodes; texts of any length count by hash and length alone.
    """
    paths, strides = _paths(turns)
    paths = written(paths, "paths")
    same = [F.first(c).alias(c) for c in ("depth", "chars", *(f"{x}{j}" for j in range(strides) for x in "uv"))]
    least = F.min("conv_id").alias("conv_id")
    nodes = written(_merged(paths.drop("last"), NODE, [F.count("*").alias("n_convs"), least, *same], [F.sum("n_convs").alias("n_convs"), least, *same]), "nodes")

    ids = F.sort_array(F.collect_list("conv_id")).alias("ids")
    ends = paths.where("last").select("conv_id", *NODE, F.floor(F.col("conv_id") / BLOCK).cast("long").alias("block"))
    ends = _merged(ends, [*NODE, "block"], [ids], [F.sort_array(F.flatten(F.collect_list("ids"))).alias("ids")])

    above = nodes.where("depth > 0")
    below = above.groupBy(F.col("u0").alias("k1"), F.col("v0").alias("k2")).agg(F.count("*").alias("n_children"))
    parents = nodes.select(F.col("k1").alias("u0"), F.col("k2").alias("v0"), F.col("conv_id").alias("parent_conv_id"))
    tree = nodes.join(below, NODE, "left").join(parents, ["u0", "v0"], "left")
    tree = tree.withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    tree = tree.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("chars")}).drop("chars")
    return _rolled_up(written(tree, "tree"), strides).join(_end_digests(ends), NODE, "left").select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, rebuilt to share the heads of each hundred's first one."""
    turns = written(turn_hashes(numbered(spark.read.parquet(f"{sf_dir}/conversations.parquet"))), "turns")
    return prefix_trie(written(with_shared_heads(turns), "rebuilt"))


QUERIES = {"op12_prefix_trie": op12_prefix_trie}
#: CRC32 by its bitwise rule; nodes are lists of turns, and a subtree is what its members reach.
ORACLE_SQL = {
    "op12_prefix_trie": """
with o as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos,
    {'r': coalesce(role, ''), 't': coalesce(text, '')} as turn from conversations where conv_id is not null),
c as (select distinct conv_id, conv_id - conv_id % 100 as base from o),
h as (select conv_id, base, xor(4294967295::bigint, list_reduce(list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint), lambda s, b:
    list_reduce(range(8)::bigint[], lambda y, i: case when y & 1 = 1 then xor(3988292384::bigint, y >> 1) else y >> 1 end, xor(s, b)), 4294967295::bigint)) % 6 as h from c),
head as (select h.conv_id, o.pos, o.turn from h join o on o.conv_id = h.base and o.pos <= h.h),
kept as (select conv_id, count(*) as n from head group by conv_id),
b as (select * from head union all select o.conv_id, o.pos - h.h + coalesce(n, 0), o.turn from o join h using (conv_id) left join kept using (conv_id) where o.pos > h.h),
path as (select conv_id, pos as d, list(turn) over (partition by conv_id order by pos) as node from b union all select conv_id, 0, [] from c),
size as (select conv_id, max(d) as n from path group by conv_id),
node as (select node, d, min(conv_id) as conv_id, count(*) as n_convs, sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (d = n), '')) as ends_sha256
    from path join size using (conv_id) group by node, d),
own as (select x.*, p.conv_id as parent_conv_id, (select count(*) from node y where y.d = x.d + 1 and y.node[1:x.d] = x.node) as n_children,
    case when x.d = 0 then 0 else (x.n_convs - 1) * length(x.node[x.d].t) end as saved from node x left join node p on x.d > 0 and p.d = x.d - 1 and p.node = x.node[1:x.d - 1]),
under as (select distinct a.node, z.node as low from path a join path z on a.conv_id = z.conv_id and z.d >= a.d)
select o.conv_id, o.d::bigint as depth, o.parent_conv_id, o.n_convs, o.n_children, count(*) filter (l.n_children = 0) as n_leaves, sum(l.saved)::bigint as saved_tokens, o.ends_sha256
from own o join under u on u.node = o.node join own l on l.node = u.low group by all""",
}
