"""13. Fill-in-middle transformation: cuts between tokens, found by chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices, tidy, written

CHUNK = 1 << 16
SENTINELS = ("<P>", "<S>", "<M>")
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
LEAD = (np.arange(256) & 0xC0) != 0x80


def token_starts(data: np.ndarray, before: int = 0) -> np.ndarray:
    """Whether each byte from number `before` on starts a token; the one before it, if there, is only looked at.

    A token starts at the first byte of a code point, unless it and the byte before are both letters. Bytes of longer code
    points are no letters, so that a chunk may end anywhere.
    """
    letter = LETTER[data]
    start = LEAD[data]
    start[1:] &= ~(letter[1:] & letter[:-1])
    return start[before:]


def _draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from a document's id; a null id counts as no digits."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def _short_cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of one chunk: tokens, and code points before and between the cuts; the other columns pass."""
    for x in batches:
        h1, h2 = (x.column(k).to_numpy() for k in ("h1", "h2"))
        n, low, high = (np.zeros(x.num_rows, np.int64) for _ in range(3))
        for s in slices(x.column("text")):
            start = token_starts(s.data)
            start[s.offsets[:-1][s.offsets[:-1] < s.offsets[1:]]] = True
            at = np.append(np.flatnonzero(start), len(s.data))
            first = np.searchsorted(at[:-1], s.offsets)
            rows = slice(s.first, s.first + s.n)
            k = np.diff(first)
            n[rows] = k
            a, b = h1[rows] % (k + 1), h2[rows] % (k + 1)
            # the rank after a text's last token is the text's end
            cut = lambda r: np.where(r < k, at[np.minimum(first[:-1] + r, len(at) - 1)], s.offsets[1:])  # noqa: E731, B023
            chars = np.append(0, np.cumsum(LEAD[s.data]))
            begin = chars[s.offsets[:-1]]
            low[rows], high[rows] = chars[cut(np.minimum(a, b))] - begin, chars[cut(np.maximum(a, b))] - begin
        yield pa.RecordBatch.from_arrays([*(x.column(c) for c in ("doc_id", "text", "h3", "h4")), pa.array(n), pa.array(low), pa.array(high)], names=["doc_id", "text", "h3", "h4", "n", "low", "high"])


def _long_cuts(long: DataFrame, chunk: int) -> DataFrame:
    """Texts of several chunks, with the same columns: chunks are dealt to all tasks and counted there; prefix sums
    over a text's counts give the chunks that hold the two cut ranks, and those alone are scanned again."""

    def cut(batches):
        for x in batches:
            for i in range(x.num_rows):
                data = np.frombuffer(x.column(2)[i].as_buffer(), np.uint8)
                for first in range(0, len(data), 64 * chunk):
                    starts = range(first, min(len(data), first + 64 * chunk), chunk)
                    k = len(starts)
                    parts = [data[max(0, a - 1) : a + chunk].tobytes() for a in starts]
                    keys = [pa.array([x.column(j)[i].as_py()] * k, pa.int64()) for j in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*keys, pa.array([a // chunk for a in starts], pa.int32()), pa.array(parts, pa.binary())], names=["k1", "k2", "chunk", "data"])

    def counted(batches):
        for x in batches:
            of = [(np.frombuffer(x.column(3)[i].as_buffer(), np.uint8), int(x.column(2)[i].as_py() > 0)) for i in range(x.num_rows)]
            starts = [int(token_starts(d, b).sum()) for d, b in of]
            chars = [int(LEAD[d[b:]].sum()) for d, b in of]
            yield pa.RecordBatch.from_arrays([*(x.column(j) for j in range(4)), pa.array(starts, pa.int64()), pa.array(chars, pa.int64())], names=["k1", "k2", "chunk", "data", "starts", "chars"])

    def rescanned(batches):
        for x in batches:
            out = []
            for i in range(x.num_rows):
                d, b = np.frombuffer(x.column(5)[i].as_buffer(), np.uint8), int(x.column(6)[i].as_py() > 0)
                at = np.flatnonzero(token_starts(d, b))[x.column(3)[i].as_py()]
                out.append(x.column(4)[i].as_py() + int(LEAD[d[b : b + at]].sum()))
            yield pa.RecordBatch.from_arrays([*(x.column(j) for j in range(3)), pa.array(out, pa.int64())], names=["k1", "k2", "last", "at"])

    # what is found depends on id and text alone, so equal rows share it
    keyed = long.withColumns({"k1": F.xxhash64("doc_id", "text"), "k2": F.xxhash64(F.lit(13), "text")})
    once = keyed.select("k1", "k2", F.col("text").cast("binary").alias("text"))
    chunks = once.mapInArrow(tidy(cut), "k1 long, k2 long, chunk int, data binary").repartition("k1", "k2", "chunk")
    chunks = written(chunks.mapInArrow(tidy(counted), "k1 long, k2 long, chunk int, data binary, starts long, chars long"), "chunks")
    whole = Window.partitionBy("k1", "k2")
    earlier = whole.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = chunks.groupBy("k1", "k2", "chunk").agg(F.first("starts").alias("starts"), F.first("chars").alias("chars"))
    sums = counts.withColumns({"before": F.coalesce(F.sum("starts").over(earlier), F.lit(0)), "chars_before": F.coalesce(F.sum("chars").over(earlier), F.lit(0)), "n": F.sum("starts").over(whole), "all_chars": F.sum("chars").over(whole)})
    ranks = keyed.select("k1", "k2", "h1", "h2").dropDuplicates(["k1", "k2"])
    sums = written(sums.join(ranks, ["k1", "k2"]).withColumns({h: F.col(h) % (F.col("n") + 1) for h in ("h1", "h2")}), "chunk_sums")
    cuts = sums.select("*", F.explode(F.array(F.struct(F.lit(0).alias("last"), F.least("h1", "h2").alias("rank")), F.struct(F.lit(1).alias("last"), F.greatest("h1", "h2").alias("rank")))).alias("c"))
    cuts = cuts.select("*", "c.*").drop("c")
    owned = cuts.where("rank >= before and rank < before + starts").select("k1", "k2", "last", (F.col("rank") - F.col("before")).alias("rank"), "chars_before", "chunk")
    scanned = owned.join(chunks.select("k1", "k2", "chunk", "data").dropDuplicates(["k1", "k2", "chunk"]), ["k1", "k2", "chunk"]).select("k1", "k2", "last", "rank", "chars_before", "data", "chunk")
    found = scanned.mapInArrow(tidy(rescanned), "k1 long, k2 long, last int, at long")
    # a rank after the last token is the end of the text
    ends = cuts.where("chunk = 0 and rank = n").select("k1", "k2", "last", F.col("all_chars").alias("at"))
    per = found.unionByName(ends).groupBy("k1", "k2").agg(F.max(F.when(F.col("last") == 0, F.col("at"))).alias("low"), F.max(F.when(F.col("last") == 1, F.col("at"))).alias("high"))
    per = per.join(sums.where("chunk = 0").select("k1", "k2", "n"), ["k1", "k2"])
    return keyed.join(per, ["k1", "k2"]).select("doc_id", "text", "h3", "h4", "n", "low", "high")


def fill_in_middle(docs: DataFrame, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, n (tokens), form, prefix_chars, middle_chars, output (text).

    Tokens are runs of A-Z and a-z, and any other code point alone. Two ranks drawn from the seed and the id cut a text
    between tokens into prefix, middle and suffix. Its form is plain, psm or spm, see `arranged`. Texts of up to `chunk`
    bytes are one chunk; longer ones are cut into overlapping chunks, which any task counts, so that no text is scanned by one task alone.

    A null text is empty, and an empty text is plain, with 0 tokens. A null id draws as no digits do. Repeated rows have equal
    results, ids are not compared with each other, and no rows give no rows. A text that holds a sentinel is plain. Columns
    other than id and text are not read.
    """
    h1, h2, h3, h4 = _draws(F.col("doc_id"), seed)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    d = d.withColumns({"h1": h1, "h2": h2, "h3": h3, "h4": h4})
    size = F.octet_length("text")
    found = d.where(size <= chunk).mapInArrow(tidy(_short_cuts), "doc_id long, text string, h3 long, h4 long, n long, low long, high long")
    long = d.where(size > chunk)
    if not long.isEmpty():
        found = found.unionByName(_long_cuts(long, chunk))
    held = F.lit(False)
    for s in SENTINELS:
        held = held | F.contains("text", F.lit(s))
    plain = (F.col("text") == "") | held | (F.col("h3") % 100 >= 100 - plain_percent)
    found = found.withColumn("form", F.when(plain, "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm"))
    shown = lambda c: F.when(F.col("form") != "plain", c)
    return found.select("doc_id", "n", "form", shown(F.col("low")).alias("prefix_chars"), shown(F.col("high") - F.col("low")).alias("middle_chars"), arranged().alias("output"))


def arranged() -> Column:
    """The output of text, form, low and high: plain is the text; psm is <P>prefix<S>suffix<M>middle, spm <S>suffix<P>prefix<M>middle."""
    text, low, high = F.col("text"), F.col("low").cast("int"), F.col("high").cast("int")
    p, s, m = (F.lit(x) for x in SENTINELS)
    prefix, middle, suffix = F.substring(text, F.lit(1), low), F.substring(text, low + 1, high - low), F.substring(text, high + 1, F.char_length(text))
    return F.when(F.col("form") == "plain", text).when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(F.concat(p, prefix, s, suffix, m, middle))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    parts = F.split(output, "<[PSM]>")
    part = lambda *k: F.concat(*(F.get(parts, F.lit(i)) for i in k))
    return F.when(form == "plain", output).when(form == "spm", part(2, 3, 1)).otherwise(part(1, 3, 2))


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fill-in-middle form, as digests of its output and of the text rebuilt from it."""
    made = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


QUERIES = {"op13_fim": op13_fim}
ORACLE_SQL = {
    "op13_fim": """
with d as (select doc_id, coalesce(text, '') as t, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
k as (select doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') as tok, ('0x' || substr(h, 1, 8))::bigint as h1, ('0x' || substr(h, 9, 8))::bigint as h2,
  ('0x' || substr(h, 17, 8))::bigint as h3, ('0x' || substr(h, 25, 8))::bigint as h4 from d),
r as (select *, len(tok) as n, least(h1 % (len(tok) + 1), h2 % (len(tok) + 1)) as a, greatest(h1 % (len(tok) + 1), h2 % (len(tok) + 1)) as b,
  case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from k),
s as (select *, coalesce(array_to_string(tok[1:a], ''), '') as p, coalesce(array_to_string(tok[a + 1:b], ''), '') as m, coalesce(array_to_string(tok[b + 1:n], ''), '') as u from r)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || u || '<M>' || m else '<S>' || u || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(t) as restored_sha256 from s""",
}
