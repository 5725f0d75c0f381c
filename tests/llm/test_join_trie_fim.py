"""The n-gram join, the conversation trie and the fill-in-middle transformation against brute force."""

import hashlib
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from caselens.llm import fim, ngram_join, prefix_trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
rng = np.random.default_rng(11)
VOCABULARY = ["".join(rng.choice(list("abcdé"), 4)) for _ in range(300)]


def prose(n, seed):
    return " ".join(np.random.default_rng(seed).choice(VOCABULARY, n))


def edited(text, seed, changes):
    words, r = text.split(), np.random.default_rng(seed)
    for i in r.choice(len(words), changes, replace=False):
        words[i] = f"w{seed}x{i}"
    return " ".join(words)


def shingle_set(text, n):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_components(rows, n, percent):
    sets, parent = [shingle_set(t, n) for _, t in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)].append(d)
    return sorted(((d, len(sets[i]), min(least[root(i)]) if least[root(i)] else None) for i, (d, _) in enumerate(rows)), key=repr)


PASSAGE, BASE = prose(60, 1), prose(150, 2)
#: a group of near copies beyond every limit, many documents that share a passage, pairs around the threshold, odd rows
JOINED = [
    *((i, edited(BASE, i, 1 + i % 4)) for i in range(60)),
    *((100 + i, prose(6 + i % 9, 50 + i) + " " + PASSAGE + " " + prose(5, 90 + i)) for i in range(50)),
    *((200 + i, edited(prose(90, 200 + i // 2), i, i % 5)) for i in range(40)),
    (300, None), (301, ""), (302, " \n\t"), (303, "one two"), (304, "ONE two"), (305, "one two three four five"), (306, "x"), (None, BASE), (None, "alone here without id at all"),
    (7, BASE), (7, BASE), (310, BASE.upper()), (311, PASSAGE), (312, "la la " * 500), (313, prose(9000, 7)), (314, edited(prose(9000, 7), 3, 200)),
]


@pytest.mark.parametrize("rare, most, k, crossed", [(8, 16, 2, 128), (2, 3, 2, 4), (2, 40, 3, 20)])
def test_join_finds_every_link(spark, rare, most, k, crossed):
    docs = spark.createDataFrame([(d, t, "z", 5) for d, t in JOINED], "doc_id long, text string, item string, prefix int").repartition(5)
    got = ngram_join.jaccard_components(docs, n=4, percent=85, k=k, rare=rare, most=most, crossed=crossed)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_components(JOINED, 4, 85)


def test_join_at_a_low_threshold(spark):
    rows = [(i, edited(prose(12 + i % 5, i // 4), i, i % 3)) for i in range(60)]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), n=2, percent=50, rare=2, most=4)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_components(rows, 2, 50)


def test_join_of_no_rows(spark):
    assert ngram_join.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_combinations(spark):
    row = spark.createDataFrame([([1, 2, 3, 4],)], "a array<long>").select(ngram_join._combinations(F.col("a"), 3).alias("c")).first()["c"]
    assert len(row) == len(set(row)) == 4


def test_join_on_the_smallest_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = ngram_join.op11_ngram_join(spark, sf)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_components(rows, 4, 85)


def brute_trie(rows, group=100, most=6):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % most
        path = (own.get(c - int(math.fmod(c, group)), [])[:h] if group else []) + turns[h if group else 0 :]
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
        ends[tuple(path)].append(c)
    out = []
    for node, convs in members.items():
        below = [x for x in members if x[: len(node)] == node]
        leaf = lambda x: not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in members)
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x)
        ids = ",".join(map(str, sorted(ends[node])))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), sum(len(x) == len(node) + 1 for x in below), sum(map(leaf, below)), saved, hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out)


TURNS = "conv_id long, turn long, role string, text string, depth string, k1 int"
CHATS = [
    *((c, t, "user" if t % 2 else "bot", f"hello {min(t, c % 7)}") for c in range(60) for t in range(1 + c % 9)),
    *((200 + c, t, "user", "same") for c in range(30) for t in range(4)),
    (105, 1, "user", "base is absent"), (400, None, None, "null turn"), (400, 2, "bot", None), (400, 2, "ann", "tie"), (400, 2, "bot", "tie"), (401, 5, "bot", "é😀"), (None, 1, "user", "no id"),
    *((500, t, "user", f"long {t}") for t in range(70)), (-5, 0, "user", "below zero"), (7, 0, "bot", "hello 0"),
]


@pytest.mark.parametrize("block", [1 << 16, 7])
def test_trie(spark, block, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    chats = spark.createDataFrame([(*x, "d", 1) for x in CHATS], TURNS).repartition(6)
    turns = prefix_trie.turn_hashes(prefix_trie.numbered(chats))
    got = prefix_trie.prefix_trie(prefix_trie.with_shared_heads(turns))
    rows = sorted(tuple(r) for r in got.collect())
    assert rows == brute_trie(CHATS)
    assert max(r[1] for r in rows) > 60


def test_trie_of_plain_conversations(spark):
    turns = prefix_trie.turn_hashes(prefix_trie.numbered(spark.createDataFrame([(*x, "d", 1) for x in CHATS], TURNS)))
    whole = turns.unionByName(prefix_trie.root_rows(turns.select("conv_id").distinct()))
    assert sorted(tuple(r) for r in prefix_trie.prefix_trie(whole).collect()) == brute_trie(CHATS, group=0)


def test_trie_of_no_rows(spark):
    turns = prefix_trie.turn_hashes(prefix_trie.numbered(spark.createDataFrame([], TURNS)))
    assert prefix_trie.prefix_trie(prefix_trie.with_shared_heads(turns)).count() == 0


def brute_fim(doc_id, text):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n, digest = len(tokens), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    if h4 % 100 < 20:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = [
    (0, None), (1, ""), (2, "a"), (3, "é"), (4, "naïve 😀😀 text,\r\nwith lines\n\n"), (5, "has <P> inside"), (6, "<S>"), (7, "a<"), (8, "> b<"), (9, "P>x<S"), (None, "no id"), (None, "no id"),
    (10, "abc" * 500), (11, prose(400, 4)), (11, prose(400, 4)), (11, prose(300, 5)), (12, "😀" * 300), (13, "<M" + "x" * 900), (14, " " * 200), (None, prose(200, 6)), (15, "x" * 64), (16, "x" * 65), (-17, "minus " * 60),
    *((100 + i, prose(5 + i, 400 + i)) for i in range(60)),
]


@pytest.mark.parametrize("chunk", [1 << 16, 64, 7])
def test_fill_in_middle(spark, chunk):
    docs = spark.createDataFrame([(d, t, "n", 4) for d, t in TEXTS], "doc_id long, text string, form string, n long").repartition(3)
    made = fim.fill_in_middle(docs, chunk=chunk)
    assert sorted((tuple(r) for r in made.collect()), key=repr) == sorted((brute_fim(d, t) for d, t in TEXTS), key=repr)
    back = made.select("doc_id", fim.restored(F.col("output"), F.col("form")).alias("text"))
    assert sorted((tuple(r) for r in back.collect()), key=repr) == sorted(((d, t or "") for d, t in TEXTS), key=repr)


def test_fill_in_middle_of_no_rows(spark):
    assert fim.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0
