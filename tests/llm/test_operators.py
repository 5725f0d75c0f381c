"""The text operators against brute force on small tables with nulls, blanks, repeats and clashing columns."""

import hashlib
import re
import zlib
from collections import Counter
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions

from caselens.llm import common, decontaminate, fingerprints, licenses, line_dedup, links, lm_scores, near_dups, packing, substrings, toxicity, url_filters

rng = np.random.default_rng(3)
WORDS = ["".join(rng.choice(list("abcdeé"), 5)) for _ in range(400)]
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def prose(n, seed):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


A, B = prose(120, 1), prose(120, 2)
TEXTS = [
    (0, A), (1, A), (2, A.replace(A.split()[60], "Zzz", 1)), (3, B), (4, B[:200] + "\n" + A), (5, None), (6, ""), (7, " \n\t "), (8, "one two"), (9, "ONE two"), (10, "x"),
    (11, "Is on. " * 300), (12, prose(3000, 5)), (13, prose(60, 6) + "\n" + prose(40, 7)), (14, prose(60, 6) + " z\n" + prose(40, 7)), (None, "no id here at all"), (3, B), (15, "naïve\u00a0 <|endoftext|> don't  \n\n é été"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 7, "q") for i, t in TEXTS], "doc_id long, text string, component_id int, n_lines string").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def words(t):
    return WORD.findall((t or "").translate(LOW))


def components(sets, links):
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if links(sets[i], sets[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(sets))]


def test_near_dups(docs, none):
    sets = [frozenset(tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))) if (w := words(t)) else frozenset() for _, t in TEXTS]
    comp = components(sets, lambda a, b: bool(a) and 100 * len(a & b) >= 85 * len(a | b))
    least = {}
    for (i, _), c in zip(TEXTS, comp):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    want = sorted(((i, len(s), i if not s else least.get(c)) for (i, _), s, c in zip(TEXTS, sets, comp)), key=str)
    got = near_dups.near_duplicates(docs, n=3, percent=85).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert near_dups.near_duplicates(none).count() == 0


def test_match_threshold():
    assert near_dups.match_threshold(32, 0.85) >= 16
    assert near_dups.match_threshold(32, 0.8) < near_dups.match_threshold(32, 0.9)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(50, 40), (41, 50), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in common.connected_components(edges).collect()}
    assert got == {**dict.fromkeys(range(1, 31), 1), 40: 40, 41: 40, 50: 40}


@pytest.mark.parametrize("head", [0, 2])
def test_cells(spark, monkeypatch, head):
    """Large keys in cells give the components that brute force gives, and that pairs give."""
    monkeypatch.setattr(links, "BLOCK", 7)
    r = np.random.default_rng(8)
    base = r.integers(1, 1 << 40, (3, 60))
    sets = {i: np.unique(np.where(r.random(60) < 0.07 * (i % 4), r.integers(1, 1 << 40, 60), base[i % 3])).astype(np.uint64) for i in range(60)}
    elems = {i: np.concatenate([u[:head], u]) for i, u in sets.items()}
    found = spark.createDataFrame([(i, e.tobytes(), len(sets[i]), 0, 0) for i, e in elems.items()], "item long, elems binary, size int, bits0 long, bits1 long").repartition(3)
    postings = spark.createDataFrame([(key, i) for key in (1, 2) for i in range(60) if key == 1 or i % 5], "key long, item long")

    def link(a, b):
        same = len(np.intersect1d(sets[a], sets[b]))
        return 10 * same >= 8 * (len(sets[a]) + len(sets[b]) - same) and (elems[a][:head] == elems[b][:head]).all()

    want = components(list(range(60)), link)
    monkeypatch.setattr(links, "PAIRED", 4)
    monkeypatch.setattr(links, "CROSSED", 50)
    posted = postings.withColumn("n", functions.lit(60))
    for rounds, cells in ((0, lambda p, found: links.in_cells(p, found, 8, 10, head, head)), (1, lambda p, found: links.in_cells(p, found, 8, 10, head, head)), (0, None), (1, None)):
        got = {x.node: x.component for x in links.link_components(posted, found.drop("elems"), "true", lambda need: found, lambda q, sets: links.confirmed(q, sets, 8, 10, head, head), cells, rounds).collect()}
        assert [got.get(i, i) for i in range(60)] == want


def test_line_dedup(docs, none):
    got = line_dedup.dedup_lines(docs).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, r)
    assert by[0].text == A and by[1].text == "" and by[1].n_removed == 1
    assert by[4].text == B[:200] and by[5].text is None and by[5].n_lines == 0 and by[7].text == " \n\t "
    assert by[14].text == "" and by[14].n_removed == 2  # one exact line, one fuzzy line
    assert by[9].text == "" and by[12].n_removed == 0 and by[0].component_id == 7
    assert line_dedup.dedup_lines(none).count() == 0


def test_edited_lines(spark):
    """Lines of 60 to 120 characters with one character or, from 100 on, one word changed go."""
    rows, r = [], np.random.default_rng(17)
    for k in range(120):
        line = prose(40, 2000 + k)[: (60, 80, 100, 120)[k % 4]].strip() + "xy"
        i = int(r.integers(20, 40))
        w = line.split()
        w[len(w) // 2] = "qwrtz"
        rows += [(10 * k, line), (10 * k + 1, line[:i] + "#" + line[i + 1 :]), (10 * k + 2, " ".join(w) if len(line) > 97 else None)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(x.n_removed == (x.doc_id % 10 > 0 and x.text is not None) for x in got)


def test_lines_of():
    texts = ["a\n\n b c \r\nq", "", "\n", "x\n"]
    (s,) = common.slices(pa.array(texts))
    a, b, first = line_dedup.split_lines(s)
    raw = s.data.tobytes()
    assert [[raw[a[i] : b[i]].decode() for i in range(p, q)] for p, q in pairwise(first)] == [[x.strip() for x in t.split("\n")] for t in texts]


@pytest.mark.parametrize("bucket", [4096, 2])
def test_substrings(docs, none, monkeypatch, bucket):
    monkeypatch.setattr(substrings, "BUCKET", bucket)
    monkeypatch.setattr(substrings, "LARGE", bucket)
    raw = [(t or "").encode() for _, t in TEXTS]
    n = Counter(t[i : i + 400] for t in raw for i in range(len(t) - 399))
    want = []
    for (i, _), t in zip(TEXTS, raw):
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 399):
            if n[t[k : k + 400]] > 1:
                gone[k : k + 400] = True
        runs = int((gone & ~np.append(False, gone[:-1])).sum()) if len(t) else 0
        want.append((i, len(t), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    got = [tuple(r)[:5] for r in substrings.remove_repeats(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert substrings.remove_repeats(none).count() == 0


@pytest.mark.parametrize("large", [8192, 3])
def test_substrings_of_long_texts(spark, monkeypatch, large):
    """A text of several segments, a passage that many texts share, and its edges, where contexts share most of their bytes."""
    monkeypatch.setattr(substrings, "BUCKET", 3)
    monkeypatch.setattr(substrings, "LARGE", large)
    r = np.random.default_rng(12)
    letters = lambda n: "".join(map(chr, r.integers(97, 123, n)))
    long, passage = letters(5 << 20), letters(700)
    cut = (1 << 20) - 300
    texts = [long[:3000000] + long[cut : cut + 900] + long[3000000:]] + ["A" + letters(299) + chr(97 + i) + "Q" + passage + "Q" + chr(97 + i) + letters(299) + "B" for i in range(12)] + ["a" * 600_000, "b" * 401, "short", None, ""]
    want = [(0, 1800, 2)] + [(i, 702, 1) for i in range(1, 13)] + [(13, 600_000, 1), (14, 401, 1), (15, 0, 0), (16, 0, 0), (17, 0, 0)]
    got = substrings.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()
    assert sorted((x.doc_id, x.n_removed, x.n_spans) for x in got) == want
    assert {x.doc_id: x.text for x in got}[15] == "short" and all(len(x.text) == 602 for x in got if 0 < x.doc_id < 13)


def test_difference_cover():
    for v in (8, 64):
        d = substrings.difference_cover(v)
        assert {(a - b) % v for a in d for b in d} == set(range(v))


def test_packing(docs, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_path())
    want = []
    for i, t in TEXTS:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        cut = len(ids) % 1024 or 1024
        want += [(i, k, p, q - p, zlib.crc32(np.array(ids[p:q], "<u4").tobytes())) for k, (p, q) in enumerate(pairwise([0, *range(cut, len(ids) + 1, 1024)]))]
    got = packing.pack_documents(docs).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 1024
    assert len(bins) <= -(-sum(w[3] for w in want) // 1024) + 1
    assert packing.pack_documents(none).count() == 0


def test_best_fit():
    bins = packing.best_fit(np.array([600, 500, 400, 300, 124, 100]), 1024)
    assert sorted(i for b in bins for i in b) == list(range(6)) and len(bins) == 2


def test_packing_rounds(spark, monkeypatch):
    """Every round packs in several partitions before one is left, and loses no piece."""
    monkeypatch.setattr(packing, "ROUND_ROWS", 20, raising=False)
    d = spark.createDataFrame([(i, prose(20 + i % 90, 700 + i)) for i in range(400)], "doc_id long, text string")
    got = packing.pack_documents(d, fan_in=4, nearly=0.98).collect()
    want = packing.pack_documents(d, capacity=1 << 20).collect()
    assert sum(r.length for r in got) == sum(r.length for r in want) and {r.doc_id for r in got} == set(range(400))
    fill, tasks = Counter(), {}
    for r in got:
        fill[r.sequence_id] += r.length
        tasks.setdefault(r.sequence_id >> 56, set()).add(r.sequence_id >> 32 & 0xFFFFFF)
    assert max(fill.values()) <= 1024 and len(tasks.keys() - {0}) >= 3 and len(tasks[1]) > 8 and len(tasks[max(tasks)]) == 1
    assert len(fill) <= 1.1 * len(packing.best_fit(np.array([r.length for r in got]), 1024)) + 1


def test_packing_batches(spark):
    """Underfull bins of one batch meet the items of the next one."""
    member = [(1, 0, 0, 1, 0)]
    items = spark.createDataFrame([(n, member) for n in [600] * 40 + [424] * 40], f"size long, members {packing.MEMBERS}").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        out = items.mapInArrow(packing._packed(1024, 1023, True, 20), f"done boolean, bin long, size long, members {packing.MEMBERS}").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sum(r["size"] for r in out) == 40 * 1024 and len(out) < 65 and len({r.bin for r in out}) == len(out)


def test_decontamination(spark, docs, none):
    item = prose(35, 40).split()
    edited = [w if i % 6 else "qqq" for i, w in enumerate(item)]
    leaks = spark.createDataFrame([(100, prose(80, 41) + " " + " ".join(item) + " " + prose(50, 42)), (101, " ".join(edited).replace("a", "A")), (102, prose(200, 43))], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, prose(30, 44)), (3, None), (4, ""), (5, "two words")], "item_id long, text string")
    every = docs.select("doc_id", "text").unionByName(leaks)
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(every, bench).collect()}
    assert set(got) == {(100, 1), (101, 1)}
    assert got[100, 1].score == 1 and (got[100, 1].first_word, got[100, 1].end_word) == (80, 115)
    assert decontaminate.without_contaminated(every, bench).count() == every.count() - 2
    assert decontaminate.contaminated(none, bench).count() == 0
    assert decontaminate.contaminated(every, bench.limit(0)).count() == 0


def test_align():
    a = np.array([1, 2, 3, 4, 5], np.uint64)
    assert decontaminate.align(a, np.array([9, 9, 1, 2, 3, 4, 5, 9], np.uint64)) == (1.0, 2, 7)
    score, p, q = decontaminate.align(a, np.array([1, 2, 4, 5], np.uint64))
    assert (score, p, q) == (7 / 10, 0, 4)


def test_toxicity(spark, none):
    bad = ["vilest", "rotten"]
    rows = [(i, prose(50, 100 + i) + (" " + bad[i % 2] if i % 5 == 0 else "")) for i in range(300)]
    d = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(200)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(d, toxicity.grades_of(labels))
    got = {r.doc_id: r for r in toxicity.score(d, model).collect()}
    assert all(got[i].toxic == (i % 5 == 0) for i in range(200, 300)) and not got[900].toxic and not got[901].toxic
    assert np.mean([got[i].expected_severity for i in range(200, 300, 5)]) > 0.5
    untrained = toxicity.train(d, toxicity.grades_of(labels.limit(0)))
    assert toxicity.score(d, untrained).where("toxic").count() == 0 and toxicity.score(none, model).count() == 0


def test_fingerprints(spark, docs, none):
    key = [(i if i is not None else -1, t or "") for i, t in TEXTS if i != 3]
    key.sort(reverse=True)
    got = {r.doc_id if r.doc_id is not None else -1: r for r in fingerprints.fingerprint_documents(docs.where("doc_id <> 3 or doc_id is null")).collect()}
    for (i, t), (_, x) in zip(key, key[1:] + key[:1]):
        edited = t[: len(t) - len(t) // 2] + x[: len(t) // 2]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert got[0].fingerprint == got[1].fingerprint and got[0].class_id == got[1].class_id == 0
    assert got[8].fingerprint == got[9].fingerprint
    assert fingerprints.fingerprint_documents(none).count() == 0


def test_within_radius(spark):
    base = rng.integers(0, 256, 32, dtype=np.uint8)
    near, far = base.copy(), base.copy()
    near[[1, 9, 17, 30]] ^= np.uint8(1)
    far[::3] ^= np.uint8(3)
    rows = [(x.tobytes().hex(),) for x in (base, near, far)]
    got = {r.fingerprint: r.class_item for r in fingerprints.within_radius(spark.createDataFrame(rows, "fingerprint string"), 7).collect()}
    assert got[rows[0][0]] == got[rows[1][0]] != got[rows[2][0]]


def test_toxicity_of_few_rows(spark):
    """Words that a handful of labelled rows hold count: no number of rows is needed before anything is rejected."""
    bad = ["scumlike", "widerlich", "asqueroso"]
    d = spark.createDataFrame([(i, prose(30, 900 + i) + (" " + bad[i // 8 % 3] if i % 8 == 0 else "")) for i in range(240)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 8 == 0)) for i in range(96)], "doc_id long, quality int, toxic int")  # four rows for each word
    model = toxicity.train(d, toxicity.grades_of(labels))
    held = {r.doc_id: r.toxic for r in toxicity.score(d, model).where("doc_id >= 96").collect()}
    assert sum(held[i] for i in range(96, 240, 8)) >= 15 and sum(v for i, v in held.items() if i % 8) <= 6


@pytest.mark.parametrize("cell", [None, 40])
def test_near_copies_share_a_class(spark, monkeypatch, cell):
    """Texts with words changed are found, and classes are those of all pairs of fingerprints."""
    if cell:
        monkeypatch.setattr(fingerprints, "CELL", (cell, cell))
    r, texts = np.random.default_rng(5), []
    for k in range(40):
        w = prose(100, 500 + k).split()
        texts.append(" ".join(w))
        for changed in (1, 2, 6):
            v = list(w)
            for i in r.choice(100, changed, replace=False):
                v[i] = f"new{i}"
            texts.append(" ".join(v))
    got = {x.doc_id: x for x in fingerprints.fingerprint_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all(got[i].class_id == i // 4 * 4 for i in range(160) if i % 4 < 3)
    bits = [np.frombuffer(bytes.fromhex(got[i].fingerprint), np.uint8) for i in range(160)]
    assert [got[i].class_id for i in range(160)] == components(bits, lambda a, b: np.bitwise_count(a ^ b).sum() <= 38)


def test_lm_scores(docs, none, monkeypatch):
    monkeypatch.setattr(lm_scores, "FREQUENT", 20)
    out = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 10 == 0
    c = Counter(w for i, t in TEXTS if not out(i) for w in [*words(t), "\0end"])
    n, z = sum(c.values()), np.log10(sum(c.values()) + 0.1 * (len(c) + 1))
    want = sorted(((i, out(i), len(words(t)) + 1, sum(c[w] > 0 for w in words(t)) + 1, n) for i, t in TEXTS), key=str)
    got = lm_scores.score_documents(docs).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == want
    text = {i: t for i, t in TEXTS}
    for r in got:
        assert r.base_score == pytest.approx(sum(np.log10(c[w] + 0.1) - z for w in [*words(text[r.doc_id]), "\0end"]), abs=1e-6) and r.score < 0
    assert lm_scores.score_documents(none).count() == 0


def test_lm_normalised():
    share = np.full(lm_scores.CLASSES, 1 / lm_scores.CLASSES)
    p = lm_scores.start(share)
    ctx = np.zeros((lm_scores.CONTEXT, lm_scores.CLASSES), np.int64)
    assert np.exp(lm_scores.log_probs(p, np.arange(lm_scores.CLASSES), ctx)).sum() == pytest.approx(1, abs=1e-5)


def test_urls(spark):
    rows = [(1, "http://A.b.NET/x?q"), (2, "https://example.net/en/1"), (3, "http://m.example.com/de/"), (4, "http://org/fr/#a"), (5, None), (6, "no scheme"), (7, "http://spam-x.example.com/en/"), (8, "http://net?x"), (1, "http://A.b.NET/x?q"), (9, "x://knet/")]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 as host")
    want = {1: ("a.b.net", "/x", "net/", "block"), 2: ("example.net", "/en/1", "example.net/en/", "allow"), 3: ("m.example.com", "/de/", "example.com/de/", "block"), 4: ("org", "/fr/", "org/fr/", "allow"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("spam-x.example.com", "/en/", None, "block"), 8: ("net", "", None, "allow"), 9: ("knet", "/", None, "allow")}
    for limit in (200, 0):
        got = url_filters.judge_urls(pages, in_plan=limit).collect()
        assert len(got) == 10 and {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == want
    assert url_filters.judge_urls(pages.limit(0)).count() == 0


def test_licenses(spark, docs, none):
    rows = [(200, "Released under the MIT License. " + prose(60, 80)), (201, prose(50, 81) + "\nLicensed under the Apache License, Version 2.0."), (202, "Licensed under CC BY-NC 4.0."), (203, prose(90, 82))]
    every = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    model = licenses.train(every.select(every.doc_id.alias("key"), "text"))
    got = {r.doc_id: r.license for r in licenses.scan(every, model).collect()}
    assert [got[i] for i in (200, 201, 202, 203)] == ["MIT", "Apache-2.0", "CC-BY-NC-4.0", "unknown"]
    twice = spark.createDataFrame([(1, "Released under the MIT License.\nplain words here\nReleased under the MIT License.")], "doc_id long, text string")
    assert licenses.scan(twice, model).first().n_licenses == 2
    assert all(got[i] == "unknown" for i, _ in TEXTS) and licenses.scan(none, model).count() == 0
    wrapped = [
        (1, "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights", "MIT"),
        (2, prose(30, 83) + "\n\n * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions\r\n * are met:\n\n" + prose(30, 84), "BSD-3-Clause"),
        (3, "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License.", "GPL-3.0"),
        (4, "Licensed under CC BY-NC-ND 4.0.", "CC-BY-NC-ND-4.0"), (5, "Licensed under CC BY 4.0.", "CC-BY-4.0"), (6, None, "unknown"), (5, "Licensed under CC BY 4.0.", "CC-BY-4.0"),
        (7, "the license of\nthis kind\n\n" + prose(200_000, 85), "unknown"),
    ]
    clashing = spark.createDataFrame([(i, t, "a", 3) for i, t, _ in wrapped], "doc_id long, text string, license string, key int")
    assert sorted((r.doc_id, r.license) for r in licenses.scan(clashing, model).collect()) == sorted((i, f) for i, _, f in wrapped)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    d = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in TEXTS], "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, prose(30, 6)[:150])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().collect()}
    assert {0, 3, 4, 11, 12} <= left and 1 not in left and 9 not in left


def test_lines_against_all_pairs(spark):
    """Every line of sf0.001: what goes is what all pairs of lines by exact Jaccard and their components say."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    first, where = {}, []
    for r in sorted(docs.collect()):
        for no, raw in enumerate((r.text or "").split("\n")):
            line = raw.strip(" \t\n\r\x0b\x0c").translate(LOW)
            if line:
                where.append((line, r.doc_id, no))
                first.setdefault(line, (r.doc_id, no))
    lines = sorted(first, key=lambda x: len(x))
    sets = [frozenset(x[i : i + 5] for i in range(max(1, len(x) - 4))) for x in lines]
    by, links = {}, []
    for i, own in enumerate(sets):
        n = Counter(j for g in own for j in by.get(g, ()))
        links += [(i, j) for j, both in n.items() if 10 * both >= 8 * (len(own) + len(sets[j]) - both)]
        for g in own:
            by.setdefault(g, []).append(i)
    parent = list(range(len(lines)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in links:
        parent[root(i)] = root(j)
    stays = {}
    for i, line in enumerate(lines):
        stays[root(i)] = min(stays.get(root(i), first[line]), first[line])
    number = {line: i for i, line in enumerate(lines)}
    gone = Counter(d for line, d, no in where if (d, no) != stays[root(number[line])])
    assert len(links) > 10
    assert {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(docs).collect() if r.n_removed} == dict(gone)


def test_pipeline_near_dedup_rows(spark):
    """Repeated and null ids, rows that repeat whole, blank texts and a column of the key's name."""
    import corpus_pipeline

    near = A.replace(A.split()[60], "Zzz", 1)
    rows = [(1, A), (2, near), (2, B), (2, B), (None, near), (None, prose(60, 91)), (None, prose(60, 91)), (5, prose(60, 91)), (6, ""), (6, ""), (7, None), (0, prose(50, 92))]
    docs = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, row_key int").repartition(3)
    out = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    want = [(1, A), (2, B), (5, prose(60, 91)), (6, ""), (6, ""), (7, None), (0, prose(50, 92))]
    assert out.columns == docs.columns and Counter((r.doc_id, r.text, r.row_key) for r in out.collect()) == Counter((i, t, 9) for i, t in want)
    assert corpus_pipeline.drop_near_duplicates(spark, docs.limit(0), "").count() == 0


def test_pipeline_empty(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, extra int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_workers_forget():
    """A packing task keeps the tokenizer for the next one; another operator's task frees it."""
    packing.tokenizer(packing.default_path())
    common.leave_to(packing.__name__)
    assert packing._tokenizers
    assert list(common.tidy(toxicity._some_rows)([])) == [] and not packing._tokenizers
