"""Decontamination against plain Smith-Waterman over all pairs of documents and items."""

import re
from collections import Counter

import numpy as np
import pytest

from caselens.llm import decontaminate

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def words(t):
    return WORD.findall((t or "").translate(LOW))


def best_score(item, text):
    """Highest local alignment score (match 2, mismatch and gap -1) as a share of the item's full score, cell by cell."""
    before, best = [0] * (len(text) + 1), 0
    for w in item:
        row = [0]
        for j, t in enumerate(text):
            row.append(max(0, before[j] + (2 if t == w else -1), before[j + 1] - 1, row[j] - 1))
        best, before = max(best, max(row)), row
    return best / (2 * len(item))


def by_all_pairs(docs, items, least=0.5):
    found = {}
    counts = [Counter(words(t)) for _, t in docs]
    for i, text in items:
        own = words(text)
        need = Counter(own)
        for (d, t), count in zip(docs, counts):
            # no alignment scores more than the words that both have
            shared = sum(min(n, count[w]) for w, n in need.items())
            if own and shared >= (least if len(own) >= 3 else 1) * len(own):
                score = best_score(own, words(t))
                if score >= (least if len(own) >= 3 else 1):
                    found[d, i] = max(score, found.get((d, i), 0))
    return found


def edited(text, seed, share):
    r, out = np.random.default_rng(seed), []
    for w in text.split():
        x = r.random()
        out += [] if x < share / 3 else [w, f"in{seed}"] if x < 2 * share / 3 else [f"new{seed}"] if x < share else [w]
    return " ".join(out)


def test_on_the_smallest_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = by_all_pairs(docs, items)
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.op6_decontamination(spark, sf).collect()}
    assert got == pytest.approx({k: v for k, v in want.items() if k in got})
    missed = [v for k, v in want.items() if k not in got]
    assert len(missed) <= 0.02 * len(want), sorted(missed)


def test_edited_copies(spark):
    """Copies with a tenth to a third of their words changed, dropped or parted, in longer texts, with ties, short items and very long texts."""
    r = np.random.default_rng(4)
    vocabulary = [f"v{i}" for i in range(500)]
    prose = lambda n: " ".join(r.choice(vocabulary, n))
    items = [(i, prose(20 + i)) for i in range(25)] + [(30, "two words"), (31, "three short words"), (32, ""), (33, None), (34, prose(20))]
    items.append((35, items[0][1]))
    docs = [(100 + i, f"{prose(30)} {edited(items[i][1], i, 0.1 + i % 4 * 0.07)} {prose(40)}") for i in range(25)]
    docs += [(200, f"a two words b three short words {items[0][1]}"), (201, None), (202, ""), (203, prose(6000) + " " + items[3][1].upper()), (203, prose(20)), (None, items[4][1])]
    of = lambda rows, names: spark.createDataFrame([(*x, "q") for x in rows], names)
    got = {(x.doc_id, x.item_id): x.score for x in decontaminate.contaminated(of(docs, "doc_id long, text string, score string").repartition(3), of(items, "item_id long, text string, seeds string")).collect()}
    want = by_all_pairs(docs, items)
    assert got == pytest.approx({k: v for k, v in want.items() if k in got})
    assert len([k for k in want if k not in got]) <= 0.05 * len(want)
    assert (200, 30) in got and (200, 31) in got and (203, 3) in got and (None, 4) in got and {i for d, i in got if d == 200} >= {0, 35}
