"""How many pairs are compared one by one in a group of texts that are alike, but not enough to link."""

import numpy as np

from caselens.llm import near_dups


def test_alike_texts_meet_in_cells(spark, monkeypatch):
    r, n = np.random.default_rng(23), 200
    base = [f"w{i}" for i in range(240)]
    texts = []
    for k in range(n):
        at = int(r.integers(0, 220))
        texts.append(" ".join(base[:at] + [f"x{k}y{i}" for i in range(20)] + base[at + 20 :]))
    texts[7] = texts[3] + " tail"  # one link among them
    pairs, confirm = [], near_dups.confirmed

    def counted(p, *args):
        pairs.append(p.count())
        return confirm(p, *args)

    monkeypatch.setattr(near_dups, "confirmed", counted)
    got = {x.doc_id: x.component_id for x in near_dups.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), n=3, percent=85).collect()}
    assert got == {k: 3 if k == 7 else k for k in range(n)}
    # all pairs are 19,900; those of a meeting of up to 128 texts are still compared one by one
    assert sum(pairs) < 60 * n
