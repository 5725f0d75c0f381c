"""Chunks that a worker has tokenized aren't tokenized again while they fit."""

import numpy as np
import pyarrow as pa

from caselens.llm import common, packing


def test_many_chunks_are_tokenized_once(monkeypatch):
    monkeypatch.setattr(packing.ChunkTokenizer, "RECENT", 1 << 18)
    tok = packing.ChunkTokenizer(packing.default_path())
    seen, add = [], tok.add
    monkeypatch.setattr(tok, "add", lambda h, size, ids: (seen.append(len(h)), add(h, size, ids)))
    texts = pa.array(["".join(f" {i}x" for i in range(k, k + 50_000)) for k in range(0, 350_000, 50_000)])

    def ids():
        return [tok.of(s)[0].copy() for s in common.slices(texts)]

    first = ids()
    assert sum(seen) == 350_000
    second = ids()
    assert sum(seen) == 350_000
    assert all(np.array_equal(a, b) for a, b in zip(first, second, strict=True))
