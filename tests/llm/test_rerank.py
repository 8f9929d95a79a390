"""What op3 reranks one by one."""

import numpy as np

from knowspan.llm import ann


def test_few_vectors_are_reranked_one_by_one(monkeypatch):
    r, k = np.random.default_rng(3), 20
    x = np.concatenate([r.normal(size=(3000, 64)), np.zeros((40, 64)) + 0.5])
    codes_of = ann.rotation(64)
    c = x.mean(0)
    far = np.sqrt(((x - c) ** 2).sum(1))
    unit = (x - c) / far[:, None] @ codes_of.T
    looked = []
    exact = ann.exact
    monkeypatch.setattr(ann, "exact", lambda q, v: looked.append(len(v)) or exact(q, v))
    ids = np.arange(len(x))
    out = ann.nearest_in_block(x[:50], ids, x, np.packbits(unit > 0, axis=1), far, np.abs(unit).sum(1) / 8, ids[:50], c, codes_of, k, 0)
    for q, found, scores in out:
        s = exact(x[q], x)
        s[q] = -np.inf
        best = np.lexsort((ids, -s))[:k]
        assert len(set(found) & set(best)) >= 19 and (np.diff(scores) <= 0).all()
    assert max(looked) <= k + 40
