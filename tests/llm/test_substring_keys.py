"""Windows whose first 64 bits agree are told apart by the other 32."""

import numpy as np

from feedlake.llm import substrings


def test_fold_uses_all_bits():
    keys = np.array([5, 5, 9, 5, 9], np.uint64)
    more = np.array([1, 2, 1, 1, 1], np.uint32)
    at = np.arange(10, 15)
    _, first, repeated, again, of = substrings.fold(keys, at, more)
    assert first.tolist() == [10, 11, 12] and repeated.tolist() == [True, False, True]
    assert sorted(zip(again.tolist(), of.tolist())) == [(13, 10), (14, 12)]


def test_colliding_windows_stay(monkeypatch):
    """Two chunks hold windows of equal 64-bit keys: only the one that agrees in all bits goes."""
    real = substrings.rolling
    monkeypatch.setattr(substrings, "rolling", lambda h, width, step=substrings._STEP: np.full(len(h), 7, np.uint64) if step == substrings._STEP else real(h, width, step))
    frames = []
    words = lambda seed: np.random.default_rng(seed).integers(1, 1 << 60, 13).astype(np.uint64)
    for uid, doc_id, seed in ((1, 10, 1), (2, 20, 1), (3, 30, 2)):
        chunk = substrings.Chunk()
        chunk.add(uid, doc_id, words(seed), np.array([0], np.int32).tobytes())
        frames.append(substrings._window_rows(chunk, 1))
    import pandas as pd

    replies = substrings._window_bucket(pd.concat(frames, ignore_index=True))
    found = {}
    for _, part in replies.groupby("chunk"):
        for uid in substrings._resolve_windows(part)["uid"]:
            found[int(uid)] = True
    assert set(found) == {2}
