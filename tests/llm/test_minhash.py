import random

import numpy as np
import pytest

from cadenza.llm import minhash as m

LETTERS = [a + b for a in "abcdefghij" for b in "klmnopqrst"]


def texts(seed, groups=12, size=12):
    rng, out = random.Random(seed), {}

    def put(words):
        out[len(out) * 3 % 997 + len(out) * 1000] = " ".join(words)

    for g in range(groups):
        base = [rng.choice(LETTERS) for _ in range(rng.choice([2, 5, 40, 120]))]
        for _ in range(size):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                words[rng.randrange(len(words))] = rng.choice(LETTERS).upper()
            put(words)
    # A chain: each is linked with the next, the ends are far apart.
    chain = [rng.choice(LETTERS) for _ in range(200)]
    for k in range(25):
        chain[(k * 7) % 200] = f"new{k}"
        put(chain)
    # Copies of one text with many or few changes, more than a small bucket holds: some are linked, some with nothing.
    base = [rng.choice(LETTERS) for _ in range(150)]
    for k in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 14)):
            words[rng.randrange(len(words))] = f"own{k}{rng.randint(0, 9)}"
        put(words)
    for t in ("", " \n", "A b", "a B", "one", "\x0bone\t", "É x y", "é x y", "w " * 30_000):
        out[90_000_000 + len(out)] = t
    return out


@pytest.mark.parametrize(("size", "percent", "block"), [(3, 85, m.BLOCK_BYTES), (3, 70, 4_000), (5, 80, 20_000)])
def test_every_link_is_found(spark, size, percent, block, monkeypatch):
    monkeypatch.setattr(m, "BLOCK_BYTES", block)
    t = texts(size)
    want = m.brute_force(t, size, percent)
    rows = [(i, x, "clash") for i, x in t.items()]
    got = m.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, digest string"), size, percent).collect()
    assert {r["doc_id"]: tuple(r)[1:4] for r in got} == want and len(got) == len(want)


def test_nulls_and_repeats(spark):
    rows = [(1, None), (2, "a b c d e"), (2, "a b c d e"), (None, "A b c d e"), (None, None), (3, ""), (None, "z z"), (5, "A B C D E")]
    got = sorted((tuple(r)[:4] for r in m.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()), key=str)
    want = [(1, 0, 1, True), (2, 3, 2, True), (2, 3, 2, True), (None, 3, 2, False), (None, 0, None, True), (3, 0, 3, True), (None, 1, None, True), (5, 3, 2, False)]
    assert got == sorted(want, key=str)
    assert m.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_coordinates_estimate_similarity():
    rng = np.random.default_rng(1)
    common, own = rng.integers(0, 1 << 63, 300, dtype=np.uint64), rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    s = m.signatures([np.unique(np.concatenate([common, own[:100]])), np.unique(np.concatenate([common, own[100:]]))], 2_000)
    assert abs((s[:, 0] == s[:, 1]).mean() - 0.6) < 0.05
