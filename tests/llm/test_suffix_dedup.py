import random

import numpy as np
import pytest

from cadenza.llm import suffix_dedup as s

KEYS = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]


def texts(seed, n=120):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    passage = lambda k: " ".join(word() for _ in range(k))
    common = [passage(rng.randint(15, 45)) for _ in range(5)]
    out = [None, "", "short", "é" * 300, "ab" * 200, "x" * 63, "x" * 64]
    for _ in range(n):
        parts = [passage(rng.randint(0, 30)) for _ in range(2)]
        for _ in range(rng.randint(0, 2)):
            c = rng.choice(common)
            if rng.random() < 0.4:
                k = rng.randrange(len(c))
                c = c[:k] + "Z" + c[k + 1 :]
            parts.insert(rng.randint(0, len(parts)), c)
        out.append(" ".join(parts))
    return out + out[10:20] + [out[30] + "!" + out[30], "long " + passage(12_000)]


@pytest.mark.parametrize("hot", [s.HOT, 1, 4])
def test_by_brute_force(spark, hot):
    t = texts(hot)
    docs = spark.createDataFrame([(k, x, "clash", "clash") for k, x in enumerate(t)], "doc_id long, text string, id string, same string")
    got = s.without_repeats(docs, 64, hot).toPandas().sort_values("doc_id").reset_index(drop=True)
    want = s.brute_force(t, 64)
    assert want["n_removed"].sum() > 1_000
    assert (got[KEYS].values.tolist()) == want[KEYS].values.tolist()


def test_nulls_and_repeats(spark):
    x = "".join(chr(97 + k * k % 23) for k in range(500))
    rows = [(1, x), (1, x), (None, "q" + x), (2, None), (3, "y" * 399), (4, "z" * 401)]
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept"]) for r in s.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([("1", 500, 500, 1, b""), ("1", 500, 500, 1, b""), ("None", 501, 500, 1, b"q"), ("2", 0, 0, 0, b""), ("3", 399, 0, 0, b"y" * 399), ("4", 401, 401, 1, b"")])
    assert s.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_family_finds_repeats_whatever_the_batches():
    rng = np.random.default_rng(1)
    for length in (37, 64):
        base = rng.integers(97, 99, 4_000, dtype=np.uint8).tobytes()
        contents = [base[a : a + int(rng.integers(length, 150))] for a in rng.integers(0, 3_800, 60).tolist()]
        contents = [c for c in contents if len(c) >= length]
        seen = {}
        for c in contents:
            for k in range(len(c) - length + 1):
                seen[c[k : k + length]] = seen.get(c[k : k + length], 0) + 1
        for size in (1, 3, 7, 100):
            f = s.Family(length)
            at = [x for k in range(0, len(contents), size) for x in f.add(contents[k : k + size])]
            for c, x in zip(contents, at):
                starts = np.array([k for k in range(len(c) - length + 1) if seen[c[k : k + length]] > 1], dtype=np.int64)
                assert f.spans(x, len(c)) == s.covered(starts, length)
            assert [n for n, _ in f.levels] == sorted((n for n, _ in f.levels), reverse=True)
            for _, level in f.levels:
                windows = [f.data[p : p + length].tobytes() for p in level]
                assert windows == sorted(windows)


@pytest.mark.parametrize("hot", [s.HOT, 1])
def test_batches_against_levels(spark, hot):
    # Each prefix of the batches is what one table of them would give, for rows of all batches.
    t = texts(11, 100)
    random.Random(4).shuffle(t)
    cuts, index, spans = [0, 20, 45, 60, 61, len(t)], s.Index(spark, 64, hot), None
    for a, b in zip(cuts, cuts[1:]):
        new = index.add(index.copied(spark.createDataFrame([(k, t[k]) for k in range(a, b)], "doc_id long, text string").repartition(2)))
        spans = new if spans is None else spans.union(new)
        got = s.removed(index.files, spans).toPandas().sort_values("doc_id").reset_index(drop=True)
        assert got[KEYS].values.tolist() == s.brute_force(t[:b], 64)[KEYS].values.tolist()
    assert [n for n, _ in index.levels] == [4, 1]
    level = index.levels[0][1]
    assert level.groupBy("gram", "digest").count().where("count > 1").isEmpty() and level.agg({"copies": "sum"}).first()[0] > level.count()
