import random
from fractions import Fraction
from math import comb

from cadenza.llm import quality_rules as q

TEXTS = ["", " \n\t", "a", "a b", "a b c", "a b c a b c", "x x x x x", "#a $b|c <d>\n#a $b|c <d>\n\n\n", "one\x0btwo\x0cthree four", "é😀 ü 日本\r\nÉ", "line a\nline a \nline a\nb", "a b c d a b c e b c d"]


def test_counts_by_the_letter():
    rng = random.Random(2)
    more = ["".join(rng.choice(["a", "b", "c", " ", " ", "\n", "#", "|"]) for _ in range(rng.randint(0, 80))) for _ in range(500)]
    for text in TEXTS + more:
        assert q.counts(text)[:5] == tuple(q.brute_counts(text)), text


def test_binomial_is_exact():
    for n, k, p in ((10, 0, 0.1), (50, 2, 0.1), (300, 5, 0.03), (2_000, 3, 0.005)):
        f = Fraction(p)
        want = float(sum(comb(n, j) * f**j * (1 - f) ** (n - j) for j in range(k + 1)))
        assert abs(q.binomial_cdf(k, n, p) - want) < 1e-9 * max(want, 1e-9)
    n = q.least_labels(0.01, 0.05)
    assert q.certified(0, n, 0.01, 0.05) and not q.certified(0, n - 1, 0.01, 0.05)


def documents(spark):
    rng, rows, labels = random.Random(1), [], []
    for k in range(6_000):
        junk = k % 10 == 0
        words = [rng.choice("abcdefgh") * rng.randint(1, 6) + ("***" if junk else "") for _ in range(60)]
        rows.append((k, " ".join(words) + (" %" if rng.random() < 0.05 else ""), ("xx", "yy")[k % 3 == 0] if k % 50 else None, "clash"))
        labels.append((k, int(not junk)))
    rows += [(7, rows[7][1], "xx", "clash"), (None, rows[8][1], "xx", "clash"), (9_000, None, "xx", "clash"), (9_001, "w " * 20_000, "zz", "clash")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_rejects_junk_and_keeps_good(spark):
    docs, labels = documents(spark)
    got = q.quality_rules(docs, labels).collect()
    assert len(got) == docs.count()
    verdict = {r["doc_id"]: r["kept"] for r in got if r["doc_id"] is not None}
    good = [verdict[k] for k in range(6_000) if k % 10]
    assert sum(good) > 0.98 * len(good)
    # The null stratum has too few labels; the others reject all junk.
    assert not any(verdict[k] for k in range(0, 6_000, 10) if k % 50)
    assert all(verdict[k] for k in range(0, 6_000, 50))
    assert not verdict[9_000] and not verdict[9_001]
    kept = q.keep_good(docs, labels)
    assert kept.schema == docs.schema and kept.count() == sum(r["kept"] for r in got)


def test_without_labels_or_rows(spark):
    docs, labels = documents(spark)
    got = q.quality_rules(docs.limit(50), labels.limit(0)).collect()
    assert all(r["kept"] != r["base_failed"] for r in got)
    assert q.quality_rules(docs.limit(0), labels).count() == q.keep_good(docs.limit(0), labels).count() == 0


def test_cutoffs_by_brute_force(spark):
    # The same cutoffs from plain loops over all calibration rows, and the verdicts that follow.
    import zlib

    docs, labels = documents(spark)
    quality = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = [(r["doc_id"], r["text"] or "", r["lang"]) for r in docs.collect()]
    counted = [(i, lang, dict(zip(q.COUNTS, q.counts(t)))) for i, t, lang in rows]
    failed = lambda c: c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"]
    rates = lambda c: {name: c[a] / max(c[b], 1) for name, (a, b) in q.RATES.items()}
    strata = {}
    for i, lang, c in counted:
        if quality.get(i) == 1 and zlib.crc32(str(i).encode()) % 3 != 1 and not failed(c):
            strata.setdefault(lang, []).append(rates(c))
    per_rate = q.ALLOWED / len(q.RATES)
    strata = {s: x for s, x in strata.items() if len(x) >= q.least_labels(per_rate, q.ERROR)}
    cutoffs = {}
    for s, x in strata.items():
        for name in q.RATES:
            for cutoff in q.GRID:
                if not q.certified(sum(r[name] > cutoff for r in x), len(x), per_rate, q.ERROR / (len(strata) * len(q.RATES))):
                    break
                cutoffs[s, name] = cutoff
    want = sorted(((i, not failed(c) and not any(r > cutoffs.get((lang, name), float("inf")) for name, r in rates(c).items())) for i, lang, c in counted), key=str)
    got = sorted(((r["doc_id"], r["kept"]) for r in q.quality_rules(docs, labels).collect()), key=str)
    assert got == want and cutoffs and len({s for s, _ in cutoffs}) == 2
