import pytest

from cadenza.llm import decontamination as d

ITEM = "Yesterday the trader Alice bought 15 apples for 3 dollars each, and later Alice sold 15 apples to Bob in Paris for profit."
OTHER = "a completely different passage about rivers which flow down through wide green valleys towards the cold northern sea"
FILL = "some quiet words that nobody would ever think to find in any test of reading at all "


def test_words():
    assert d.word_of("***")[0] == "" and d.word_of("Reed***,")[0] == "reed"
    assert d.word_of("3.5")[1] == d.NUM and d.word_of("km")[1] == d.UNIT
    assert d.word_of("Alice")[2] and not d.word_of("ALICE")[2]


CASES = {
    1: (FILL + ITEM + FILL, [7]),
    2: (FILL + ITEM.replace("Alice", "Carla").replace("15", "40").replace("Bob", "Dan").replace("Paris", "Rome").replace("3 ", "8 "), [7]),
    # Slots that contradict: one name stands for two.
    3: (FILL + ITEM.replace("Alice bought 15", "Carla bought 40").replace("Alice sold 15", "Dora sold 77").replace("Bob", "Carla").replace("Paris", "Carla").replace("3 dollars", "40 dollars"), []),
    4: (FILL * 50, []),
    5: (ITEM.upper(), [7]),
    6: (" ".join(w + "$$$" for w in (FILL + OTHER).split()), [8]),
    7: (None, []),
    8: ("", []),
    9: (FILL + OTHER.replace("rivers", "streams") + " " + ITEM, [7, 8]),
    10: ("the trader Alice bought nothing. " + FILL, []),
    11: (FILL * 8_000 + OTHER, [8]),
    12: ("and then we found 15km and 15 km of road", []),
}


@pytest.mark.parametrize("limit", [d.BROADCAST_WINDOWS, 0])
def test_leaks(spark, limit, monkeypatch):
    monkeypatch.setattr(d, "BROADCAST_WINDOWS", limit)
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, (t, _) in CASES.items()] + [(1, CASES[1][0], "clash", 1), (None, OTHER, "clash", 1)], "doc_id long, text string, items string, hash int")
    benchmark = spark.createDataFrame([(7, ITEM, "x"), (8, OTHER, "x"), (9, None, "x"), (10, "too short", "x"), (None, FILL, "x")], "item_id long, text string, place string")
    got = d.contaminated(docs, benchmark).collect()
    assert len(got) == len(CASES) + 2
    for r in got:
        want = CASES[r["doc_id"]][1] if r["doc_id"] else [8]
        assert (r["items"], r["contaminated"], r["n_items"]) == (want, bool(want), len(want)), r


def test_without_rows(spark):
    docs = spark.createDataFrame([(1, ITEM)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert not d.contaminated(docs, none).first()["contaminated"]
    assert d.contaminated(docs.limit(0), none).count() == 0


def test_questions_with_many_slots(spark):
    item = "Tom buys 3 pens at 4 dollars each and 2 books at 7 dollars each. How much does Tom pay in total?"
    other = "Ann buys 5 pens at 6 dollars each and 8 books at 9 dollars each. How much does Ann pay in total?"
    cases = [
        (1, FILL + other, True),
        (2, FILL + other.replace("8", "5").replace("9", "5"), True),  # equal values are no contradiction
        (3, other.replace("does Ann", "does Eve"), False),
        (4, FILL + item, True),
        (5, "How much does Ann pay in total? " + FILL, False),
        (6, FILL + other.replace("Ann buys", "then Ann buys"), True),
    ]
    docs = spark.createDataFrame([c[:2] for c in cases], "doc_id long, text string")
    got = {r["doc_id"]: r["contaminated"] for r in d.contaminated(docs, spark.createDataFrame([(1, item), (2, "Sort these numbers 5 3 2 8 1 9 7")], "item_id long, text string")).collect()}
    assert got == {i: want for i, _, want in cases}


def test_dense_templates_do_not_leave_the_text():
    import pyarrow as pa

    texts = ["pay 3 4 5 6", "7 8 9 words and so on here", "pay 3 4 5 6 words and", "", "x"]
    together = d.Windows(d.Words(), pa.array(texts))
    alone = [list(d.Windows(d.Words(), pa.array([t])).rows(lambda h: h != 0)) for t in texts]
    rows = list(together.rows(lambda h: h != 0))
    for k, mine in enumerate(alone):
        assert sorted(r[1:] for r in rows if r[0] == k) == sorted(r[1:] for r in mine)
    assert not any(r[3] for r in alone[0]) and any(r[3] for r in alone[2])


def brute_force(texts, items):
    """Items found in each text, over all pairs: every window of one against every window of the other."""
    import pyarrow as pa

    rows = lambda t: [(h, template, (place, template, slots, usable), n, m) for _, h, place, template, slots, usable, n, m in d.Windows(d.Words(), pa.array([t])).rows(lambda h: h != 0)]
    of_items = {i: rows(t) for i, t in items.items()}
    out = {}
    for key, text in texts.items():
        mine, found = rows(text), []
        for i, theirs in of_items.items():
            hits = [(a, b, n, m) for h, t, a, n, m in theirs for g, u, b, _, _ in mine if (h, t) == (g, u)]
            if hits and d.story([x[0] for x in hits], [x[1] for x in hits], max(x[2] for x in hits), max(x[3] for x in hits))[1]:
                found.append(i)
        out[key] = sorted(found)
    return out


@pytest.mark.parametrize("limit", [d.BROADCAST_WINDOWS, 0])
def test_by_brute_force(spark, limit, monkeypatch):
    # Items share openings, endings and whole templates; texts hold items, parts of items, other values, or just shared phrases.
    import random

    monkeypatch.setattr(d, "BROADCAST_WINDOWS", limit)
    rng = random.Random(9)
    shared = ["which of the following is the best answer to this", "how much does it cost in total at the end of the day", "a farmer has some fields near the old river"]
    words = [a + b for a in ("ka", "lo", "mi", "nu", "pe", "ro") for b in ("ta", "sel", "ver", "din", "gor")]
    names = ["Anna", "Bert", "Cleo", "Dora", "Emil"]
    some = lambda k: [rng.choice([*words, rng.choice(names), str(rng.randint(2, 99))]) if rng.random() < 0.4 else rng.choice(words) for _ in range(k)]
    items = {}
    for i in range(40):
        middle = some(rng.randint(2, 25))
        items[i] = " ".join([*(rng.choice(shared).split() if rng.random() < 0.6 else []), *middle, *(rng.choice(shared).split() if rng.random() < 0.6 else [])])
    items |= {40: shared[0], 41: shared[0] + " " + shared[1], 42: items[3], 43: "five words are an item", 44: "only four words here"}
    texts = {}
    for k in range(160):
        item = items[rng.randrange(45)].split()
        kind = rng.randrange(5)
        if kind == 1:
            cut = rng.randint(1, len(item))
            item = item[:cut] if rng.random() < 0.5 else item[-cut:]
        elif kind == 2:
            item = [str(rng.randint(2, 99)) if w.isdigit() else rng.choice(names) if w in names and rng.random() < 0.3 else w for w in item]
        elif kind == 3:
            item = rng.choice(shared).split()
        elif kind == 4:
            item[rng.randrange(len(item))] = "changed"
        texts[k] = " ".join(some(rng.randint(0, 30)) + item + some(rng.randint(0, 30)))
    want = brute_force(texts, items)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["items"] for r in d.contaminated(docs, spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()}
    assert got == want
    assert 40 < sum(map(bool, want.values())) < 160


def test_rows_that_share_an_id_are_judged_by_their_text(spark):
    docs = spark.createDataFrame([(None, OTHER), (None, FILL), (1, FILL), (1, FILL + OTHER)], "doc_id long, text string")
    got = [(r["doc_id"], r["contaminated"]) for r in d.contaminated(docs, spark.createDataFrame([(8, OTHER)], "item_id long, text string")).collect()]
    assert sorted(got, key=str) == [(1, False), (1, True), (None, False), (None, True)]
