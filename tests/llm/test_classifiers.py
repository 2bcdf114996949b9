import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from cadenza.llm import labelled, quality_cnn, toxicity

BAD = ["vilestem", "badword", "ugh"]


def rows(n=900):
    rng, out = random.Random(4), []
    for k in range(n):
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(5, 120))]
        toxic, junk = rng.random() < 0.25, rng.random() < 0.3
        if toxic:
            words[rng.randrange(len(words))] = "vilestem" + rng.choice("abcdefghij") if rng.random() < 0.5 else rng.choice(BAD) + ","
        text = " ".join(w + rng.choice(["***", "$$$"]) if junk else w for w in words)
        out.append((k, text, rng.choice(["xx", "yy"]), int(not junk), int(toxic)))
    return out


def tables(spark):
    r = rows()
    extra = [(9_000, None, "xx"), (9_001, "", None), (None, "a b", "xx"), (5, r[5][1], "xx"), (9_002, "w " * 100_000 + "badword", "yy")]
    docs = spark.createDataFrame([x[:3] + ("clash",) for x in r] + [x + ("clash",) for x in extra], "doc_id long, text string, lang string, score string")
    labels = spark.createDataFrame([(x[0], x[3], x[4]) for x in r] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    return docs, labels, {x[0]: x for x in r}, len(r) + len(extra)


@pytest.mark.parametrize(("run", "label", "cutoff"), [(toxicity.toxicity, 4, 0.7), (quality_cnn.quality, 3, 0.5)])
def test_held_out_rows(spark, run, label, cutoff):
    docs, labels, known, n = tables(spark)
    got = run(docs, labels).collect()
    assert len(got) == n and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= cutoff) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    test = [r for r in got if r["held_out"] and r["doc_id"] in known]
    y = [known[r["doc_id"]][label] for r in test]
    assert labelled.auc([r["score"] for r in test], y) > 0.95
    assert np.mean([r["predicted"] == v for r, v in zip(test, y)]) > 0.9
    if label == 4:
        assert next(r for r in got if r["doc_id"] == 9_002)["predicted"] == 1


@pytest.mark.parametrize("run", [toxicity.toxicity, quality_cnn.quality])
def test_without_labels_or_rows(spark, run):
    docs, labels, _, n = tables(spark)
    assert len(run(docs, labels.limit(0)).collect()) == n
    assert run(docs.limit(0), labels).count() == 0


def test_labels_of_the_held_out_fold_are_not_read(spark):
    _, labels, known, _ = tables(spark)
    used = {r["doc_id"] for r in labelled.training_rows(labels, "toxic").collect()}
    assert used == {k for k in known if zlib.crc32(str(k).encode()) % 3 != 1}


def test_scores_do_not_depend_on_neighbours():
    r = rows(60)
    texts, y = [x[1] for x in r], np.array([x[4] for x in r], dtype=float)
    t = toxicity.train(texts, y, epochs=1)
    together = toxicity.Scorer(t)(pa.array(texts))
    assert np.allclose(together, [toxicity.Scorer(t)(pa.array([x]))[0] for x in texts], atol=1e-5)
    q = quality_cnn.train(texts, y, epochs=1)
    together = quality_cnn.Scorer(q)(texts)
    assert np.allclose(together, [quality_cnn.Scorer(q)([x])[0] for x in texts], atol=1e-5)


def test_chunks_cover_every_byte():
    for n in (0, 1, 7, 8, 9, 259, 260, 261, 452, 453, 5_000):
        symbols, chunks = quality_cnn.chunk_symbols([bytes(k % 250 for k in range(n))])
        hop = quality_cnn.HOP * quality_cnn.STEP
        seen = {j * hop + k for j in range(chunks[0]) for k in np.flatnonzero(symbols[j] != quality_cnn.PAD)}
        assert seen == set(range(n))


def test_thresholds_come_from_all_labelled_rows(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_ROWS", 60)
    # A language with one row in ten has few rows in a sample of 60 of each label.
    r = [(k, text, "rare" if k % 10 == 0 else lang, bad) for k, text, lang, _, bad in rows(1_500)]
    docs = spark.createDataFrame([x[:3] for x in r] + [(90_000, "w", "unseen")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(x[0], x[3]) for x in r], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {x["doc_id"]: x for x in toxicity.toxicity(docs, labels, model).collect()}
    fitted = set(model.fitted)
    assert 0 < len(fitted) <= 120 and got[90_000]["threshold"] == 0.7
    for lang in ("rare", "xx", "yy"):
        clean = [got[x[0]] for x in r if x[2] == lang and not x[3] and not got[x[0]]["held_out"] and x[0] not in fitted]
        score = np.array([x["score"] for x in clean])
        (threshold,) = {x["threshold"] for x in clean}
        edges = np.arange(toxicity.CELLS + 1) / toxicity.CELLS
        want = next(e for e in edges if (score >= e).sum() <= 0.01 * len(score))
        assert len(score) >= 20 and threshold == pytest.approx(np.clip(want, 0.3, 0.95), abs=1e-12)


def test_labels_of_absent_documents_leave_the_sample_whole(spark):
    from cadenza.llm.labelled import sample

    docs = spark.createDataFrame([(k, f"text {k}") for k in range(0, 4_000, 40)] + [(8, "x" * 30_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k // 40 % 2, 0) for k in range(4_000)], "doc_id long, toxic int, quality int")
    rows, sizes = sample(docs, labels, "toxic", 20)
    wanted = [k for k in range(0, 4_000, 40) if zlib.crc32(str(k).encode()) % 3 != 1]
    assert sum(sizes.values()) == len(wanted) and set(rows["doc_id"]) <= set(wanted)
    assert (rows["label"] == 0).sum() == (rows["label"] == 1).sum() == 20
    again, _ = sample(docs.repartition(7), labels.repartition(3), "toxic", 20)
    assert again["doc_id"].tolist() == rows["doc_id"].tolist()
