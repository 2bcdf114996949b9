"""The pipeline, stage by stage, against brute force on a small fixture."""

import random

import pytest

import corpus_pipeline
from cadenza.llm import minhash, quality_rules
from cadenza.llm.queries import tokenizer_path

ITEM = "a completely different passage about rivers which flow down through wide green valleys towards the cold northern sea"
SECRET = "token=abc-DEF_123"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, path = random.Random(8), str(tmp_path_factory.mktemp("tables"))
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    rows = []
    for k in range(200):
        words = [word() for _ in range(rng.randint(20, 150))]
        if k % 20 == 0:
            words[5:5] = ITEM.split()
        if k % 15 == 0:
            words.insert(3, SECRET)
        rows.append((k, " ".join(words), "en", "src", 0))
        if k % 10 == 0:
            words[7] = "changed"
            rows.append((k + 1_000, " ".join(words), "en", "src", 0))
    rows += [(2_000, rows[9][1], "en", "src", 0), (2_001, None, "en", "src", 0), (2_002, "", None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(50)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    schema = docs.schema
    stage = dict(corpus_pipeline.STAGES)
    texts = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}

    before = texts(docs)
    docs = corpus_pipeline.written(stage["quality_rules"](spark, docs, folder), "t")
    counted = {i: quality_rules.counts(t or "") for i, t in before.items()}
    assert docs.schema == schema  # too few labels for a certified cutoff: the base limits alone reject
    assert texts(docs) == {i: before[i] for i, c in counted.items() if c[0] >= 50 and 100 * c[4] <= 50 * c[0]}

    before = texts(docs)
    docs = corpus_pipeline.written(stage["minhash_dedup"](spark, docs, folder), "t")
    want = minhash.brute_force(before, 5, 80)
    assert docs.schema == schema and set(texts(docs)) == {i for i, x in want.items() if x[2]} < set(before)

    before = texts(docs)
    docs = corpus_pipeline.written(stage["decontamination"](spark, docs, folder), "t")
    assert docs.schema == schema and texts(docs) == {i: t for i, t in before.items() if "northern sea" not in t}

    before = texts(docs)
    docs = corpus_pipeline.written(stage["secret_scan"](spark, docs, folder), "t")
    assert docs.schema == schema and texts(docs) == {i: t.replace(SECRET, "[SECRET]") for i, t in before.items()}
    assert any(SECRET in t for t in before.values())

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    got = stage["bpe"](spark, docs, folder).collect()
    now = texts(docs)
    assert len(got) == len(now) and all(r["ids"] == library.encode(now[r["doc_id"]], add_special_tokens=False).ids for r in got)
    assert sorted(map(str, corpus_pipeline.run(spark, folder).collect())) == sorted(map(str, got))


def test_stages_on_odd_rows(spark, tmp_path):
    # Null and repeated ids, null and very long texts, columns whose names the operators use, and no rows at all.
    path = str(tmp_path)
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    rng = random.Random(2)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    a, b, c = prose(80), prose(80), prose(60)
    rows = [(1, a), (1, a), (1, b), (None, c), (None, c + " " + ITEM), (None, None), (2, ""), (3, prose(60_000)), (4, f"{prose(60)} {SECRET}"), (None, b + " x")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, id string, same string, digest string, _row string, hash string"
    docs = spark.createDataFrame([(i, t, None, None, None, "x", "x", "x", "x", "x") for i, t in rows], schema)
    kept = []
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), path)
        docs = corpus_pipeline.written(stage(spark, docs, path), "t")
        assert empty.count() == 0 and empty.columns == docs.columns
        kept.append(sorted(((r["doc_id"], (r["text"] if "text" in docs.columns else r["decoded"])[:20]) for r in docs.collect()), key=str))
    of = lambda *texts: sorted(((i, t[:20]) for i, t in texts), key=str)
    good = [(1, a), (1, a), (1, b), (None, c), (None, c), (3, rows[7][1]), (4, rows[8][1]), (None, b)]
    assert kept[0] == of(*good)
    assert kept[1] == of((1, a), (1, b), (None, c), (None, c), (3, rows[7][1]), (4, rows[8][1]))
    assert kept[2] == kept[3] == of((1, a), (1, b), (None, c), (3, rows[7][1]), (4, rows[8][1]))
    assert len(kept[4]) == 5
