import random
import zlib

import numpy as np
import pytest

from cadenza.llm import token_output as t
from cadenza.llm import url_filter as u
from cadenza.llm.queries import tokenizer_path

URLS = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/1?x#y", "https://a.net/es/", "https://a.net/de/", "http://com/x", "http://b.com", "x://Example.com:80/en/", "http://example.com/en/?q=http://www.example.com/en/", "a://net/fr/" + "p" * 50_000, "http://" + "a." * 20_000 + "net/es/x", "http://com/x", "http://é.com/fr/"]


@pytest.mark.parametrize("limit", [u.BROADCAST_RULES, 0])
def test_urls_match_rule_by_rule(spark, limit):
    rows = [(k % 12, x, "clash", "clash") for k, x in enumerate(URLS)]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string, host string")
    got = u.judge_urls(pages, u.rules_frame(spark, u.RULES), broadcast_rules=limit).collect()
    want = [(i, *u.brute_force(x, u.RULES)) for i, x, *_ in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_urls_without_rows_or_rules(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert u.judge_urls(none, u.rules_frame(spark, u.RULES)).count() == 0
    one = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert [tuple(r) for r in u.judge_urls(one, spark.createDataFrame([], "host string, path string, action string")).collect()] == [(1, "a.com", "/", None, "allow")]
    odd = spark.createDataFrame([(None, "/", "block"), ("com", "/", None), ("com", "/", "block"), ("com", "/", "allow")], "host string, path string, action string")
    assert u.judge_urls(one, odd).first()["verdict"] == "block"


PIECES = ["a", " ", "  ", "\n", "\t", "don't", "é", "1", "!!", " ", " ", "<|endoftext|>", "word", "\r\n", "\x1f", "日本", "The ", "x" * 60, " word,", " don", " Été;:", " ok!!", "."]


def test_piecewise_ids_are_the_library_s():
    from tokenizers import Tokenizer

    path, rng = tokenizer_path("byte_bpe_50k.json"), random.Random(5)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 30))) for _ in range(2_000)]
    mine = t.ByteEncoder(path)
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    for at in range(0, len(texts), 100):
        assert [np.frombuffer(x, "<u4").tolist() for x in mine.encode(texts[at : at + 100])] == want[at : at + 100]


def test_shards_hold_every_document(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    rows = [(k % 90, None if k % 7 == 0 else f"text {k} " * (k % 5), "x") for k in range(120)] + [(None, "no id", "x"), (500, "long " * 40_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    manifest, dictionary = t.write_shards(docs, path, shard_bytes=2_000)
    got = sorted(t.read_shards(manifest, dictionary).collect(), key=lambda r: r["start"])
    k = Tokenizer.from_file(path)
    ids = {(i, zlib.crc32(b)): len(b) // 4 for i, x, _ in rows for b in [np.array([*k.encode(x or "", add_special_tokens=False).ids, 0], "<u4").tobytes()]}
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows), key=lambda x: -1 if x is None else x)
    at = 0
    for r in got:
        assert r["start"] == at and r["n_tokens"] == ids[r["doc_id"], r["ids_crc32"]]
        at += r["n_tokens"]
    one = [s for s in (t.Shard(m["path"], dictionary) for m in manifest.collect()) if s.find(500)]
    assert len(one) == 1 and len(one[0].document(one[0].find(500)[0])) // 4 == len(k.encode("long " * 40_000).ids) + 1
    with pytest.raises(ValueError):
        t.Shard(manifest.first()["path"], b"another")


def test_no_documents_no_shards(spark):
    assert t.token_output(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path("byte_bpe_50k.json")).count() == 0


def test_letters_of_all_scripts_are_one_piece_in_the_byte_alphabet():
    from tokenizers import Tokenizer

    path, rng = tokenizer_path("byte_bpe_50k.json"), random.Random(6)
    letters = [x for x in map(chr, [*range(0xD800), *range(0xE000, 0x110000)]) if x.isalpha()]
    words = ["".join(rng.choice(letters[: rng.choice((52, 200, len(letters)))]) for _ in range(rng.randint(1, 8))) for _ in range(4_000)]
    words += [f"a{x}b" for x in letters]
    texts = [" ".join(words[at : at + 50]) for at in range(0, len(words), 50)]
    want = [np.array(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert t.ByteEncoder(path).encode(texts) == want


def test_batches_of_a_task_are_encoded_together():
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"doc_id": [k], "text": [f"some words again {'x' * n}"]}) for k, n in enumerate((10, 10, 500, 10, 10, 10))]
    got = list(t.gathered(iter(batches), limit=200))
    assert [b.column("doc_id").to_pylist() for b in got] == [[0, 1], [2], [3, 4, 5]]
    assert list(t.gathered(iter([]))) == []
    mine, seen = t.ByteEncoder(tokenizer_path("byte_bpe_50k.json")), []
    tokenize, mine.tokenize = mine.tokenize, lambda x: seen.append(x) or tokenize(x)
    for batch in t.gathered(iter(batches)):
        mine.encode_array(batch.column("text"))
    assert len(seen) == len(set(seen)) == 4
