import hashlib
import random

import pytest

from cadenza.llm import bpe
from cadenza.llm.queries import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")
POOL = ["a", "b", "s", "'s", "'LL", "İ", "ΟΔΟΣ", "ß", "ǅ", " ", "  ", "\n", "\x1c", "\x85", "\xa0", "é", "é", "日本", "①", "²", "_", "-", "!!", "<|endoftext|>", "<|startoftext|>", "<|", "😀", "‍", " ", "᠎", "ﬁ", "٣", "aaa", "zzz"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_ids_and_text_are_the_library_s(library):
    mine, rng = bpe.WordBpe(PATH, remembered=100), random.Random(3)
    assert mine.merges.in_order
    texts = ["".join(rng.choice(POOL) for _ in range(rng.randint(0, 20))) for _ in range(2_000)]
    texts += ["".join(chr(rng.choice([rng.randint(0, 0x2FF), rng.randint(0, 0x3000), rng.randint(0x10000, 0x1FFFF)])) for _ in range(8)) for _ in range(1_000)]
    for at in range(0, len(texts), 250):
        some = texts[at : at + 250]
        for text, entries in zip(some, mine.encode(some)):
            ids = library.encode(text, add_special_tokens=False).ids
            assert [int(i) for e in entries for i in e[1].split()] == ids, text
            assert " ".join(e[2] for e in entries) == library.decode(ids, skip_special_tokens=False) == mine.decode(ids)


def test_out_of_order_merges_go_one_at_a_time():
    # ab before bc, but "abc" is made by a rank below its part: the scan must fall back to the leftmost place.
    a = bpe.byte_alphabet()
    vocabulary = {c: k for k, c in enumerate(a)} | {"ab": 256, "abab": 257}
    m = bpe.Merges(vocabulary, [["ab", "ab"], ["a", "b"]])
    assert not m.in_order
    ids, counts = m.encode([b"ababab", b"ab"])
    assert ids.tolist() == [257, 256, 256] and counts.tolist() == [2, 1]


def test_rows(spark, library):
    rows = [(1, "Hello hello", 0), (1, "Hello hello", 0), (2, None, 0), (3, "", 0), (None, " \n", 0), (4, "wordpieces! " * 30_000, 0), (5, "x" * 20_000, 0)]
    got = sorted((tuple(r) for r in bpe.bpe_digests(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), PATH).collect()), key=str)
    want = []
    for i, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((i, len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want, key=str)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.bpe_digests(none, PATH).count() == bpe.bpe_ids(none, PATH).count() == 0
    assert bpe.bpe_ids(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), PATH).first()["ids"] == library.encode("a b").ids


def test_long_words_in_linear_time(library):
    # Random letters of one unbroken word, and words whose lowest pair overlaps itself, of all lengths around the switch.
    import time

    mine, rng = bpe.WordBpe(PATH), random.Random(5)
    for n in (bpe.LONG - 1, bpe.LONG + 1, 3 * bpe.LONG):
        for letters in ("ab", "a", "the ", "abcdefghijklmnopqrstuvwxyz"):
            text = "".join(rng.choice(letters) for _ in range(n))
            assert mine.encode_ids(text) == library.encode(text, add_special_tokens=False).ids
            both = [bytes(text.replace(" ", ""), "ascii")] * 2
            ids, counts = mine.merges.encode([b"short", *both, b"words"])
            assert counts[1] == counts[2] == len(mine.merges._batch(both[:1])[0]) and ids[counts[0] : counts[0] + counts[1]].tolist() == mine.merges._batch(both[:1])[0].tolist()
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000))
    began = time.time()
    ids = mine.encode_ids(text)
    assert time.time() - began < 20 and ids == library.encode(text, add_special_tokens=False).ids
