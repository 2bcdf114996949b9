"""BPE encoding and decoding in batched numpy merge rounds.

The symbols of many words lie in one flat array. Ranks of adjacent pairs are found by binary search over the sorted pair
keys. A round merges in each word all places of its lowest-ranked pair, packs the array and looks up the pairs beside the
merges; words without a pair that merges leave. A long word comes alone: its rounds go from rank to rank and cost what
they merge, so that it takes time in proportion to its length. Words repeat, so a task remembers what it has merged.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import documents, map_documents

#: White-space runs whose ids a task remembers, and the longest of them.
REMEMBERED, REMEMBERED_CHARACTERS = 120_000, 32
#: Symbols in one flat array (a longer word comes alone).
BATCH_SYMBOLS = 1 << 18
#: Bytes from which on a word comes alone.
LONG = 1 << 10
NO_RANK = np.int64(1 << 40)


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself if printable, else the next from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b if b in printable else spare))
        spare += b not in printable
    return out


class Merges:
    """Pair keys of a vocabulary in sorted order, with rank and merged id of each."""

    def __init__(self, vocabulary: dict[str, int], merges: list, suffix: str = ""):
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in merges]
        left = np.array([vocabulary[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocabulary[b] for _, b in pairs], dtype=np.int64)
        keys = left << 32 | right
        # Of equal pairs the later rank holds, as in a map filled in order.
        order = np.lexsort((-np.arange(len(keys)), keys))
        order = order[np.concatenate([[True], keys[order][1:] != keys[order][:-1]])] if len(keys) else order
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocabulary[a + b] for a, b in pairs], dtype=np.int64)[order]
        # If each pair ranks after the merges that make its parts, all places of the lowest pair may merge at once.
        made = np.full(max(vocabulary.values()) + 1, -1, dtype=np.int64)
        np.maximum.at(made, self.merged, self.ranks)
        parts = np.maximum(made[self.keys >> 32], made[self.keys & 0xFFFFFFFF])
        self.in_order = bool((parts < self.ranks).all())
        alphabet = byte_alphabet()
        self.inner = np.array([vocabulary.get(c, -1) for c in alphabet], dtype=np.int64)
        self.last = np.array([vocabulary.get(c + suffix, -1) for c in alphabet], dtype=np.int64)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words (bytes, none empty) in a row, and how many each word has."""
        ids, counts = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        start = held = 0
        for k, n in enumerate([*map(len, words), 0]):
            long = n > LONG and self.in_order
            if k > start and (k == len(words) or long or held + n > BATCH_SYMBOLS):
                for x, out in zip(self._batch(words[start:k]), (ids, counts)):
                    out.append(x)
                start, held = k, 0
            if long:
                ids.append(self._long(words[k]))
                counts.append(np.array([len(ids[-1])]))
                start, held = k + 1, 0
            else:
                held += n
        return np.concatenate(ids), np.concatenate(counts)

    def _symbols(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The first symbols of words and the word of each; a byte that the vocabulary lacks is dropped."""
        lengths = np.array([len(w) for w in words])
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        symbols, ends = self.inner[data], np.cumsum(lengths) - 1
        symbols[ends] = self.last[data[ends]]
        word = np.repeat(np.arange(len(words)), lengths)
        known = symbols >= 0
        return symbols[known], word[known]

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places of pairs among the sorted keys; those that no merge has are len(keys)."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, len(self.keys)) if len(self.keys) else np.zeros(len(keys), dtype=np.int64)

    def _batch(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Rounds over many words at once: each merges, in every word, all places of its lowest pair; only pairs beside a merge are looked up again."""
        ranks = np.append(self.ranks, NO_RANK)
        symbols, word = self._symbols(words)
        settled_symbols, settled_words = [], []
        pair = np.full(len(symbols), len(self.keys))  # that starts at each symbol
        pair[:-1] = np.where(word[1:] == word[:-1], self._pairs(symbols[:-1], symbols[1:]), len(self.keys))
        while len(symbols):
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            rank = ranks[pair]
            lowest = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(symbols))))
            active = lowest < NO_RANK
            if not active.all():
                settled_symbols.append(symbols[~active])
                settled_words.append(word[~active])
                symbols, word, pair, rank, lowest = symbols[active], word[active], pair[active], rank[active], lowest[active]
                if not len(symbols):
                    break
            where = _every_other(np.flatnonzero(rank == lowest))
            if not self.in_order:
                where = where[np.append(True, word[where[1:]] != word[where[:-1]])]
            symbols[where] = self.merged[pair[where]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[where + 1] = False
            symbols, word, pair = symbols[keep], word[keep], pair[keep]
            changed = np.zeros(len(symbols) + 1, dtype=bool)
            changed[where - np.arange(len(where))] = changed[where - np.arange(len(where)) - 1] = True  # place -1 is the last of the array, which stands for none
            if changed[len(symbols) - 1]:
                pair[-1] = len(self.keys)
            changed = np.flatnonzero(changed[: len(symbols) - 1])
            pair[changed] = np.where(word[changed] == word[changed + 1], self._pairs(symbols[changed], symbols[changed + 1]), len(self.keys))
        symbols = np.concatenate(settled_symbols) if settled_symbols else symbols
        word = np.concatenate(settled_words) if settled_words else word
        return symbols[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))

    def _long(self, text: bytes) -> np.ndarray:
        """One long word, rank by rank: a round costs what it merges. A pair made by a merge ranks after it, so no rank comes twice too early."""
        symbols, _ = self._symbols([text])
        n = len(symbols)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        alive = np.ones(n, dtype=bool)
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[tuple[int, int]] = []

        def put(places: np.ndarray) -> None:
            """Pairs that start at places wait for their rank."""
            if not len(places):
                return
            pair = self._pairs(symbols[places], symbols[after[places]])
            hit = pair < len(self.keys)
            places, pair = places[hit], pair[hit]
            order = np.argsort(pair, kind="stable")
            places, pair = places[order], pair[order]
            cuts = np.flatnonzero(pair[1:] != pair[:-1]) + 1
            for p, some in zip(pair[np.append(0, cuts)].tolist() if len(pair) else [], np.split(places, cuts)):
                if p not in waiting:
                    waiting[p] = []
                    heapq.heappush(heap, (int(self.ranks[p]), p))
                waiting[p].append(some)

        put(np.arange(n - 1))
        while heap:
            _, p = heapq.heappop(heap)
            places = np.unique(np.concatenate(waiting.pop(p)))
            places = places[alive[places] & (after[places] < n)]
            left, right = int(self.keys[p]) >> 32, int(self.keys[p]) & 0xFFFFFFFF
            places = places[(symbols[places] == left) & (symbols[after[places]] == right)]
            if left == right:
                # Numbered along the word, overlapping places are neighbours.
                follows = np.append(False, after[places[:-1]] == places[1:])
                first = np.maximum.accumulate(np.where(follows, 0, np.arange(len(places))))
                places = places[(np.arange(len(places)) - first) % 2 == 0]
            if not len(places):
                continue
            gone = after[places]
            symbols[places] = self.merged[p]
            alive[gone] = False
            after[places] = after[gone]
            inner = after[places] < n
            before[after[places[inner]]] = places[inner]
            left_of = before[places]
            put(np.unique(np.concatenate([places[inner], left_of[left_of >= 0]])))
        return symbols[alive]


def _every_other(where: np.ndarray) -> np.ndarray:
    """Of places in a row (a pair that overlaps itself, as in a a a) every other one from the left."""
    new_run = np.append(True, np.diff(where) > 1)
    first = np.repeat(where[new_run], np.diff(np.append(np.flatnonzero(new_run), len(where))))
    return where[(where - first) % 2 == 0]


# Texts of these characters alone are cut by a pattern; for all others the library's own normalizer and pre-tokenizer say
# what is lower case, a letter or white space, as tables differ between versions of Unicode.
_PLAIN = re.compile("[\t\n\r -~\u00a1-\u00ac\u00ae-\u024f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf]*")


class WordBpe:
    """Encoder and decoder for a tokenizers file of the kind: NFC, lower case, words without white space, byte level, word ends."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.merges = Merges(model["vocab"], model["merges"], model["end_of_word_suffix"] or "")
        self.tokens = {v: k for k, v in model["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.decimals = {i: str(i) for i in self.tokens}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern)
        self.byte = {c: b for b, c in enumerate(byte_alphabet())}
        self.remembered = remembered
        #: run -> (number of ids, ids in decimal, tokens), both joined by blanks
        self.known: dict[str | bytes, tuple[int, str, str]] = {}

    def runs(self, text: str) -> list[str | bytes]:
        """What is remembered together: lower-case runs between white space, or the bytes of single words of unusual texts."""
        if _PLAIN.fullmatch(text):
            return text.lower().split()
        words = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(self.byte.__getitem__, w)) for w, _ in words]

    def _words(self, run: str | bytes) -> list[bytes]:
        return [run] if isinstance(run, bytes) else [w.encode("utf-8") for w in self.words.findall(run)]

    def _entries(self, runs: list[str | bytes]) -> dict[str | bytes, tuple[int, str, str]]:
        words = list(map(self._words, runs))
        ids, counts = self.merges.encode([w for ws in words for w in ws])
        ends = np.append(0, np.cumsum(counts))[np.cumsum([0, *map(len, words)])].tolist()
        ids = ids.tolist()
        decimals, tokens = list(map(self.decimals.__getitem__, ids)), list(map(self.tokens.__getitem__, ids))
        return {r: (b - a, " ".join(decimals[a:b]), " ".join(tokens[a:b])) for r, a, b in zip(runs, ends, ends[1:])}

    def encode(self, texts: list[str]) -> list[list[tuple[int, str, str]]]:
        """For each text its entries: number of ids, ids in decimal, tokens. Entries without ids are left out."""
        cut: list[list[tuple[bool, object]]] = []
        wanted: set[str | bytes] = set()
        for text in texts:
            parts = []
            for k, part in enumerate(self.cut.split(text) if "<|" in text else [text]):
                if k % 2:
                    parts.append((True, part))
                elif part:
                    runs = self.runs(part)
                    wanted.update(runs)
                    parts.append((False, runs))
            cut.append(parts)
        missing = [r for r in wanted if r not in self.known]
        found = self._entries(missing) if missing else {}
        if len(self.known) + len(found) > self.remembered:
            found |= {r: self.known[r] for r in wanted if r in self.known}
            self.known.clear()
        if len(self.known) + len(found) <= self.remembered:
            self.known.update((r, e) for r, e in found.items() if len(r) <= REMEMBERED_CHARACTERS)
        get = lambda r: self.known.get(r) or found[r]
        out = []
        for parts in cut:
            entries = []
            for special, x in parts:
                entries += [(1, str(self.special[x]), x)] if special else [e for e in map(get, x) if e[0]]
            out.append(entries)
        return out

    def encode_ids(self, text: str) -> list[int]:
        return [int(i) for e in self.encode([text])[0] for i in e[1].split(" ")]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by blanks, specials included; ids that no token has are skipped."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def bpe_digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of docs.

    A null or empty text has no ids, and the digests of the empty string. Repeated rows are each encoded, a null id is kept,
    other columns are ignored, and a text is encoded whole, however long.
    """

    def make():
        bpe = word_bpe(tokenizer_path)

        def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, ids, decoded = [], [], []
            for entries in bpe.encode(batch.column("text").to_pylist()):
                n.append(sum(e[0] for e in entries))
                ids.append(hashlib.sha256(" ".join([e[1] for e in entries]).encode()).hexdigest())
                decoded.append(hashlib.sha256(" ".join([e[2] for e in entries]).encode()).hexdigest())
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        kernel.close = bpe.known.clear
        return kernel

    return map_documents(documents(docs), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def bpe_ids(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, ids (array of int), decoded for each row of docs; nulls as for bpe_digests."""

    def make():
        bpe = word_bpe(tokenizer_path)

        def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
            entries = bpe.encode(batch.column("text").to_pylist())
            flat = np.fromstring(" ".join(e[1] for x in entries for e in x), dtype=np.int32, sep=" ")
            ends = np.cumsum([0, *(sum(e[0] for e in x) for x in entries)], dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, pa.array([" ".join(e[2] for e in x) for x in entries], pa.string())], ["doc_id", "ids", "decoded"])

        kernel.close = bpe.known.clear
        return kernel

    return map_documents(documents(docs), make, "doc_id long, ids array<int>, decoded string")
