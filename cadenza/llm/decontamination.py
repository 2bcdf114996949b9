"""Benchmark decontamination by template windows.

Words lose case and outer punctuation. In a template, numbers, names (capitalised words within a sentence) and units become
typed placeholders. Windows of five words are hashed as they are and as templates (a template goes on until it has three
literal words; where a capitalised word opens a sentence there is a second one, with it as a name); documents keep the
windows that a bitmap of fixed size lets through, and these are hash-joined with the benchmark's. An item takes several matches,
m at least, so its m - 1 most common windows make no candidates: any text that has m of its windows has one of the others. They are
looked up for candidates only, and so phrases that many items share don't bring all of these together with all texts. For each document and item
the windows then have to tell one story: a slot of the item has one value in the document, of its type, a name of the item
is one name in the document, and different names are different ones.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, fits, map_documents, written
from .minhash import scatter

WINDOW = 5
#: Words of a template window that must be literal.
LITERAL = 3
#: An item is in a document if such a share of its windows is, or so many words in a row; with other slot values than its own, the greater share.
COVERED, IN_A_ROW, COVERED_OTHER = 0.5, 13, 0.8
#: With other slot values, the share is of the windows that can match then, and so many have to match at least (all, if the item has fewer).
LEAST_OTHER = 3
#: Bits of the bitmap, whatever the benchmark's size.
BITS = 24
BROADCAST_WINDOWS = 500_000
#: Words that a task remembers.
REMEMBERED = 100_000

#: Units.
UNITS = frozenset(
    "mm cm dm m km inch inches ft foot feet yard yards mile miles mg g kg t ton tons tonne tonnes oz ounce ounces lb lbs pound pounds "
    "ml cl l liter liters litre litres gallon gallons s sec secs second seconds min mins minute minutes h hr hrs hour hours day days "
    "week weeks month months year years hz khz mhz ghz w kw mw v a j kj cal kcal pa kpa bar k c f % $ dollar dollars cent cents euro euros percent degrees".split()
)
NUMBER = re.compile(r"[+-]?\d+(?:[.,:/]\d+)*(?:e[+-]?\d+)?")
_CORE = re.compile(r"[^\W_](?:.*[^\W_])?", re.S)
PLAIN, NUM, NAME, UNIT = range(4)
_BASE = 0xD6E8FEB86659FD93
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACE = [np.uint64(0x9E3779B97F4A7C15 * (k + 1) & 0xFFFFFFFFFFFFFFFF) for k in range(4)]


def word_of(raw: str) -> tuple[str, int, bool, bool]:
    """Canonical word ('' for punctuation alone), type where context doesn't matter, whether capitalised, whether a sentence ends."""
    if raw.isalpha():
        core, ends = raw, False
    else:
        found = _CORE.search(raw)
        ends = raw.rstrip("\"')]}*#$%&!").endswith((".", "?", "!", ":")) or raw.endswith(("!", "?"))
        if not found:
            return "", PLAIN, False, ends
        core = found[0]
    low = core.lower()
    kind = UNIT if low in UNITS and len(low) > 1 else NUM if core[0] in "+-0123456789" and NUMBER.fullmatch(low) else PLAIN
    return low, kind, core[0].isupper() and not core.isupper(), ends


WORD = np.dtype([("hash", "<u8"), ("kind", "u1"), ("capital", "?"), ("ends", "?"), ("real", "?")])


class Words:
    """Numbers raw words; their properties lie in an array that grows by doubling."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}
        self.canonical: list[str] = []
        self.table = np.zeros(1 << 12, dtype=WORD)

    def __call__(self, raw: list[str]) -> np.ndarray:
        """Numbers of distinct raw words."""
        if len(self.known) > REMEMBERED:
            self.known, self.canonical = {}, []
        known, first = self.known, len(self.canonical)
        fresh = []
        for w in raw:
            if w not in known:
                low, kind, capital, ends = word_of(w)
                known[w] = len(self.canonical)
                self.canonical.append(low)
                fresh.append((xxhash.xxh3_64_intdigest(low), kind, capital, ends, bool(low)))
        if len(self.canonical) > len(self.table):
            self.table = np.concatenate([self.table[:first], np.zeros(2 * len(self.canonical) - first, dtype=WORD)])
        if fresh:
            self.table[first : first + len(fresh)] = np.array(fresh, dtype=WORD)
        return np.fromiter(map(known.__getitem__, raw), dtype=np.int64, count=len(raw))


class Windows:
    """The windows of a batch of texts: word numbers and types of all words in a row, where each text's words start, and for each place
    whether a window starts there, its hash as it is, and as templates (0: too few literal words up to the text's end, or no placeholder)."""

    def __init__(self, words: Words, texts: pa.Array):
        # A number and the unit it is written with are two words.
        lists = pc.utf8_split_whitespace(pc.replace_substring_regex(texts, r"(\d)(\p{L})", r"\1 \2"))
        offsets = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        ids = words(coded.dictionary.to_pylist())[coded.indices.to_numpy()] if len(coded) else np.zeros(0, dtype=np.int64)
        t = words.table[ids]
        starts = np.append(True, t["ends"])[: len(t)]
        starts[offsets[:-1][offsets[:-1] < len(t)]] = True
        named = (t["kind"] == PLAIN) & t["capital"]
        before = np.concatenate([[0], np.cumsum(t["real"])])
        self.starts = before[offsets]  # one more than texts
        self.ids, plain = ids[t["real"]], t["hash"][t["real"]]
        # Types with capitalised words that open a sentence as they are, and as names.
        kinds = [np.where(x, NAME, t["kind"])[t["real"]] for x in (named & ~starts, named)]
        self.words = words
        sizes = np.diff(self.starts)
        self.counts = np.maximum(sizes - WINDOW + 1, 0)
        n = max(len(self.ids) - WINDOW + 1, 0)
        ends = np.repeat(self.starts[1:], sizes)
        self.whole = (ends - np.arange(len(self.ids)))[:n] >= WINDOW
        self.exact = np.zeros(n, dtype=np.uint64)
        for j in range(WINDOW):
            self.exact += plain[j : j + n] * np.uint64((2 * j + 3) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF)
        self.exact = scatter(self.exact)
        opens = np.concatenate([[0], np.cumsum(kinds[0] != kinds[1])])
        has_opening = (opens[WINDOW:] != opens[:-WINDOW])[:n] if n else np.zeros(0, dtype=bool)
        # By typing: types, hash and end of the template at each place. The second is only there where it differs.
        self.templates = []
        usable = np.zeros(n, dtype=bool)
        for k, kind in enumerate(kinds):
            hashes, to, literal = self._templates(np.where(kind == PLAIN, plain, np.array(_PLACE, dtype=np.uint64)[kind]), kind, ends, n)
            if k:
                wide = np.flatnonzero(to > np.arange(n) + WINDOW)
                has_opening[wide] = opens[to[wide]] != opens[wide]
                usable |= (literal == WINDOW) & ~has_opening
                usable |= hashes != 0
                hashes = np.where(has_opening, hashes, np.uint64(0))
            else:
                usable |= hashes != 0
            self.templates.append((kind, np.where(self.whole, hashes, np.uint64(0)), to))
        #: Whether a window at a place can match where values are changed, and how many of a text's windows can.
        self.usable = usable & self.whole
        total = np.concatenate([[0], np.cumsum(self.usable)])
        edge = np.minimum(self.starts, n)
        self.usable_counts = total[edge[1:]] - total[edge[:-1]]

    @staticmethod
    def _templates(typed: np.ndarray, kind: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, end, and literal words among the first five, of the template at each of n places."""
        template = np.zeros(n, dtype=np.uint64)
        for j in range(WINDOW):
            template += typed[j : j + n] * np.uint64((2 * j + 3) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF)
        count = np.concatenate([[0], np.cumsum(kind == PLAIN)])
        literal = (count[WINDOW:] - count[:-WINDOW])[:n] if n else np.zeros(0, dtype=np.int64)
        hashes = np.where((literal >= LITERAL) & (literal < WINDOW), scatter(template ^ np.uint64(0x5851F42D4C957F2D)), np.uint64(0))
        to = np.arange(n) + WINDOW
        # Windows with too few literal words go on to the third one, if the text has it.
        at = np.flatnonzero(literal < LITERAL)
        where = np.flatnonzero(kind == PLAIN)
        third = count[at] + LITERAL - 1
        at, third = at[third < len(where)], third[third < len(where)]
        end = where[third] + 1
        at, end = at[end <= ends[at]], end[end <= ends[at]]
        if len(at):
            power = np.cumprod(np.full(len(typed), _BASE, dtype=np.uint64))
            inverse = np.cumprod(np.full(len(typed), _BASE_INVERSE, dtype=np.uint64))
            sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(typed * power)])
            hashes[at] = scatter((sums[end] - sums[at]) * inverse[at] ^ np.uint64(0x2545F4914F6CDD1D))
            to[at] = end
        return hashes, to, literal

    def rows(self, there: Callable[[np.ndarray], np.ndarray]) -> Iterator[tuple[int, int, int, bool, list[str], bool, int, int]]:
        """Text number, hash, place in the text, whether a template, slots (type, place in the window and value), whether the window can
        match with other values, windows of the text, and those that can; of windows whose hashes are there."""
        plain = (None, np.where(self.whole, self.exact, np.uint64(0)), None)
        for kind, hashes, to in (plain, *self.templates):
            at = np.flatnonzero((hashes != 0) & there(hashes))
            of = np.searchsorted(self.starts, at, side="right") - 1
            for k, d, place, h in zip(at.tolist(), of.tolist(), (at - self.starts[of]).tolist(), hashes[at].astype(np.int64).tolist()):
                slots = [f"{kind[j]}{j - k}:{self.words.canonical[self.ids[j]]}" for j in range(k, to[k]) if kind[j]] if kind is not None else []
                yield d, h, place, kind is not None, slots, bool(self.usable[k]), int(self.counts[d]), int(self.usable_counts[d])


def document_windows(docs: DataFrame, bitmap: bytes, *ids: str) -> DataFrame:
    """ids, hash, place, template, slots, usable of windows whose hash the bitmap has (an empty one: of all windows), and n and n_usable, the text's windows."""

    def make() -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
        words = Words()
        bits = np.unpackbits(np.frombuffer(bitmap, dtype=np.uint8)).astype(bool) if bitmap else None

        def kernel(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            w = Windows(words, batch.column("text"))
            there = (lambda h: bits[(h >> np.uint64(64 - BITS)).astype(np.int64)]) if bits is not None else (lambda h: np.ones(len(h), dtype=bool))
            out: list[tuple] = []
            for row in w.rows(there):
                out.append(row)
                if len(out) >= 10_000:
                    yield as_batch(batch, out)
                    out = []
            if out:
                yield as_batch(batch, out)

        return kernel

    def as_batch(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
        of, *columns = zip(*rows)
        return pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(of)) for c in ids), *(pa.array(c, t) for c, t in zip(columns, _KINDS))], [*ids, *_NAMES])

    return map_documents(docs, make, ", ".join(f"{c} long" for c in ids) + ", hash long, place long, template boolean, slots array<string>, usable boolean, n long, n_usable long")


_NAMES = ["hash", "place", "template", "slots", "usable", "n", "n_usable"]
_KINDS = [pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.string()), pa.bool_(), pa.int64(), pa.int64()]


def story(item: list[tuple[int, bool, list[str], bool]], document: list[tuple[int, bool, list[str], bool]], n: int, n_usable: int) -> tuple[float, bool]:
    """Share of the item's n windows that the matches cover, and whether that is enough; n_usable of them can match with other values.

    item and document have, for each match, place, whether a template, slots and whether usable on their side. Matches are taken
    along the diagonal (document place less item place), those with most matches first; a match whose slots contradict is left out.
    Numbers and units are held to the item's place (equal ones may be different quantities), names to the item's name.
    """
    by: dict[int, list[int]] = {}
    for k, (x, y) in enumerate(zip(item, document)):
        by.setdefault(y[0] - x[0], []).append(k)
    covered: dict[int, bool] = {}
    usable: set[int] = set()
    to: dict[str | int, str] = {}
    back: dict[str, str] = {}
    for _, ks in sorted(by.items(), key=lambda e: (-len(e[1]), e[0])):
        for k in sorted(ks, key=lambda k: (item[k][1], item[k][0])):
            place, template, slots, can = item[k]
            if template:
                if len(slots) != len(document[k][2]):
                    continue
                new_to, new_back, same = dict(to), dict(back), True
                for a, b in zip(slots, document[k][2]):
                    (kind_at, value), (kind_at_b, other) = a.split(":", 1), b.split(":", 1)
                    name = int(kind_at[0]) == NAME
                    key = value if name else place + int(kind_at[1:])
                    same = same and kind_at == kind_at_b and new_to.setdefault(key, other) == other and (not name or new_back.setdefault(other, value) == value)
                if not same:
                    continue
                to, back = new_to, new_back
                covered.setdefault(place, False)
            else:
                covered[place] = True
            if can:
                usable.add(place)
    exact = sorted(p for p, same in covered.items() if same)
    longest = run = 0
    for k, p in enumerate(exact):
        run = run + 1 if k and p == exact[k - 1] + 1 else 1
        longest = max(longest, run + WINDOW - 1)
    share = len(covered) / max(n, 1)
    other = len(usable) >= max(COVERED_OTHER * n_usable, min(n, LEAST_OTHER))
    return share, len(exact) >= COVERED * n or longest >= IN_A_ROW or share >= COVERED_OTHER or other


def least_matches(n: Column, usable: Column) -> Column:
    """The fewest places of an item, of n and usable, with which `story` can be satisfied."""
    other = F.greatest(F.ceil(COVERED_OTHER * usable), F.least(n, F.lit(LEAST_OTHER)))
    return F.greatest(F.least(F.ceil(COVERED * n), F.lit(IN_A_ROW - WINDOW + 1), F.ceil(COVERED_OTHER * n), other), F.lit(1)).cast("int")


def candidate_windows(wanted: DataFrame) -> DataFrame:
    """hash, template, item_id of the windows that make candidates: all but those at an item's most common places, as many as may be missed."""
    common = wanted.groupBy("hash", "template").agg(F.countDistinct("item_id").alias("items"))
    places = wanted.join(common, ["hash", "template"]).groupBy("item_id", "place").agg(F.max("items").alias("items"), F.max("n").alias("n"), F.max("n_usable").alias("n_usable"))
    # One item's places: an item is one passage.
    order = Window.partitionBy("item_id").orderBy(F.col("items").desc(), "place")
    kept = places.withColumn("rank", F.row_number().over(order)).where(F.col("rank") >= least_matches(F.col("n"), F.col("n_usable")))
    return wanted.join(kept.select("item_id", "place"), ["item_id", "place"], "left_semi").select("hash", "template", "item_id").distinct()


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and id and same, which tell rows apart that share an id (null too)."""
    return documents(docs).withColumn("id", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("same", F.xxhash64("text"))


def found_items(d: DataFrame, benchmark: DataFrame) -> DataFrame:
    """id, same, items, share of the texts of d (keyed) that share a window with a candidate item; items are the sorted ids of items found."""
    b = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    wanted = written(document_windows(b, b"", "item_id"), "windows")
    # The bitmap is built from distinct slots of it, so what comes to the driver is bounded by its fixed size.
    slots = wanted.select(F.shiftrightunsigned("hash", 64 - BITS).alias("bit")).distinct()
    bitmap = np.zeros(1 << BITS, dtype=bool)
    bitmap[slots.toPandas()["bit"].to_numpy(dtype=np.int64)] = True
    found = written(document_windows(d.select("id", "same", "text"), np.packbits(bitmap).tobytes(), "id", "same"), "found")
    bounded = lambda df: F.broadcast(df) if fits(df, BROADCAST_WINDOWS) else df
    pairs = written(found.select("id", "same", "hash", "template").join(bounded(written(candidate_windows(wanted), "keys")), ["hash", "template"]).select("id", "same", "item_id").distinct(), "pairs")
    right = wanted.select("hash", "template", "item_id", F.struct("place", "template", "slots", "usable").alias("in_item"), F.col("n").alias("of"), F.col("n_usable").alias("of_usable"))
    left = found.select("id", "same", "hash", "template", F.struct("place", "template", "slots", "usable").alias("in_document"))
    hits = pairs.join(bounded(right), "item_id").join(left, ["id", "same", "hash", "template"])
    grouped = hits.groupBy("id", "same", "item_id").agg(F.max("of").alias("n"), F.max("of_usable").alias("n_usable"), F.collect_list(F.struct("in_item", "in_document")).alias("hits"))

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        as_match = lambda x: (x["place"], x["template"], list(x["slots"]), x["usable"])
        for f in frames:
            told = [story([as_match(h["in_item"]) for h in hs], [as_match(h["in_document"]) for h in hs], n, m) for hs, n, m in zip(f["hits"], f["n"], f["n_usable"])]
            yield pd.DataFrame({"id": f["id"], "same": f["same"], "item_id": f["item_id"], "share": [s for s, _ in told], "leak": [x for _, x in told]})

    judged = grouped.mapInPandas(judge, "id long, same long, item_id long, share double, leak boolean")
    return judged.groupBy("id", "same").agg(F.sort_array(F.collect_set(F.when(F.col("leak"), F.col("item_id")))).alias("items"), F.max("share").alias("share"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, n_items, items, share for each row of docs (doc_id, text); benchmark has item_id and text.

    items are the ids of the items found, sorted; share is the largest share of a candidate item's windows that the text has. Null or
    empty texts have no windows and no items; so have items of fewer than five words, which are no passage. Rows that
    share an id (a null one too) are judged each by their own text. Other columns are ignored.
    """
    d = keyed(docs)
    out = d.select("doc_id", "id", "same").join(found_items(d, benchmark), ["id", "same"], "left")
    items = F.coalesce("items", F.array().cast("array<long>"))
    return out.select("doc_id", (F.size(items) > 0).alias("contaminated"), F.size(items).cast("long").alias("n_items"), items.alias("items"), F.coalesce("share", F.lit(0.0)).alias("share"))
