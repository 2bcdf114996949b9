"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the sum of the hashed rows of the word and its prefixes, so that words with a common stem share what
is learned. Filters one, two and three words wide are max-pooled over the whole text and combined by a logistic layer. Scores
never see the language; thresholds by language are calibrated afterwards, on the scores of all labelled rows outside the
held-out fold and the fitted sample, and only decide `flagged`.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, map_documents, written
from .labelled import SAMPLE_CHARACTERS, SAMPLE_ROWS, held_out, sample, sigmoid, training_rows
from .minhash import scatter

BUCKETS, DIMENSIONS, FILTERS = 1 << 16, 12, 8
WIDTHS = (1, 2, 3)
PREFIXES = (3, 4, 5, 6, 7, 8)
EPOCHS, STEPS, BATCH, RATE = 3, 200, 64, 0.05
#: Score from which predicted is 1; the share of clean training texts that a language's own threshold may flag.
CUTOFF, CLEAN_FLAGGED = 0.7, 0.01
#: Clean rows without which a language has no threshold of its own, the range of thresholds, and the cells a score's histogram has.
LEAST_CLEAN, LOWEST, HIGHEST, CELLS = 20, 0.3, 0.95, 2_000
#: Words whose filter values a task remembers.
REMEMBERED = 200_000
#: Stands before and after each text, so that short ones fill the widest filter.
EDGE = ""


def features(words: list[str]) -> np.ndarray:
    """Rows of the embedding table of each word: of the whole and of each prefix (in bytes; a shorter word repeats the whole)."""
    raw = [w.encode("utf-8") for w in words]
    whole = np.fromiter(map(xxhash.xxh3_64_intdigest, raw), dtype=np.uint64, count=len(raw))
    sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    head = np.array(raw or [b""], dtype="S8").view("<u8")[: len(raw)]
    out = [whole]
    for n in PREFIXES:
        prefix = scatter((head & np.uint64((1 << 8 * n) - 1)) + np.uint64(n * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        out.append(np.where(sizes >= n, prefix, whole))
    return (np.stack(out, axis=1) % np.uint64(BUCKETS)).astype(np.int64)


STRIPPED = ".,;:!?*#$%&|\"'()[]"


def word_numbers(texts: pa.Array, number: Callable[[list[str]], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words of all texts in a row, with two edge words before and after each text, and where each text ends.

    Distinct words are found by Arrow; number gives the numbers of a list of them, the first of which is EDGE.
    """
    lists = pc.utf8_split_whitespace(pc.utf8_lower(texts))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    numbers = number([EDGE, *(w.strip(STRIPPED) for w in coded.dictionary.to_pylist())])
    sizes = np.diff(offsets)
    ends = np.cumsum(sizes + 4)
    out = np.full(int(ends[-1]) if len(ends) else 0, numbers[0], dtype=np.int64)
    out[np.arange(len(coded)) + np.repeat(4 * np.arange(len(sizes)) + 2, sizes)] = numbers[1:][coded.indices.to_numpy()]
    return out, ends


@dataclass
class Model:
    table: np.ndarray
    filters: list[np.ndarray]  # by width: width x DIMENSIONS x FILTERS
    filter_bias: np.ndarray
    out: np.ndarray
    bias: float
    thresholds: dict[str, float] = field(default_factory=dict)
    fitted: list[int] = field(default_factory=list)  # ids of the rows it was fitted on

    def projected(self, embedded: np.ndarray) -> np.ndarray:
        """The share of each word in the filters, at each place of each width."""
        return np.concatenate([embedded @ w[j] for w in self.filters for j in range(len(w))], axis=1)


def convolved(projected: np.ndarray, ids: np.ndarray) -> list[np.ndarray]:
    """Filter values by width at each word, before the bias (the last width - 1 words of a text run into the next one)."""
    out, column = [], 0
    for width in WIDTHS:
        n = len(ids) - width + 1
        value = np.zeros((len(ids), FILTERS), dtype=np.float32)
        for j in range(width):
            value[:n] += projected[ids[j : j + n], column : column + FILTERS]
            column += FILTERS
        out.append(value)
    return out


def pooled(values: list[np.ndarray], starts: np.ndarray) -> np.ndarray:
    """Maxima over each text. Windows that leave a text start in its edge words, which are masked."""
    return np.concatenate([np.maximum.reduceat(v, starts) for v in values], axis=1)


def mask_ends(values: list[np.ndarray], ends: np.ndarray) -> None:
    for width, v in zip(WIDTHS, values):
        for j in range(width - 1):
            v[ends - 1 - j] = -np.inf


def train(texts: list[str], labels: np.ndarray, seed: int = 7, epochs: int = EPOCHS) -> Model:
    """Fits the model by Adagrad on whole texts; embeddings start from smoothed log odds of their buckets in one dimension."""
    rng = np.random.default_rng(seed)
    number: dict[str, int] = {}
    flat, ends = word_numbers(pa.array(texts, pa.string()), lambda words: np.array([number.setdefault(w, len(number)) for w in words]))
    docs = np.split(flat, ends[:-1])
    rows = features(list(number))
    weight = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum())) * len(labels)
    count = np.zeros((2, BUCKETS))
    for ids, y in zip(docs, labels):
        count[int(y), np.unique(rows[ids])] += 1
    n = np.array([(labels == 0).sum(), (labels == 1).sum()])
    odds = np.log((count[1] + 0.5) / (n[1] + 1)) - np.log((count[0] + 0.5) / (n[0] + 1))
    seen = count.sum(axis=0)
    table = rng.normal(0, 0.02, (BUCKETS, DIMENSIONS)).astype(np.float32)
    table[:, 0] = odds * seen / (seen + 10) / (1 + len(PREFIXES))
    filters = [rng.normal(0, 0.3, (w, DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS]
    filters[0][0, 0, 0] = 1.0
    model = Model(table, filters, np.zeros(len(WIDTHS) * FILTERS, dtype=np.float32), rng.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(np.float32), 0.0)
    model.out[0] = 1.0
    squares = [np.full_like(x, 1e-4) for x in (table, *filters, model.filter_bias, model.out)] + [1e-4]

    def step(x: np.ndarray, grad: np.ndarray, square: np.ndarray, rate: float = RATE) -> None:
        square += grad * grad
        x -= rate * grad / np.sqrt(square)

    for _ in range(max(epochs, math.ceil(STEPS * BATCH / len(docs))) if n.all() else 0):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            ids, inverse = np.unique(np.concatenate([docs[k] for k in some]), return_inverse=True)
            ends = np.cumsum([len(docs[k]) for k in some])
            starts = np.append(0, ends[:-1])
            embedded = table[rows[ids]].sum(axis=1)
            values = convolved(model.projected(embedded), inverse)
            mask_ends(values, ends)
            top = pooled(values, starts)
            active = np.tanh(top + model.filter_bias)
            grad = (sigmoid(active @ model.out + model.bias) - labels[some]) * weight[some] / len(some)
            d_out, d_bias = active.T @ grad, grad.sum()
            d_top = grad[:, None] * model.out * (1 - active * active)
            d_embedded = np.zeros_like(embedded)
            d_filters = [np.zeros_like(f) for f in filters]
            for w, width in enumerate(WIDTHS):
                for f in range(FILTERS):
                    column = w * FILTERS + f
                    hit = np.flatnonzero(values[w][:, f] == np.repeat(top[:, column], np.diff(np.append(starts, ends[-1]))))
                    of = np.searchsorted(ends, hit, side="right")
                    of, first = np.unique(of, return_index=True)
                    hit, g = hit[first], d_top[of, column].astype(np.float32)
                    for j in range(width):
                        words = inverse[hit + j]
                        d_filters[w][j, :, f] += embedded[words].T @ g
                        np.add.at(d_embedded, words, g[:, None] * filters[w][j, :, f])
            touched, back = np.unique(rows[ids], return_inverse=True)
            d_table = np.zeros((len(touched), DIMENSIONS), dtype=np.float32)
            np.add.at(d_table, back.reshape(rows[ids].shape), d_embedded[:, None, :])
            square = squares[0][touched]
            square += d_table * d_table
            squares[0][touched] = square
            table[touched] -= RATE * d_table / np.sqrt(square)
            for f, d, q in zip(filters, d_filters, squares[1:4]):
                step(f, d, q)
            step(model.filter_bias, d_top.sum(axis=0).astype(np.float32), squares[4])
            step(model.out, d_out.astype(np.float32), squares[5])
            squares[6] += d_bias * d_bias
            model.bias -= RATE * d_bias / squares[6] ** 0.5
    return model


class Scorer:
    """Scores whole texts; remembers what a word gives to each filter."""

    def __init__(self, model: Model):
        self.model, self.known, self.used = model, {}, 0
        self.values = np.zeros((REMEMBERED, sum(WIDTHS) * FILTERS), dtype=np.float32)

    def _ids(self, words: list[str]) -> np.ndarray:
        if self.used + len(words) > len(self.values):
            self.known, self.used = {}, 0
            if len(words) > len(self.values):
                self.values = np.zeros((len(words), self.values.shape[1]), dtype=np.float32)
        missing = [w for w in dict.fromkeys(words) if w not in self.known]
        if missing:
            end = self.used + len(missing)
            self.values[self.used : end] = self.model.projected(self.model.table[features(missing)].sum(axis=1))
            self.known.update(zip(missing, range(self.used, end)))
            self.used = end
        return np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))

    def __call__(self, texts: pa.Array) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        ids, ends = word_numbers(texts, self._ids)
        values = convolved(self.values, ids)
        mask_ends(values, ends)
        active = np.tanh(pooled(values, np.append(0, ends[:-1])) + self.model.filter_bias)
        return sigmoid((active @ self.model.out + self.model.bias).astype(np.float64))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model from a bounded sample of training rows of docs (doc_id, text, lang)."""
    rows, _ = sample(documents(docs, F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang")), labels, "toxic", SAMPLE_ROWS, SAMPLE_CHARACTERS, "lang")
    rows = rows[np.arange(len(rows)) % 5 != 4]
    model = train(rows["text"].tolist(), rows["label"].to_numpy(dtype=np.float64))
    model.fitted = rows["doc_id"].astype(int).tolist()
    return model


def calibrated(scored: DataFrame, labels: DataFrame, fitted: list[int]) -> dict[str, float]:
    """Thresholds by language, from all clean labelled rows of scored (doc_id, lang, score) that may be learned from and weren't fitted on.

    A threshold is the lowest edge of a cell from which on at most CLEAN_FLAGGED of the language's clean rows lie. Only counts per
    language and cell come to the driver.
    """
    spark = scored.sparkSession
    clean = training_rows(labels, "toxic").where("label = 0").select("doc_id")
    clean = clean.join(F.broadcast(spark.createDataFrame([(i,) for i in fitted], "doc_id long")), "doc_id", "left_anti")
    cell = F.least(F.floor(F.col("score") * CELLS), F.lit(CELLS - 1)).cast("int")
    cells = scored.join(clean, "doc_id", "left_semi").groupBy("lang", cell.alias("cell")).count()
    found: dict[str, np.ndarray] = {}
    for r in cells.collect():
        found.setdefault(r["lang"], np.zeros(CELLS + 1, dtype=np.int64))[r["cell"]] = r["count"]
    out = {}
    for lang, counts in sorted(found.items()):
        if counts.sum() >= LEAST_CLEAN:
            from_here = np.cumsum(counts[::-1])[::-1]
            out[lang] = float(np.clip(np.argmax(from_here <= CLEAN_FLAGGED * counts.sum()) / CELLS, LOWEST, HIGHEST))
    return out


def toxicity(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted, threshold, flagged for each row of docs (doc_id, text, lang; others are ignored).

    score is between 0 and 1 and predicted is 1 from CUTOFF on; flagged holds the score against the language's threshold (CUTOFF for a
    language without one, as a null one). A null or empty text has the score of no words. Repeated rows are each scored.
    Without labels of both kinds the scores are those of the untrained model.
    """
    model = model or fit(docs, labels)
    d = documents(docs, F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"))

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        scorer = Scorer(model)

        def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(scorer(batch.column("text")), pa.float64())], ["doc_id", "lang", "score"])

        return kernel

    scored = written(map_documents(d, make, "doc_id long, lang string, score double"), "scores")
    own = model.thresholds or calibrated(scored, labels, model.fitted)
    of_lang = d.sparkSession.createDataFrame(sorted(own.items()), "lang string, own double")
    threshold = F.coalesce("own", F.lit(CUTOFF))
    rows = scored.join(F.broadcast(of_lang), "lang", "left").select("doc_id", "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"), threshold.alias("threshold"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "threshold", (F.col("score") >= F.col("threshold")).alias("flagged"))
