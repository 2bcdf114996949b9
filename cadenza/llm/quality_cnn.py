"""Quality: a byte-level convolutional network in numpy.

Bytes are embedded; filters eight bytes wide slide over the text in steps of four; chunks of 64 filter places, each overlapping
the next by a quarter, are max-pooled. A hidden layer reads each chunk's maxima, and its mean and maximum over all chunks of
the document, however many, give one probability.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, map_documents
from .labelled import SAMPLE_CHARACTERS, SAMPLE_ROWS, held_out, sample, sigmoid

EMBEDDING, WIDTH, STEP, FILTERS, HIDDEN = 6, 8, 4, 24, 16
#: Filter places in a chunk, and from one chunk to the next.
CHUNK, HOP = 64, 48
EPOCHS, STEPS, BATCH, RATE = 3, 300, 32, 0.004
CUTOFF = 0.5
#: The symbol after a text's last byte.
PAD = 256
#: Filter places computed at once.
BLOCK = 1 << 15


@dataclass
class Model:
    embed: np.ndarray  # 257 x EMBEDDING
    filters: np.ndarray  # WIDTH * EMBEDDING x FILTERS
    filter_bias: np.ndarray
    hidden: np.ndarray  # FILTERS x HIDDEN
    hidden_bias: np.ndarray
    out: np.ndarray  # 2 * HIDDEN
    bias: np.ndarray  # 1
    prior: float = 0.0

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.filter_bias, self.hidden, self.hidden_bias, self.out, self.bias]


def untrained(seed: int = 3) -> Model:
    rng = np.random.default_rng(seed)
    f = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
    return Model(f(0.5, PAD + 1, EMBEDDING), f(0.2, WIDTH * EMBEDDING, FILTERS), f(0.1, FILTERS), f(0.3, FILTERS, HIDDEN), f(0.1, HIDDEN), f(0.2, 2 * HIDDEN), np.zeros(1, dtype=np.float32))


def layout(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For texts of so many bytes: chunks of each, and filter places of each (they cover every byte; an empty text has one chunk)."""
    places = np.maximum(1, -(-np.maximum(0, sizes - WIDTH) // STEP) + 1)
    return np.maximum(1, -(-np.maximum(0, places - CHUNK) // HOP) + 1), places


def chunk_symbols(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of each chunk of all texts (rows), and how many chunks each text has."""
    chunks, _ = layout(np.array([len(r) for r in raws], dtype=np.int64))
    width, hop = (CHUNK - 1) * STEP + WIDTH, HOP * STEP
    out = np.full((int(chunks.sum()), width), PAD, dtype=np.int16)
    row = 0
    for raw, n in zip(raws, chunks.tolist()):
        data = np.full((n - 1) * hop + width, PAD, dtype=np.int16)
        data[: len(raw)] = np.frombuffer(raw, dtype=np.uint8)
        out[row : row + n] = np.lib.stride_tricks.sliding_window_view(data, width)[::hop]
        row += n
    return out, chunks


def filter_values(model: Model, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Filter inputs (chunks x CHUNK x WIDTH * EMBEDDING) and their products with the filters."""
    embedded = model.embed[symbols].reshape(len(symbols), -1)
    windows = np.lib.stride_tricks.sliding_window_view(embedded, WIDTH * EMBEDDING, axis=1)[:, :: STEP * EMBEDDING]
    windows = np.ascontiguousarray(windows)
    return windows, (windows.reshape(-1, WIDTH * EMBEDDING) @ model.filters).reshape(len(symbols), CHUNK, FILTERS)


def chunk_maxima(model: Model, symbols: np.ndarray) -> np.ndarray:
    out = np.empty((len(symbols), FILTERS), dtype=np.float32)
    step = max(1, BLOCK // CHUNK)
    for at in range(0, len(symbols), step):
        out[at : at + step] = filter_values(model, symbols[at : at + step])[1].max(axis=1)
    return np.maximum(out + model.filter_bias, 0)


def combined(model: Model, maxima: np.ndarray, starts: np.ndarray, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hidden values of chunks, features of documents (mean and maximum over chunks), logits."""
    h = np.maximum(maxima @ model.hidden + model.hidden_bias, 0)
    features = np.concatenate([np.add.reduceat(h, starts) / chunks[:, None], np.maximum.reduceat(h, starts)], axis=1)
    return h, features, features @ model.out + model.bias[0]


def train(texts: list[str], labels: np.ndarray, seed: int = 3, epochs: int = EPOCHS) -> Model:
    """Fits the network by Adam on whole texts, both labels with equal weight."""
    model, rng = untrained(seed), np.random.default_rng(seed)
    raws = [t.encode("utf-8") for t in texts]
    n1 = (labels == 1).sum()
    if not 0 < n1 < len(labels):
        return model
    weight = np.where(labels == 1, 0.5 / n1, 0.5 / (len(labels) - n1)) * len(labels)
    parameters = model.parameters()
    first, second = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
    t = 0
    for _ in range(max(epochs, math.ceil(STEPS * BATCH / len(raws)))):
        order = rng.permutation(len(raws))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            symbols, chunks = chunk_symbols([raws[k] for k in some])
            starts = np.cumsum(chunks) - chunks
            windows, values = filter_values(model, symbols)
            top = values.argmax(axis=1)
            before = np.take_along_axis(values, top[:, None, :], axis=1)[:, 0] + model.filter_bias
            maxima = np.maximum(before, 0)
            h, features, logit = combined(model, maxima, starts, chunks)
            g = ((sigmoid(logit) - labels[some]) * weight[some] / len(some)).astype(np.float32)
            d_out, d_bias = features.T @ g, np.array([g.sum()], dtype=np.float32)
            d_features = g[:, None] * model.out
            of = np.repeat(np.arange(len(chunks)), chunks)
            d_h = (d_features[:, :HIDDEN] / chunks[:, None])[of]
            best = h == features[of, HIDDEN:]
            d_h = d_h + best * (d_features[:, HIDDEN:] / np.maximum(1, np.add.reduceat(best, starts, dtype=np.int64)))[of]
            d_h = (d_h * (h > 0)).astype(np.float32)
            d_before = (d_h @ model.hidden.T) * (before > 0)
            rows = np.arange(len(symbols))
            d_filters, d_embed = np.zeros_like(model.filters), np.zeros_like(model.embed)
            for f in range(FILTERS):
                place = top[:, f]
                d_filters[:, f] = windows[rows, place].T @ d_before[:, f]
                d_window = d_before[:, f][:, None, None] * model.filters[:, f].reshape(WIDTH, EMBEDDING)
                np.add.at(d_embed, symbols[rows[:, None], place[:, None] * STEP + np.arange(WIDTH)], d_window)
            grads = [d_embed, d_filters, d_before.sum(axis=0), maxima.T @ d_h, d_h.sum(axis=0), d_out, d_bias]
            t += 1
            for p, d, m, v in zip(parameters, grads, first, second):
                m += 0.1 * (d - m)
                v += 0.001 * (d * d - v)
                p -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return model


class Scorer:
    def __init__(self, model: Model):
        self.model = model

    def __call__(self, texts: list[str]) -> np.ndarray:
        """Probability of label 1 of each whole text."""
        if not texts:
            return np.zeros(0)
        maxima, counts = [], []
        for raws in _bounded([t.encode("utf-8") for t in texts], 1 << 19):
            symbols, chunks = chunk_symbols(raws)
            maxima.append(chunk_maxima(self.model, symbols))
            counts.append(chunks)
        chunks = np.concatenate(counts)
        logit = combined(self.model, np.concatenate(maxima), np.cumsum(chunks) - chunks, chunks)[2]
        return sigmoid(logit.astype(np.float64) + self.model.prior)


def _bounded(raws: list[bytes], limit: int) -> Iterator[list[bytes]]:
    some, held = [], 0
    for r in raws:
        if some and held + len(r) > limit:
            yield some
            some, held = [], 0
        some.append(r)
        held += len(r)
    if some:
        yield some


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The network from a bounded sample of training rows; the share of good rows among all training rows sets the prior."""
    rows, sizes = sample(documents(docs), labels, "quality", SAMPLE_ROWS, SAMPLE_CHARACTERS)
    model = train(rows["text"].tolist(), rows["label"].to_numpy(dtype=np.float64))
    if sizes.get(0) and sizes.get(1):
        model.prior = 0.5 * math.log(sizes[1] / sizes[0])
    return model


def quality(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs (doc_id, text; others are ignored).

    score, between 0 and 1, is the probability of label 1, and predicted is 1 from CUTOFF on. A null or empty text is scored as one
    chunk of padding. Repeated rows are each scored. Without labels of both kinds the scores are those of the untrained network.
    """
    model = model or fit(docs, labels)

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        scorer = Scorer(model)

        def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
            score = scorer(batch.column("text").to_pylist())
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64()), pa.array((score >= CUTOFF).astype(np.int32))], ["doc_id", "score", "predicted"])

        return kernel

    scored = map_documents(documents(docs), make, "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
