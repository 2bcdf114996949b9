"""Quality rules with risk-controlled thresholds.

Rates per document (symbols, capitals, exclamation marks, repeated lines) reject above cutoffs. For each stratum (a language)
and each rate, cutoffs are tried from lax to strict on labelled good documents of the calibration folds; the last one whose
share of false rejections is, by an exact binomial bound, below the allowance holds. The allowance of a stratum is shared by
the rates and the error probability by all tests (Bonferroni over strata and rates; the fixed order of trial cutoffs needs no
further correction). A stratum with too few labels for any such statement keeps all its documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import map_documents, written

#: Good documents of a stratum that may be rejected, and the probability that the statement fails for any stratum.
ALLOWED, ERROR = 0.02, 0.05
#: Base limits: fewer words, or a greater percentage of words in repeated windows, fail.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Trial cutoffs of every rate, from lax to strict.
GRID = [2.0 ** (3 - k / 4) for k in range(45)]
SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\x0b\x0c\r"
CAPITALS = bytes(range(65, 91))

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks")
RATES = {
    "symbol_rate": ("n_symbols", "n_words"),
    "capital_rate": ("n_capitals", "word_chars"),
    "mark_rate": ("n_marks", "n_words"),
    "dup_line_rate": ("n_dup_lines", "n_lines"),
}


def counts(text: str) -> tuple[int, ...]:
    """COUNTS of one text. Words are runs without blank and the characters 9 to 13, which is how bytes split."""
    b = text.encode("utf-8")
    words = b.split()
    n = len(words)
    windows = Counter(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(windows) < n - 2:
        last = 0  # words before it are counted
        for k, w in enumerate(zip(words, words[1:], words[2:])):
            if windows[w] > 1:
                repeated += k + 3 - max(k, last)
                last = k + 3
    lines = [x for x in b.split(b"\n") if x.strip()]
    return (
        n,
        len(text) - sum(b.count(c) for c in WHITE),
        sum(b.count(c) for c in SYMBOLS),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        len(b) - len(b.translate(None, CAPITALS)),
        b.count(b"!"),
    )


def with_counts(rows: DataFrame) -> DataFrame:
    """_row (a struct with a text, among others) and COUNTS of its text (null: none of anything)."""
    schema = StructType([rows.schema["_row"], *(StructField(c, LongType()) for c in COUNTS)])

    def make():
        def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
            columns = list(zip(*(counts(t or "") for t in batch.column("_row").field("text").cast(pa.string()).to_pylist())))
            return pa.RecordBatch.from_arrays([batch.column("_row"), *(pa.array(c, pa.int64()) for c in columns)], ["_row", *COUNTS])

        return kernel

    return map_documents(rows, make, schema, column="_row")


def rate(name: str) -> Column:
    a, b = RATES[name]
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) for X of n trials with probability p, k not above the mean: exact terms, largest first."""
    if k >= n:
        return 1.0
    log = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    term = total = math.exp(log)
    for j in range(k, 0, -1):
        term *= j * (1 - p) / ((n - j + 1) * p)
        total += term
        if term < total * 1e-17 and j < n * p:
            break
    return min(1.0, total)


def certified(rejected: int, n: int, allowed: float, error: float) -> bool:
    """Whether the exact upper bound (Clopper-Pearson) on a rate, with so many of n seen, is at most allowed."""
    return n > 0 and rejected < n * allowed and binomial_cdf(rejected, n, allowed) <= error


def least_labels(allowed: float, error: float) -> int:
    """Labels without which not even no rejection at all is certified."""
    return math.ceil(math.log(error) / math.log1p(-allowed))


def stratum() -> Column:
    """The language, in a form that tells a null one from all others."""
    return F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("null"))


def calibration_rows(labels: DataFrame) -> DataFrame:
    """doc_id of labelled good documents outside the held-out fold; of contradicting labels the worse holds."""
    good = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality")).where("quality = 1")
    return good.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1).select("doc_id")


def fit_cutoffs(counted: DataFrame, labels: DataFrame, allowed: float = ALLOWED, error: float = ERROR) -> dict[str, dict[str, float]]:
    """Cutoffs by stratum and rate, from all calibration rows.

    counted has doc_id, lang and COUNTS. Documents that the base limits reject anyway say nothing about a cutoff, so they
    don't enter. Only counts per stratum, rate and trial cutoff come to the driver.
    """
    rows = counted.join(calibration_rows(labels), "doc_id", "left_semi").where(~base_failed())
    # How many trial cutoffs each value exceeds: GRID falls, so these are the last ones.
    over = lambda value: sum((value > g).cast("int") for g in GRID)
    cells = rows.select(stratum().alias("stratum"), F.explode(F.array(*[F.struct(F.lit(r).alias("rate"), over(rate(r)).alias("over")) for r in RATES])).alias("x"))
    per_rate = allowed / len(RATES)
    seen = cells.groupBy("stratum", "x.rate", "x.over").count()
    large = cells.groupBy("stratum").count().where(F.col("count") >= len(RATES) * least_labels(per_rate, error)).select("stratum")
    found: dict[tuple[str, str], dict[int, int]] = {}
    for r in seen.join(large, "stratum", "left_semi").collect():
        found.setdefault((r["stratum"], r["rate"]), {})[r["over"]] = r["count"]
    out: dict[str, dict[str, float]] = {}
    for (s, name), by in sorted(found.items()):
        n, rejected = sum(by.values()), 0
        for k, cutoff in enumerate(GRID):  # cutoff k is exceeded by values that exceed len(GRID) - k of the cutoffs or more
            rejected = sum(c for o, c in by.items() if o >= len(GRID) - k)
            if not certified(rejected, n, per_rate, error / len(found)):
                break
            out.setdefault(s, {})[name] = cutoff
    return out


def rejected_by(cutoffs: dict[str, dict[str, float]]) -> Column:
    """Whether a row's rates exceed its stratum's cutoffs."""
    out = F.lit(False)
    for s, by in cutoffs.items():
        for name, cutoff in by.items():
            out = out | ((stratum() == s) & (rate(name) > cutoff))
    return out


def quality_rules(docs: DataFrame, labels: DataFrame, allowed: float = ALLOWED, error: float = ERROR) -> DataFrame:
    """A row per row of docs: doc_id, COUNTS, rates, base_failed, kept.

    docs has doc_id, text and lang; labels has doc_id and quality. A null or empty text has no words and fails the base
    limits; a null lang is a stratum of its own; repeated rows are each judged and each count; without labels only the base
    limits reject; other columns are ignored.
    """
    d = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).alias("_row"))
    counted = written(with_counts(d).select("_row.doc_id", "_row.lang", *COUNTS), "counts")
    cutoffs = fit_cutoffs(counted, labels, allowed, error)
    return counted.select("doc_id", *COUNTS, *(rate(r).alias(r) for r in RATES), base_failed().alias("base_failed"), (~base_failed() & ~rejected_by(cutoffs)).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, **options: float) -> DataFrame:
    """The rows of docs that quality_rules keeps, with all their columns.

    A text goes to Python and back once: rows are written with their counts, and the verdict is a filter on what was written.
    """
    # The columns travel in one, so that none can clash with a count.
    counted = written(with_counts(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))).where(~base_failed()), "counted")
    keyed = counted.select(F.col("_row.doc_id").cast("long").alias("doc_id"), F.col("_row.lang").cast("string").alias("lang"), *COUNTS)
    cutoffs = fit_cutoffs(keyed, labels, **options)
    return counted.withColumn("lang", F.col("_row.lang").cast("string")).where(~rejected_by(cutoffs)).select("_row.*")


def brute_counts(text: str) -> Iterator[int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words by the letter; for tests."""
    import re

    word = re.compile("[^\x20\x09-\x0d]+")
    words = word.findall(text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    lines = text.split("\n")
    yield len(words)
    yield sum(map(len, words))
    yield sum(c in "#*$%&|<>" for c in text)
    yield sum(bool(word.search(x)) and x in lines[:k] for k, x in enumerate(lines))
    yield len({j for k, w in enumerate(windows) if windows.count(w) > 1 for j in (k, k + 1, k + 2)})
