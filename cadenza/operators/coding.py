"""Decisions that encoders and containers make, as relational operators: argmins, prefix sums, runs and lacing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pcm import div


def _argmin(costs: list[Column]) -> Column:
    """Number of the first smallest cost."""
    return F.array_min(F.array(*(F.struct(c.alias("cost"), F.lit(k).alias("k")) for k, c in enumerate(costs))))["k"]


def fixed_order(samples: DataFrame, block: int = 4096) -> DataFrame:
    """stream_id, block_no, predictor order: the least sum of |residual| over orders 0 to 4, the lowest order on ties.

    Orders are compared on the samples that all of them predict (from the fifth of a block on).
    """
    s = samples.select("stream_id", div("n", block).alias("block_no"), "n", F.col("v").cast("long").alias("v"))
    w = Window.partitionBy("stream_id", "block_no").orderBy("n")
    x = [F.col("v"), *(F.lag("v", k).over(w) for k in range(1, 5))]
    residuals = [x[0], x[0] - x[1], x[0] - 2 * x[1] + x[2], x[0] - 3 * x[1] + 3 * x[2] - x[3], x[0] - 4 * x[1] + 6 * x[2] - 4 * x[3] + x[4]]
    r = s.select("stream_id", "block_no", *(F.abs(e).alias(f"r{k}") for k, e in enumerate(residuals))).where("r4 IS NOT NULL")
    sums = r.groupBy("stream_id", "block_no").agg(*(F.sum(f"r{k}").alias(f"s{k}") for k in range(5)))
    return sums.select("stream_id", "block_no", _argmin([F.col(f"s{k}") for k in range(5)]).alias("order"), *(f"s{k}" for k in range(5)))


def rice_parameter(residuals: DataFrame, most: int = 14) -> DataFrame:
    """stream_id, block_no, k, bits of residuals(stream_id, block_no, r): the folded values' cheapest Rice parameter, the lowest on ties."""
    u = F.when(F.col("r") >= 0, F.col("r") * 2).otherwise(F.col("r") * -2 - 1)
    sums = residuals.select("stream_id", "block_no", u.alias("u")).groupBy("stream_id", "block_no").agg(*(F.sum(F.shiftright("u", k) + 1 + k).alias(f"b{k}") for k in range(most + 1)))
    return sums.select("stream_id", "block_no", _argmin([F.col(f"b{k}") for k in range(most + 1)]).alias("k"), F.least(*(F.col(f"b{k}") for k in range(most + 1))).alias("bits"))


def stereo_mode(pairs: DataFrame) -> DataFrame:
    """stream_id, block_no, mode of pairs(stream_id, block_no, l, r): 0 left/right, 1 left/side, 2 right/side, 3 mid/side, by sums of magnitudes."""
    l, r = F.col("l"), F.col("r")  # noqa: E741
    side, mid = l - r, F.shiftright(l + r, 1)
    total = lambda x: F.sum(F.abs(x))
    sums = pairs.groupBy("stream_id", "block_no").agg(total(l).alias("a"), total(r).alias("b"), total(side).alias("s"), total(mid).alias("m"))
    costs = [F.col("a") + F.col("b"), F.col("a") + F.col("s"), F.col("s") + F.col("b"), F.col("m") + F.col("s")]
    return sums.select("stream_id", "block_no", _argmin(costs).alias("mode"), F.least(*costs).alias("cost"))


def decorrelate(mode: Column, l: Column, r: Column) -> tuple[Column, Column]:  # noqa: E741
    """The two channels that a stereo mode stores."""
    return F.when(mode == 2, l - r).when(mode == 3, F.shiftright(l + r, 1)).otherwise(l), F.when(mode.isin(1, 3), l - r).otherwise(r)


def recorrelate(mode: Column, a: Column, b: Column) -> tuple[Column, Column]:
    """Left and right from what a stereo mode stores."""
    mid = F.shiftleft(a, 1).bitwiseOR(b.bitwiseAND(F.lit(1)))
    left = F.when(mode == 2, a + b).when(mode == 3, F.shiftright(mid + b, 1)).otherwise(a)
    return left, F.when(mode == 1, a - b).when(mode == 3, F.shiftright(mid - b, 1)).otherwise(b)


def autocorrelation(samples: DataFrame, lags: int = 8, block: int = 4096) -> DataFrame:
    """stream_id, block_no, lag, r: Hann-windowed products of each block with itself, lag 0 to lags."""
    s = samples.select("stream_id", div("n", block).alias("block_no"), "n", "v")
    by = Window.partitionBy("stream_id", "block_no")
    i, n = F.col("n") % block, F.count("*").over(by)
    weight = 0.5 * (1 - F.cos(2 * F.lit(3.141592653589793) * i / n))
    x = s.withColumn("x", F.col("v") * weight)
    w = by.orderBy("n")
    terms = x.select("stream_id", "block_no", *(F.coalesce(F.col("x") * F.lag("x", k).over(w), F.lit(0.0)).alias(f"t{k}") for k in range(1, lags + 1)), (F.col("x") * F.col("x")).alias("t0"))
    sums = terms.groupBy("stream_id", "block_no").agg(*(F.sum(f"t{k}").alias(f"s{k}") for k in range(lags + 1)))
    return sums.select("stream_id", "block_no", F.posexplode(F.array(*(F.col(f"s{k}") for k in range(lags + 1)))).alias("lag", "r"))


def sample_index(packets: DataFrame, per_chunk: int = 1, base: int = 0) -> DataFrame:
    """stream_id, sample_no, chunk_no, offset, size of packets(stream_id, n, size): chunks in order, samples back to back within one."""
    chunk = div("n", per_chunk)
    w = Window.partitionBy("stream_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    return packets.select("stream_id", F.col("n").alias("sample_no"), chunk.alias("chunk_no"), (F.coalesce(F.sum("size").over(w), F.lit(0)) + base).alias("offset"), "size")


def expand_sample_table(chunks: DataFrame, runs: DataFrame, sizes: DataFrame) -> DataFrame:
    """stream_id, sample_no, offset, size from an MP4 sample table.

    chunks(stream_id, chunk_no, chunk_offset) and runs(stream_id, first_chunk, per_chunk) are numbered from 1, sizes(stream_id, sample_no,
    size) from 0. A run holds until the next one starts: looked up as of the chunk, then expanded, numbered and summed.
    """
    both = runs.select("stream_id", F.col("first_chunk").alias("chunk_no"), F.lit(0).alias("probe"), "per_chunk").unionByName(chunks.select("stream_id", "chunk_no", F.lit(1).alias("probe"), "chunk_offset"), allowMissingColumns=True)
    last = Window.partitionBy("stream_id").orderBy("chunk_no", "probe").rowsBetween(Window.unboundedPreceding, 0)
    c = both.withColumn("per_chunk", F.last("per_chunk", ignorenulls=True).over(last)).where("probe = 1 AND per_chunk > 0")
    before = Window.partitionBy("stream_id").orderBy("chunk_no").rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("first", F.coalesce(F.sum("per_chunk").over(before), F.lit(0)))
    s = c.select("stream_id", "chunk_no", "chunk_offset", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("per_chunk") - 1)).alias("sample_no"))
    inside = Window.partitionBy("stream_id", "chunk_no").orderBy("sample_no").rowsBetween(Window.unboundedPreceding, -1)
    return s.join(sizes, ["stream_id", "sample_no"]).select("stream_id", "sample_no", (F.col("chunk_offset") + F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("offset"), "size")


def lacing(packets: DataFrame) -> DataFrame:
    """stream_id, segment_no, n, lace: 255s and a closing value below 255 for each packet of packets(stream_id, n, size)."""
    s = packets.select("stream_id", "n", "size", F.explode(F.sequence(F.lit(0).cast("long"), div("size", 255))).alias("i"))
    w = Window.partitionBy("stream_id").orderBy("n", "i")
    return s.select("stream_id", (F.row_number().over(w) - 1).cast("long").alias("segment_no"), "n", F.least(F.col("size") - F.col("i") * 255, F.lit(255)).alias("lace"))


def packets_of(segments: DataFrame) -> DataFrame:
    """stream_id, n, size, segments from lacing values: a packet ends with a value below 255; an unended one is left out."""
    w = Window.partitionBy("stream_id").orderBy("segment_no").rowsBetween(Window.unboundedPreceding, -1)
    s = segments.withColumn("n", F.coalesce(F.sum(F.when(F.col("lace") < 255, 1).otherwise(0)).over(w), F.lit(0)))
    return s.groupBy("stream_id", "n").agg(F.sum("lace").alias("size"), F.count("*").alias("segments"), F.min("lace").alias("least")).where("least < 255").drop("least")


def sections(bands: DataFrame) -> DataFrame:
    """stream_id, section, first, length, book: runs of equal codebook in bands(stream_id, band, book)."""
    w = Window.partitionBy("stream_id").orderBy("band")
    changed = F.when(F.col("book") == F.lag("book").over(w), 0).otherwise(1)
    b = bands.withColumn("changed", changed).withColumn("section", F.sum("changed").over(w) - 1)
    return b.groupBy("stream_id", "section").agg(F.min("band").alias("first"), F.count("*").alias("length"), F.first("book").alias("book"))


def nearest_entry(vectors: DataFrame, entries: DataFrame, most: int = 8192) -> DataFrame:
    """id, entry, distance: the entry with the least squared distance of each vector, the lowest number on ties.

    vectors(id, x) and entries(entry, y). A codebook has at most `most` entries (its format's limit), which travel to the vectors
    as one row; vectors are never multiplied.
    """
    if entries.limit(most + 1).count() > most:
        raise ValueError(f"a codebook has at most {most} entries")
    book = entries.agg(F.sort_array(F.collect_list(F.struct("entry", "y"))).alias("book"))
    distance = lambda y: F.aggregate(F.zip_with("x", y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    best = F.array_min(F.transform("book", lambda e: F.struct(distance(e["y"]).alias("distance"), e["entry"].alias("entry"))))
    return vectors.crossJoin(F.broadcast(book)).select("id", best.alias("b")).select("id", "b.entry", "b.distance")
