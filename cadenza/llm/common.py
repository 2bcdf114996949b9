"""What the operators share: the folder all executors see, tables that cut lineage, and Arrow kernels."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Text bytes that a kernel gets at once (one longer document comes alone).
SLICE_BYTES = 1 << 20

#: Bytes of an Arrow batch between the JVM and a Python worker at most (one longer row comes alone).
BATCH_BYTES = 8 << 20

#: Where driver and executors are one process (tests) and no folder is named.
LOCAL_DEFAULT = "/tmp/checkpoints/cadenza"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which driver and executors share; a local one will do only for a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    return (named or LOCAL_DEFAULT).rstrip("/")


def workspace(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/cadenza/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, and survives the loss of any executor."""
    path = workspace(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that `written` made, once nothing will read it again."""
    hadoop, jvm = df.sparkSession.sparkContext._jsc.hadoopConfiguration(), df.sparkSession.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(hadoop).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's bound on Arrow batches to BATCH_BYTES: both sides of a Python stage hold several batches at once."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(key, "64m").lower().rstrip("b")
    size = int(held[:-1]) << {"k": 10, "m": 20, "g": 30}[held[-1]] if held[-1:] in "kmg" else int(held)
    if size <= 0 or size > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def tidy() -> None:
    """Gives memory that this worker no longer needs back to the system: idle workers stay beside the JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(docs: DataFrame, *more: str) -> DataFrame:
    """Only the columns an operator reads; a null text is an empty one."""
    from pyspark.sql import functions as F

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """batch in runs of rows with at most limit bytes of text each, one row at least."""
    texts = batch.column(column)
    if pa.types.is_struct(texts.type):
        texts = texts.field("text")
    start = held = 0
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    for k, n in enumerate(sizes):
        if k > start and held + n > limit:
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def map_documents(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], object]], schema: str | StructType, column: str = "text", limit: int = SLICE_BYTES) -> DataFrame:
    """Applies make()'s kernel to bounded slices of each partition; a kernel returns one record batch or an iterator of them.

    What a kernel remembers ends with the partition: if it has a function `close`, that is called then.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = make()
        for batch in batches:
            for part in slices(batch, column, limit):
                out = kernel(part)
                if isinstance(out, pa.RecordBatch):
                    yield out
                elif out is not None:
                    yield from out
        getattr(kernel, "close", lambda: None)()
        del kernel
        tidy()

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def fits(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows: the check before a broadcast."""
    return df.limit(rows + 1).count() <= rows


def open_filesystem(uri: str):
    """A pyarrow filesystem and the path in it, for a URI or a plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(uri))
