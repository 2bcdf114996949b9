"""Ordered folds over streams whose state is small: rows pass a task once, in order, and nothing of a stream is gathered."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType

#: Rows that are handed on together.
ROWS = 20_000


def folded(rows: DataFrame, order: list[str], columns: list[str], start: Callable[[], Callable[..., Iterable[tuple]]], schema: str) -> DataFrame:
    """stream_id and schema's columns: what start()'s function gives for the columns of each row of a stream, in order.

    Streams are dealt by id and sorted, and a task carries the state of one stream at a time, whatever its length; the order of a
    stream is inherent to a fold, so one stream is one task.
    """
    key = rows.schema["stream_id"]
    out = StructType([StructField("stream_id", key.dataType), *StructType.fromDDL(schema).fields])
    names = [f.name for f in out.fields]
    dealt = rows.select("stream_id", *dict.fromkeys([*order, *columns])).repartition("stream_id").sortWithinPartitions("stream_id", *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)
        held: list[tuple] = []
        now, step = object(), None
        as_batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), arrow.types)], names)
        for batch in batches:
            for sid, *values in zip(batch.column("stream_id").to_pylist(), *(batch.column(c).to_pylist() for c in columns)):
                if sid != now:
                    now, step = sid, start()
                held += [(sid, *x) for x in step(*values)]
                if len(held) >= ROWS:
                    yield as_batch()
                    held.clear()
        if held:
            yield as_batch()

    return dealt.mapInArrow(run, out)
