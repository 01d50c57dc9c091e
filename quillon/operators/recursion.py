"""Recursions over each key's rows in order, where a row's result depends on the result before it."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

_ARROW = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
_SPARK = {"int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType()}


def carried(df: DataFrame, by: Sequence[str], order: Sequence[str], inputs: Sequence[str], outputs: dict[str, str], start: Callable[[], object], step: Callable) -> DataFrame:
    """df with the columns `outputs` (name -> int, long or double): step(state, *inputs) gives the next
    state and the row's values; each key begins with start().

    Rows are dealt by key, sorted within their partition and streamed through in Arrow batches; the state
    is all that is held of a key, however long its history is. Missing doubles come as None."""
    keys = list(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = object(), None
        for batch in batches:
            at = batch.schema.get_field_index
            out: list[list] = [[] for _ in outputs]
            names = zip(*(batch.column(at(k)).to_pylist() for k in keys))
            for name, values in zip(names, zip(*(batch.column(at(c)).to_pylist() for c in inputs))):
                if name != key:
                    key, state = name, start()
                state, got = step(state, *values)
                for column, value in zip(out, got):
                    column.append(value)
            cols = [pa.array(c, _ARROW[kind], from_pandas=True) for c, kind in zip(out, outputs.values())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, *outputs])

    schema = T.StructType([*df.schema.fields, *[T.StructField(n, _SPARK[kind]) for n, kind in outputs.items()]])
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
