"""A fold over the rows of each key, in order: what windows can't say because a row's outcome decides the next.

Rows are dealt by key, sorted within their partition, and read as a stream of Arrow batches; only a small
state is held, and it begins anew with each key. Time and memory don't depend on how many rows a key has,
but a key is one task's work, as each outcome needs the one before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: Takes the state (None at first) and a row's input values; gives the next state and the row's outputs.
Step = Callable[[Any, tuple], tuple[Any, tuple]]


def ordered_scan(df: DataFrame, keys: list[str], order: list[str], inputs: list[str], outputs: str, step: Step) -> DataFrame:
    """df with the `outputs` columns (a schema as text) of `step`, applied to each key's rows in order."""
    more = StructType.fromDDL(outputs)
    df = df.drop(*more.names)
    schema = StructType([*df.schema.fields, *more.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, now, state = to_arrow_schema(more), None, None
        for batch in batches:
            found = []
            key_rows = zip(*[batch.column(k).to_pylist() for k in keys], strict=True)
            for key, row in zip(key_rows, zip(*[batch.column(c).to_pylist() for c in inputs], strict=True), strict=True):
                if key != now:
                    now, state = key, None
                state, out = step(state, row)
                found.append(out)
            columns = [pa.array([x[i] for x in found], f.type) for i, f in enumerate(arrow)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *more.names])

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
