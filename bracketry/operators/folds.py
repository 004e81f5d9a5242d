"""Folds of rows in their order, with a state that goes from one row of a key to the next."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


def ordered_fold(df: DataFrame, key: list[str], order: list[str], reads: list[str], start: Callable[[tuple], object], step: Callable[[object, tuple], tuple[object, tuple]], adds: str, dealt: bool = False) -> DataFrame:
    """df with the columns of adds, which step gives for each row of a key in order.

    step(state, row) has the row's reads and gives the next state and the added values; start(row) is a key's first state. Rows
    are dealt by key and sorted by Spark, which spills, and a task holds one batch and one state however many rows a key has.
    dealt: rows are where they should be, sorted; a key's state begins anew in each partition. Nulls are a key.
    """
    schema = StructType([*df.schema.fields, *_parse_datatype_string(adds).fields])
    kind, n = to_arrow_schema(schema), len(key)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for b in batches:
            out = []
            for row in zip(*(b.column(c).to_pylist() for c in [*key, *reads]), strict=True):
                if last is None or row[:n] != last:
                    last, state = row[:n], start(row[n:])
                state, values = step(state, row[n:])
                out.append(values)
            added = [pa.array(v, f.type) for v, f in zip(zip(*out, strict=True), list(kind)[b.num_columns :], strict=True)] if out else []
            if out:
                yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(b.columns, kind, strict=False)), *added], schema=kind)

    rows = df if dealt else df.repartition(*key).sortWithinPartitions(*key, *order)
    return rows.mapInArrow(fold, schema)
