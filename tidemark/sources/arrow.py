"""Per-batch Python helpers for operators that leave the built-in functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def append_columns(
    df: DataFrame,
    inputs: Sequence[str],
    fields: Sequence[T.StructField],
    fn: Callable[..., Sequence[list]],
) -> DataFrame:
    """`df` with `fields` appended, computed batch by batch.

    `fn` gets one Python list per input column and returns one list per field.
    Narrow: no shuffle, row order and the other columns untouched. A field named like an
    existing column takes its place, at the end.
    """
    names = [f.name for f in fields]
    positions = [df.columns.index(c) for c in inputs]
    arrow_types = [to_arrow_type(f.dataType) for f in fields]
    # By place while in Python: any name will do, dots and doubles included.
    columns = [f"c{i}" for i in range(len(df.columns) + len(fields))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = fn(*(batch.column(p).to_pylist() for p in positions))
            arrays = [pa.array(m, type=t) for m, t in zip(made, arrow_types, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=columns)

    types = [f.dataType for f in (*df.schema.fields, *fields)]
    out = df.toDF(*columns[: len(df.columns)]).mapInArrow(run, T.StructType([T.StructField(c, t) for c, t in zip(columns, types, strict=True)]))
    kept = [F.col(c).alias(n) for c, n in zip(columns, df.columns, strict=False) if n not in names]
    return out.select(*kept, *(F.col(c).alias(n) for c, n in zip(columns[len(df.columns) :], names, strict=True)))
