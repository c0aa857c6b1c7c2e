"""Columns and schemas by name, whatever characters a name is made of."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def column(name: str) -> Column:
    """The top-level column of exactly that name, dots and backticks included."""
    return F.col(quoted(name))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def extended(fields: T.StructType | list[T.StructField], **more: T.DataType) -> T.StructType:
    """A schema of the given fields, all nullable, and more behind them."""
    kept = [T.StructField(f.name, f.dataType, True, f.metadata) for f in fields]
    return T.StructType(kept + [T.StructField(name, kind) for name, kind in more.items()])


def map_arrow(df: DataFrame, function: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` for columns of any name; those with dots or backticks reach it under plain names."""
    names = df.columns
    if all(n.isidentifier() for n in names):
        return df.mapInArrow(function, schema)
    plain = df.select(*[column(n).alias(f"c{i}") for i, n in enumerate(names)])

    def named(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return function(pa.RecordBatch.from_arrays(b.columns, names=names) for b in batches)

    return plain.mapInArrow(named, schema)
