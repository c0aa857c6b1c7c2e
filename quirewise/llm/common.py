"""Helpers shared by the training-data operators.

Everything here is small and stateless: reading a table, mapping Arrow batches,
cutting lineage, and the one text convention the operators share (a null text
is the empty text).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirewise.columns import column, map_arrow
from quirewise.operators.graph import checkpoint
from quirewise.session import scratch, ship

#: Rows and bytes of an Arrow batch handed to Python, where the session names none.
#: A text may be megabytes long, so rows alone would not bound a worker's memory.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500", "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}

#: A-Z to a-z and nothing else: the ASCII lower-casing the operators ask for.
ASCII_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The table ``table`` of a data folder, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Ship the package, and keep Arrow batches small where the session has not set them itself."""
    ship(spark)
    for name, value in BATCHES.items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, value)


def map_batches(
    df: DataFrame,
    per_batch: Callable[[pa.RecordBatch], pa.RecordBatch | None],
    schema: str | T.StructType,
) -> DataFrame:
    """Apply ``per_batch`` to every Arrow batch of ``df``, partition by partition."""
    bound_batches(df.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = per_batch(batch)
                if out is not None:
                    yield out

    return map_arrow(df, run, schema)


def record_batch(**columns: tuple[Iterable, pa.DataType]) -> pa.RecordBatch:
    """A record batch from ``name=(values, type)`` pairs."""
    return pa.RecordBatch.from_arrays(
        [pa.array(values, type=kind) for values, kind in columns.values()],
        names=list(columns),
    )


def run_folder(spark: SparkSession) -> str:
    """A new folder's name inside the folder that driver and executors share."""
    return scratch(spark)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` by a reliable checkpoint in the shared folder."""
    return checkpoint(df)


def row_hash(df: DataFrame) -> Column:
    """A hash of a whole row that tells where nulls stand; nested values go in as JSON."""
    parts: list[Column] = []
    for f in df.schema:
        value = column(f.name)
        nested = isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType))
        parts += [value.isNull(), F.to_json(F.struct(value), {"ignoreNullFields": "false"}) if nested else value]
    return F.xxhash64(*parts)


def text_or_empty(name: str = "text"):
    """The text column, a null taken as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))
