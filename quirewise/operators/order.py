"""Ranks and running sums over a whole table, without one task that sees all of it, and spare column names."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirewise.operators.graph import checkpoint


def spare(df: DataFrame, name: str) -> str:
    """``name``, with underscores appended until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def running_sums(rows: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """``rows`` with ``<column>_upto``, the sums of ``columns`` up to each row in ascending ``order``, which has no ties.

    Rows are dealt by ranges of ``order``; each part is summed within itself, and
    the driver gets one row of sums for each part.
    """
    part = spare(rows, "_part")
    dealt = checkpoint(rows.repartitionByRange(order).sortWithinPartitions(order).withColumn(part, F.spark_partition_id()))
    sums = sorted(map(tuple, dealt.groupBy(part).agg(*[F.sum(c).alias(c) for c in columns]).collect()))
    offsets, total = [], [0] * len(columns)
    for number, *of_part in sums:
        offsets.append((number, *total))
        total = [a + (b or 0) for a, b in zip(total, of_part, strict=True)]
    before = {c: spare(rows, f"_before_{c}") for c in columns}
    schema = ", ".join([f"{part} int", *[f"`{b}` {dealt.agg(F.sum(c).alias(c)).schema[c].dataType.simpleString()}" for c, b in before.items()]])
    known = dealt.sparkSession.createDataFrame(offsets, schema)
    upto = Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    joined = dealt.join(F.broadcast(known), part)  # one row a part
    return joined.withColumns({f"{c}_upto": F.col(b) + F.sum(c).over(upto) for c, b in before.items()}).drop(part, *before.values())


def ranked(values: DataFrame, order: str, name: str) -> DataFrame:
    """Distinct ``values`` with their rank from 1 in ascending ``order``, which has no ties among them."""
    one = spare(values, "_one")
    numbered = running_sums(values.distinct().withColumn(one, F.lit(1).cast("bigint")), order, [one])
    return numbered.withColumnRenamed(f"{one}_upto", name).drop(one)


def by_key(batches: Iterable[pa.RecordBatch], columns: list[str]) -> Iterator[dict[str, list]]:
    """The rows of each value of the first column as lists by column; rows of one value stand together.

    A value's rows in this partition are held, so at most a partition is.
    """
    key, held = columns[0], None
    for batch in batches:
        data = {c: batch.column(c).to_pylist() for c in columns}
        at, keys = 0, data[key]
        while at < len(keys):
            end = at + 1
            while end < len(keys) and keys[end] == keys[at]:
                end += 1
            part = {c: v[at:end] for c, v in data.items()}
            if held is not None and held[key][0] == keys[at]:
                for c in columns:
                    held[c] += part[c]
            else:
                if held is not None:
                    yield held
                held = part
            at = end
    if held is not None:
        yield held
