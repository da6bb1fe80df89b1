"""Running totals over a total order without passing the rows through one task."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.scratch import Scratch

#: Tables with up to this many rows (some MB) are broadcast by ``small``; larger ones are joined by a shuffle.
SMALL_ROWS = 100_000


def small(df: DataFrame) -> DataFrame:
    """A hint to broadcast ``df`` if a count finds it small."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def _accumulate(place: int):
    """Rows of a sorted partition -> the rows with the partition's number and the sum up to and with each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, carried = TaskContext.get().partitionId(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            sums = pc.add(pc.cumulative_sum(batch.column(place)), carried).cast(batch.column(place).type)
            carried = sums[-1]
            number = pa.array([part] * batch.num_rows, pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, number, sums], [*batch.schema.names, "part", "in_part"])

    return run


def running_total(df: DataFrame, order: list[Column], value: str, total: str, scratch: Scratch, name: str) -> DataFrame:
    """``df`` with ``total``: the sum of ``value``, which is never null, over all rows up to and with this one in ``order``.

    Rows move once: they are range-partitioned, sorted, summed up within their part while they stream by, and kept. Each part's sum (a
    row a part) gives the offset of the next. Rows that tie in all of ``order`` land in one part and follow each other in any order, so an
    order that can tie on many rows should end in a unique column.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = T.StructType([*df.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("in_part", df.schema[value].dataType)])
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = scratch.keep(dealt.mapInArrow(_accumulate(df.columns.index(value)), schema), name)
    sums = dealt.groupBy("part").agg(F.max("in_part").alias("sum"))
    upto = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select("part", F.coalesce(F.sum("sum").over(upto), F.lit(0)).alias("offset"))
    return dealt.join(F.broadcast(offsets), "part").withColumn(total, F.col("offset") + F.col("in_part")).drop("part", "offset", "in_part")
