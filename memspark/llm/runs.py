"""Runs of equal keys in range-partitioned, sorted rows, streamed in constant memory."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize


def later_in_run(rows: DataFrame, keys: list[str], value: str, rest: list[str] = (), name: str = "runs") -> DataFrame:
    """Rows (value, *rest, least) whose value is not the least of those with equal keys; all columns are integers.

    Rows are range-partitioned by keys, value and rest, so that a key which a third of the rows share spreads over
    many partitions, and sorted; each partition is streamed once, and rows that hold their key's least value are not
    returned. A partition may begin in the middle of a key's rows. So each also returns the first value of its first
    and of its last key; the least of these by key, at most two rows a partition, settles what it can't know alone.
    """
    by = [*keys, value, *rest]
    slim = materialize(rows.select(*by), f"{name}-rows")  # range partitioning samples its input before it reads it
    spread = slim.repartitionByRange(*by).sortWithinPartitions(*by)
    fields = [*slim.schema.fields, slim.schema[value]]
    names = [*by, "__ms_first", "__ms_open", "__ms_mark"]
    kinds = [np.dtype({"tinyint": "i1", "int": "i4"}.get(f.dataType.simpleString(), "i8")) for f in fields] + [np.dtype(bool)] * 2
    schema = T.StructType([*slim.schema.fields, T.StructField("__ms_first", slim.schema[value].dataType), T.StructField("__ms_open", T.BooleanType()), T.StructField("__ms_mark", T.BooleanType())])
    n_keys = len(keys)

    def record(values, first, opened, mark):
        arrays = [*values, first, opened, np.full(len(first), mark)]
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, dtype=k)) for x, k in zip(arrays, kinds, strict=True)], names=names)

    def marked(key, first):
        return record([*([k] for k in key), [first], *([0] for _ in rest)], [first], [False], True)

    def stream(batches):
        last = None  # key that the batch before ended in, its first value here, whether it began the partition
        for b in batches:
            if not b.num_rows:
                continue
            values = [np.asarray(b.column(i)) for i in range(b.num_columns)]
            own = values[n_keys]
            new = np.ones(len(own), dtype=bool)
            new[1:] = np.any([k[1:] != k[:-1] for k in values[:n_keys]], axis=0)
            starts = np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))
            first, opened = own[starts], np.zeros(len(own), dtype=bool)
            goes_on = last is not None and last[0] == tuple(k[0] for k in values[:n_keys])
            if goes_on:
                first = np.where(starts == 0, last[1], first)
            if last is None or goes_on and last[2]:
                opened = starts == 0
            if last is None:
                yield marked([k[0] for k in values[:n_keys]], first[0])
            last = (tuple(k[-1] for k in values[:n_keys]), first[-1], bool(opened[-1]))
            out = np.flatnonzero(opened | (own != first))
            yield record([x[out] for x in values], first[out], opened[out], False)
        if last is not None:
            yield marked(last[0], last[1])

    streamed = materialize(spread.mapInArrow(stream, schema), name)
    marks = streamed.where("__ms_mark").groupBy(*keys).agg(F.min("__ms_first").alias("__ms_least"))
    closed = streamed.where("not __ms_mark and not __ms_open").select(value, *rest, F.col("__ms_first").alias("least"))
    opened = streamed.where("__ms_open").join(F.broadcast(marks), keys, "left")  # two marks a partition at most
    opened = opened.select(value, *rest, F.least("__ms_first", "__ms_least").alias("least")).where(F.col(value) != F.col("least"))
    return closed.unionByName(opened)
