"""Row numbers inside groups without one task per group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def number_rows(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with ``name``: 0, 1, 2, ... inside each group, in the order of
    ``order``.  The rows are range-partitioned and sorted by group and order, so
    a group of any size is spread over many tasks; a task numbers what it has,
    and what a group has in earlier tasks is added afterwards.  Nulls are a
    group of their own and come first."""
    spark = df.sparkSession
    schema = df.schema
    ready = df.withColumn("_group", F.xxhash64(*group)).repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)

    def run(batches):
        task, last, count, seen, first = TaskContext.get().partitionId(), None, 0, 0, True
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            g = batch.column(batch.num_columns - 1).to_numpy()
            new = np.ones(n, bool)
            new[1:] = g[1:] != g[:-1]
            new[0] = last is None or g[0] != last
            starts = np.flatnonzero(new)
            begin = np.full(n, -1)
            begin[starts] = starts
            begin = np.maximum.accumulate(begin)
            place = np.arange(n) - np.where(begin < 0, -count, begin)
            in_first = np.zeros(n, bool)
            if first:
                end = starts[1] if last is None and len(starts) > 1 else starts[0] if last is not None and len(starts) else n
                in_first[:end] = True
                first = end == n
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(n, task, np.int32)), pa.array(np.arange(seen, seen + n)),
                 pa.array(place.astype(np.int64)), pa.array(in_first)],
                [*batch.schema.names, "_task", "_row", "_place", "_first"])
            last, count, seen = g[-1], int(place[-1]) + 1, seen + n

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    numbered = stored(ready.mapInArrow(run, f"{columns}, _group long, _task int, _row long, _place long, _first boolean"),
                      "numbered")
    # a row per task, each of which the driver has watched
    tasks = numbered.groupBy("_task").agg(
        F.min_by("_group", "_row"), F.max_by("_group", "_row"), F.max_by("_place", "_row"), F.min(F.col("_first"))).collect()
    carry, before, running = [], None, 0
    for task, first_group, last_group, place, one_group in sorted(map(tuple, tasks)):
        add = running if first_group == before else 0
        carry.append((task, add))
        running = place + 1 + (add if one_group else 0)
        before = last_group
    added = F.broadcast(spark.createDataFrame(carry, "_task int, _add long"))
    return (numbered.join(added, "_task")
            .withColumn(name, F.col("_place") + F.when(F.col("_first"), F.col("_add")).otherwise(F.lit(0)))
            .select(*schema.names, name))
