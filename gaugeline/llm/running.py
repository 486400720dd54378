"""Running sums over a key's rows in an order, also where one key has most of the rows.

Rows are range-partitioned by key and order, so a common key lies in several partitions.  Each partition sums as its
rows stream by; what a key had in the partitions before is added afterwards, from one row a partition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import staged

MARKS = (("_part", T.IntegerType()), ("_first", T.BooleanType()), ("_last", T.BooleanType()))


def summed(key: str, sums: tuple[str, ...]):
    """Over sorted rows: the sums up to and with each row within the partition, its number, and its two edges."""

    def run(batches):
        part, first, total, at, held = TaskContext.get().partitionId(), True, np.zeros(len(sums), np.int64), None, None
        for b in batches:
            if not b.num_rows:
                continue
            if held is not None:
                yield held
            keys = b.column(key).to_numpy()
            begins = np.flatnonzero(np.concatenate([[at is None or keys[0] != at], keys[1:] != keys[:-1]]))
            values = np.stack([b.column(s).to_numpy() for s in sums], 1).astype(np.int64)
            up = np.cumsum(values, 0)
            # what lies before a row's key: the sums up to the last beginning, or else what the batch before carries on
            before = np.concatenate([-total[None], (up - values)[begins]])
            up = up - before[np.searchsorted(begins, np.arange(len(keys)), "right")]
            at, total = keys[-1], up[-1]
            edge = np.zeros(len(keys), bool)
            edge[0], first = first, False
            cols = [*b.columns, *(pa.array(up[:, i]) for i in range(len(sums))), pa.array(np.full(len(keys), part, np.int32)), pa.array(edge)]
            names = [*b.schema.names, *(f"{s}_run" for s in sums), "_part", "_first"]
            held = pa.RecordBatch.from_arrays([*cols, pa.array(np.zeros(len(keys), bool))], names=[*names, "_last"])
        if held is not None:
            last = np.zeros(held.num_rows, bool)
            last[-1] = True
            yield pa.RecordBatch.from_arrays([*held.columns[:-1], pa.array(last)], names=held.schema.names)

    return run


def running(rows: DataFrame, key: str, order: list[Column], sums: tuple[str, ...], drop: tuple[str, ...] = (), label: str = "running") -> DataFrame:
    """rows with s_run for each of sums (long, no nulls): the sum over rows of the same key (long, no null) up to and
    with the row, in an order without ties that matter.  Columns in drop are only ordered by."""
    own = rows.repartitionByRange(F.col(key), *order).sortWithinPartitions(F.col(key), *order).drop(*drop)
    made = T.StructType([*own.schema.fields, *(T.StructField(f"{s}_run", T.LongType()) for s in sums), *(T.StructField(n, t) for n, t in MARKS)])
    own = staged(own.mapInArrow(summed(key, sums), made), label)
    ends = own.where("_last").select(F.col(key).alias("_key"), F.col("_part").alias("_of"), *(F.col(f"{s}_run").alias(f"_{s}") for s in sums))
    heads = own.where("_first").select(F.col(key).alias("_key"), F.col("_part").alias("_at"))
    # one row a partition on either side
    carried = heads.join(F.broadcast(ends), "_key").where("_of < _at").groupBy("_key", "_at").agg(*(F.sum(f"_{s}").alias(f"_{s}") for s in sums))
    out = own.join(F.broadcast(carried), (F.col(key) == F.col("_key")) & (F.col("_part") == F.col("_at")), "left")
    whole = [(F.col(f"{s}_run") + F.coalesce(f"_{s}", F.lit(0))).alias(f"{s}_run") for s in sums]
    return out.select(*(c for c in own.columns if c not in {f"{s}_run" for s in sums} | {n for n, _ in MARKS}), *whole)
