"""Neighbours in a sorted table, and groups of one in blocks.

A table is range-partitioned by an order that ends in the rows' places, so rows of one group may lie in several
partitions and a common group fills none.  Within a partition rows are compared with their neighbours as they stream
by; the first and last rows of partitions, two each, are compared among each other afterwards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import staged

FLAGS = ("again", "differs", "edge")


def neighbours(group: tuple[str, ...], kind: str, place: tuple[str, ...], every: bool):
    """Over sorted rows: again, the row's group and kind are also those of a neighbour at another place; differs, a
    neighbour of its group is of another kind; edge, the partition's first or last row.  Repeated rows go; without
    every, so do rows with no flag."""

    def run(batches):
        held, before = None, None
        for b in batches:
            t = pa.Table.from_batches([b] if held is None else [held, b]).combine_chunks()
            cols = {c: t.column(c).to_numpy() for c in {*group, kind, *place}}
            new = np.ones(len(t), bool)
            new[1:] = np.any([cols[c][1:] != cols[c][:-1] for c in (kind, *place)], axis=0)
            if not new.all():
                t, cols = t.filter(pa.array(new)), {c: v[new] for c, v in cols.items()}
            if not len(t):
                continue
            if len(t) > 1:
                yield from told(t.slice(0, len(t) - 1), cols, before, None)
                before = {c: v[-2] for c, v in cols.items()}
            held = t.slice(len(t) - 1).combine_chunks().to_batches()[0]
        if held is not None:
            t = pa.Table.from_batches([held])
            yield from told(t, {c: t.column(c).to_numpy() for c in {*group, kind, *place}}, before, True)

    def told(t, cols, before, last):
        """cols may hold one row more than t, its next; before is the row before it, last says that none follows."""
        n = len(t)
        near, same = np.zeros(n + 1, bool), np.zeros(n + 1, bool)  # of rows i - 1 and i
        if before is not None:
            near[0] = all(cols[c][0] == before[c] for c in group)
            same[0] = near[0] and cols[kind][0] == before[kind]
        m = len(cols[kind])
        if m > 1:
            near[1:m] = np.all([cols[c][1:] == cols[c][:-1] for c in group], axis=0)
            same[1:m] = near[1:m] & (cols[kind][1:] == cols[kind][:-1])
        again, differs, edge = same[:-1] | same[1:], (near & ~same)[:-1] | (near & ~same)[1:], np.zeros(n, bool)
        edge[0], edge[-1] = edge[0] or before is None, edge[-1] or bool(last)
        for name, flag in zip(FLAGS, (again, differs, edge), strict=True):
            t = t.append_column(name, pa.array(flag))
        yield from (t if every else t.filter(pa.array(again | differs | edge))).to_batches()

    return run


def scan(rows: DataFrame, order: tuple[str, ...], group: tuple[str, ...], kind: str, place: tuple[str, ...], label: str, every: bool = False, folder: str | None = None) -> DataFrame:
    """rows, in order, with the flags of neighbours(); staged."""
    schema = T.StructType([*rows.schema.fields, *(T.StructField(f, T.BooleanType()) for f in FLAGS)])
    found = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(neighbours(group, kind, place, every), schema)
    return staged(found, label, folder=folder)


def settled(scanned: DataFrame, group: tuple[str, ...], kind: str, place: tuple[str, ...]) -> DataFrame:
    """The rows with a flag again or differs, after the edges of partitions have been compared.  There are two edges
    a partition at most, so they are broadcast."""
    edges = scanned.where("edge").select(*group, kind, *place).distinct()
    mixed = edges.groupBy(*group).agg((F.min(kind) != F.max(kind)).alias("mixed"))
    twice = edges.groupBy(*group, kind).agg((F.count(F.lit(1)) > 1).alias("twice"))
    found = twice.join(mixed, list(group)).where("mixed or twice")
    flagged = scanned.where("again or differs or edge").join(F.broadcast(found), [*group, kind], "left")
    flag = lambda f, by: (F.col(f) | (F.col("edge") & F.coalesce(by, F.lit(False)))).alias(f)
    rest = [c for c in scanned.columns if c not in FLAGS]
    return flagged.select(*rest, flag("again", "twice"), flag("differs", "mixed")).where("again or differs")


def in_blocks(rows: DataFrame, key: str, item: str, size: int) -> DataFrame:
    """rows with lo, hi, mine, dealt and sorted so that each (key, lo, hi) is one stretch of a partition: a group is cut
    into blocks of some `size` items, and each block meets itself (lo = hi) and every other.  No task need hold
    more than two blocks, and no pair is a row: n items become n * n / size rows."""
    n = rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / size).alias("blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    dealt = rows.join(n, key).withColumn("mine", F.pmod(F.xxhash64(item), F.col("blocks"))).select(*rows.columns, "mine", other.alias("other"))
    dealt = dealt.select(*rows.columns, "mine", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"))
    return dealt.repartition(key, "lo", "hi").sortWithinPartitions(key, "lo", "hi", item)


def stretches(batches, key: str):
    """(table, where its (key, lo, hi) groups begin, and its end) of whole groups, from rows in the order of in_blocks()."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b] if held is None else [held, b]).combine_chunks()
        if not len(t):
            continue
        cols = np.stack([t.column(c).to_numpy() for c in (key, "lo", "hi")])
        first = np.flatnonzero(np.concatenate([[True], (cols[:, 1:] != cols[:, :-1]).any(0)]))
        if first[-1]:
            yield t.slice(0, first[-1]).combine_chunks(), first
        held = t.slice(first[-1]).combine_chunks().to_batches()[0]
    if held is not None:
        yield pa.Table.from_batches([held]), np.array([0, len(held)])


def pairs_within(t, begin: np.ndarray, part: str, step: int = 20_000):
    """Row numbers (x, y) of pairs of a stretch's rows whose parts differ; blocks that meet pair only across."""
    parts, mine = t.column(part).to_numpy(), t.column("mine").to_numpy()
    meet = t.column("lo").to_numpy() != t.column("hi").to_numpy()
    end = np.repeat(begin[1:], np.diff(begin))
    for far in range(1, int(np.diff(begin).max())):
        x = np.flatnonzero(np.arange(len(t)) + far < end)
        x = x[(parts[x] != parts[x + far]) & (~meet[x] | (mine[x] != mine[x + far]))]
        for k in range(0, len(x), step):
            yield x[k : k + step], x[k : k + step] + far
