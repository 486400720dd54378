"""Drawings as text: lines of a group code and a value in turn, entities, polylines, blocks with attributes.

Files are read line by line, in splits, and a split's entities are cut from its lines as they stream by, so no file is
one task's, and lines are neither sorted nor sent.  Only what lies across the edge of two splits is put together afterwards.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeline.operators import geometry as G
from gaugeline.sources.staging import staged
from gaugeline.sources.tables import spread

#: Records that belong to the entity before them.
PARTS = ("VERTEX", "ATTRIB", "SEQEND")
#: What is read of a split: its records, or (lines not null) how many lines it has, its first and last one, and its last record.
#: Whether a later split begins with a value (odd) is not known until all are counted, so these are read both ways.
SPLITS = "drawing string, block long, odd boolean, record long, parts array<struct<place:long,code:int,value:string>>, lines long, first string, last string"
PAIR = pa.struct([("place", pa.int64()), ("code", pa.int32()), ("value", pa.string())])
KINDS = {"drawing": pa.string(), "block": pa.int64(), "odd": pa.bool_(), "record": pa.int64(), "parts": pa.list_(PAIR), "lines": pa.int64(), "first": pa.string(), "last": pa.string()}


def group_code(text: str) -> int | None:
    """A line as a whole number of 32 bits, or null."""
    n = int(text) if re.fullmatch(r"\s*[+-]?[0-9]{1,99}\s*", text, re.ASCII) else None
    return n if n is not None and -(2**31) <= n < 2**31 else None


class Reading:
    """A split's lines as pairs from the first or second line on, cut to records; record 0 is what stands before the first."""

    def __init__(self, odd: bool):
        self.odd, self.skip, self.place, self.record = odd, int(odd), 1 + odd, 0
        self.rest, self.open = pa.array([], pa.string()), []

    def records(self, lines: pa.Array) -> dict | None:
        """Records that end within further lines."""
        lines, self.skip = pa.concat_arrays([self.rest, lines.slice(self.skip)]), 0
        n = len(lines) // 2
        self.rest = lines.slice(2 * n)
        at = np.arange(n) * 2
        codes, value = lines.take(pa.array(at)).dictionary_encode(), lines.take(pa.array(at + 1))
        code = pa.array([group_code(c) for c in codes.dictionary.to_pylist()], pa.int32()).take(codes.indices)
        pairs = pa.StructArray.from_arrays([pa.array(at + self.place), code, value], fields=list(PAIR))
        self.place += 2 * n
        begins = np.flatnonzero(pc.and_(pc.fill_null(pc.equal(code, 0), False), pc.invert(pc.is_in(value, pa.array(PARTS)))))
        if not len(begins):
            self.open.append(pairs)
            return None
        before = sum(map(len, self.open))
        return self._cut([*self.open, pairs.slice(0, begins[-1])], np.concatenate([[0], before + begins]), [pairs.slice(begins[-1])])

    def ending(self) -> dict | None:
        """The record that is open at the end."""
        size = sum(map(len, self.open))
        return self._cut(self.open, np.array([0, size]), []) if size else None

    def _cut(self, pairs: list, bounds: np.ndarray, rest: list) -> dict:
        record = self.record + np.arange(len(bounds) - 1)
        if rest:
            self.record += len(record)
        self.open = rest
        some = int(bounds[1] == 0)  # record 0, or one that was sent, may be empty
        return {"odd": pa.repeat(self.odd, len(record) - some), "record": pa.array(record[some:]), "parts": pa.ListArray.from_arrays(pa.array(bounds[some:], pa.int32()), pa.concat_arrays(pairs))}


def split_records(batches):
    """SPLITS rows of lines (drawing, block, value), the lines of a split in a row."""
    key, n, first, last, ways = None, 0, None, None, []

    def made(cols: dict | None):
        if cols and (size := len(cols["record"])):
            cols |= {"drawing": pa.repeat(key[0], size), "block": pa.repeat(key[1], size)}
            yield pa.RecordBatch.from_arrays([cols[c] if c in cols else pa.nulls(size, t) for c, t in KINDS.items()], names=list(KINDS))

    def over():
        for w in ways:
            yield from made(w.ending())
            yield from made({"odd": pa.array([w.odd]), "record": pa.array([w.record]), "lines": pa.array([n]), "first": pa.array([first]), "last": pa.array([last])})

    for b in batches:
        if not b.num_rows:
            continue
        drawing, block, value = b.columns
        other = pc.or_(pc.not_equal(drawing[1:], drawing[:-1]), pc.not_equal(block[1:], block[:-1]))
        edges = [0, *(np.flatnonzero(other) + 1).tolist(), b.num_rows]
        for lo, hi in zip(edges, edges[1:], strict=False):
            lines = value[lo:hi]
            if key != (now := (drawing[lo].as_py(), block[lo].as_py())):
                yield from over()
                key, n, first, ways = now, 0, lines[0].as_py(), [Reading(odd) for odd in ((False, True) if now[1] else (False,))]
            n, last = n + len(lines), lines[-1].as_py()
            for w in ways:
                yield from made(w.records(lines))
    yield from over()


def begins(code: Column, value: Column) -> Column:
    return F.coalesce((code == 0) & ~value.isin(*PARTS), F.lit(False))


def records(spark: SparkSession, path: str) -> DataFrame:
    """(drawing, entity, parts): drawing is the file's path, entity counts within it, 0 is what stands before the first;
    parts are the (place, code, value) of its own lines and of the records that belong to it."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("drawing"), F.col("_metadata.file_block_start").alias("block"), F.trim("value").alias("value"))
    got = staged(lines.mapInArrow(split_records, SPLITS), "records")
    of = lambda odd: F.max(F.when(F.col("odd") == odd, F.col("record")))
    splits = got.where("lines is not null").groupBy("drawing", "block").agg(*(F.max(c).alias(c) for c in ("lines", "first", "last")), of(False).alias("even_n"), of(True).alias("odd_n"))
    file = Window.partitionBy("drawing")
    w = file.orderBy("block")
    earlier, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    splits = splits.withColumns({"before": F.coalesce(F.sum("lines").over(earlier), F.lit(0)), "code": F.lag("last").over(w).try_cast("int"), "n_splits": F.count(F.lit(1)).over(file)}).where("n_splits > 1")
    splits = splits.withColumn("is_odd", F.col("before") % 2 == 1).withColumns({"n": F.when(F.col("is_odd"), F.col("odd_n")).otherwise(F.col("even_n")), "begins": (F.col("is_odd") & begins(F.col("code"), F.col("first"))).cast("long")})
    splits = staged(splits.withColumn("offset", F.coalesce(F.sum("n").over(earlier), F.lit(0)) + F.sum("begins").over(upto)), "splits")
    # a row a split of the files that have more than one
    own = got.where("lines is null").join(F.broadcast(splits.select("drawing", "block", "is_odd", "before", "offset", "n")), ["drawing", "block"], "left").where("is_odd is null or is_odd = odd")
    split = F.col("is_odd").isNotNull()
    parts = F.when(split, F.transform("parts", lambda p: F.struct((p["place"] + F.col("before")).alias("place"), p["code"].alias("code"), p["value"].alias("value")))).otherwise(F.col("parts"))
    across = split & ((F.col("record") == 0) | (F.col("record") == F.col("n")))
    out = ["drawing", (F.coalesce("offset", F.lit(0)) + F.col("record")).alias("entity"), parts.alias("parts")]
    pair = F.array(F.struct(F.col("before").alias("place"), "code", F.col("first").alias("value")))
    edge = splits.where("is_odd").select("drawing", F.col("offset").alias("entity"), pair.alias("parts"))
    joined = own.where(across).select(*out).unionByName(edge).groupBy("drawing", "entity").agg(F.flatten(F.sort_array(F.collect_list("parts"))).alias("parts"))
    return own.where(~across).select(*out).unionByName(joined)


def pairs(spark: SparkSession, path: str) -> DataFrame:
    """(drawing, place, code, value): place is the code's line in the file, from 1; a last line without a value goes."""
    return records(spark, path).select("drawing", F.inline("parts"))


def entities(spark: SparkSession, path: str) -> DataFrame:
    """(drawing, entity, begin, type, layer, parts): the entities of a drawing's ENTITIES section in their order, which is
    entity begin, each with the (place, code, value) of its own lines and of the records that belong to it."""
    own = records(spark, path).select("drawing", "entity", F.col("parts")[0]["value"].alias("type"), "parts")
    marks = own.where("type in ('SECTION', 'ENDSEC')").select("drawing", "entity", "type", value(F.col("parts"), 2).alias("name"))
    later = Window.partitionBy("drawing").orderBy("entity").rowsBetween(1, Window.unboundedFollowing)
    marks = marks.withColumn("end", F.min(F.when(F.col("type") == "ENDSEC", F.col("entity"))).over(later))
    # written first, so that the join knows how few they are before it sends any entity
    inside = staged(marks.where("type = 'SECTION' and name = 'ENTITIES'").select("drawing", F.col("entity").alias("begin"), "end"), "sections")
    return own.join(inside, "drawing").where("entity > begin and entity < end").select("drawing", "entity", "begin", "type", value(F.col("parts"), 8).alias("layer"), "parts")


def values(parts: Column, code: int) -> Column:
    return F.transform(F.filter(parts, lambda p: p["code"] == code), lambda p: p["value"])


def value(parts: Column, code: int) -> Column:
    """The first value of a code, or null."""
    return F.try_element_at(values(parts, code), F.lit(1))


def after_first(parts: Column) -> Column:
    """The lines of the records that belong to an entity."""
    return F.aggregate(parts, F.struct(F.lit(0).alias("n"), F.slice(parts, 1, 0).alias("out")), lambda s, p: F.struct((s["n"] + F.when(p["code"] == 0, 1).otherwise(0)).alias("n"), F.when((s["n"] >= 1) & ((p["code"] == 0) | (s["n"] >= 2)), F.concat(s["out"], F.array(p))).otherwise(s["out"]).alias("out")))["out"]


def points(parts: Column) -> Column:
    x, y = values(parts, 10), values(parts, 20)
    return F.zip_with(x, y, lambda a, b: F.struct(a.try_cast("double").alias("x"), b.try_cast("double").alias("y")))


def shapes(found: DataFrame) -> DataFrame:
    """entities with ring (vertices of polylines, lines and circles) and closed (declared, or its ends meet)."""
    kind, parts = F.col("type"), F.col("parts")
    number = lambda c: value(parts, c).try_cast("double")
    one = lambda x, y: F.struct(number(x).alias("x"), number(y).alias("y"))
    ring = F.when(kind == "LWPOLYLINE", points(parts)).when(kind == "POLYLINE", points(after_first(parts))).when(kind == "LINE", F.array(one(10, 20), one(11, 21)))
    ring = ring.when(kind == "CIRCLE", G.circle(number(10), number(20), number(40)))
    out = found.withColumn("ring", F.filter(ring, lambda p: p["x"].isNotNull() & p["y"].isNotNull()))
    declared = F.coalesce(value(parts, 70).try_cast("int"), F.lit(0)).bitwiseAND(F.lit(1)) == 1
    meets = (F.size("ring") >= 3) & G.closed(F.col("ring"))
    return out.withColumn("closed", F.when(kind.isin("LWPOLYLINE", "POLYLINE"), F.coalesce(declared | meets, F.lit(False))).otherwise(kind == "CIRCLE"))


def blocks(found: DataFrame) -> DataFrame:
    """Of INSERT entities: (drawing, entity, layer, block, x, y, attributes), tags in upper case, texts trimmed."""
    parts = F.col("parts")
    own = found.where("type = 'INSERT'").withColumn("rest", after_first(parts))
    tags = F.zip_with(values(F.col("rest"), 2), values(F.col("rest"), 1), lambda t, v: F.struct(F.upper(F.trim(t)).alias("key"), F.trim(v).alias("value")))
    # of a tag that is repeated the last text counts
    last = F.aggregate(tags, F.create_map().cast("map<string,string>"), lambda m, t: F.map_concat(F.map_filter(m, lambda k, _: k != t["key"]), F.map_from_arrays(F.array(t["key"]), F.array(t["value"]))))
    return own.select("drawing", "entity", "layer", value(parts, 2).alias("block"), value(parts, 10).try_cast("double").alias("x"), value(parts, 20).try_cast("double").alias("y"), last.alias("attributes"))


def boundary(found: DataFrame, layer: str) -> DataFrame:
    """(drawing, ring, area) of the largest closed polyline on a layer; the first of equal ones."""
    own = shapes(found.where((F.col("layer") == layer) & F.col("type").isin("LWPOLYLINE", "POLYLINE"))).where("closed").where(G.valid(F.col("ring")))
    own = own.select("drawing", "entity", "ring", G.area(F.col("ring")).alias("area"))
    return own.groupBy("drawing").agg(F.max_by(F.struct("ring", "area"), F.struct("area", (-F.col("entity")).alias("e"))).alias("b")).select("drawing", "b.ring", "b.area")


def bound(zones: DataFrame, inserts: DataFrame, side: float) -> DataFrame:
    """inserts(drawing, entity, x, y, ...) with zone, the first of zones(drawing, entity, ring) in the drawing that holds
    its point, or null.  Points meet rings in grid cells."""
    at = lambda v: F.floor(v / side)
    lo, hi = lambda c: F.array_min(F.col(f"ring.{c}")), lambda c: F.array_max(F.col(f"ring.{c}"))
    z = zones.select("drawing", F.col("entity").alias("zone"), "ring", F.explode(F.sequence(at(lo("x")), at(hi("x")))).alias("cx")).withColumn("cy", F.explode(F.sequence(at(lo("y")), at(hi("y")))))
    p = inserts.select("drawing", "entity", "x", "y", at(F.col("x")).alias("cx"), at(F.col("y")).alias("cy"))
    held = G.held(p.join(z, ["drawing", "cx", "cy"])).groupBy("drawing", "entity").agg(F.min("zone").alias("zone"))
    return inserts.join(held, ["drawing", "entity"], "left")


def write(lines: DataFrame, path: str) -> None:
    """Write lines(drawing, seq, line), each drawing one text file at path/drawing=<drawing>/.  A line may be several."""
    spread(lines, "drawing").sortWithinPartitions("drawing", "seq").select("drawing", F.col("line").alias("value")).write.partitionBy("drawing").text(path)
