"""Mixing sources to target weights by entropy balancing.

A document of so many words is taken at a rate.  The rates of a source minimise the
relative entropy sum(r log r - r + 1) to "take every document once", under the
constraints that its expected words meet the target and that no rate is over CAP: so
r = min(CAP, exp(lambda * words / mean words)), tilted exponentially by the document's
words.  The convex dual in lambda, one number a source, has no closed form; it is solved
by Newton steps kept inside a bracket, each a grouped sum over the documents' (source,
size) cells.

Rates are rounded into copies: the whole part for every document, and one more for some
of each cell.  How many is settled from the longest documents to the shortest, the error
being carried on, so that a source's words miss their target by little more than half its
shortest document; which ones, by a hash order of doc_id, found by hash bins, so that no
cell of documents is ever gathered in one task.

Defined results: null or wordless text has size 0 and is taken 0 words; a null
source is a source of its own, last in order; rows that repeat a doc_id are told apart
by their text's hash, and equal rows are interchangeable; a source without words has
target 0.  Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.operators.dedup import numbered

from .common import BROADCAST_ROWS, small_side, staged

WEIGHTS = (3, 1, 2)
#: Of all sizes, to be taken; and of a document's or source's size, at most.
SHARE, CAP = 1.5, 2
#: Documents that a hash bin holds on average.
BIN_ROWS = 4096
TOLERANCE, MAX_STEPS = 1e-12, 200
#: Multipliers and rates are rounded to these units, so that sums taken in another order change nothing.
LAMBDA_DIGITS, UNIT = 9, 1_000_000


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from (source, source_size): shares by weight in code-point order,
    stopped at cap times the size, the excess reshared by weight.

    A target is min(cap * size, level * weight).  The level rises with each round that stops more sources; a round is
    one sum over the sources, which are numbered by range partitions, so no task holds them all."""
    order = F.struct(F.col("source").isNull().alias("last"), F.coalesce("source", F.lit("")).alias("name"))
    t = numbered(sizes.select("source", "source_size", order.alias("order")), [F.col("order")])
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int")).cast("double")
    t = staged(t.select("source", "source_size", w.alias("w"), (F.col("source_size") * cap).alias("most")), "mix-sources")
    level, before = 0.0, -1.0
    while level != before:
        full = F.lit(level) * F.col("w") > F.col("most")
        got = t.agg((F.sum("source_size") * share).alias("total"), F.sum(F.when(full, F.col("most")).otherwise(0)).alias("full"), F.sum(F.when(~full, F.col("w"))).alias("open")).first()
        before, level = level, (got["total"] - got["full"]) / got["open"] if got["open"] else level
    return t.select("source", "source_size", F.least(F.col("most").cast("double"), F.lit(level) * F.col("w")).alias("target"))


def rate(cap: float) -> Column:
    """From lam, size, mean; the exponent is held where exp is finite and above any cap."""
    return F.least(F.lit(float(cap)), F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(500.0))))


def balance(cells: DataFrame, goals: DataFrame, cap: float = CAP) -> DataFrame:
    """(g, lam) for cells(g, size, n) and goals(g, target, source_size, docs): the root of the dual's gradient,
    sum(n * size * rate) = target, for every source with words and a target between 0 and its cap."""
    some = goals.where((F.col("source_size") > 0) & (F.col("target") > 0) & (F.col("target") < cap * F.col("source_size") * (1 - 1e-12)))
    none = F.lit(None).cast("double")
    state = staged(some.select("g", "target", (F.col("source_size") / F.col("docs")).alias("mean"), F.lit(0.0).alias("lam"), none.alias("lo"), none.alias("hi")), "mix-lambda")
    few = state.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    mass = F.col("n") * F.col("size")
    for step in range(MAX_STEPS):
        at = cells.join(F.broadcast(state) if few else state, "g")
        slope = F.when(rate(cap) < cap, mass * F.col("size") / F.col("mean") * rate(cap)).otherwise(0.0)
        sums = at.groupBy("g", "target", "mean", "lam", "lo", "hi").agg(F.sum(mass * rate(cap)).alias("now"), F.sum(slope).alias("slope"))
        lo, hi = F.when(F.col("now") < F.col("target"), F.col("lam")).otherwise(F.col("lo")), F.when(F.col("now") > F.col("target"), F.col("lam")).otherwise(F.col("hi"))
        sums = sums.withColumns({"lo": lo, "hi": hi})
        # Newton on the logarithm of the expected words; where it leaves the bracket, halve or widen that
        newton = F.col("lam") + F.try_divide(F.log(F.col("target") / F.col("now")) * F.col("now"), F.col("slope"))
        inside = (F.col("lo").isNull() | (newton > F.col("lo"))) & (F.col("hi").isNull() | (newton < F.col("hi")))
        wide = 1 + F.abs("lam")
        other = F.when(F.col("lo").isNull(), F.col("lam") - wide).when(F.col("hi").isNull(), F.col("lam") + wide).otherwise((F.col("lo") + F.col("hi")) / 2)
        new = F.when(F.col("now") == F.col("target"), F.col("lam")).when(F.coalesce(inside, F.lit(False)), newton).otherwise(other)
        moved = staged(sums.select("g", "target", "mean", new.alias("lam"), "lo", "hi", (F.abs(new - F.col("lam")) / wide).alias("moved")), f"mix-lambda{step}")
        worst = moved.agg(F.max("moved")).first()[0]
        state = moved.drop("moved")
        if worst is None or worst <= TOLERANCE:
            break
    return state.select("g", F.round("lam", LAMBDA_DIGITS).alias("lam"))


def group(source: Column) -> Column:
    """A source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit(""))


def tie() -> Column:
    """Tells rows that repeat a doc_id apart by their texts."""
    return F.xxhash64("doc_id", "text")


def planned(cells: DataFrame, goals: DataFrame, cap: int = CAP) -> DataFrame:
    """(g, size, n, base, extra): of each cell's n documents all are taken base times, and extra of them once more."""
    lam = balance(cells, goals, cap)
    about = goals.select("g", "target", (F.col("source_size") / F.col("docs")).alias("mean")).join(lam, "g", "left")
    fixed = F.when(F.col("target") > 0, F.lit(float(cap))).otherwise(0.0)
    units = F.when(F.col("size") == 0, 0).otherwise(F.round(F.coalesce(rate(cap), fixed) * UNIT)).cast("long")
    c = cells.join(small_side(about), "g").select("g", "size", "n", units.alias("units"))
    return c.select("g", "size", "n", "units").groupBy("g").applyInPandas(rounded, "g string, size long, n long, base long, extra long")


def rounded(cells):
    """From the longest documents to the shortest, extras bring the words taken so far next to the words expected so
    far; a cell whose rate is whole takes none.  A source has a cell for each different size."""
    cells = cells.sort_values("size", ascending=False)
    want, took, extra = 0, 0, []
    for size, n, units in zip(cells["size"].tolist(), cells["n"].tolist(), cells["units"].tolist(), strict=True):
        k = 0
        if size and units % UNIT:
            want += n * (units % UNIT) * size
            k = min(n, max(0, (2 * (want - took) + size * UNIT) // (2 * size * UNIT)))
            took += k * size * UNIT
        extra.append(k)
    return cells.assign(base=cells["units"] // UNIT, extra=extra)[["g", "size", "n", "base", "extra"]]


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, key: bool = False) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken[, tie]) for docs(doc_id, text, source)."""
    d = staged(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words(F.col("text").cast("string")).alias("size"),
            F.xxhash64(F.col("doc_id").cast("string"), F.lit("mix")).alias("u"), tie().alias("tie"),
        ).withColumn("g", group(F.col("source"))),
        "mix-docs",
    )
    cells = staged(d.groupBy("g", "source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-cells")
    sources = cells.groupBy("g", "source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("docs"))
    goals = staged(targets(sources, weights, share, cap).withColumn("g", group(F.col("source"))).join(sources.select("g", "docs"), "g"), "mix-goals")
    cells = cells.select("g", "size", "n")
    plan = staged(planned(cells, goals, cap).join(goals.select("g", "source_size", "target"), "g").withColumn("bins", F.ceil(F.col("n") / BIN_ROWS)), "mix-plan")
    d = d.join(small_side(plan), ["g", "size"])
    d = d.withColumn("bin", F.floor((F.col("u") / F.lit(2.0**64) + 0.5) * F.col("bins")).cast("long"))
    out = [F.col(c) for c in ("doc_id", "source", "size", "source_size", "target", *["tie"] * key)]
    open_ = (F.col("extra") > 0) & (F.col("extra") < F.col("n"))
    alike = d.where(~open_).select(*out, (F.col("base") + (F.col("extra") > 0).cast("int")).alias("copies"))
    # documents before each bin of the cells of several bins, then within the bin in which the extras run out
    several = d.where(open_ & (F.col("bins") > 1)).groupBy("g", "size", "bin").agg(F.count(F.lit(1)).alias("in_bin"))
    before = F.sum("in_bin").over(Window.partitionBy("g", "size").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    bins = small_side(staged(several.select("g", "size", "bin", F.coalesce(before, F.lit(0)).alias("start"), "in_bin"), "mix-bins"))
    some = d.where(open_).join(bins, ["g", "size", "bin"], "left").withColumns({"start": F.coalesce("start", F.lit(0)), "in_bin": F.coalesce("in_bin", "n")})
    edge = (F.col("start") < F.col("extra")) & (F.col("start") + F.col("in_bin") > F.col("extra"))
    rank = F.row_number().over(Window.partitionBy("g", "size", "bin").orderBy("u", "doc_id", "tie"))
    rows = (
        alike.unionByName(some.where(~edge).select(*out, (F.col("base") + (F.col("start") < F.col("extra")).cast("int")).alias("copies")))
        .unionByName(some.where(edge).withColumn("r", F.col("start") + rank).select(*out, (F.col("base") + (F.col("r") <= F.col("extra")).cast("int")).alias("copies")))
    )
    return rows.withColumn("copies", F.col("copies").cast("long")).withColumn("taken", F.col("copies") * F.col("size"))
