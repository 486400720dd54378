"""A prefix trie of conversations, its subtree totals by leaf-peeling message passing.

A conversation's prefix of d turns is named by the sum of a hash of each turn with its place (four lanes of 32 bits), so
that prefixes need running sums only, and equal prefixes meet in one grouped node.  Nodes in a row down the trie that
have the same members are one stretch; the trie of stretches is peeled: each holds the number of children it still
waits for, those that wait for none send their subtree's totals to their parents, and what has been sent goes, until
the root is done.  Rounds are as many as stretches lie above each other, not as conversations have turns.

Defined results: rows are ordered by turn (null first), then role, then text; repeated rows are turns of their own; null
role or text is empty; rows without a conv_id belong to no conversation; extra columns are ignored; an empty table has
no root and gives an empty result.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .mixing import words
from .running import running

LANES = 4
#: Characters of joined ids in one row, of which a node with many ends has several.
CHUNK = 8192
EMPTY = hashlib.sha256(b"").hexdigest()
NODE = ("depth", "hi", "lo")


def turns(rows: DataFrame) -> DataFrame:
    """(conv_id, n_own, said, words, place): each turn's place in its conversation from 1, and its content's digest."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = rows.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    own = own.select("*", said.alias("said"), words(F.col("text")).cast("long").alias("words"), F.lit(1).cast("long").alias("one"))
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()]
    return running(own, "conv_id", order, ("one",), drop=("turn", "role", "text"), label="trie-turns").select("conv_id", "said", "words", F.col("one_run").alias("place"))


def rebuilt(own: DataFrame, group: int, most: int) -> tuple[DataFrame, DataFrame]:
    """((conv_id, place, said, words, is_end), (conv_id, n_turns)): each conversation begins with the first h turns of the
    first of its group of ids, h = crc32(conv_id) % (most + 1), and goes on with its own turns after its first h."""
    begins = [F.max(F.when(F.col("place") == i, F.struct("said", "words"))).alias(f"t{i}") for i in range(1, most + 1)]
    size = staged(own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), *begins), "trie-sizes")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)
    base = size.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"), *(F.col(f"t{i}").alias(f"b{i}") for i in range(1, most + 1)))
    plan = size.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base")).join(base, "base", "left")
    plan = plan.withColumn("k", F.least("h", F.coalesce("base_n", F.lit(0).cast("long")))).withColumn("n_turns", F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0).cast("long")))
    plan = staged(plan, "trie-plan")
    given = F.filter(F.array(*(F.struct(F.lit(i).cast("long").alias("place"), F.col(f"b{i}").alias("t")) for i in range(1, most + 1))), lambda x: x["place"] <= F.col("k"))
    shared = plan.select("conv_id", "n_turns", F.explode(given).alias("g")).select("conv_id", F.col("g.place").alias("place"), F.col("g.t.said").alias("said"), F.col("g.t.words").alias("words"), (F.col("g.place") == F.col("n_turns")).alias("is_end"))
    later = own.join(plan.where("n > h").select("conv_id", "h", "k", "n"), "conv_id").where("place > h")
    later = later.select("conv_id", (F.col("place") - F.col("h") + F.col("k")).alias("place"), "said", "words", (F.col("place") == F.col("n")).alias("is_end"))
    return shared.unionByName(later), plan.select("conv_id", "n_turns")


def prefixes(made: DataFrame) -> DataFrame:
    """(conv_id, depth, hi, lo, up_hi, up_lo, words, words_run, is_end): the name of each prefix and of the one before it."""
    h = F.sha2(F.concat(F.col("place").cast("string"), F.lit(":"), "said"), 256)
    lanes = [F.conv(F.substring("_h", 8 * i + 1, 8), 16, 10).cast("long").alias(f"l{i}") for i in range(LANES)]
    rows = made.select("*", h.alias("_h")).select("conv_id", "place", "words", "is_end", *lanes)
    sums = tuple(f"l{i}" for i in range(LANES))
    got = running(rows, "conv_id", [F.col("place").asc()], (*sums, "words"), label="trie-prefixes")
    mask = F.lit((1 << 32) - 1)
    two = lambda a, b: F.shiftleft(a.bitwiseAND(mask), 32).bitwiseOR(b.bitwiseAND(mask))
    full, up = [F.col(f"{s}_run") for s in sums], [F.col(f"{s}_run") - F.col(s) for s in sums]
    return got.select(
        "conv_id", F.col("place").alias("depth"), two(*full[:2]).alias("hi"), two(*full[2:]).alias("lo"), two(*up[:2]).alias("up_hi"), two(*up[2:]).alias("up_lo"), "words", "words_run", "is_end"
    )


def joined(batches):
    """Rows sorted by node and conv_id to rows (node, first id, some ids joined by commas)."""
    node, first, ids, size = None, None, [], 0
    for b in batches:
        rows = [c.to_pylist() for c in b.columns]
        out = []
        for *at, c in zip(*rows, strict=True):
            if at != node or size >= CHUNK:
                if ids:
                    out.append((*node, first, ",".join(ids)))
                node, first, ids, size = at, c, [], 0
            ids.append(str(c))
            size += len(ids[-1]) + 1
        if out:
            yield packed(out, [*NODE, "first", "ids"])
    if ids:
        yield packed([(*node, first, ",".join(ids))], [*NODE, "first", "ids"])


def hashed(batches):
    """Rows of joined() sorted by node and first id to (node, SHA-256 of all its ids), which stream through one hash."""
    node, sha = None, None
    for b in batches:
        out = []
        for *at, ids in zip(*(b.column(c).to_pylist() for c in (*NODE, "ids")), strict=True):
            if at != node:
                if node:
                    out.append((*node, sha.hexdigest()))
                node, sha = at, hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        if out:
            yield packed(out, [*NODE, "ends_sha256"])
    if node:
        yield packed([(*node, sha.hexdigest())], [*NODE, "ends_sha256"])


def packed(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kind = lambda c: pa.string() if c in ("ids", "ends_sha256") else pa.int64()
    return pa.RecordBatch.from_arrays([pa.array(v, kind(c)) for c, v in zip(names, zip(*rows, strict=True), strict=True)], names=names)


def ends(found: DataFrame) -> DataFrame:
    """(depth, hi, lo, ends_sha256) for found(depth, hi, lo, conv_id), one row a conversation that ends there.

    A digest reads its bytes in order, so a node's ids come to one task at last, joined to rows of CHUNK characters
    and streamed, never held."""
    key = [F.col(c) for c in NODE]
    some = found.select(*NODE, "conv_id").repartitionByRange(*key, F.col("conv_id")).sortWithinPartitions(*key, F.col("conv_id"))
    some = some.mapInArrow(joined, "depth long, hi long, lo long, first long, ids string")
    return some.repartition(*key).sortWithinPartitions(*key, F.col("first")).mapInArrow(hashed, "depth long, hi long, lo long, ends_sha256 string")


def peeled(stretches: DataFrame) -> DataFrame:
    """(conv_id, n_convs, n_leaves, below) for stretches(conv_id, n_convs, up_conv, up_n, children, saved): the childless
    stretches of each one's subtree, and what is saved below it.

    Round by round the stretches that wait for no child send (1, n_leaves, below + saved) to their parents, where the
    messages are summed before they are joined; only those that still wait are written again."""
    zero = F.lit(0).cast("long")
    now = stretches.select("*", F.col("children").alias("waits"), F.when(F.col("children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), zero.alias("below"))
    done = [staged(now, "trie-peel")]
    while done[-1].where("waits > 0").limit(1).count():
        sent = done[-1].where("waits = 0 and up_n is not null").groupBy("up_conv", "up_n").agg(
            F.count(F.lit(1)).alias("m_n"), F.sum("n_leaves").alias("m_leaves"), F.sum(F.col("below") + F.col("saved")).alias("m_saved"))
        sent = sent.withColumnsRenamed({"up_conv": "conv_id", "up_n": "n_convs"})
        left = done[-1].where("waits > 0").join(sent, ["conv_id", "n_convs"], "left")
        add = lambda a, b: (F.col(a) + F.coalesce(b, zero)).alias(a)
        left = left.select("conv_id", "n_convs", "up_conv", "up_n", "children", "saved", (F.col("waits") - F.coalesce("m_n", zero)).alias("waits"), add("n_leaves", "m_leaves"), add("below", "m_saved"))
        done.append(staged(left, "trie-peel"))
    every = stretches.sparkSession.read.schema(done[0].schema).parquet(*(d.staged_path for d in done))
    return every.where("waits = 0").select("conv_id", "n_convs", "n_leaves", "below")


def conversation_trie(rows: DataFrame, group: int = 20, most: int = 3) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, n_ends) of every node."""
    made, sizes = rebuilt(turns(rows), group, most)
    pre = staged(prefixes(made), "trie-pre")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = sizes.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    root = root.select(zero.alias("depth"), zero.alias("hi"), zero.alias("lo"), "conv_id", "n_convs", none.alias("up_hi"), none.alias("up_lo"), zero.alias("words"), zero.alias("words_run"), F.lit(None).cast("long").alias("n_ends"))
    inner = pre.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("up_hi").alias("up_hi"), F.max("up_lo").alias("up_lo"), F.max("words").alias("words"),
        F.max("words_run").alias("words_run"), F.count_if("is_end").alias("n_ends"))
    none_said = sizes.where("n_turns = 0").select(zero.alias("depth"), zero.alias("hi"), zero.alias("lo"), "conv_id")
    nodes = staged(root.unionByName(inner), "trie-nodes")
    # a stretch: nodes of the same smallest member and as many members lie above each other and have the same members
    runs = staged(nodes.groupBy("conv_id", "n_convs").agg(
        F.min("depth").alias("top"), F.max("depth").alias("bottom"), F.min_by("up_hi", "depth").alias("up_hi"), F.min_by("up_lo", "depth").alias("up_lo"),
        F.max("words_run").alias("words_all"), ((F.col("n_convs") - 1) * F.sum("words")).alias("saved")), "trie-runs")
    above = nodes.select((F.col("depth") + 1).alias("top"), F.col("hi").alias("up_hi"), F.col("lo").alias("up_lo"), F.col("conv_id").alias("up_conv"), F.col("n_convs").alias("up_n"))
    placed = staged(runs.join(above, ["top", "up_hi", "up_lo"], "left"), "trie-placed")
    children = placed.where("up_n is not null").groupBy("up_conv", "up_n").agg(F.count(F.lit(1)).alias("children")).withColumnsRenamed({"up_conv": "conv_id", "up_n": "n_convs"})
    placed = placed.join(children, ["conv_id", "n_convs"], "left").withColumn("children", F.coalesce("children", zero))
    placed = staged(placed, "trie-stretches")
    totals = peeled(placed.select("conv_id", "n_convs", "up_conv", "up_n", "children", "saved"))
    facts = placed.select("conv_id", "n_convs", "top", "bottom", "up_conv", "children", "words_all").join(totals, ["conv_id", "n_convs"])
    out = nodes.join(facts, ["conv_id", "n_convs"]).join(ends(pre.where("is_end").select(*NODE, "conv_id").unionByName(none_said)), list(NODE), "left")
    saved = F.col("below") + (F.col("n_convs") - 1) * (F.col("words_all") - F.col("words_run") + F.col("words"))
    return out.select(
        "conv_id", "depth", F.when(F.col("depth") == F.col("top"), F.col("up_conv")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs",
        F.when(F.col("depth") == F.col("bottom"), F.col("children")).otherwise(F.lit(1).cast("long")).alias("n_children"), "n_leaves", saved.alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )
