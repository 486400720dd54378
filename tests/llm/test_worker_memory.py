"""What a worker holds while it scores texts."""

import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gaugeline.llm import quality, suffix, toxicity


@pytest.mark.parametrize("module, model", [(quality, quality.train([], [])), (toxicity, b"")])
def test_texts_are_sent_to_a_scorer_once(spark, docs, module, model):
    sent = lambda df: re.search(r"MapInArrow run\(([^)]*)\)", df._jdf.queryExecution().executedPlan().toString())[1].split(", ")
    some = docs.select("doc_id", "text", F.lit("x").alias("score"))
    got = module.score(some, model)
    assert len(sent(got)) == 1 and got.columns == ["doc_id", "text", "score"]
    # a text of another type is read as a string and comes back as it was
    binary = module.score(some.withColumn("text", F.col("text").cast("binary")), model)
    rows = lambda df: sorted((str(r.doc_id), r.score, bytes(r.text or "", "utf-8") if isinstance(r.text, str) else bytes(r.text or b"")) for r in df.collect())
    assert len(sent(binary)) == 2 and rows(binary) == rows(got)


def test_a_scorer_holds_little_beside_its_batch():
    batch = pa.RecordBatch.from_arrays([pa.array([{"text": f"word{i} and more " * 120} for i in range(2000)])], names=["row"])
    run = quality.scorer(np.ones(quality.BUCKETS + 1, np.float32).tobytes())
    tracemalloc.start()
    assert sum(len(b) for b in run(iter([batch]))) == 2000
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60e6


def test_a_worker_unfolds_few_texts_at_a_time():
    rng, n, least = np.random.default_rng(3), 2000, 256
    keys, texts = pa.array(range(n)), pa.array([" ".join(map(str, rng.integers(0, 99999, 250))) for _ in range(n)])
    batch = pa.RecordBatch.from_arrays([keys, keys, texts], names=["k1", "k2", "text"])
    runs = [[] for _ in range(n)]
    for b in suffix.indexer(least)(iter([batch])):
        for r in b.select(["k1", "pos", "n", "lead", "anchor"]).to_pylist():
            runs[r.pop("k1")].append(r | {"m": min(r["n"], suffix.BLOCK)})
    kind = pa.struct([("pos", pa.int64()), ("n", pa.int32()), ("lead", pa.int32()), ("anchor", pa.int64()), ("m", pa.int32())])
    batch = batch.append_column("runs", pa.array(runs, pa.list_(kind)))
    for step in (suffix.cut_blocks(least), suffix.each_window(least)):
        tracemalloc.start()
        assert sum(len(b) for b in step(iter([batch]))) > 100_000
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 20e6


def test_spans_of_a_row_are_merged_by_themselves():
    rng = np.random.default_rng(4)
    rows = [[{"a": int(a), "b": int(a + n)} for a, n in zip(rng.integers(0, 400, k), rng.integers(1, 30, k), strict=True)] for k in rng.integers(0, 12, 300)]
    rows += [[], [{"a": 5, "b": 9}, {"a": 9, "b": 12}, {"a": 13, "b": 14}], [{"a": 0, "b": 2**31 - 1}], [{"a": 0, "b": 1}], []]
    col = pa.array(rows, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))

    def expected(row):
        inside = {i for s in row if s["b"] < 1000 for i in range(2 * s["a"], 2 * s["b"] + 1)}  # half steps: spans that touch are one
        return [{"a": i // 2, "b": next(j for j in range(i, 2100) if j + 1 not in inside) // 2} for i in sorted(inside) if i - 1 not in inside] or row

    assert suffix.merged_spans(col).to_pylist() == [expected(r) for r in rows]
    assert suffix.merged_spans(col.slice(7, 40)).to_pylist() == [expected(r) for r in rows[7:47]]
    assert suffix.merged_spans(col.slice(300, 1)).to_pylist() == [[]]
