"""Quality rules as a bitmask ledger.

Every rule is evaluated once for every document.  The ledger keeps the measurements
and one failure bit for each rule; a policy is a versioned set of bits, applied
afterwards without reading a text again, and ablations are bitwise aggregates.

Defined results: null or wordless text has zero measurements and fails too_few_words;
rows that repeat a doc_id are measured one by one; extra columns are ignored; an
empty table gives an empty ledger.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytehash import U, Hasher, chunks, column_bytes, mix, runs, table, white, word_hashes

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_marked_words")


def rule_columns() -> dict[str, Column]:
    """Rule name -> failure, in bit order.  New rules go last: bits never change meaning."""
    c = F.col
    return {
        "too_few_words": c("n_words") < 20,
        "repeated_words": 100 * c("n_repeat_words") > 30 * c("n_words"),
        "short_words": c("word_chars") < 2 * c("n_words"),
        "long_words": c("word_chars") > 20 * c("n_words"),
        "symbols": 10 * c("n_symbols") > c("n_words"),
        "repeated_lines": 100 * c("n_dup_lines") > 30 * c("n_lines"),
        "shouting": 10 * c("n_upper") > 5 * c("n_letters"),
        "marked_words": 10 * c("n_marked_words") > 3 * c("n_words"),
    }


BASE = ("too_few_words", "repeated_words")
POLICIES = {
    1: BASE,
    2: (*BASE, "short_words", "long_words", "symbols", "repeated_lines", "shouting", "marked_words"),
}
POLICY = 2


def by_doc(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[off[1:]] - total[off[:-1]]


def repeated(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether each (document, hash) occurs twice or more."""
    key = (doc.astype(np.uint64) << U(52)) | (h >> U(12))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    out = np.zeros(len(h), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def measure(batches):
    h, coef = Hasher(), table(23, WINDOW)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    mark = np.zeros(256, bool)
    mark[list(b"!?#*$%&|<>=~^_{}[]\\")] = True
    with np.errstate(over="ignore"):
        for b in batches:
            data, off = column_bytes(b.column(1))
            for i, j in chunks(off):
                d, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
                n_docs = j - i
                word = ~white(d)
                a, e, doc = runs(word, o)
                w, first = word_hashes(h, d, o)
                m = len(w) - WINDOW + 1
                covered = np.zeros(len(w), bool)
                if m > 0:
                    acc = sum(w[k : k + m] * coef[k] for k in range(WINDOW))
                    ok = np.flatnonzero(np.arange(m) + WINDOW <= first[1:][doc[:m]])
                    hit = ok[repeated(mix(acc[ok]), doc[:m][ok])]
                    step = np.zeros(len(w) + 1, np.int64)
                    np.add.at(step, hit, 1)
                    np.add.at(step, hit + WINDOW, -1)
                    covered = np.cumsum(step[:-1]) > 0
                # \n-split lines: boundaries after each \n and at text ends
                la, le, ldoc = runs(d != 10, o)
                words_before = np.concatenate([[0], np.cumsum(word)])
                full = words_before[le] > words_before[la]
                la, le, ldoc = la[full], le[full], ldoc[full]
                line = mix(h.spans(h.prefix(d), la, le) + (le - la).astype(np.uint64))
                lkey = np.unique((ldoc.astype(np.uint64) << U(52)) | (line >> U(12)))
                n_lines = np.bincount(ldoc, minlength=n_docs)
                distinct = np.bincount((lkey >> U(52)).astype(np.int64), minlength=n_docs)
                upper = (d >= 65) & (d <= 90)
                lower = (d >= 97) & (d <= 122)
                # two-byte Latin capitals: C3 80..9E, but for the multiplication sign
                latin = np.zeros(len(d), bool)
                latin[1:] = (d[:-1] == 0xC3) & (d[1:] >= 0x80)
                big = latin & (d <= 0x9E) & (d != 0x97)
                marks = np.concatenate([[0], np.cumsum(mark[d])])
                marked = marks[e] > marks[a]
                cols = {
                    "n_words": np.diff(first),
                    "word_chars": by_doc(word & ((d & 0xC0) != 0x80), o),
                    "n_symbols": by_doc(symbol[d], o),
                    "n_dup_lines": n_lines - distinct,
                    "n_repeat_words": by_doc(covered, first),
                    "n_lines": n_lines,
                    "n_upper": by_doc(upper | big, o),
                    "n_letters": by_doc(upper | lower | latin, o),
                    "n_marked_words": by_doc(marked, first),
                }
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, n_docs), *(pa.array(cols[k].astype(np.int64)) for k in MEASURES)], names=["doc_id", *MEASURES])


def bits(names) -> int:
    order = list(rule_columns())
    return sum(1 << order.index(n) for n in set(names))


def ledger(docs: DataFrame) -> DataFrame:
    """(doc_id, measurements, failed bigint): one bit for each failed rule."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        measure, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)
    )
    failed = reduce(lambda x, y: x.bitwiseOR(y), (F.when(c, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, c in enumerate(rule_columns().values())))
    return rows.withColumn("failed", failed)


def apply_policy(led: DataFrame, version: int = POLICY) -> DataFrame:
    """Adds base_failed, kept and the policy's version."""
    hit = lambda names: F.col("failed").bitwiseAND(F.lit(bits(names)).cast("long")) != 0
    return led.withColumns({"base_failed": hit(BASE), "kept": ~hit((*BASE, *POLICIES[version])), "policy": F.lit(version)})


def ablations(led: DataFrame, version: int = POLICY) -> DataFrame:
    """(rule, n_failed, n_only): documents a rule fails, and those that only it fails under the
    policy (kept if the rule were left out)."""
    names = POLICIES[version]
    mask = F.col("failed").bitwiseAND(F.lit(bits(names)).cast("long"))
    sums = led.agg(*(x for n in names for x in (F.count_if(mask.bitwiseAND(F.lit(bits([n])).cast("long")) != 0).alias(f"{n}_f"), F.count_if(mask == bits([n])).alias(f"{n}_o"))))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(f"{n}_f").alias("n_failed"), F.col(f"{n}_o").alias("n_only")) for n in names))).alias("r")).select("r.*")
