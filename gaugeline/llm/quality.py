"""Quality classification by supervised subword embeddings.

A text is the average of learned vectors of its hashed words, of a token for each
word said twice in a row and of character n-grams (3 to 5 code points), and a softmax over two classes reads the average; vectors and softmax
are trained together by minibatch stochastic gradient descent (Adagrad steps) in numpy,
both classes weighing the same.  The softmax's scale and bias are then calibrated on a
fifth of the labelled texts that the vectors were not trained on, again with both classes
weighing the same: a score is the probability of label 1 where 0 and 1 are equally
frequent.  After training each bucket's vector is folded with the softmax into one number,
so scoring is a hash, a table look-up and a mean per text.

Training uses at most MAX_DOCS labelled texts of at most MAX_BYTES bytes (what one task
holds); scoring reads every text whole.

Defined results: null counts as empty, whose score is the softmax of the zero vector;
without labelled rows of both classes every score is 0.5; a repeated label row counts once
(the larger of differing labels); rows that repeat a doc_id are scored one by one; a column
of docs named score is replaced; other extra columns stay; an empty table gives an empty
result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bytehash import U, Hasher, chunks, column_bytes, mix, runs, white
from .sampling import fit_in_task, labelled_sample, scored, sent_texts

MAX_DOCS, MAX_BYTES = 3000, 100_000
BUCKETS, DIM, EPOCHS, BATCH, RATE = 1 << 16, 8, 5, 64, 0.08
NGRAMS = (3, 4, 5)
#: The bucket of the token for a word said again.
AGAIN = 0
#: Every so many-th text of a class calibrates.
HELD = 5


def features(h: Hasher, d: np.ndarray, off: np.ndarray):
    """(buckets, first feature of each text) for words, for the token that stands beside each word equal to
    the one before it, then for each n-gram length.  N-grams are of whole characters; those that run over a
    text's end belong to none."""
    s = h.prefix(d)
    a, e, doc = runs(~white(d), off)
    w = mix(h.spans(s, a, e) + U(1))
    yield (w >> U(64 - 16)).astype(np.int64), np.searchsorted(doc, np.arange(len(off)), "left")
    again = doc[1:][(w[1:] == w[:-1]) & (doc[1:] == doc[:-1])]
    yield np.full(len(again), AGAIN), np.searchsorted(again, np.arange(len(off)), "left")
    start = np.flatnonzero((d & 0xC0) != 0x80)
    at, scale = s[np.append(start, len(d))], h.ipw[start]
    first_char = np.searchsorted(start, off)
    for n in NGRAMS:
        m = len(start) - n + 1
        if m <= 0:
            yield np.zeros(0, np.int64), np.zeros(len(off), np.int64)
            continue
        w = (at[n : n + m] - at[:m]) * scale[:m]
        ok = np.ones(m, bool)
        for k in range(1, n):  # n-grams that start less than n characters before a text's end
            cut = first_char[1:] - k
            ok[cut[(cut >= 0) & (cut < m)]] = False
        first = np.concatenate([[0], np.cumsum(ok)])[np.minimum(first_char, m)]
        yield (((w[ok] * U(0x9FB21C651E98DF25)) ^ U(n)) * U(0xD6E8FEB86659FD93) >> U(64 - 16)).astype(np.int64), first


def hidden_of(parts, vec: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(averages of the vectors, numbers of features) of a batch of texts."""
    n = np.maximum(1, sum(np.diff(first) for _, first in parts))
    hidden = np.zeros((n_docs, vec.shape[1]))
    for k in range(vec.shape[1]):
        col = np.ascontiguousarray(vec[:, k])
        for f, first in parts:
            total = np.concatenate([[0.0], np.cumsum(col[f], dtype=np.float64)])
            hidden[:, k] += total[first[1:]] - total[first[:-1]]
    return hidden / n[:, None], n


def gradients(parts, y: np.ndarray, weight: np.ndarray, vec: np.ndarray, out: np.ndarray, bias: np.ndarray):
    """Gradients of the weighted mean cross-entropy by vec, out and bias."""
    hidden, n = hidden_of(parts, vec, len(y))
    z = hidden @ out + bias
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    p[np.arange(len(y)), y] -= 1
    p *= (weight / len(y))[:, None]
    back = (p @ out.T) / n[:, None]
    f = np.concatenate([x for x, _ in parts])
    own = np.concatenate([np.repeat(np.arange(len(y)), np.diff(first)) for _, first in parts])
    by_vec = np.stack([np.bincount(f, weights=back[own, k], minlength=len(vec)) for k in range(vec.shape[1])], axis=1)
    return by_vec, hidden.T @ p, p.sum(0)


def calibrated(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """(scale, shift) of the logistic regression of y on z, by Newton; labels are pulled in a little, so that
    classes that z parts have a finite scale."""
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    if not n1 or not n0:
        return 1.0, 0.0
    goal = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([z, np.ones(len(z))], axis=1)
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -40, 40)))
        grad = x.T @ (weight * (p - goal))
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.clip(np.linalg.solve(hess, grad), -2, 2)
        theta -= step
        if np.abs(step).max() < 1e-9:
            break
    return (float(theta[0]), float(theta[1])) if theta[0] > 0 else (1.0, 0.0)


def batches_of(texts: list[bytes], rows: np.ndarray, h: Hasher):
    for at in range(0, len(rows), BATCH):
        some = rows[at : at + BATCH]
        off = np.concatenate([[0], np.cumsum([len(texts[i]) for i in some])]).astype(np.int64)
        yield some, list(features(h, np.frombuffer(b"".join(texts[i] for i in some), np.uint8), off))


def train(texts: list[bytes], labels: list[int]) -> bytes:
    """Folded bucket values, then the bias, as float32."""
    y = np.array(labels, np.int64)
    if len(np.unique(y)) < 2:
        return np.zeros(BUCKETS + 1, np.float32).tobytes()
    rng = np.random.Generator(np.random.PCG64(7))
    h = Hasher()
    vec = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, 2)), np.zeros(2)
    params = [vec, out, bias]
    seen = [np.full_like(p, 1e-8) for p in params]
    share = np.bincount(y, minlength=2) / len(y)
    weight = 0.5 / share[y]
    # each class gives every fifth of its texts, in the order they come, to calibration
    nth = np.zeros(len(y), np.int64)
    for c in (0, 1):
        nth[y == c] = np.arange((y == c).sum())
    held = nth % HELD == HELD - 1
    with np.errstate(over="ignore"):
        for epoch in range(EPOCHS):
            step = RATE * (1 - epoch / EPOCHS)
            for rows, parts in batches_of(texts, rng.permutation(np.flatnonzero(~held)), h):
                for p, g, past in zip(params, gradients(parts, y[rows], weight[rows], *params), seen, strict=True):
                    past += g**2
                    p -= step * g / np.sqrt(past)
        fold, shift = out[:, 1] - out[:, 0], bias[1] - bias[0]
        z = [hidden_of(parts, vec, len(rows))[0] @ fold + shift for rows, parts in batches_of(texts, np.flatnonzero(held), h)]
    a, b = calibrated(np.concatenate(z), y[held], weight[held]) if z else (1.0, 0.0)
    return np.concatenate([a * (vec @ fold), [a * shift + b]]).astype(np.float32).tobytes()


def scorer(model: bytes):
    def run(batches):
        table = np.frombuffer(model, np.float32)
        value, bias = table[:-1].astype(np.float64), float(table[-1])
        h = Hasher()
        with np.errstate(over="ignore"):
            for b in batches:
                data, off = column_bytes(sent_texts(b))
                out = np.zeros(len(off) - 1)
                for i, j in chunks(off):
                    total, n = np.zeros(j - i), np.zeros(j - i)
                    for f, first in features(h, data[off[i] : off[j]], off[i : j + 1] - off[i]):
                        run_ = np.concatenate([[0.0], np.cumsum(value[f])])
                        total += run_[first[1:]] - run_[first[:-1]]
                        n += np.diff(first)
                    out[i:j] = total / np.maximum(n, 1) + bias
                scores = pa.array(1 / (1 + np.exp(-np.clip(out, -60, 60))))
                yield pa.RecordBatch.from_arrays([b.column("row"), scores], names=["row", "score"])

    return run


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_DOCS, max_bytes: int = MAX_BYTES) -> bytes:
    """A model from docs(doc_id, text) and labels(doc_id, label)."""
    return fit_in_task(labelled_sample(docs, labels, most, max_bytes), train)


def score(docs: DataFrame, model: bytes) -> DataFrame:
    """docs(text, ...) with a score column, in place of any column of that name."""
    return scored(docs, scorer(model))
