"""Toxicity scores by weak supervision.

Voters are the words of a fixed lexicon and word beginnings mined from labelled training
texts; each fires on a text or doesn't.  A generative label model is fitted to the votes
alone, of labelled and unlabelled texts, by expectation maximisation: a hidden class 0 and
a class 1 that is a mixture of vocabularies (groups of voters that fire together, lightly
or heavily), all with estimated shares; in each every voter has its own accuracy (its rate
of firing) and, along a forest over the voters, its correlation to another one: the rate
depends on whether that one fired.  The forest spans the voters by their mutual information
given the class, where that is significant.

The posteriors train a linear classifier on hashed words and word beginnings, which scores
every whole text.  Its scale and bias are calibrated on the labelled training texts, both
classes weighing the same: a score is the probability of label 1 where 0 and 1 are equally
frequent.

Fitting uses at most MAX_DOCS labelled and UNLABELLED other texts of at most MAX_BYTES bytes
(what one task holds).

Defined results: null counts as empty, which scores as a text without known words;
without any labelled row every score is 0; a repeated label row counts once (the larger of
differing labels); rows that repeat a doc_id are scored one by one; a column of docs named
score is replaced; other extra columns stay; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bytehash import U, Hasher, chunks, column_bytes, mix, runs
from .quality import calibrated
from .sampling import fit_in_task, labelled_sample, scored, sent_texts

MAX_DOCS, UNLABELLED, MAX_BYTES = 6000, 2000, 100_000
BITS = 22
#: Bytes of a word's beginning that are a feature each; 0 is the whole word.
BEGINNINGS = (0, 4, 5, 6, 7, 8)
LEXICON = (
    "idiot idiots idiotic moron morons moronic stupid stupidity clown clowns trash scum scumbag loser losers pathetic "
    "worthless disgusting dumb dumbass fool fools foolish garbage vermin filth filthy freak freaks jerk jerks coward cowards "
    "creep creeps imbecile imbeciles degenerate degenerates lowlife parasite parasites bastard bastards bitch bitches "
    "asshole assholes whore slut retard retarded subhuman useless brainless hideous repulsive hate "
    "idiote idiots imbécile imbéciles crétin crétins connard connards connasse salaud salope ordure ordures abruti abrutis "
    "débile débiles minable minables pourriture raclure stupide dégoûtant dégueulasse enculé "
    "idioten trottel dummkopf dumm blödmann abschaum widerlich ekelhaft arschloch arschlöcher schwachkopf versager "
    "scheißkerl drecksau missgeburt wichser hurensohn erbärmlich "
    "estúpido estúpida estúpidos imbécil imbéciles basura escoria asqueroso asquerosa tonto tonta cabrón cabrones "
    "gilipollas mierda pendejo inútil patético repugnante"
).split()
#: A mined voter: training texts it must hit, share of them labelled toxic, newly reached texts; and voters at most.
SUPPORT, PRECISION, NEW, MOST_VOTERS = 4, 0.9, 2, 192
#: A voter's link in the forest: twice the texts times the mutual information is over this (0.1 % of a chi-square of
#: two degrees).  Pseudo-counts of a rate, and of a rate given the other voter's vote.
SIGNIFICANT, FIRED1, FIRED0, GIVEN = 13.8, (0.5, 8.0), (0.05, 20.0), 4.0
VOCABULARIES, FEW = 8, 2
SELECTED, STEPS, RATE, RIDGE = 4096, 400, 0.5, 1e-4


def lower(d: np.ndarray) -> np.ndarray:
    """ASCII and two-byte Latin capitals to small letters."""
    low = np.where((d >= 65) & (d <= 90), d + np.uint8(32), d)
    if len(d) > 1:
        big = np.zeros(len(d), bool)
        big[1:] = (d[:-1] == 0xC3) & (d[1:] >= 0x80) & (d[1:] <= 0x9E) & (d[1:] != 0x97)
        low = np.where(big, low + np.uint8(32), low)
    return low


def word_features(h: Hasher, data: np.ndarray, off: np.ndarray):
    """(text number, bucket) of every word's features, one array pair for each kind."""
    d = lower(data)
    letters = ((d >= 97) & (d <= 122)) | (d >= 0x80)
    a, e, doc = runs(letters, off)
    s = h.prefix(d)
    for n in BEGINNINGS:
        use = e - a >= max(n, 1)
        stop = e[use] if n == 0 else a[use] + n
        yield doc[use], (mix(h.spans(s, a[use], stop) + U(n * 0x1F3D5B79)) >> U(64 - BITS)).astype(np.int64)


def presence(h: Hasher, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, bucket), sorted."""
    keys = []
    for at in range(0, len(texts), 256):
        part = texts[at : at + 256]
        off = np.concatenate([[0], np.cumsum([len(t) for t in part])]).astype(np.int64)
        got = [((doc + at) << BITS) | f for doc, f in word_features(h, np.frombuffer(b"".join(part), np.uint8), off)]
        keys.append(np.unique(np.concatenate(got)))
    key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
    return (key >> BITS).astype(np.int32), (key & ((1 << BITS) - 1)).astype(np.int32)


def mine(doc: np.ndarray, f: np.ndarray, y: np.ndarray, fixed: list[int]) -> tuple[list[int], np.ndarray]:
    """The lexicon's buckets, then word beginnings that reach labelled texts no voter before them reaches; and for
    each the share of labelled texts it reaches that are labelled 0 (half a text more, of one text more)."""
    every = np.bincount(f[y[doc] >= 0], minlength=1 << BITS)
    toxic = np.bincount(f[y[doc] == 1], minlength=1 << BITS)
    voters = list(dict.fromkeys(int(b) for b in np.array(fixed)[np.isin(fixed, f)]))
    reached = np.zeros(len(y), bool)
    reached[doc[np.isin(f, voters)]] = True
    good = np.flatnonzero((toxic >= SUPPORT) & (toxic >= PRECISION * every))
    order = np.argsort(f, kind="stable")
    fs = f[order]
    for b in good[np.lexsort((good, -toxic[good]))]:
        if len(voters) >= MOST_VOTERS:
            break
        hit = doc[order[np.searchsorted(fs, b) : np.searchsorted(fs, b, "right")]]
        if (~reached[hit] & (y[hit] == 1)).sum() >= NEW:
            voters.append(int(b))
            reached[hit] = True
    return voters, (every[voters] - toxic[voters] + 0.5) / (every[voters] + 1) if voters else np.full(1, 0.5)


def forest(votes: np.ndarray, classes: list[np.ndarray]) -> np.ndarray:
    """Each voter's parent (-1: none) in the maximum spanning forest of mutual information given the class, summed
    over texts weighted by classes; links that are not significant are left out."""
    m = votes.shape[1]
    gain = np.zeros((m, m))
    for w in classes:
        total = w.sum() + 1e-9
        fired = w @ votes
        both = votes.T @ (votes * w[:, None])
        for x, a, b in ((both, fired[:, None], fired[None, :]), (fired[:, None] - both, fired[:, None], total - fired[None, :]), (fired[None, :] - both, total - fired[:, None], fired[None, :]), (total - fired[:, None] - fired[None, :] + both, total - fired[:, None], total - fired[None, :])):
            gain += np.where(x > 1e-6, x * np.log(np.maximum(x, 1e-6) * total / np.maximum(a * b, 1e-9)), 0)
    gain = np.where(2 * gain > SIGNIFICANT, gain, -1)
    parent, best, done = np.full(m, -1), np.full(m, -1.0), np.zeros(m, bool)
    for _ in range(m):
        j = int(np.argmax(np.where(done, -2, best)))
        done[j] = True
        closer = ~done & (gain[j] > best)
        best[closer], parent[closer] = gain[j][closer], j
    return parent


def vocabularies(votes: np.ndarray) -> np.ndarray:
    """A number for each text: 0 without votes, else that of a group of voters that fire together (1 + VOCABULARIES
    for what fits none), in a light kind (up to FEW voters) and a heavy one."""
    m = votes.shape[1]
    both = votes.T @ votes
    alone = np.diag(both)
    near = (both >= 2) & (both * len(votes) > 4 * alone[:, None] * alone[None, :])
    group = np.arange(m)
    while True:  # the smallest number of all voters joined
        low = np.where(near | np.eye(m, dtype=bool), group[None, :], m).min(1)
        if (low == group).all():
            break
        group = low
    mass = np.bincount(group, weights=alone, minlength=m)
    kept = np.argsort(-mass, kind="stable")[:VOCABULARIES]
    name = np.full(m, VOCABULARIES)
    name[kept[mass[kept] > 0]] = np.arange((mass[kept] > 0).sum())
    fired = np.stack([votes[:, name[group] == k].sum(1) for k in range(VOCABULARIES + 1)], axis=1)
    most, total = fired.argmax(1), votes.sum(1)
    return np.where(total > 0, 1 + 2 * most + (total > FEW), 0)


def rates(votes: np.ndarray, parent: np.ndarray, w: np.ndarray, wrong: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(classes, voters): rates of firing where the parent fired and where it didn't, over texts weighted by w.
    In class 0 no voter fires more often than its share wrong of all times it fires."""
    fired, total = w.T @ votes, w.sum(0)[:, None]
    first = np.arange(w.shape[1])[:, None] == 0
    held = np.where(first, np.minimum(1, wrong * votes.sum(0) / np.maximum(fired, 1e-12)), 1)
    fired = fired * held
    p = np.clip((fired + np.where(first, FIRED0[0], FIRED1[0])) / (total + np.where(first, FIRED0[1], FIRED1[1])), 1e-6, 1 - 1e-6)
    up = votes[:, np.maximum(parent, 0)]
    with_up, both = w.T @ up, (w.T @ (votes * up)) * held
    given = np.clip((both + GIVEN * p) / (with_up + GIVEN), 1e-6, 1 - 1e-6)
    alone = np.clip((fired - both + GIVEN * p) / (total - with_up + GIVEN), 1e-6, 1 - 1e-6)
    root = parent < 0
    return np.where(root, p, given), np.where(root, p, alone)


def likelihood(votes: np.ndarray, parent: np.ndarray, given: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """(texts, classes): logarithms of the probabilities of a text's votes."""
    up = votes[:, np.maximum(parent, 0)] * (parent >= 0)
    yes1, no1, yes0, no0 = np.log(given), np.log(1 - given), np.log(alone), np.log(1 - alone)
    return no0.sum(1) + votes @ (yes0 - no0).T + up @ (no1 - no0).T + (votes * up) @ (yes1 - no1 - yes0 + no0).T


def label_model(votes: np.ndarray, wrong: np.ndarray, missed: float, rounds: int = 60) -> np.ndarray:
    """Posterior of class 1, all hidden classes but the first, for each row of 0/1 votes, without labels.  Which
    class is 1, and whether a voter that fires alone or a text without votes is right, can't be told from votes:
    wrong bounds each voter's share of false votes, missed that of class 1 in texts without votes."""
    silent = ~votes.any(1)
    start = vocabularies(votes)
    _, start = np.unique(np.append(start, 0), return_inverse=True)
    start = start[:-1]
    post = np.full((len(votes), max(2, start.max(initial=0) + 1)), 1e-9)
    post[np.arange(len(votes)), start] = 1.0
    post[:, 0] = np.where(start == 0, 1.0, 0.1)
    post /= post.sum(1, keepdims=True)
    parent = np.full(votes.shape[1], -1)
    for step in range(rounds):
        if step in (3, 8, 16):  # the forest settles before the rates do
            parent = forest(votes, list(post.T))
        share = (post.sum(0) + 0.1) / (len(votes) + 0.1 * post.shape[1])
        z = np.log(share) + likelihood(votes, parent, *rates(votes, parent, post, wrong))
        new = np.exp(z - z.max(1, keepdims=True))
        new /= new.sum(1, keepdims=True)
        over = np.maximum(1, (1 - new[:, 0]) / missed)[silent, None]
        new[silent] /= over
        new[silent, 0] = 1 - new[silent, 1:].sum(1)
        moved, post = np.abs(new - post).max(), new
        if moved < 1e-6 and step > 16:
            break
    return 1 - post[:, 0]


def linear(doc: np.ndarray, f: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """(buckets, weights, bias, values of the texts) of a logistic model on the posteriors q."""
    n = len(q)
    every = np.bincount(f, minlength=1 << BITS)
    toxic = np.bincount(f, weights=q[doc], minlength=1 << BITS)
    base = q.mean()
    gain = np.where(every >= 3, np.maximum(toxic - every * base, 0) ** 2 / np.maximum(every * base * (1 - base), 1e-9), 0)
    pick = np.sort(np.argsort(-gain, kind="stable")[:SELECTED])
    pick = pick[gain[pick] > 4]
    at = np.searchsorted(pick, f)
    use = (at < len(pick)) & (pick[np.minimum(at, max(len(pick) - 1, 0))] == f) if len(pick) else np.zeros(len(f), bool)
    d, c = doc[use], at[use]
    w, b = np.zeros(len(pick)), float(np.log(base / (1 - base)))
    seen_w, seen_b = np.full(len(pick), 1e-8), 1e-8
    for k in range(STEPS):
        z = np.bincount(d, weights=w[c], minlength=n) + b
        g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - q) / n
        gw = np.bincount(c, weights=g[d], minlength=len(pick)) + RIDGE * w
        gb = g.sum()
        seen_w += gw**2
        seen_b += gb**2
        w -= RATE * gw / np.sqrt(seen_w)
        b -= RATE * gb / np.sqrt(seen_b)
    return pick, w, b, np.bincount(d, weights=w[c], minlength=n) + b


def train(texts: list[bytes], labels: list[int]) -> bytes:
    """From texts labelled 1, 0 or -1 (unknown): bias, buckets and weights."""
    h = Hasher()
    y = np.array(labels, np.int64)
    with np.errstate(over="ignore"):
        if not (y >= 0).any():
            return np.zeros(0).tobytes()
        words = [w.encode() for w in LEXICON]
        off = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
        fixed = next(iter(word_features(h, np.frombuffer(b"".join(words), np.uint8), off)))[1].tolist()
        doc, f = presence(h, texts)
        voters, wrong = mine(doc, f, y, fixed)
        votes = np.zeros((len(y), max(1, len(voters))))
        place = {b: i for i, b in enumerate(voters)}
        use = np.isin(f, voters)
        votes[doc[use], [place[b] for b in f[use].tolist()]] = 1
        silent = (y >= 0) & ~votes.any(1)
        q = label_model(votes, wrong, ((y[silent] == 1).sum() + 0.5) / (silent.sum() + 1))
        pick, w, b, z = linear(doc, f, np.clip(q, 1e-4, 1 - 1e-4))
        known = y >= 0
        share = np.bincount(y[known], minlength=2) / known.sum()
        scale, shift = calibrated(z[known], y[known], 0.5 / np.maximum(share[y[known]], 1e-9))
    return np.concatenate([[scale * b + shift], pick.astype(np.float64), scale * w]).tobytes()


def scorer(model: bytes):
    def run(batches):
        got = np.frombuffer(model, np.float64)
        k = (len(got) - 1) // 2
        weight = np.zeros(1 << BITS, np.float32)
        if len(got):
            weight[got[1 : k + 1].astype(np.int64)] = got[k + 1 :]
        bias = got[0] if len(got) else -60.0
        known = weight != 0
        h = Hasher()
        with np.errstate(over="ignore"):
            for b in batches:
                data, off = column_bytes(sent_texts(b))
                z = np.full(len(off) - 1, bias)
                for i, j in chunks(off):
                    keys = []
                    for doc, f in word_features(h, data[off[i] : off[j]], off[i : j + 1] - off[i]):
                        hit = known[f]
                        keys.append((doc[hit] << BITS) | f[hit])
                    key = np.unique(np.concatenate(keys))
                    z[i:j] += np.bincount(key >> BITS, weights=weight[key & ((1 << BITS) - 1)], minlength=j - i)
                scores = pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))
                yield pa.RecordBatch.from_arrays([b.column("row"), scores], names=["row", "score"])

    return run


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_DOCS, max_bytes: int = MAX_BYTES, unlabelled: int = UNLABELLED) -> bytes:
    """A model from docs(doc_id, text) and labels(doc_id, label)."""
    return fit_in_task(labelled_sample(docs, labels, most, max_bytes, unlabelled), train)


def score(docs: DataFrame, model: bytes) -> DataFrame:
    """docs(text, ...) with a score column, in place of any column of that name."""
    return scored(docs, scorer(model))
