"""Byte-level BPE encoding and decoding with a finite-state transducer.

A token boundary that survives all merges splits the encoding: the encoding of a
prefix is the encoding of a shorter prefix plus one last token, and two tokens may
stand side by side exactly if their joint bytes encode to them.  The transducer reads
bytes; all tokens that may be under way at once form one deterministic state, named by
the longest suffix that begins a token, made with its transitions when first reached
and kept.  At each byte exactly one token that ends there fits the token before it.
Tokens are emitted once every start still open agrees on them, so the lookahead is
bounded by the longest token.  Whole pieces are memoised as their packed ids.

Decoding streams token bytes through an incremental UTF-8 decoder in blocks.

Defined results: null counts as empty, with no ids; any Unicode text, special-token
strings included, is ordinary text; rows that repeat a doc_id are encoded one by one.
Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import struct
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries kept in a task's memos before they are dropped and refilled.
KEPT_PIECES, KEPT_STATES, KEPT_PAIRS = 300_000, 60_000, 300_000
#: Tokens decoded at a time, characters encoded at a time.
BLOCK, TEXT_BLOCK = 4096, 1 << 20


def read_ranks(path: str) -> bytes:
    """The rank file as it is; read once on the driver and shipped (its size is fixed)."""
    with open(path, "rb") as f:
        return f.read()


class State:
    """A deterministic state: the longest suffix of the input that begins a token.  ends: the tokens
    that may end here, longest first, with their lengths; next: transitions met so far."""

    __slots__ = ("text", "ends", "next")

    def __init__(self, text: bytes, ends: list[tuple[int, int]]):
        self.text, self.ends = text, ends
        self.next: dict[int, State] = {}


def compiled(ranks: bytes) -> tuple[dict[bytes, int], dict[int, tuple[int, int]]]:
    """(token bytes -> id, id -> the two tokens its merge joins; a byte joins itself twice).
    Tokens that merging never makes have no entry in the second.  Made once on the driver."""
    rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
    parts: dict[int, tuple[int, int]] = {}
    for token, own in rank.items():
        if len(token) == 1:
            parts[own] = (own, own)
            continue
        cuts = [(l, r) for i in range(1, len(token)) if (l := rank.get(token[:i], own)) < own and (r := rank.get(token[i:], own)) < own]
        if len(cuts) > 1:
            left = merged(token, rank, own)
            cuts = [tuple(rank[p] for p in left)] if len(left) == 2 else []
        if cuts:
            parts[own] = cuts[0]
    return rank, parts


def merged(data: bytes, rank: dict[bytes, int], below: int) -> list[bytes]:
    """Plain merging by the ranks under below: the definition of the encoding."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: rank.get(parts[i] + parts[i + 1], below))
        if rank.get(parts[best] + parts[best + 1], below) >= below:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts


class Transducer:
    def __init__(self, rank: dict[bytes, int], parts: dict[int, tuple[int, int]]):
        self.rank, self.parts = rank, parts
        self.token = {i: t for t, i in rank.items()}
        self.opens = {t[:n] for t in rank for n in range(len(t) + 1)}
        self.joins = {lr: i for i, lr in parts.items() if lr != (i, i)}
        self.pair: dict[tuple[int, int], bool] = {}
        self.states: dict[bytes, State] = {}
        self.start = State(b"", [])

    def side_by_side(self, a: int, b: int) -> bool:
        """Whether token b may follow token a (-1: a piece's start): no merge across their border
        comes before both are whole.  Their border tokens are taken apart, the later merge first."""
        if b not in self.parts:
            return False
        if a < 0:
            return True
        if (got := self.pair.get((a, b))) is None:
            x, y, until, got = a, b, 1 << 60, True
            while True:
                if self.joins.get((x, y), until) < until:
                    got = False
                    break
                if x > y:
                    x, until, whole = self.parts[x][1], x, x
                    if x != whole:
                        continue
                    y, whole = self.parts[y][0], y
                    until = whole + 1
                    if y == whole:
                        break
                else:
                    whole = y
                    until, y = y + 1, self.parts[y][0]
                    if y != whole:
                        continue
                    whole = x
                    until, x = x, self.parts[x][1]
                    if x == whole:
                        break
            if len(self.pair) >= KEPT_PAIRS:
                self.pair.clear()
            self.pair[a, b] = got
        return got

    def step(self, state: State, byte: int) -> State:
        text = state.text + bytes((byte,))
        while text not in self.opens:
            text = text[1:]
        made = self.states.get(text)
        if made is None:
            if len(self.states) >= KEPT_STATES:
                self.states.clear()
                self.start = State(b"", [])
            ends = ((self.rank.get(text[i:]), len(text) - i) for i in range(len(text)))
            made = self.states[text] = State(text, [(t, n) for t, n in ends if t is not None and t in self.parts])
        state.next[byte] = made
        return made

    def encode(self, piece: bytes) -> list[int]:
        """back[i]: the last token of the first i bytes' encoding, the only one that fits there."""
        ids, back, state, ok, pair = [], [-1], self.start, self.side_by_side, self.pair
        for byte in piece:
            state = state.next.get(byte) or self.step(state, byte)
            i = len(back)
            for t, n in state.ends:
                if n <= i:
                    a = back[i - n]
                    if (fits := pair.get((a, t))) is None:
                        fits = ok(a, t)
                    if fits:
                        back.append(t)
                        break
            if len(back) > BLOCK:
                back = self.emit(back, len(state.text), ids)
        self.path(back, len(back) - 1, ids)
        return ids

    def path(self, back: list[int], i: int, ids: list[int]) -> None:
        own = []
        while i > 0:
            own.append(back[i])
            i -= len(self.token[back[i]])
        ids += reversed(own)

    def emit(self, back: list[int], open_: int, ids: list[int]) -> list[int]:
        """Emit the tokens on which all ends that a later token may start from agree."""
        n = len(back) - 1
        common = None
        for end in range(n - open_, n + 1):
            cuts, i = set(), end
            while i > 0:
                cuts.add(i)
                i -= len(self.token[back[i]])
            common = cuts if common is None else common & cuts
        cut = max(common, default=0)
        if cut:
            self.path(back, cut, ids)
            back = [back[cut], *back[cut + 1 :]]
        return back


class Pieces(dict):
    """Piece -> its ids as packed little-endian 32-bit numbers."""

    def __init__(self, machine: Transducer):
        self.machine = machine

    def __missing__(self, piece: str) -> bytes:
        data = piece.encode("utf-8", "surrogatepass")
        whole = self.machine.rank.get(data)
        ids = [whole] if whole is not None else self.machine.encode(data)
        if len(self) >= KEPT_PIECES:
            self.clear()
        self[piece] = packed = struct.pack(f"<{len(ids)}I", *ids)
        return packed


def decoded(ids, token: dict[int, bytes]):
    """Texts of successive blocks of ids; a character cut by a block waits for its rest."""
    machine = codecs.getincrementaldecoder("utf-8")("surrogatepass")
    for i in range(0, len(ids), BLOCK):
        yield machine.decode(b"".join(map(token.__getitem__, ids[i : i + BLOCK])))
    yield machine.decode(b"", True)


def encoder(ranks: bytes, pattern: str, keep_ids: bool):
    tables = compiled(ranks)

    def run(batches):
        import regex

        split = regex.compile(pattern)
        # whole matches at any length of text, of a pattern with groups too
        found = (lambda t: [m[0] for m in split.finditer(t)]) if split.groups else split.findall
        machine = Transducer(*tables)
        pieces = Pieces(machine)

        def one(text: str) -> tuple:
            """(number of ids, their hash, the decoded text's hash, packed ids), a block at a time."""
            count, ids_hash, text_hash, kept = 0, hashlib.sha256(), hashlib.sha256(), []
            back = codecs.getincrementaldecoder("utf-8")("surrogatepass")
            if len(text) <= TEXT_BLOCK:
                blocks = [[pieces[p] for p in found(text)]]
            else:
                blocks = batched((pieces[m[0]] for m in split.finditer(text)), BLOCK)
            for block in blocks:
                packed = b"".join(block)
                ids_hash.update(packed)
                ids = memoryview(packed).cast("I").tolist()
                text_hash.update(back.decode(b"".join(map(machine.token.__getitem__, ids))).encode("utf-8", "surrogatepass"))
                count += len(ids)
                if keep_ids:
                    kept.append(packed)
            text_hash.update(back.decode(b"", True).encode("utf-8", "surrogatepass"))
            return count, ids_hash.hexdigest(), text_hash.hexdigest(), b"".join(kept)

        def record(ids, rows) -> pa.RecordBatch:
            count, sha, back, packed = zip(*rows, strict=True)
            cols = [ids, pa.array(count, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                ends = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), np.int32))))
                names.append("ids")
            return pa.RecordBatch.from_arrays(cols, names=names)

        last, got = None, ()
        for b in batches:
            at, size, rows = 0, 0, []
            for i, text in enumerate(b.column(1)):
                text = text.as_py() or ""
                if text != last:  # copies that follow each other are encoded once
                    last, got = text, one(text)
                rows.append(got)
                size += len(text)
                if size >= 2 * TEXT_BLOCK:
                    yield record(b.column(0).slice(at, len(rows)), rows)
                    at, size, rows = i + 1, 0, []
            if rows:
                yield record(b.column(0).slice(at, len(rows)), rows)

    return run


def encode(docs: DataFrame, ranks_path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids array<int>]) for docs(doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return rows.mapInArrow(encoder(read_ranks(ranks_path), pattern, keep_ids), schema)


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, text) for encoded(doc_id, ids)."""
    ranks = read_ranks(ranks_path)

    def run(batches):
        token = {int(b): base64.b64decode(a) for a, b in (line.split() for line in ranks.splitlines() if line)}
        for b in batches:
            texts = ["".join(decoded(ids or [], token)) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
