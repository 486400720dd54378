"""BPE with word ends: encoding by a contiguous array of ranks, and decoding.

The tokenizer's file says how a text is cut: its added tokens first, then, in what lies between, Unicode composition, one
space for white space, lower case, and words by its pattern; each word's bytes are letters of the vocabulary, the last
one with the word's end.  A short word is one array of parts and one of the ranks of adjacent parts: the smallest rank
(the first of equal ones) is found by a scan, its boundary goes, and its two neighbours' ranks are looked up anew.  A
word of more than SCAN parts finds the smallest rank in a heap over linked parts instead, as the scans would take its square.

A text is cut at blanks, which no token holds, in blocks; what lies between two blanks is encoded once and remembered.

Decoding gives the tokens' strings with blanks between them, as the file names no decoder.

Defined results: null counts as empty, with no ids; an added token's string within a text is that token; rows that
repeat a doc_id are encoded one by one.  Extra columns are ignored; an empty table gives an empty result.  A file with
other steps than these is refused.  Which code points are letters, and their lower case, is by Python's Unicode: those
that only a later Unicode version assigns may be cut otherwise by a library that knows it.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts of a word up to which ranks are scanned; blank-free strings kept in a task's memo, and their longest.
SCAN, KEPT, LONGEST = 128, 300_000, 256
#: Characters of a text, and ids of a list, worked on at a time.
TEXT_BLOCK, BLOCK = 1 << 20, 4096
NO_RANK = 1 << 60
#: Stands for code points without a category while words are found: the pattern's library may know newer letters.
UNKNOWN = "\ue000"


def read_tokenizer(path: str) -> dict:
    """What the file says, read once on the driver and shipped: merges as ids, the letters of bytes, token strings."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, cut = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
    steps = [n["type"] for n in spec["normalizer"]["normalizers"]]
    plain = all(not model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
    simple = all(not t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")) and not any(" " in t["content"] or t["content"].isalpha() for t in spec["added_tokens"])
    fits = steps == ["NFC", "Replace", "Lowercase"] and [c["type"] for c in cut] == ["Split", "ByteLevel"] and cut[0]["behavior"] == "Removed" and cut[0]["invert"] and not cut[1]["add_prefix_space"] and not cut[1]["use_regex"]
    if not (plain and simple and fits and model["type"] == "BPE" and spec["decoder"] is None and spec["post_processor"] is None):
        raise ValueError(f"{path}: not a BPE with word ends of the kind that this encoder reads")
    vocab, end = model["vocab"], model["end_of_word_suffix"]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    letters = byte_letters()
    tokens = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    return {
        "rank": {(vocab[a], vocab[b]): rank for rank, (a, b) in enumerate(pairs)}, "made": [vocab[a + b] for a, b in pairs],
        "inner": [vocab[c] for c in letters], "last": [vocab[c + end] for c in letters], "tokens": tokens,
        "added": {t["content"]: t["id"] for t in spec["added_tokens"]}, "words": cut[0]["pattern"]["Regex"], "space": spec["normalizer"]["normalizers"][1],
    }


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it can be seen, else the next one from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in seen else chr(next(rest)) for b in range(256)]


def merge_short(parts: list[int], rank: dict, made: list[int]) -> list[int]:
    """The rank array: ranks[i] belongs to parts i and i + 1."""
    get = rank.get
    ranks = [get(p, NO_RANK) for p in zip(parts, parts[1:], strict=False)]
    while ranks and (least := min(ranks)) < NO_RANK:
        i = ranks.index(least)
        parts[i] = new = made[least]
        del parts[i + 1], ranks[i]
        if i:
            ranks[i - 1] = get((parts[i - 1], new), NO_RANK)
        if i < len(ranks):
            ranks[i] = get((new, parts[i + 1]), NO_RANK)
    return parts


def merge_long(parts: list[int], rank: dict, made: list[int]) -> list[int]:
    """The same from a heap of (rank, place) over linked parts; entries whose pair has changed are passed over."""
    n = len(parts)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    heap = [(rank[p], i, *p) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in rank]
    heapq.heapify(heap)
    while heap:
        least, i, a, b = heapq.heappop(heap)
        j = after[i]
        if j < 0 or parts[i] != a or parts[j] != b:
            continue
        parts[i], parts[j] = made[least], -1
        after[i] = k = after[j]
        if k >= 0:
            before[k] = i
            if (p := (parts[i], parts[k])) in rank:
                heapq.heappush(heap, (rank[p], i, *p))
        if (h := before[i]) >= 0 and (p := (parts[h], parts[i])) in rank:
            heapq.heappush(heap, (rank[p], h, *p))
    return [p for p in parts if p >= 0]


class Words(dict):
    """Word -> (packed ids, their token strings, each after a blank)."""

    def __init__(self, spec: dict):
        self.rank, self.made, self.inner, self.last = (spec[k] for k in ("rank", "made", "inner", "last"))
        self.said = {i: f" {t}".encode() for i, t in spec["tokens"].items()}

    def __missing__(self, word: str) -> tuple[bytes, bytes]:
        data = word.encode("utf-8", "surrogatepass")
        parts = [self.inner[b] for b in data]
        parts[-1] = self.last[data[-1]]
        ids = (merge_short if len(parts) <= SCAN else merge_long)(parts, self.rank, self.made)
        got = self.packed(ids)
        if len(word) <= LONGEST:
            if len(self) >= KEPT:
                self.clear()
            self[word] = got
        return got

    def packed(self, ids: list[int]) -> tuple[bytes, bytes]:
        return struct.pack(f"<{len(ids)}I", *ids), b"".join([self.said[i] for i in ids])


class Encoder:
    """A task's encoder with its memos: of words, and of strings between blanks."""

    def __init__(self, spec: dict):
        import regex

        self.own, self.memo = Words(spec), {}
        self.words, self.space, self.blank = regex.compile(spec["words"]), regex.compile(spec["space"]["pattern"]["Regex"]), spec["space"]["content"]
        self.added = {t: self.own.packed([i]) for t, i in spec["added"].items()}
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) or "(?!)")

    def between(self, text: str) -> list[tuple[bytes, bytes]]:
        """Word by word, of text without added tokens."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower case takes each letter by itself, a last sigma too
        text = self.space.sub(self.blank, text).lower()
        if text.isascii():
            return [self.own[w] for w in self.words.findall(text)]
        seen = "".join([UNKNOWN if unicodedata.category(c) == "Cn" else c for c in text])
        return [self.own[text[m.start() : m.end()]] for m in self.words.finditer(seen)]

    def pieces(self, chunk: str) -> list[tuple[bytes, bytes]]:
        if chunk.isascii() and chunk.isalpha():
            return [self.own[w] for w in self.words.findall(chunk.lower())]
        at, got = 0, []
        for m in self.cut.finditer(chunk):
            got += [*self.between(chunk[at : m.start()]), self.added[m[0]]]
            at = m.end()
        return got + self.between(chunk[at:])

    def chunk(self, chunk: str) -> tuple[bytes, bytes]:
        """(packed ids, bytes of " token" for each) of a string without blanks, remembered unless it is long."""
        made = self.pieces(chunk)
        got = made[0] if len(made) == 1 else (b"".join([m[0] for m in made]), b"".join([m[1] for m in made]))
        if len(chunk) <= LONGEST:
            if len(self.memo) >= KEPT:
                self.memo.clear()
            self.memo[chunk] = got
        return got

    def blocks(self, text: str):
        """(packed ids, bytes of " token" for each) of successive blocks of whole blank-free strings."""
        at, memo = 0, self.memo
        while at < len(text):
            end = text.find(" ", at + TEXT_BLOCK)
            end = len(text) if end < 0 else end
            made = [memo.get(c) or self.chunk(c) for c in text[at:end].split(" ") if c]
            yield b"".join([m[0] for m in made]), b"".join([m[1] for m in made])
            at = end + 1


def encoder(spec: dict, keep_ids: bool):
    def run(batches):
        own = Encoder(spec)

        def one(text: str) -> tuple:
            count, ids_hash, text_hash, kept = 0, hashlib.sha256(), hashlib.sha256(), []
            for packed, said in own.blocks(text):
                ids_hash.update(packed)
                text_hash.update(said if count else said[1:])
                count += len(packed) // 4
                if keep_ids:
                    kept.append(packed)
            return count, ids_hash.hexdigest(), text_hash.hexdigest(), b"".join(kept)

        def record(ids, rows) -> pa.RecordBatch:
            count, sha, back, packed = zip(*rows, strict=True)
            cols, names = [ids, pa.array(count, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(np.frombuffer(b"".join(packed), np.int32))))
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


def encode(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids array<int>]) for docs(doc_id, text) by the tokenizer file at path."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return rows.mapInArrow(encoder(read_tokenizer(path), keep_ids), schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) for encoded(doc_id, ids): the tokens' strings, null ids as none."""
    tokens = read_tokenizer(path)["tokens"]

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([" ".join(map(tokens.__getitem__, ids.as_py() or ())) for ids in b.column(1)], pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
