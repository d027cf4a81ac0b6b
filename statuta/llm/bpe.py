"""Byte-pair encoding and decoding with a pair occurrence index.

The new distinct pieces of a slab lie in one array of symbols.  An index maps each mergeable pair, by
its rank, to all its positions there.  Active ranks are taken in ascending order; a merge touches
only the lists of the pairs beside it.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pretokens as P
from .columns import keyed, rekeyed

_NONE = np.iinfo(np.int32).max


@functools.cache
def byte_chars() -> str:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return "".join(chr(b if b in plain else next(spare)) for b in range(256))


class MergeTable:
    """Ranks and results of merges, and the bytes of each id, from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        model = data["model"]
        vocab, self.suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.pattern = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.single = np.array([vocab.get(c, -1) for c in byte_chars()], np.int32)
        self.final = np.array([vocab.get(c + self.suffix, -1) for c in byte_chars()], np.int32)
        pairs = [tuple(m.split(" ", 1) if isinstance(m, str) else m) for m in model["merges"]]
        self.left = np.array([vocab[a] for a, _ in pairs], np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        keys = (self.left << 32) | self.right
        order = np.argsort(keys, kind="stable")
        self._keys, self._ranks = keys[order], order.astype(np.int32)
        number = {c: b for b, c in enumerate(byte_chars())}
        spelled: dict[int, bytes] = {}
        for token, i in vocab.items():
            spelled[i] = bytes(number[c] for c in token.removesuffix(self.suffix) if c in number) if self.suffix else (
                bytes(number[c] for c in token) if all(c in number for c in token) else token.encode())
        spelled |= {i: token.encode() for token, i in self.special.items()}
        size = max(spelled) + 1
        self.lengths = np.array([len(spelled.get(i, b"")) for i in range(size)], np.int64)
        self.at = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(spelled.get(i, b"") for i in range(size)), np.uint8)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or _NONE."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        return np.where((self._keys[at] == keys) & (left >= 0) & (right >= 0), self._ranks[at], _NONE)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token counts and flat ids of distinct pieces."""
        raw = [w.encode("utf-8") for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        byte = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(size)
        sym = self.single[byte]
        if self.suffix:
            sym[ends[size > 0] - 1] = self.final[byte[ends[size > 0] - 1]]
        n = len(sym)
        nxt = np.arange(1, n + 1, dtype=np.int32)
        nxt[ends[size > 0] - 1] = -1
        prv = np.arange(-1, n - 1, dtype=np.int32)
        prv[(ends - size)[size > 0]] = -1
        self._merge(sym, nxt, prv)
        alive = sym >= 0
        owner = np.repeat(np.arange(len(words)), size)
        return np.bincount(owner[alive], minlength=len(words)), sym[alive]

    def _merge(self, sym: np.ndarray, nxt: np.ndarray, prv: np.ndarray) -> None:
        at = np.flatnonzero(nxt >= 0).astype(np.int32)
        rank = self.ranks(sym[at], sym[nxt[at]])
        at, rank = at[rank != _NONE], rank[rank != _NONE]
        if not len(at):
            return
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        active, begin = np.unique(rank, return_index=True)
        places = {int(r): [at[b:e]] for r, b, e in zip(active, begin, np.append(begin[1:], len(at)), strict=True)}
        heap = active.tolist()  # ascending, hence a heap
        while heap:
            r = heapq.heappop(heap)
            left, right, made = self.left[r], self.right[r], self.made[r]
            lists = places.pop(r)
            pos = lists[0] if len(lists) == 1 and isinstance(lists[0], np.ndarray) else np.unique(
                np.concatenate([np.atleast_1d(np.asarray(x, np.int32)) for x in _packed(lists)]))
            follow = nxt[pos]
            good = (sym[pos] == left) & (follow >= 0) & (sym[follow] == right)
            pos, follow = pos[good], follow[good]
            if not len(pos):
                continue
            if left == right:
                pos = _alternate(pos, follow)
                follow = nxt[pos]
            after = nxt[follow]
            sym[pos] = made
            sym[follow] = -1
            nxt[pos] = after
            tail = after >= 0
            prv[after[tail]] = pos[tail]
            before = prv[pos]
            fresh = np.concatenate([before[before >= 0], pos[tail]])
            if not len(fresh):
                continue
            rank = self.ranks(sym[fresh], sym[nxt[fresh]])
            found = rank != _NONE
            if not found.any():
                continue
            for k, p in zip(rank[found].tolist(), fresh[found].tolist(), strict=True):
                if k in places:
                    places[k].append(p)
                else:
                    places[k] = [p]
                    heapq.heappush(heap, k)

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes that a sequence of ids stands for."""
        n = self.lengths[ids]
        at = np.repeat(self.at[ids] - (np.cumsum(n) - n), n)
        at += np.arange(len(at))
        return self.bytes[at].tobytes()


def _packed(lists: list) -> list:
    """The arrays of a list and its single places as one more array."""
    return [*(x for x in lists if isinstance(x, np.ndarray)), np.array([x for x in lists if not isinstance(x, np.ndarray)], np.int32)]


def _alternate(pos: np.ndarray, follow: np.ndarray) -> np.ndarray:
    """Of overlapping places, every second one from the left of each run."""
    begins = np.ones(len(pos), bool)
    begins[1:] = pos[1:] != follow[:-1]
    run_at = np.flatnonzero(begins)
    nth = np.arange(len(pos)) - np.repeat(run_at, np.diff(np.append(run_at, len(pos))))
    return pos[nth % 2 == 0]


@functools.cache
def merge_table(path: str) -> MergeTable:
    return MergeTable(path)


@functools.cache
def word_table(path: str) -> P.WordTable:
    table = merge_table(path)
    return P.WordTable(table.encode, table.special)


def _rows(batches: Iterator[pd.DataFrame], key: str, text: str) -> Iterator[tuple]:
    for pdf in batches:
        yield from zip(pdf[key].tolist(), ("" if t is None else t for t in pdf[text].tolist()), strict=True)


def encoded(batches, key: str, text: str, path: str) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Keys and id arrays of slabs of rows."""
    words = word_table(path)
    table = merge_table(path)
    for slab in P.slabs(_rows(batches, key, text)):
        words.renew()
        codes, n = P.pieces(words, [t for _, t in slab], P.byte_level_pieces, table.pattern)
        words.fill()
        ends = np.cumsum(n)
        for b, e in P.chunks([t for _, t in slab]):
            lo = ends[b - 1] if b else 0
            ids = words.flat(codes[lo:ends[e - 1]])
            per = np.add.reduceat(np.append(words.counts[codes[lo:ends[e - 1]]], 0), np.minimum(ends[b:e] - n[b:e] - lo, ends[e - 1] - lo))
            per[n[b:e] == 0] = 0
            yield [k for k, _ in slab[b:e]], np.split(ids, np.cumsum(per)[:-1])


@functools.cache
def _digits(path: str) -> list[str]:
    return [str(i) for i in range(len(merge_table(path).lengths))]


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids) of every row.  A null text is empty and has no ids; equal texts have equal ids; special
    strings of the tokenizer file become their ids; other columns are not read."""
    def run(batches):
        for keys, ids in encoded(batches, "key", "text", path):
            yield pd.DataFrame({"key": pd.Series(keys, dtype=object), "ids": [x.tolist() for x in ids]})

    return rekeyed(keyed(docs, key, text).mapInPandas(run, "key string, ids array<int>"), docs, key)


def decode(encoded_rows: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) from (key, ids); null ids give null, bytes that are no UTF-8 give U+FFFD."""
    def run(batches):
        table = merge_table(path)
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "text": [
                None if x is None else table.decode(np.asarray(x, np.int64)).decode("utf-8", "replace") for x in pdf["ids"]]})

    rows = encoded_rows.select(F.col(key).cast("string").alias("key"), F.col(ids).alias("ids"))
    return rekeyed(rows.mapInPandas(run, "key string, text string"), encoded_rows, key)


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): each text encoded, and its ids decoded again.

    A null or empty text has no tokens and the digests of the empty string.  Rows with equal or null
    keys stay rows of their own.  Texts are handled whole, in slabs of about SLAB_CHARS code points or
    of one longer text.
    """
    def run(batches):
        table, digits = merge_table(path), _digits(path)
        for keys, ids in encoded(batches, "key", "text", path):
            yield pd.DataFrame({
                "key": pd.Series(keys, dtype=object), "n_tokens": [len(x) for x in ids],
                "ids_sha256": [hashlib.sha256(",".join([digits[i] for i in x.tolist()]).encode()).hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(table.decode(x).decode("utf-8", "replace").encode()).hexdigest() for x in ids]})

    return rekeyed(keyed(docs, key, text).mapInPandas(run, "key string, n_tokens long, ids_sha256 string, decoded_sha256 string"), docs, key)
