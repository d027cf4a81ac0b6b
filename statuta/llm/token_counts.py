"""Token counts by dynamic programming over prefixes.

For every prefix of a piece the table keeps the exact number of tokens, so that the count of any
prefix of a text is a sum over its pieces, and truncation needs no second encoding.  The last token
of a prefix is the one token ending there that the token before it would not have absorbed.
"""

from __future__ import annotations

import functools
import itertools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import pretokens as P
from .bpe import MergeTable
from .columns import keyed, rekeyed

#: Checked pairs of neighbours a Python worker keeps.
KEPT_PAIRS = 400_000
_WHITE = re.compile("[" + "".join(map(chr, P.WHITE)) + "]+")


@functools.cache
def _newer() -> re.Pattern:
    """One of the newer letters; ranges, since a class of single characters beyond U+FFFF is tried one by one."""
    runs: list[list[int]] = []
    for c in sorted(itertools.chain(*P.newer_letters())):
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in runs) + "]" if runs else r"(?!)")


@functools.cache
def _library_steps():
    from tokenizers import Regex, normalizers

    return normalizers.Sequence([normalizers.NFC(), normalizers.Replace(Regex(r"\s+"), " "), normalizers.Lowercase()])


def normal(text: str) -> str:
    """Composed form, white space as blanks, lower case without context.

    Texts with letters newer than this Python's Unicode tables are left to the library's own steps.
    """
    if not text.isascii() and _newer().search(text):
        return _library_steps().normalize_str(text)
    text = text if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return _WHITE.sub(" ", text).lower()


class PrefixCounter:
    """Exact counts of all prefixes of pieces under a merge table with word ends."""

    def __init__(self, path: str):
        self.table = MergeTable(path)
        t = self.table
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        size = len(t.lengths)
        # a token's two halves, and the rank of its merge; single bytes have rank -1 and no halves
        self.halves: list = [None] * size
        self.rank = [-1] * size
        made = {int(m): r for r, m in reversed(list(enumerate(t.made.tolist())))}
        for m, r in made.items():
            self.halves[m], self.rank[m] = (int(t.left[r]), int(t.right[r])), r
        self.merge = {(int(a), int(b)): r for r, (a, b) in enumerate(zip(t.left.tolist(), t.right.tolist(), strict=True))}
        for b in range(256):
            self.inner[bytes([b])], self.final[bytes([b])] = int(t.single[b]), int(t.final[b])
        ends = {int(i) for i in t.final}
        spelled = {int(t.single[b]): bytes([b]) for b in range(256)} | {int(t.final[b]): bytes([b]) for b in range(256)}
        for a, b, m in zip(t.left.tolist(), t.right.tolist(), t.made.tolist(), strict=True):
            spelled[m] = spelled[a] + spelled[b]
            if b in ends:
                ends.add(m)
            if self._stands(m):
                (self.final if m in ends else self.inner)[spelled[m]] = m
        #: spelling -> the token inside a piece and the token at its end, -1 where there is none
        self.ends = {raw: (self.inner.get(raw, -1), self.final.get(raw, -1)) for raw in {*self.inner, *self.final}}
        self.longest = max(map(len, self.ends))
        self._pairs: dict[int, bool] = {}

    def _stands(self, token: int) -> bool:
        """Whether the merges of a token's own spelling lead to the token."""
        left, right = self.halves[token]
        return self._separate(left, right, self.rank[token])

    def _separate(self, a: int, b: int, limit: int) -> bool:
        """Whether two tokens side by side keep their border until merges of rank ``limit``."""
        halves, rank, merge = self.halves, self.rank, self.merge
        while True:
            if (r := merge.get((a, b))) is not None and r < limit:
                return False
            # undo the later of the two merges: before it, the border had other neighbours
            if rank[a] > rank[b]:
                limit = rank[a]
                a = halves[a][1]
            elif rank[b] >= 0:
                # of equal ranks the place further left merges first, so that of this rank across the border counts
                limit = rank[b] + 1
                b = halves[b][0]
            else:
                return True

    def joins(self, a: int, b: int) -> bool:
        key = (a << 20) | b
        if len(self._pairs) > KEPT_PAIRS:
            self._pairs.clear()
        known = self._pairs[key] = self._separate(a, b, 1 << 30)
        return known

    def prefixes(self, raw: bytes) -> list[int]:
        """Number of tokens of raw[:1], raw[:2], ... each as a whole piece."""
        ends, pairs, joins, longest = self.ends, self._pairs, self.joins, self.longest
        n = len(raw)
        last, count, whole = [0] * (n + 1), [0] * (n + 1), []
        for i in range(1, n + 1):
            open_left = shut_left = True
            for j in range(i - 1, i - longest - 1 if i > longest else -1, -1):
                both = ends.get(raw[j:i])
                if both is None:
                    continue
                t, f = both
                before = last[j]
                if open_left and t >= 0:
                    good = True if not j else pairs.get((before << 20) | t)
                    if good is None:
                        good = joins(before, t)
                    if good:
                        last[i], count[i], open_left = t, count[j] + 1, False
                if shut_left and f >= 0:
                    good = True if not j else pairs.get((before << 20) | f)
                    if good is None:
                        good = joins(before, f)
                    if good:
                        whole.append(count[j] + 1)
                        shut_left = False
                if not (open_left or shut_left):
                    break
        return whole

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For a word table: per piece, the counts of its prefixes that end at a code point."""
        sizes, flat = [], []
        for word in words:
            raw = word.encode("utf-8")
            counts = self.prefixes(raw)
            if len(raw) != len(word):
                counts = [c for i, c in enumerate(counts) if i + 1 == len(raw) or raw[i + 1] & 0xC0 != 0x80]
            sizes.append(len(counts))
            flat += counts
        return np.array(sizes, np.int64), np.array(flat, np.int32)


@functools.cache
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


@functools.cache
def word_table(path: str) -> P.WordTable:
    own = counter(path)
    return P.WordTable(own.encode, dict.fromkeys(own.table.special, 1))


def _slabs(batches: Iterator[pd.DataFrame], path: str):
    """Rows, piece numbers, pieces per text and the table of prefix counts, slab by slab."""
    table = word_table(path)
    rows = ((k, "" if t is None else t) for pdf in batches for k, t in zip(pdf["key"].tolist(), pdf["text"].tolist(), strict=True))
    for slab in P.slabs(rows):
        table.renew()
        codes, n = P.pieces(table, [t for _, t in slab], P.word_level_pieces, counter(path).table.pattern, normal)
        table.fill()
        yield slab, codes, n, table


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every row, by whole texts.

    A null or empty text has 0 bytes and 0 tokens; special strings count one token each; rows with
    equal or null keys stay rows of their own; other columns are not read.
    """
    def run(batches):
        for slab, codes, n, table in _slabs(batches, path):
            last = table.ids[np.maximum(table.starts + table.counts - 1, 0)]  # count of the whole piece
            sums = np.concatenate([[0], np.cumsum(last[codes], dtype=np.int64)])
            ends = np.cumsum(n)
            total = sums[ends] - sums[ends - n]
            yield pd.DataFrame({"key": pd.Series([k for k, _ in slab], dtype=object), "n_bytes": [len(t.encode()) for _, t in slab],
                                "n_tokens": total, "over_limit": total > limit})

    return rekeyed(keyed(docs, key, text).mapInPandas(run, "key string, n_bytes long, n_tokens long, over_limit boolean"), docs, key)


def fit(docs: DataFrame, path: str, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, kept_tokens, kept_pieces, kept_chars): the longest prefix of pieces and of a last
    piece's code points with at most ``limit`` tokens.  kept_chars counts inside the piece that is cut.

    A null or empty text keeps nothing; a limit of 0 keeps nothing.
    """
    def run(batches):
        for slab, codes, n, table in _slabs(batches, path):
            last = table.ids[np.maximum(table.starts + table.counts - 1, 0)]
            out, begin = [], 0
            for (k, _), size in zip(slab, n.tolist(), strict=True):
                own = codes[begin:begin + size]
                begin += size
                sums = np.cumsum(last[own], dtype=np.int64)
                whole = int(np.searchsorted(sums, limit, side="right"))
                kept, chars = (int(sums[whole - 1]) if whole else 0), 0
                if whole < size:
                    w = own[whole]
                    inside = table.ids[table.starts[w]:table.starts[w] + table.counts[w]]
                    fits = np.flatnonzero(kept + inside <= limit)
                    if len(fits):
                        chars, kept = int(fits[-1]) + 1, kept + int(inside[fits[-1]])
                out.append((k, int(sums[-1]) if size else 0, kept, whole, chars))
            yield pd.DataFrame(out, columns=["key", "n_tokens", "kept_tokens", "kept_pieces", "kept_chars"])

    return rekeyed(keyed(docs, key, text).mapInPandas(
        run, "key string, n_tokens long, kept_tokens long, kept_pieces long, kept_chars long"), docs, key)
