"""Splitting of many texts at once into the pieces that byte-pair merges never cross.

Texts are laid end to end as one array of code points; piece boundaries are found with array
operations, and equal pieces share one number, so that a tokenizer runs once per distinct piece.
"""

from __future__ import annotations

import ctypes
import functools
import re
import sys
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: Code points of one array pass, and of the texts that are held together.
CHUNK_CHARS, SLAB_CHARS = 1 << 20, 8 << 20
#: Memory that the pieces a Python worker keeps between slabs may take, by estimate, and what one takes beside
#: its characters.
KEPT_BYTES, PIECE_BYTES = 80 << 20, 180
# Unicode White_Space.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


#: Beyond this code point no letters or numbers are assigned.
LAST_ASSIGNED = 0x33480


@functools.cache
def newer_letters() -> tuple[list[int], list[int]]:
    """Letters and numbers that the tokenizers library knows and this Python's Unicode tables do not."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    unknown = "".join(c for c in map(chr, range(0x80, LAST_ASSIGNED)) if unicodedata.category(c) == "Cn")
    found = [Split(Regex(rf"[^\p{{{kind}}}]+"), "removed").pre_tokenize_str(unknown) for kind in "LN"]
    return tuple([ord(c) for run, _ in runs for c in run] for runs in found)


@functools.cache
def char_classes() -> np.ndarray:
    """Class of every code point."""
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    kinds = "".join(unicodedata.category(chr(i))[0] for i in range(LAST_ASSIGNED))
    first = np.frombuffer(kinds.encode("ascii"), np.uint8)
    out[:LAST_ASSIGNED][first == ord("L")] = LETTER
    out[:LAST_ASSIGNED][first == ord("N")] = NUMBER
    for kind, newer in zip((LETTER, NUMBER), newer_letters(), strict=True):
        out[newer] = kind
    out[WHITE] = SPACE
    return out


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def table(base):
        out = np.full(n + 1, base, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    return table(_BASE), table(_BASE_INVERSE)


def laid_out(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """The joined text, its code points and the start of every text, with the end as last entry."""
    joined = "".join(texts)
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)), out=at[1:])
    return joined, np.frombuffer(joined.encode("utf-32-le"), np.uint32), at


def _contractions(cp: np.ndarray, at: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``at`` where an apostrophe opens a contraction, and the contraction's length; last: end of its text."""
    def char(k):
        return np.where(at + k < last, cp[np.minimum(at + k, len(cp) - 1)], 0)

    one, two = char(1), char(2)
    single = np.isin(one, [ord(c) for c in "stmd"])
    double = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | (
        (one == ord("l")) & (two == ord("l")))
    found = single | double
    return at[found], np.where(single[found], 2, 3)


def _edges(cp: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kind = char_classes()[cp]
    fresh = np.zeros(len(cp) + 1, bool)  # first code point of a text
    fresh[bounds] = True
    return kind, fresh


def _open_contractions(cp, kind, fresh, start, bounds):
    at = np.flatnonzero((cp == 39) & start[:-1])
    if not len(at):
        return
    at, n = _contractions(cp, at, bounds[np.searchsorted(bounds, at, side="right")])
    start[at + 1] = False
    follow = (at + n)[at + n < len(cp)]
    keep = ~fresh[follow] & (kind[follow] == LETTER)
    start[follow[keep]] = True


def byte_level_starts(cp: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Starts of the pieces of the pattern with a leading space; ``bounds`` has every text's start and the end.

    A blank goes with the word that follows it, other white space before a word stands alone, a run
    of white space leaves its last character, contractions are cut after an apostrophe.
    """
    kind, fresh = _edges(cp, bounds)
    n = len(cp)
    start = np.zeros(n + 1, bool)
    start[1:n] = kind[1:] != kind[:-1]
    start |= fresh
    white = kind == SPACE
    last_white = white.copy()  # last of its run, with a word behind it in the same text
    last_white[:-1] &= ~white[1:] & ~fresh[1:n]
    last_white[-1:] = False
    joined = np.flatnonzero(last_white & (cp == 32)) + 1
    start[joined] = False
    start[:n] |= last_white
    _open_contractions(cp, kind, fresh, start, bounds)
    return np.flatnonzero(start[:n])


def word_level_pieces(cp: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces of the pattern without white space, where every digit stands alone."""
    kind, fresh = _edges(cp, bounds)
    n = len(cp)
    start = np.zeros(n + 1, bool)
    start[1:n] = kind[1:] != kind[:-1]
    start |= fresh
    start[:n] |= kind == NUMBER
    _open_contractions(cp, kind, fresh, start, bounds)
    at = np.flatnonzero(start[:n])
    ends = np.append(at[1:], n)
    keep = kind[at] != SPACE
    return at[keep], ends[keep]


def white_words(cp: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs without blanks and the controls 9 to 13."""
    white = (cp == 32) | ((cp >= 9) & (cp <= 13))
    n = len(cp)
    start = ~white
    if n:
        fresh = np.zeros(n + 1, bool)
        fresh[bounds] = True
        start[1:] &= white[:-1] | fresh[1:n]
        end = ~white
        end[:-1] &= white[1:] | fresh[1:n]
        return np.flatnonzero(start), np.flatnonzero(end) + 1
    return np.zeros(0, np.int64), np.zeros(0, np.int64)


def numbered(joined: str, cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """Equal pieces get equal numbers: the number of every piece and the distinct pieces in that order.

    Pieces are grouped by a polynomial hash and then compared with the first of their group.
    """
    if not len(starts):
        return np.zeros(0, np.int64), []
    powers, inverse = _powers(max(CHUNK_CHARS, 1 << int(len(cp)).bit_length()))
    sums = np.zeros(len(cp) + 1, np.uint64)
    np.cumsum((cp.astype(np.uint64) + np.uint64(1)) * powers[:len(cp)], out=sums[1:])
    size = ends - starts
    hashed = (sums[ends] - sums[starts]) * inverse[starts] + size.astype(np.uint64)
    del sums
    codes, distinct = pd.factorize(hashed)
    first = np.empty(len(distinct), np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    same = size == size[first][codes]
    if same.all():
        shift = np.repeat(starts[first][codes] - starts, size)
        run = np.arange(len(shift)) + np.repeat(starts - (np.cumsum(size) - size), size)
        same = bool((cp[run] == cp[run + shift]).all())
    if not np.all(same):  # a collision: number the pieces by themselves
        words = [joined[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
        codes, distinct = pd.factorize(np.array(words, object))
        return codes, list(distinct)
    return codes, [joined[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]


@functools.cache
def _allocator():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda pad: 0


def give_back() -> None:
    """Hand freed memory back to the system: a worker lives on through other operators' tasks."""
    _allocator()(0)


class WordTable:
    """Token ids of distinct pieces, kept for the life of a Python worker within ``kept`` bytes.

    ``encode`` gets the new pieces of a slab at once and returns their ids as (counts, flat ids); ``forget``
    empties what its owner keeps for each piece.  Of all tables of a worker only the one in use holds pieces.
    """

    in_use: WordTable | None = None

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], fixed: dict[str, int],
                 forget: Callable[[], None] | None = None, kept: int = KEPT_BYTES):
        self._encode, self._fixed, self._forget, self._kept = encode, fixed, forget, kept
        self._clear()

    def _clear(self) -> None:
        if self._forget is not None:
            self._forget()
        self.size = 0
        self.number: dict[str, int] = {}
        self.counts, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.starts = np.zeros(0, np.int64)
        self.known = 0
        for word in self._fixed:
            self.number[word] = len(self.number)

    def renew(self) -> None:
        """Forget the pieces when there are too many, and those of another table; only between slabs."""
        if WordTable.in_use is not self:
            if WordTable.in_use is not None:
                WordTable.in_use._clear()
            WordTable.in_use = self
        if self.size + self.ids.nbytes > self._kept:
            self._clear()
        give_back()

    def numbers(self, words: list[str]) -> np.ndarray:
        """Numbers of distinct pieces, new ones behind the others."""
        number = self.number
        found = list(map(number.get, words))
        for k, word in enumerate(words):
            if found[k] is None:
                found[k] = number[word] = len(number)
                self.size += PIECE_BYTES + len(word)
        return np.array(found, np.int64)

    def fill(self) -> None:
        """Encode the pieces that came in since the last call."""
        new = list(self.number)[self.known:] if self.known else list(self.number)
        if not new:
            return
        own = [self._fixed[w] for w in new if w in self._fixed] if not self.known else []
        rest = new[len(own):]
        counts, ids = self._encode(rest) if rest else (np.zeros(0, np.int64), np.zeros(0, np.int32))
        self.counts = np.concatenate([self.counts, np.ones(len(own), np.int64), counts])
        self.ids = np.concatenate([self.ids, np.array(own, np.int32), ids])
        self.starts = np.cumsum(self.counts) - self.counts
        self.known = len(self.number)

    def flat(self, words: np.ndarray) -> np.ndarray:
        """Ids of a sequence of pieces, one after the other."""
        n = self.counts[words]
        at = np.repeat(self.starts[words] - (np.cumsum(n) - n), n)
        at += np.arange(len(at))
        return self.ids[at]


def chunks(texts: list[str], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``limit`` code points, or of one longer text."""
    begin = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield begin, i
            begin, size = i, 0
        size += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def slabs(rows: Iterable[tuple], limit: int = SLAB_CHARS) -> Iterator[list[tuple]]:
    """Rows (key, text) in groups whose texts hold about ``limit`` code points."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[1]) + 16
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def pieces(table: WordTable, texts: list[str], find, special: re.Pattern | None = None,
           normal: Callable[[str], str] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Piece numbers of all texts in order and the number of pieces of every text.

    ``find`` gives starts and ends from code points and bounds; strings of ``special`` are pieces of
    their own, and what stands between them is treated as texts of their own.
    """
    codes, per_text = [], []
    for b, e in chunks(texts):
        parts, owner, fixed = [], [], []
        for i in range(b, e):
            text = texts[i]
            if special is not None and "<|" in text:
                for part in special.split(text):
                    if part:
                        own = part in table._fixed
                        fixed.append(own)
                        parts.append(part if own or normal is None else normal(part))
                        owner.append(i - b)
            else:
                fixed.append(False)
                parts.append(text if normal is None else normal(text))
                owner.append(i - b)
        joined, cp, bounds = laid_out(parts)
        starts, ends = find(cp, bounds)
        if any(fixed):
            spans = [(bounds[k], bounds[k + 1]) for k, f in enumerate(fixed) if f]
            inside = np.zeros(len(cp) + 1, bool)
            for s, t in spans:
                inside[s:t] = True
            keep = ~inside[starts]
            starts = np.concatenate([starts[keep], [s for s, _ in spans]]).astype(np.int64)
            ends = np.concatenate([ends[keep], [t for _, t in spans]]).astype(np.int64)
            order = np.argsort(starts)
            starts, ends = starts[order], ends[order]
        own, words = numbered(joined, cp, starts, ends)
        codes.append(table.numbers(words)[own].astype(np.int32) if len(words) else own.astype(np.int32))
        part_of = np.searchsorted(bounds, starts, side="right") - 1
        # parts of no length share a start; the last of them owns nothing, as no piece starts before it
        per_text.append(np.bincount(np.array(owner, np.int64)[part_of], minlength=e - b) if len(starts)
                        else np.zeros(e - b, np.int64))
    return (np.concatenate(codes) if codes else np.zeros(0, np.int32),
            np.concatenate(per_text) if per_text else np.zeros(0, np.int64))


def byte_level_pieces(cp: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = byte_level_starts(cp, bounds)
    return starts, np.append(starts[1:], len(cp))
