"""Quality verdicts from how public vocabularies split a text.

Measures: characters per token, share of byte-fallback tokens and entropy of the tokens, each by two
vocabularies; and the share of tokens that stand for symbols.  A byte-level vocabulary has no fallback of
its own: there, tokens that are no whole characters count.  The bands of the measures come from their
distributions over all documents that pass the base rule, per script, language and length; where a
group is too small, per script and length within fixed ones.  Texts outside their band are rejected.
Words are encoded one by one, as the vocabularies do not merge across blanks.
"""

from __future__ import annotations

import functools
import itertools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from . import pretokens as P
from .columns import numbered, rekeyed


@dataclass(frozen=True)
class Band:
    """What a text of one script may measure; entropy (bits) and chars_steady count from ``steady`` tokens on."""

    chars_low: float
    chars_high: float
    byte_share: float
    chars_steady: float = 0.0
    part_share: float = 1.0
    symbol_share: float = 0.05
    entropy_low: float = 3.0
    steady: int = 64


#: First code points of blocks, in ascending order, and their script.
SCRIPT_BLOCKS = [(0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "other"), (0x0590, "semitic"), (0x0780, "other"),
                 (0x0900, "indic"), (0x0E00, "thai_lao"), (0x0F00, "other"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"),
                 (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "cjk"), (0xA000, "other"),
                 (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "cjk"), (0xFB00, "other"),
                 (0x20000, "cjk"), (0x32000, "other")]
BANDS = {
    "latin": Band(1.2, 8.0, 0.10, 1.6, 0.35), "greek": Band(0.6, 6.0, 0.60), "cyrillic": Band(0.8, 7.0, 0.40), "semitic": Band(0.5, 5.0, 0.70),
    "indic": Band(0.3, 5.0, 0.95), "thai_lao": Band(0.3, 5.0, 0.95), "hangul": Band(0.3, 4.0, 0.95), "cjk": Band(0.3, 4.0, 0.90),
    "other": Band(0.2, 8.0, 0.98),
}
# The symbols that the base measure counts, and the longest repeat share in percent.
#: Learned measures: width of a histogram bin, and the least spread of a text of one token (it shrinks with the root of the length).
LEARNED = {"chars_per_token": (0.005, 1.0), "byte_chars_per_token": (0.005, 1.0), "token_entropy": (0.01, 2.0), "byte_token_entropy": (0.01, 2.0),
           "byte_share": (0.001, 0.5), "part_share": (0.001, 0.5)}
#: Documents a group needs for bands of its own; a band ends so many quartile distances beyond the quartiles.
LEAST_DOCS, FENCE = 100, 3.0
#: Stands for all languages of a script.
ANY = "\u0000"
SYMBOLS = "#*$%&|<>"
WINDOW, LEAST_WORDS, REPEAT_PERCENT = 5, 10, 20
_BLANKS = " \t\n\x0b\x0c\r"


@functools.cache
def _scripts() -> tuple[list[str], np.ndarray]:
    names = list(BANDS)
    return names, np.array([names.index(s) for _, s in SCRIPT_BLOCKS], np.int8)


class Vocabulary:
    """Per distinct word: its ids, and its code points, symbols, byte tokens, symbol tokens, letters' script.

    The same by a byte-level vocabulary, with a blank before the word: ids, and tokens that are no whole characters.
    """

    def __init__(self, path: str, byte_path: str):
        import sentencepiece
        import tiktoken

        merges = bpe.MergeTable(byte_path)
        data = merges.bytes.tobytes()
        spelled_bytes = [data[b:b + k] for b, k in zip(merges.at.tolist(), merges.lengths.tolist(), strict=True)]
        # ranks are ids: the single bytes first, then the merges in their order
        ranks = {x: i for i, x in enumerate(spelled_bytes) if x and i not in merges.special.values()}
        self.byte_level = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.is_part = np.array([not _whole(x) for x in spelled_bytes])
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        spelled = [self.model.id_to_piece(i) for i in range(n)]
        self.is_byte = np.array([self.model.is_byte(i) for i in range(n)])
        self.is_symbol = np.array([not self.model.is_byte(i) and bool(p := s.replace("▁", "")) and all(
            unicodedata.category(c)[0] == "S" or c in SYMBOLS for c in p) for i, s in enumerate(spelled)])
        self.table = P.WordTable(self.encode, {}, self._forget)
        self.begins = np.array([b for b, _ in SCRIPT_BLOCKS])

    def _forget(self) -> None:
        self.facts = np.zeros((0, 5), np.int32)
        self.byte_counts, self.byte_ids, self.parts = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self.model.encode(words, num_threads=1)
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(counts.sum()))
        ends = np.concatenate([[0], np.cumsum(counts)])
        spread = lambda flags: (s := np.concatenate([[0], np.cumsum(flags)]))[ends[1:]] - s[ends[:-1]]
        _, cp, at = P.laid_out(words)
        per = lambda flags: (s := np.concatenate([[0], np.cumsum(flags)]))[at[1:]] - s[at[:-1]]
        letters = P.char_classes()[cp] == P.LETTER
        script = _scripts()[1][np.searchsorted(self.begins, cp, side="right") - 1]
        # a word has the script of its first letter, or none
        first = np.full(len(words), -1, np.int64)
        where = np.flatnonzero(letters)
        owner = np.searchsorted(at, where, side="right") - 1
        first[owner[::-1]] = script[where[::-1]]
        facts = np.stack([np.diff(at), per(np.isin(cp, [ord(c) for c in SYMBOLS])), spread(self.is_byte[flat]), spread(self.is_symbol[flat]), first], axis=1)
        self.facts = np.concatenate([self.facts, facts.astype(np.int32)])
        self._encode_bytes(words)
        return counts, flat

    def _encode_bytes(self, words: list[str]) -> None:
        encode = self.byte_level.encode_ordinary
        ids = [encode(f" {w}") for w in words]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(counts.sum()))
        ends = np.concatenate([[0], np.cumsum(counts)])
        running = np.concatenate([[0], np.cumsum(self.is_part[flat])])
        parts = running[ends[1:]] - running[ends[:-1]]
        new = (counts.astype(np.int32), flat, parts.astype(np.int32))
        self.byte_counts, self.byte_ids, self.parts = (np.concatenate(x) for x in zip((self.byte_counts, self.byte_ids, self.parts), new, strict=True))
        self.byte_starts = np.cumsum(self.byte_counts, dtype=np.int64) - self.byte_counts

    def flat_bytes(self, words: np.ndarray) -> np.ndarray:
        """Ids of the byte-level vocabulary of a sequence of pieces."""
        n = self.byte_counts[words]
        at = np.repeat(self.byte_starts[words] - (np.cumsum(n) - n), n)
        return self.byte_ids[at + np.arange(len(at))]


def _whole(token: bytes) -> bool:
    try:
        token.decode()
    except UnicodeDecodeError:
        return False
    return True


@functools.cache
def vocabulary(path: str, byte_path: str) -> Vocabulary:
    return Vocabulary(path, byte_path)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def repeated_words(codes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Per text, the words inside windows of WINDOW words that occur twice or more in that text."""
    out = np.zeros(len(n), np.int64)
    size = len(codes)
    if size < WINDOW:
        return out
    owner = np.repeat(np.arange(len(n)), n)
    at = np.flatnonzero(owner[:size - WINDOW + 1] == owner[WINDOW - 1:])
    hashed = _mixed(owner[at].astype(np.uint64) + np.uint64(1))
    for k in range(WINDOW):
        hashed = _mixed(hashed * np.uint64(3) + codes[at + k].astype(np.uint64) + np.uint64(k + 1))
    group, distinct = pd.factorize(hashed)
    often = np.bincount(group, minlength=len(distinct))[group] > 1
    cover = np.zeros(size + 1, np.int64)
    np.add.at(cover, at[often], 1)
    np.add.at(cover, at[often] + WINDOW, -1)
    inside = np.cumsum(cover[:size]) > 0
    return np.bincount(owner[inside], minlength=len(n))


def _entropy(ids: np.ndarray, per: np.ndarray) -> np.ndarray:
    """Entropy in bits of the tokens of each text."""
    owner = np.repeat(np.arange(len(per)), per)
    key, count = np.unique(owner * (1 << 20) + ids, return_counts=True)
    total = np.maximum(per, 1)[key >> 20]
    share = count / total
    return np.bincount(key >> 20, weights=-share * np.log2(share), minlength=len(per))


def _repeated_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(_BLANKS)]
    return len(lines) - len(set(lines))


def _length(tokens: np.ndarray) -> np.ndarray:
    """Length class of a text: the power of two below its number of tokens."""
    return np.frexp(np.maximum(tokens, 1))[1].astype(np.int64) - 1


def measured(texts: list[str], path: str, byte_path: str) -> pd.DataFrame:
    """All measures of whole texts."""
    vocab = vocabulary(path, byte_path)
    table = vocab.table
    table.renew()
    codes, n = P.pieces(table, texts, P.white_words)
    table.fill()
    names, out, done = list(BANDS), [], 0
    for b, e in P.chunks(texts, P.CHUNK_CHARS):
        size = n[b:e]
        own = codes[done:done + int(size.sum())].astype(np.int64)
        done += len(own)
        owner = np.repeat(np.arange(e - b), size)
        total = lambda v: np.bincount(owner, weights=v, minlength=e - b).astype(np.int64)  # noqa: E731, B023
        some = len(own) > 0
        facts = vocab.facts[own] if some else np.zeros((0, 5), np.int64)
        tokens, byte_tokens = total(table.counts[own]), total(vocab.byte_counts[own] if some else own)
        chars = total(facts[:, 0])
        by_script = np.stack([total(facts[:, 0] * (facts[:, 4] == s)) for s in range(len(names))], axis=1)
        script = np.where(by_script.sum(axis=1) > 0, by_script.argmax(axis=1), names.index("other"))
        frame = pd.DataFrame({
            "n_words": size, "word_chars": chars, "n_symbols": total(facts[:, 1]), "n_dup_lines": [_repeated_lines(t) for t in texts[b:e]],
            "n_repeat_words": repeated_words(own, size), "script": [names[s] for s in script], "n_tokens": tokens,
            "chars_per_token": chars / np.maximum(tokens, 1), "byte_share": total(facts[:, 2]) / np.maximum(tokens, 1),
            "symbol_share": total(facts[:, 3]) / np.maximum(tokens, 1), "token_entropy": _entropy(table.flat(own), tokens),
            "byte_chars_per_token": chars / np.maximum(byte_tokens, 1),
            "part_share": total(vocab.parts[own] if some else own) / np.maximum(byte_tokens, 1),
            "byte_token_entropy": _entropy(vocab.flat_bytes(own) if some else own, byte_tokens)})
        frame["base_failed"] = (frame.n_words < LEAST_WORDS) | (100 * frame.n_repeat_words > REPEAT_PERCENT * frame.n_words)
        out.append(frame)
    return pd.concat(out, ignore_index=True)


def measures(texts: list[str], path: str, bands: dict[str, Band], learned: dict | None = None, langs: list[str] | None = None,
             byte_path: str | None = None) -> pd.DataFrame:
    """All measures and the verdict of whole texts; ``learned`` has the limits of ``limits_of``."""
    frame = measured(texts, path, byte_path or _byte_path())
    limit = {f: np.array([getattr(bands[s], f) for s in frame.script]) for f in Band.__dataclass_fields__}
    steady = (frame.n_tokens >= limit["steady"]).to_numpy()
    none = np.full(len(frame), np.inf)
    fixed = {"chars_per_token": (np.where(steady, limit["chars_steady"], limit["chars_low"]), limit["chars_high"]), "byte_share": (-none, limit["byte_share"]),
             "part_share": (-none, limit["part_share"]), "token_entropy": (np.where(steady, limit["entropy_low"], -np.inf), none)}
    bounds = {m: np.stack(fixed.get(m, (-none, none)), axis=1).astype(float) for m in LEARNED}
    groups = frame.groupby(["script", pd.Series(langs if langs is not None else [ANY] * len(frame), dtype=object), _length(frame.n_tokens.to_numpy())], sort=False)
    for (script, lang, length), at in groups.indices.items():
        own, all_languages = ((learned or {}).get((script, x, length)) for x in (lang, ANY))
        for m, (low, high) in (own or {}).items():
            bounds[m][at] = low, high
        for m, (low, high) in (all_languages or {}).items() if not own or lang == ANY else ():
            # languages together spread wide: the fixed band holds as well
            bounds[m][at] = np.stack([np.maximum(low, fixed.get(m, (-none, none))[0][at]), np.minimum(high, fixed.get(m, (-none, none))[1][at])], axis=1)
    fits = {m: frame[m].between(x[:, 0], x[:, 1]) for m, x in bounds.items()} | {"symbol_share": frame.symbol_share <= limit["symbol_share"]}
    frame["outside"] = [",".join(m for m, ok in zip(fits, row) if not ok) for row in zip(*fits.values(), strict=True)]
    frame["kept"] = ~frame.base_failed & (frame.outside == "")
    return frame


MEASURES = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
            "script string, n_tokens long, chars_per_token double, byte_share double, symbol_share double, token_entropy double, "
            "byte_chars_per_token double, part_share double, byte_token_entropy double, outside string")


def _byte_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def _slabs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames whose texts together hold about SLAB_CHARS code points."""
    for pdf in batches:
        texts = ["" if t is None else t for t in pdf["text"].tolist()]
        for b, e in P.chunks(texts, P.SLAB_CHARS):
            yield pdf.iloc[b:e].reset_index(drop=True)


def _read(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, lang) as strings; without a column ``lang`` all are of one language."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(ANY)) if "lang" in docs.columns else F.lit(ANY)
    return docs.select(F.col(key).cast("string").alias("key"), F.col(text).cast("string").alias("text"), lang.alias("lang"))


def limits_of(docs: DataFrame, path: str, text: str = "text", byte_path: str | None = None) -> dict:
    """(script, language, length class) -> measure -> (low, high), from all documents that pass the base rule.

    Workers count values in bins; quartiles are read from the sums of the bins.  Only the edges of groups
    of LEAST_DOCS documents come to the driver.
    """
    byte_path = byte_path or _byte_path()

    def run(batches):
        for pdf in _slabs(batches):
            frame = measured(["" if t is None else t for t in pdf["text"].tolist()], path, byte_path)
            frame = frame.assign(lang=pdf["lang"], length=_length(frame.n_tokens.to_numpy()))[~frame.base_failed]
            long = pd.concat([frame[["script", "lang", "length"]].assign(measure=m, bin=np.floor(frame[m] / step).astype("int64"))
                              for m, (step, _) in LEARNED.items()], ignore_index=True)
            long = pd.concat([long, long[long.lang != ANY].assign(lang=ANY)], ignore_index=True)
            yield long.groupby(["script", "lang", "length", "measure", "bin"], as_index=False).size().rename(columns={"size": "n"})

    bins = _read(docs, text, text).mapInPandas(run, "script string, lang string, length int, measure string, bin long, n long").groupBy(
        "script", "lang", "length", "measure", "bin").agg(F.sum("n").alias("n"))
    group = ["script", "lang", "length", "measure"]
    after = bins.withColumn("upto", F.sum("n").over(Window.partitionBy(*group).orderBy("bin"))).withColumn("all", F.sum("n").over(Window.partitionBy(*group)))
    edges = after.filter(F.col("all") >= LEAST_DOCS).groupBy(*group).agg(
        F.min(F.when(F.col("upto") * 4 >= F.col("all"), F.col("bin"))).alias("q1"), F.min(F.when(F.col("upto") * 4 >= F.col("all") * 3, F.col("bin"))).alias("q3"))
    out: dict = {}
    for r in edges.collect():
        step, spread = LEARNED[r.measure]
        reach = FENCE * max((r.q3 - r.q1) * step, spread / 2 ** (r.length / 2))
        low = r.q1 * step - reach if "share" not in r.measure else -np.inf
        high = (r.q3 + 1) * step + reach if "entropy" not in r.measure else np.inf
        out.setdefault((r.script, r.lang, r.length), {})[r.measure] = (low, high)
    return out


def measure(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", bands: dict[str, Band] | None = None,
            byte_path: str | None = None) -> DataFrame:
    """(key, measures, base_failed, kept, outside) of every row; ``outside`` names the measures out of their bands.

    A null or empty text has no words and fails the base rule.  Rows with equal or null keys stay rows
    of their own; of other columns only ``lang`` is read, so their names cannot clash.
    """
    fixed, byte_path = {**BANDS, **(bands or {})}, byte_path or _byte_path()
    learned = limits_of(docs, path, text, byte_path)

    def run(batches):
        for pdf in _slabs(batches):
            frame = measures(["" if t is None else t for t in pdf["text"].tolist()], path, fixed, learned, pdf["lang"].tolist(), byte_path)
            frame.insert(0, "key", pdf["key"])
            yield frame

    return rekeyed(_read(docs, key, text).mapInPandas(run, f"key string, {MEASURES}"), docs, key)


def keep(docs: DataFrame, path: str, text: str = "text", bands: dict[str, Band] | None = None, byte_path: str | None = None) -> DataFrame:
    """The rows of ``docs``, with their columns, whose text passes; a null text does not."""
    fixed, byte_path = {**BANDS, **(bands or {})}, byte_path or _byte_path()
    learned = limits_of(docs, path, text, byte_path)

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            langs = [ANY if x is None else str(x) for x in batch.column(lang).to_pylist()] if lang is not None else [ANY] * len(texts)
            for b, e in P.chunks(texts, P.SLAB_CHARS):
                kept = measures(texts[b:e], path, fixed, learned, langs[b:e], byte_path).kept.to_numpy()
                yield batch.slice(b, e - b).filter(pa.array(kept))

    inner, _ = numbered(docs)
    at, lang = docs.columns.index(text), docs.columns.index("lang") if "lang" in docs.columns else None
    return inner.mapInArrow(run, inner.schema).toDF(*docs.columns)
