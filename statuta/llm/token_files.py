"""Token ids written as entropy-coded files and read back.

A row of the files holds a run of documents in ascending key order.  Its ids are coded with a range
asymmetric numeral system: one static frequency table per row is shared by all its blocks, a block
interleaves LANES coder states in one stream of 32-bit words and stands for itself, and inside a block
checkpoints (states and stream place) let several decoders start at once.  Every block has a CRC-32.
"""

from __future__ import annotations

import itertools
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_folder
from . import pretokens as P

PROB_BITS, LANES, STEPS, CHECK_STEPS = 20, 64, 512, 128
BLOCK = LANES * STEPS
_LOW = np.uint64(1 << 31)
#: Code points of the texts in one row of the files.
ROW_CHARS = 8 << 20
#: Memory of the pieces that a worker keeps: more than elsewhere, since the library is dear and nothing else is kept.
KEPT_BYTES = 140 << 20
FILE_SCHEMA = "part int, slab int, keys binary, lengths binary, n_ids long, symbols binary, freqs binary, blocks array<binary>"


# --- the coder ------------------------------------------------------------------

def frequency_table(counts: np.ndarray) -> np.ndarray:
    """Positive frequencies with the sum 2**PROB_BITS, near in proportion to positive counts."""
    total = 1 << PROB_BITS
    freq = np.maximum(1, np.floor(counts * (total / counts.sum()))).astype(np.int64)
    over = int(freq.sum()) - total
    order = np.argsort(-freq, kind="stable")
    if over < 0:
        freq[order[0]] -= over
    while over > 0:  # taken from the largest, which change least
        for k in order:
            take = min(over, int(freq[k] - 1), max(1, int(freq[k]) >> 6))
            freq[k] -= take
            over -= take
            if not over:
                break
    return freq


def code_blocks(places: np.ndarray, freq: np.ndarray) -> list[tuple[bytes, list[tuple[int, np.ndarray]]]]:
    """Blocks of symbol places (rows of BLOCK): each its words and its checkpoints (word offset, states)."""
    base = np.cumsum(freq) - freq
    n = len(places)
    grid = places.reshape(n, STEPS, LANES)
    x = np.full((n, LANES), _LOW, np.uint64)
    words = np.zeros((STEPS, n, LANES), np.uint32)
    given = np.zeros((STEPS, n, LANES), bool)
    freq64, base64 = freq.astype(np.uint64), base.astype(np.uint64)
    top = freq64 << np.uint64(63 - PROB_BITS)
    saved = {}
    for s in range(STEPS - 1, -1, -1):
        sym = grid[:, s, :]
        f = freq64[sym]
        emit = x >= top[sym]
        given[s] = emit
        words[s] = x.astype(np.uint32)
        x = np.where(emit, x >> np.uint64(32), x)
        q = x // f
        x = (q << np.uint64(PROB_BITS)) + (x - q * f) + base64[sym]
        if s % CHECK_STEPS == 0:
            saved[s] = x.copy()
    out = []
    for b in range(n):
        per_step = given[:, b].sum(axis=1)
        before = np.concatenate([[0], np.cumsum(per_step)])
        out.append((words[:, b][given[:, b]].tobytes(), [(int(before[s]), saved[s][b]) for s in range(0, STEPS, CHECK_STEPS)]))
    return out


def decode_blocks(blocks: list[tuple[np.ndarray, list[tuple[int, np.ndarray]]]], freq: np.ndarray) -> np.ndarray:
    """Symbol places of whole blocks; every checkpoint of every block is a decoder, and all run in step."""
    base = np.cumsum(freq) - freq
    slot_of = np.repeat(np.arange(len(freq), dtype=np.int32), freq)
    stream = np.concatenate([w for w, _ in blocks] + [np.zeros(LANES, np.uint32)])
    begins = np.cumsum([0] + [len(w) for w, _ in blocks])[:-1]
    runs = STEPS // CHECK_STEPS
    at = np.array([begin + offset for begin, (_, points) in zip(begins, blocks, strict=True) for offset, _ in points], np.int64)
    x = np.stack([state for _, points in blocks for _, state in points])
    out = np.empty((len(x), CHECK_STEPS, LANES), np.int32)
    mask = np.uint64((1 << PROB_BITS) - 1)
    freq64, base64 = freq.astype(np.uint64), base.astype(np.uint64)
    for s in range(CHECK_STEPS):
        slot = x & mask
        sym = slot_of[slot.astype(np.int64)]
        out[:, s] = sym
        x = freq64[sym] * (x >> np.uint64(PROB_BITS)) + slot - base64[sym]
        need = x < _LOW
        nth = np.cumsum(need, axis=1)
        word = stream[np.minimum(at[:, None] + nth - 1, len(stream) - 1)].astype(np.uint64)
        x = np.where(need, (x << np.uint64(32)) | word, x)
        at += nth[:, -1]
    return out.reshape(len(blocks), runs * CHECK_STEPS * LANES)


def pack(ids: np.ndarray, blocks_at_once: int = 64) -> tuple[bytes, bytes, list[bytes]]:
    """Symbols, frequencies and coded blocks of a run of ids; a block states its number of ids and CRC-32."""
    if not len(ids):
        return b"", b"", []
    often = np.bincount(ids)
    symbols = np.flatnonzero(often)
    counts = often[symbols]
    place_of = np.zeros(len(often), np.int32)
    place_of[symbols] = np.arange(len(symbols))
    freq = frequency_table(counts)
    fill = -len(ids) % BLOCK
    grid = np.concatenate([place_of[ids], np.full(fill, np.argmax(counts), np.int32)]).reshape(-1, BLOCK)
    blocks = []
    for b in range(0, len(grid), blocks_at_once):
        for k, (words, points) in enumerate(code_blocks(grid[b:b + blocks_at_once], freq), b):
            own = ids[k * BLOCK:(k + 1) * BLOCK].astype("<u4")
            head = struct.pack("<III", len(own), zlib.crc32(own.tobytes()), len(points))
            marks = b"".join(struct.pack("<I", offset) + states.astype("<u8").tobytes() for offset, states in points)
            blocks.append(head + marks + words)
    return symbols.astype("<u4").tobytes(), freq.astype("<u4").tobytes(), blocks


def unpack(symbols: bytes, freqs: bytes, blocks: list[bytes], blocks_at_once: int = 64) -> np.ndarray:
    """The ids of coded blocks; a wrong checksum raises."""
    if not blocks:
        return np.zeros(0, np.uint32)
    symbol, freq = np.frombuffer(symbols, "<u4"), np.frombuffer(freqs, "<u4").astype(np.int64)
    out = []
    for b in range(0, len(blocks), blocks_at_once):
        read, heads = [], []
        for raw in blocks[b:b + blocks_at_once]:
            n, crc, points = struct.unpack_from("<III", raw)
            step = 4 + 8 * LANES
            marks = [(struct.unpack_from("<I", raw, 12 + k * step)[0], np.frombuffer(raw, "<u8", LANES, 16 + k * step)) for k in range(points)]
            read.append((np.frombuffer(raw, "<u4", offset=12 + points * step), marks))
            heads.append((n, crc))
        for (n, crc), row in zip(heads, decode_blocks(read, freq), strict=True):
            ids = symbol[row[:n]]
            if zlib.crc32(ids.tobytes()) != crc:
                raise ValueError("a block of token ids does not match its checksum")
            out.append(ids)
    return np.concatenate(out)


# --- the library's ids ------------------------------------------------------------

_TABLES: dict[str, tuple] = {}


def _library(path: str) -> tuple:
    """Word table over the tokenizers library, once per Python worker."""
    if path not in _TABLES:
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        special = {t.content: i for i, t in tok.get_added_tokens_decoder().items()}

        def encode(words):
            rows = [e.ids for k in range(0, len(words), 20_000) for e in tok.encode_batch_fast(words[k:k + 20_000], add_special_tokens=False)]
            counts = np.fromiter(map(len, rows), np.int64, len(rows))
            return counts, np.fromiter(itertools.chain.from_iterable(rows), np.int32, int(counts.sum()))

        _TABLES[path] = (P.WordTable(encode, special, kept=KEPT_BYTES), re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None)
    return _TABLES[path]


def _slab_ids(texts: list[str], path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after the other, each closed by end_id, and the number of ids of each text."""
    table, special = _library(path)
    table.renew()
    codes, n = P.pieces(table, texts, P.byte_level_pieces, special)
    table.fill()
    per_piece = np.concatenate([[0], np.cumsum(table.counts[codes])])
    ends = np.cumsum(n)
    per = per_piece[ends] - per_piece[ends - n]
    out = np.full(int(per.sum()) + len(per), end_id, np.int32)
    keep = np.ones(len(out), bool)
    keep[np.cumsum(per + 1) - 1] = False
    out[keep] = table.flat(codes)
    return out, per + 1


# --- files ------------------------------------------------------------------------

def write_files(docs: DataFrame, folder: str, path: str, end_id: int, key: str = "doc_id", text: str = "text") -> None:
    """Encode all texts in ascending key order (null first, equal keys by text hash) and write the coded rows.

    The order is dealt by ranges: files ascend by ``part``, rows in a file by ``slab``.  Null texts are
    empty and hold the end id only; keys must be integers.
    """
    def run(batches: Iterator[pa.RecordBatch]):
        part = TaskContext.get().partitionId()
        rows = ((k, t or "") for b in batches for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        for slab, held in enumerate(P.slabs(rows, ROW_CHARS)):
            ids, lengths = _slab_ids([t for _, t in held], path, end_id)
            keys = pa.array([k for k, _ in held], pa.int64())
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pa.schema([("key", pa.int64())])) as out:
                out.write_batch(pa.record_batch([keys], names=["key"]))
            symbols, freqs, blocks = pack(ids)
            yield pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([slab], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary()),
                pa.array([lengths.astype("<i8").tobytes()], pa.binary()), pa.array([len(ids)], pa.int64()),
                pa.array([symbols], pa.binary()), pa.array([freqs], pa.binary()), pa.array([blocks], pa.list_(pa.binary()))],
                names=["part", "slab", "keys", "lengths", "n_ids", "symbols", "freqs", "blocks"])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    ordered = rows.repartitionByRange("key").sortWithinPartitions("key", F.xxhash64("text"))
    ordered.mapInArrow(run, FILE_SCHEMA).write.option("compression", "none").parquet(folder)


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """(part, slab, before, key, n_ids, ids binary): the documents of all files; ids are little-endian
    unsigned 32-bit integers, before counts the ids ahead of the document in its row of the file."""
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(row["symbols"], row["freqs"], row["blocks"]).astype("<u4")
                keys = pa.ipc.open_stream(row["keys"]).read_all().column(0).combine_chunks()
                lengths = np.frombuffer(row["lengths"], "<i8")
                before = np.cumsum(lengths) - lengths
                for b in range(0, len(lengths), 500):
                    own = slice(b, b + 500)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(lengths[own]), row["part"], np.int32)), pa.array(np.full(len(lengths[own]), row["slab"], np.int32)),
                        pa.array(before[own]), keys[b:b + 500].cast(pa.int64()), pa.array(lengths[own]),
                        pa.array([ids[s:s + n].tobytes() for s, n in zip(before[own].tolist(), lengths[own].tolist(), strict=True)], pa.binary())],
                        names=["part", "slab", "before", "key", "n_ids", "ids"])

    return spark.read.schema(FILE_SCHEMA).parquet(folder).mapInArrow(
        run, "part int, slab int, before long, key long, n_ids long, ids binary")


def row_offsets(spark: SparkSession, folder: str) -> DataFrame:
    """(part, slab, offset): ids in all rows of the files before each row, by sums of parts and then inside a part."""
    sizes = spark.read.schema(FILE_SCHEMA).parquet(folder).select("part", "slab", "n_ids")
    # one row per file: as many as the range exchange has partitions
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn(
        "ahead", F.sum("n").over(Window.orderBy("part")) - F.col("n")).select("part", "ahead")
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("slab")) - F.col("n_ids")
    return sizes.withColumn("inside", inside).join(parts, "part").select("part", "slab", (F.col("inside") + F.col("ahead")).alias("offset"))


def written_and_read(docs: DataFrame, path: str, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every row, from files written to the shared folder and read back.

    start counts the ids of all documents before it in key order.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    write_files(docs, folder, path, end_id, key, text)
    read = read_files(spark, folder).select("part", "slab", "before", "key", "n_ids", F.crc32("ids").alias("ids_crc32"))
    return read.join(row_offsets(spark, folder), ["part", "slab"]).select(
        F.col("key").alias(key), (F.col("before") + F.col("offset")).alias("start"), F.col("n_ids").alias("n_tokens"), "ids_crc32")
