"""Encoding, counting and files of token ids against the tokenizers library."""

import hashlib
import os
import zlib

import numpy as np
import pytest
from tests.llm.conftest import by_key
from tokenizers import Tokenizer

from statuta.llm import bpe, token_counts, token_files

os.environ["TOKENIZERS_PARALLELISM"] = "false"


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))


def test_round_trip_is_the_librarys(odd, odd_rows, documents, paths):
    tok = Tokenizer.from_file(paths["byte_bpe_50k.json"])
    for frame, rows in ((odd, odd_rows), (documents, [tuple(r) for r in documents.collect()])):
        want = []
        for key, text, *_ in rows:
            ids = tok.encode(text or "", add_special_tokens=False).ids
            back = tok.decode(ids, skip_special_tokens=False)
            want.append((key, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
        got = [tuple(r) for r in bpe.round_trip(frame, paths["byte_bpe_50k.json"]).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_ids_and_texts_of_the_general_interface(odd, odd_rows, paths):
    back = bpe.decode(bpe.encode(odd, paths["byte_bpe_50k.json"]), paths["byte_bpe_50k.json"])
    assert sorted(repr((r.doc_id, r.text)) for r in back.collect()) == sorted(repr((k, t or "")) for k, t, *_ in odd_rows)


def test_overlapping_pairs_merge_from_the_left(paths):
    tok, table = Tokenizer.from_file(paths["byte_bpe_50k.json"]), bpe.MergeTable(paths["byte_bpe_50k.json"])
    for text in ("aaaaaaaaaaa", "......", "lllll", "eeee", "0000000"):
        assert table.encode([text])[1].tolist() == tok.encode(text, add_special_tokens=False).ids


def test_counts_of_texts_and_of_every_prefix(odd, odd_rows, documents, paths):
    tok = Tokenizer.from_file(paths["word_bpe_49k.json"])
    for frame, rows in ((odd, odd_rows), (documents, [tuple(r) for r in documents.collect()])):
        want = []
        for key, text, *_ in rows:
            n = len(tok.encode(text or "", add_special_tokens=False).ids)
            want.append((key, len((text or "").encode()), n, n > 100))
        got = [tuple(r) for r in token_counts.count_tokens(frame, paths["word_bpe_49k.json"], limit=100).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, want))
    counter = token_counts.counter(paths["word_bpe_49k.json"])
    for word in ("internationalisation", "qzxjkvw", "straße", "thethethe"):
        sizes, counts = counter.encode([word])
        assert counts.tolist() == [len(tok.encode(word[:i + 1], add_special_tokens=False).ids) for i in range(len(word))]
        assert sizes.tolist() == [len(word)]


def test_fitting_to_a_limit(spark, paths):
    frame = spark.createDataFrame([(1, "internationalisation of qzxjkvw words"), (2, None)], "doc_id long, text string")
    one, none = by_key(token_counts.fit(frame, paths["word_bpe_49k.json"], 4))
    assert one["kept_tokens"] <= 4 < one["n_tokens"]
    assert (none["n_tokens"], none["kept_tokens"], none["kept_pieces"]) == (0, 0, 0)


def test_files_give_back_every_id(odd, odd_rows, documents, paths):
    tok = Tokenizer.from_file(paths["byte_bpe_50k.json"])
    rows = [tuple(r) for r in documents.collect()]
    start, want = 0, []
    for key, text, *_ in sorted(rows):
        ids = [*tok.encode(text, add_special_tokens=False).ids, 2]
        want.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = token_files.written_and_read(documents.repartition(5), paths["byte_bpe_50k.json"])
    assert sorted(tuple(r) for r in got.collect()) == want
    odd_got = [tuple(r) for r in token_files.written_and_read(odd, paths["byte_bpe_50k.json"]).collect()]
    assert sorted(str(r[0]) for r in odd_got) == sorted(str(r[0]) for r in odd_rows)
    starts = sorted(r[1:3] for r in odd_got)
    assert [s for s, _ in starts] == [0, *np.cumsum([n for _, n in starts]).tolist()[:-1]]


@pytest.mark.parametrize("n", [0, 1, token_files.BLOCK, token_files.BLOCK + 1, 100_000])
def test_coder_is_lossless(n):
    ids = (np.random.default_rng(n).zipf(1.2, n) % 50_257).astype(np.int32)
    assert (token_files.unpack(*token_files.pack(ids)) == ids).all()


def test_a_broken_block_is_noticed():
    symbols, freqs, blocks = token_files.pack((np.arange(5000) % 700).astype(np.int32))
    broken = bytearray(blocks[0])
    broken[12 + 4 * (4 + 8 * token_files.LANES) + 20] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        token_files.unpack(symbols, freqs, [bytes(broken)])


def test_empty_tables(empty, paths):
    assert bpe.round_trip(empty, paths["byte_bpe_50k.json"]).collect() == []
    assert token_counts.count_tokens(empty, paths["word_bpe_49k.json"]).collect() == []
    assert token_files.written_and_read(empty, paths["byte_bpe_50k.json"]).collect() == []


def test_every_code_point_is_split_as_the_library_does(paths):
    import pandas as pd

    texts = [f"a{chr(c)}a {chr(c)}{chr(c)} 1{chr(c)}1" for c in [*range(0xD800), *range(0xE000, 0x20000), *range(0x31340, 0x31360)]]
    path = paths["byte_bpe_50k.json"]
    own = [i.tolist() for _, ids in bpe.encoded(iter([pd.DataFrame({"k": range(len(texts)), "t": texts})]), "k", "t", path) for i in ids]
    assert own == [e.ids for e in Tokenizer.from_file(path).encode_batch_fast(texts, add_special_tokens=False)]
    path = paths["word_bpe_49k.json"]
    table, tok = token_counts.counter(path), Tokenizer.from_file(path)
    for text in ("\U00013808\U00013808", "aꟋa", "É́ İ Σ"):
        assert token_counts.normal(text) == tok.normalizer.normalize_str(text)
    assert table.longest < 64
