"""Packing by powers of two against the tokenizers library, and as an exact round trip."""

import collections
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from test_operators import SCHEMA, TEXTS, rows_of
from tokenizers import Tokenizer

from weir.llm.packing import ByteEncoder, binary_lengths, packed, with_crc32

BYTE, WORD = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def test_binary_lengths():
    counts, lengths = binary_lengths(np.array([0, 1, 6, 2048, 5000]), 2048)
    assert counts.tolist() == [0, 1, 2, 1, 6]
    assert lengths.tolist() == [1, 4, 2, 2048, 2048, 2048, 512, 256, 128, 8]
    counts, lengths = binary_lengths(np.array([3]), 1)
    assert (counts.tolist(), lengths.tolist()) == ([3], [1, 1, 1])
    assert [x.tolist() for x in binary_lengths(np.zeros(0, np.int64), 8)] == [[], []]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder(path):
    library, encoder = Tokenizer.from_file(path), ByteEncoder(Path(path).read_text(encoding="utf-8"))
    assert (encoder.fast is None) == (path == WORD)
    for text in [*TEXTS, "a  b\n \n c", "x\u0220y\u2014z", "\u0221 \ud7ff", "<|endoftext|>", "1\u00b22 \u00aa\u00b5", "'s 'S 'll"]:
        assert encoder.encode(text or "") == library.encode(text or "", add_special_tokens=False).ids


def test_packed(spark):
    edge = spark.createDataFrame(rows_of(), SCHEMA).repartition(3)
    library = Tokenizer.from_file(BYTE)
    want = collections.Counter()
    for i, text, *_ in rows_of():
        want[i, tuple(library.encode(text or "", add_special_tokens=False).ids + [1])] += 1
    for longest in (2048, 4):
        got = packed(edge, BYTE, longest).collect()
        assert all(r.length == len(r.ids) <= longest and r.length & (r.length - 1) == 0 and r.offset == 0 for r in got)
        # every document from its pieces; numbers of sequences are gapless, longest bucket first
        texts = collections.Counter()
        for (i, n), pieces in grouped(got).items():
            copies = {}
            for r in sorted(pieces, key=lambda r: (r.start, r.ids)):
                copies.setdefault(r.start, []).append(r)
            for k in range(len(copies[0])):
                parts = [c[k] for _, c in sorted(copies.items())]
                assert [p.start for p in parts] == np.cumsum([0, *[p.length for p in parts[:-1]]]).tolist()
                ids = tuple(x for p in parts for x in p.ids)
                assert len(ids) == n
                texts[i, ids] += 1
        assert texts == want
        by_id = sorted(got, key=lambda r: r.sequence_id)
        assert [r.sequence_id for r in by_id] == list(range(len(got)))
        assert [r.length for r in by_id] == sorted((r.length for r in got), reverse=True)
    sums = {r.sequence_id: r.ids_crc32 for r in with_crc32(packed(edge, BYTE)).collect()}
    full = packed(edge, BYTE).collect()
    assert sums == {r.sequence_id: zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in full}


def grouped(rows):
    out = collections.defaultdict(list)
    for r in rows:
        out[r.doc_id, r.doc_tokens].append(r)
    return out


def test_edges(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert with_crc32(packed(none, BYTE)).count() == 0
    text_ids = spark.createDataFrame([("x", "one two"), (None, None)], "doc_id string, text string")
    assert {(r.doc_id, r.doc_tokens) for r in packed(text_ids, BYTE).collect()} == {("x", 3), (None, 1)}
    assert packed(text_ids.where("doc_id IS NULL"), BYTE, end_id=None).count() == 0
    big = spark.createDataFrame([(2**53 + 1, "a"), (None, "b"), (2**53 + 3, None)], "doc_id long, text string").coalesce(1)
    assert {r.doc_id for r in packed(big, BYTE).collect()} == {2**53 + 1, None, 2**53 + 3}
    with pytest.raises(ValueError):
        packed(none, BYTE, longest=1000)
