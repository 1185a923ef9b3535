import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ticklake.llm import tokens
from ticklake.llm.packing import best_fit, dot_product, packed_documents, pieces, residual_norm, sequences
from ticklake.llm.token_counts import spliced_count, token_counts

from . import edge

WORD = Tokenizer.from_file(tokens.path(tokens.WORD_BPE))
BYTE = Tokenizer.from_file(tokens.path(tokens.BYTE_BPE))
ODD = ["<|endoftext|>", "<|startoftext|>", " ", "  ", "\n", "\t", "\x1c", "\x85", " ", " ", "é", "İ", "ΑΣ", "'s", "'LL", "12", "中文", "🙂", "!!", "\x00", "don't", "Étés", "ſ", "<|"]
TEXT = st.lists(st.one_of(st.sampled_from(ODD), st.text(max_size=6)), max_size=25).map("".join)


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_encoders_equal_the_library(text):
    ids = np.frombuffer(b"".join(tokens.word_encoder(tokens.path(tokens.WORD_BPE)).encode(text)), "<u4").tolist()
    assert ids == WORD.encode(text, add_special_tokens=False).ids
    assert tokens.piece_counter(tokens.path(tokens.BYTE_BPE)).count(text) == len(BYTE.encode(text, add_special_tokens=False))


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, max_size=12).map(" ".join), st.sampled_from([(30, 2), (80, 10)]))
def test_splice_equals_the_library(text, sizes):
    assert spliced_count(BYTE, text, *sizes) == len(BYTE.encode(text, add_special_tokens=False))


@pytest.mark.parametrize("text", ["a" * 3000, " " * 3000, "x\n\n  y" * 500, "<|endoftext|>" * 300, "ab cd " * 900])
def test_splice_without_places(text):
    assert spliced_count(BYTE, text, 200, 8) == len(BYTE.encode(text, add_special_tokens=False))


def test_counts_of_edge_rows(spark):
    got = token_counts(edge.docs(spark)).collect()
    want = sorted((str(i), len((t or "").encode()), len(BYTE.encode(t or "", add_special_tokens=False))) for i, t, *_ in edge.rows())
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    assert token_counts(edge.empty(spark)).count() == 0


def test_packing_edge_rows(spark):
    got = packed_documents(edge.docs(spark)).collect()
    assert packed_documents(edge.empty(spark)).count() == 0
    want = {}
    for i, t, *_ in edge.rows():
        ids = WORD.encode(t or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            p = ids[k : k + 4096]
            want.setdefault((i, k // 4096), []).append((k, len(p), zlib.crc32(np.array(p, "<u4").tobytes())))
    have, bins = {}, {}
    for r in got:
        have.setdefault((r.doc_id, r.piece), []).append((r.start, r.length, r.ids_crc32))
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r.length for r in got)
    assert len(bins) <= -(-total // 4096) + 1


def test_sequences_hold_the_pieces(spark):
    df = edge.docs(spark, extra=False)
    ids = {r.sequence_id: bytes(r.ids) for r in sequences(df).collect()}
    assert sum(map(len, ids.values())) == sum(r.length * 4 for r in pieces(df).select("length").collect())
    assert all(len(x) <= 4 * 4096 for x in ids.values())


@pytest.mark.parametrize("score", [dot_product, residual_norm])
def test_best_fit_keeps_every_capacity(score):
    rng = np.random.default_rng(3)
    length = np.minimum(rng.lognormal(5, 1.2, 3000).astype(np.int64) + 1, 4096)
    b, at = best_fit(length, tokens=4096, documents=9, cost=9_000_000, weights=(1.0, 0.3, 0.3), score=score)
    for k in range(b.max() + 1):
        own = length[b == k]
        assert len(own) and own.sum() <= 4096 and len(own) <= 9
        assert (own**2).sum() <= 9_000_000 or len(own) == 1
    alone = length**2 > 9_000_000  # these get a bin each; the rest needs one capacity or another
    rest = length[~alone]
    bound = alone.sum() + max(rest.sum() / 4096, len(rest) / 9, (rest**2).sum() / 9_000_000)
    assert b.max() + 1 <= 1.4 * bound + 2
    b, _ = best_fit(length, tokens=4096, documents=4096, cost=4096**2, weights=(1.0, 1e-3, 1e-3), score=score)
    assert b.max() + 1 <= -(-length.sum() // 4096) * 1.01 + 1
    assert len(best_fit(np.empty(0, np.int64), tokens=8, documents=8, cost=64, weights=(1, 1, 1), score=score)[0]) == 0
