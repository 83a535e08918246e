"""Packing against the tokenizer itself and the rules of a sequence."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ordersight.llm.packing import Encoder, pack, pack_block, step_groups

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.sampled_from(
    ["The Cat, sat.", "ΣΑΣ Σ", "é É", "it's 12x²", "<|endoftext|> a\tb", "x<|ENDOFTEXT|>y", "<|startoftext|>", "...", "İI K"])), max_size=4))
def test_cached_encoding_equals_whole_text(parts):
    text = " ".join(parts)
    t = Tokenizer.from_file(PATH)
    got = np.frombuffer(Encoder(PATH).encode(text), dtype="<u4").tolist()
    assert got == t.encode(text, add_special_tokens=False).ids


def test_a_look_up_does_not_go_through_the_words_of_the_generation_before():
    class Kept(dict):
        def __iter__(self):
            raise AssertionError("all words were gone through")
    enc, want = Encoder(PATH), Encoder(PATH)
    enc.encode("old words, again")
    enc.before, enc.words = Kept(enc.words), {}
    assert enc.encode("old words and new ones") == want.encode("old words and new ones")
    assert enc.words["old"] == enc.before["old"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20_000), max_size=60))
def test_block_is_a_partition_with_little_padding(lengths):
    windows = pack_block(lengths)
    seen = [np.zeros(n, dtype=int) for n in lengths]
    padded = 0
    for tier, pieces in windows:
        used = sum(n for _, _, n in pieces)
        assert used <= tier <= 4096
        padded += used != tier
        for doc, start, n in pieces:
            assert n > 0
            seen[doc][start:start + n] += 1
    assert all((s == 1).all() for s in seen)
    assert padded <= 1


def test_step_groups_hold_equal_tokens():
    windows = pack_block([700, 900, 4000, 120, 5000, 33] * 50)
    groups = step_groups(windows, 16_384)
    by = {}
    for (tier, pieces), g in zip(windows, groups, strict=True):
        by.setdefault(g, []).append(tier)
    assert all(len(set(t)) == 1 and sum(t) <= 16_384 for t in by.values())
    assert min(groups) == 0 and len(by) == max(groups) + 1


def _expected(rows):
    t = Tokenizer.from_file(PATH)
    return {(d, i): t.encode(x or "", add_special_tokens=False).ids + [2] for i, (d, x) in enumerate(rows)}


def test_pack_small_table(spark):
    rows = [(1, "hello world " * 3000), (2, None), (3, ""), (None, "a b c"), (5, "same"), (5, "same"), (6, "x" * 30000)]
    docs = spark.createDataFrame([(d, x, 1, "q") for d, x in rows],
                                 "doc_id long, text string, start int, tier string")
    got = pack(docs, PATH).collect()
    want = _expected(rows)
    assert sum(r.length for r in got) == sum(map(len, want.values()))
    by_seq = {}
    for r in got:
        by_seq.setdefault(r.sequence_id, []).append(r)
    for pieces in by_seq.values():
        pieces.sort(key=lambda r: r.offset)
        assert [p.offset for p in pieces] == list(np.cumsum([0] + [p.length for p in pieces[:-1]]))
        assert sum(p.length for p in pieces) <= 4096
    for d in (1, 2, 3, 6):
        ids = next(v for k, v in want.items() if k[0] == d)
        own = sorted((r for r in got if r.doc_id == d), key=lambda r: r.start)
        assert [r.start for r in own] == list(np.cumsum([0] + [r.length for r in own[:-1]]))
        assert own[-1].start + own[-1].length == len(ids) == own[0].doc_tokens
        for r in own:
            raw = np.asarray(ids[r.start:r.start + r.length], dtype="<u4").tobytes()
            assert r.ids_crc32 == zlib.crc32(raw)
    assert sum(r.length for r in got if r.doc_id == 5) == 2 * len(want[(5, 4)])


def test_pack_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_whole_table_padding(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    rows = pack(docs, PATH).collect()
    used = {}
    for r in rows:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    padding = sum(4096 - u for u in used.values() if u & (u - 1))
    assert padding <= 4096 * len({s >> 36 for s in used})
    assert len({r.doc_id for r in rows}) == docs.count()


def test_one_model_in_an_encoder(monkeypatch):
    """The tokenizer's file is read once: both ways to tokenize share the model."""
    import public_tokenizers
    import tokenizers
    from ordersight.llm import packing as P
    read, real = [], tokenizers.Tokenizer

    class Once:
        def __new__(cls, model):
            return real(model)

        @staticmethod
        def from_file(path):
            read.append(path)
            return real.from_file(path)

    monkeypatch.setattr(tokenizers, "Tokenizer", Once)
    enc = P.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    text = "Some words, some Words; näive 12 x-y."
    assert len(read) == 1
    assert enc.encode(text) == enc._ids(enc.tokenizer.encode(text, add_special_tokens=False).ids)
