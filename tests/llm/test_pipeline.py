"""The pipeline, stage by stage, against brute force on the smallest tables."""

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as CP
from ordersight.llm import pii, quality
from ordersight.llm.common import read
from ordersight.llm.queries import quality_model
from tests.llm.test_decontaminate import brute as brute_windows
from tests.llm.test_minhash import brute as brute_groups
from tests.llm.test_pii import brute_words

SF = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark):
    docs = read(spark, SF, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    items = [(r.item_id, r.text) for r in read(spark, SF, "benchmark").collect()]

    w, t = quality_model(docs, read(spark, SF, "labels"))
    w = w.astype(np.float32)
    tail = {d: 1 / (1 + np.exp(t[1] - w[quality.features((r.text or "").encode())].sum(dtype=float))) for d, r in rows.items()}
    good = sorted(d for d in rows if tail[d] >= 0.5)
    one = CP.quality_stage(spark, docs, SF)
    assert one.columns == docs.columns and sorted(r.doc_id for r in one.collect()) == good
    assert 0 < len(good) < len(rows)

    groups = brute_groups([(d, rows[d].text) for d in good])
    first = sorted(set(groups.values()))
    two = CP.near_duplicate_stage(spark, one, SF)
    assert two.columns == docs.columns and sorted(r.doc_id for r in two.collect()) == first

    hit = {d for d, _, k, _ in brute_windows([(d, rows[d].text) for d in first], items) if k}
    clean = [d for d in first if d not in hit]
    three = CP.decontaminate_stage(spark, two, SF)
    assert hit and three.columns == docs.columns and sorted(r.doc_id for r in three.collect()) == clean

    known = brute_words([(d, rows[d].text, None) for d in clean], 6, 1.5, 0.5, 0.8, 8.0)
    texts = {d: pii.redact(rows[d].text, pii._find(rows[d].text, known, 0.8)) for d in clean}
    four = CP.pii_stage(spark, three, SF)
    got = {r.doc_id: r for r in four.collect()}
    assert four.columns == docs.columns and {d: r.text for d, r in got.items()} == texts
    assert all(r.n_chars == len(r.text) and r.lang == rows[d].lang for d, r in got.items())

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = {}
    for r in CP.run(spark, SF).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    assert sorted(pieces) == clean
    for d, own in pieces.items():
        ids = np.array(tok.encode(texts[d], add_special_tokens=False).ids + [2], dtype="<u4")
        own.sort(key=lambda r: r.start)
        assert sum(r.length for r in own) == len(ids) == own[0].doc_tokens
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes()) for r in own)


def test_registered():
    import __spark_entry__ as E
    assert E.queries()["pipeline"] is CP.run and len(CP.STAGES) == 5
    numbers = {n.split("_")[0] for n in E.queries() if n.startswith("op")}
    assert numbers <= {f"op{k}" for k in range(1, 14)}
