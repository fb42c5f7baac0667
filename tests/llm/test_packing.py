import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quire.llm import bpe, packing
from quire.llm.queries import tokenizer_path


def unfold(plan):
    spans = []
    for size, low, high, first, per, offset in plan.rows:
        into = np.arange(high - low)
        spans += zip(first + into // per, offset + into % per * size, [size] * (high - low))
    return sorted(spans)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=300), st.sampled_from([8, 20, 40]), st.sampled_from([2, 8]))
def test_plan_places_every_piece_once_without_gaps(lengths, small, groups):
    counts = np.bincount(lengths, minlength=65)
    plan = packing.Plan(counts, packing.Settings(capacity=64, small=small, groups=groups))
    spans = unfold(plan)
    assert sorted(s for _, _, s in spans) == sorted(lengths)
    place = {}
    for sequence, offset, size in spans:
        assert place.get(sequence, 0) == offset
        place[sequence] = offset + size
    assert all(v <= 64 for v in place.values()) and len(place) == plan.sequences
    assert len(place) <= 2 * max(1, -(-sum(lengths) // 64))
    ranks = sorted(plan.rows)
    for a, b in zip(ranks, ranks[1:]):
        assert b[1] == (a[2] if a[0] == b[0] else 0)


def test_close_to_the_bound():
    rng = np.random.default_rng(0)
    lengths = np.clip(np.exp(rng.normal(6.4, 0.9, 40_000)), 1, 2047).astype(int)
    plan = packing.Plan(np.bincount(lengths, minlength=2049), packing.Settings())
    assert plan.sequences <= 1.002 * -(-lengths.sum() // 2048)


def test_programme_is_the_best_of_all_configurations():
    columns, uses = packing.configurations(np.array([6, 4, 3]), np.array([30.0, 50.0, 40.0]), 10)
    assert (columns @ uses >= np.array([30, 50, 40]) - 1e-6).all() and (np.array([6, 4, 3]) @ columns <= 10).all()
    assert uses.sum() == pytest.approx(50)  # 500 in all, so no less is possible


TEXTS = ["a b  c  d\n\n e\r\nf\x0bg \x85h\x1cx\x1f y", "  lead", "trail  ", "\n", "<|endoftext|> x", "é’s don't 123 $%^",
         "　　x", "a\n\n\nb", "\t\tz \t q", " ", "", "日本語 テキスト", "A" * 3000]


def test_ids_are_those_of_the_tokenizer(tables):
    own = Tokenizer.from_file(tokenizer_path())
    texts = TEXTS + [r["text"] for r in tables("documents").limit(60).collect()]
    for text, ids in zip(texts, bpe.Encoder(tokenizer_path(), 500)(texts)):
        assert np.array(own.encode(text, add_special_tokens=False).ids, "<u4").tobytes() == ids


def test_other_vocabularies_are_encoded_as_they_are():
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    encoder = bpe.Encoder(path, 500)
    assert encoder.ranked is None
    assert encoder(["Hello  world"])[0] == np.array(own.encode("Hello  world", add_special_tokens=False).ids, "<u4").tobytes()


def test_round_trip(spark, hard_docs):
    own = Tokenizer.from_file(tokenizer_path())
    rows = packing.pack(hard_docs, tokenizer_path()).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for doc in hard_docs.where("doc_id > 1").collect():
        ids = np.array([*own.encode(doc["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        got, at = sorted(by_doc[doc["doc_id"]], key=lambda r: r["piece"]), 0
        for r in got:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at:at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids) and (len(got) == 1) == (len(ids) <= 2048) and all(r["length"] == 2048 for r in got[1:])
    assert len(by_doc[1]) == 2 and len(by_doc[None]) == 2
    place = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert place.get(r["sequence_id"], 0) == r["offset"]
        place[r["sequence_id"]] = r["offset"] + r["length"]
    assert packing.pack(hard_docs.limit(0), tokenizer_path()).count() == 0
