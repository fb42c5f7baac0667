"""Token files against the tokenizers library in plain Python, and the Elias-Fano sequence."""

import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quire.llm import bpe, queries, tokenfiles


def _plain(rows):
    """(doc_id, start, n_tokens, crc) in order of doc_id, by the library's own call."""
    own, start, out = Tokenizer.from_file(queries.tokenizer_path()), 0, []
    for key, text in rows:
        ids = np.array([*own.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def _got(df):
    return sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in df.collect()), key=lambda r: r[1])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 10**6), st.integers(0, 2**40)), max_size=300))
def test_sequences_come_back(steps):
    values = np.cumsum(np.array(steps, np.uint64), dtype=np.uint64)
    found = tokenfiles.EliasFano.parse(memoryview(tokenfiles.EliasFano.of(values).to_bytes()))
    assert found.all().tolist() == values.tolist()
    assert [found.select(k) for k in range(len(values))] == values.tolist()


def test_sequences_near_64_bits_and_with_wide_gaps():
    values = [0, 0, 1, 2**63 - 1, 2**64 - 1]
    found = tokenfiles.EliasFano.of(np.array(values, np.uint64))
    assert [found.select(k) for k in range(5)] == values == found.all().tolist()
    clumped = [*range(1000), *range(10**7, 10**7 + 1000)]
    found = tokenfiles.EliasFano.of(np.array(clumped))
    assert [found.select(k) for k in (0, 999, 1000, 1063, 1064, 1999)] == [clumped[k] for k in (0, 999, 1000, 1063, 1064, 1999)]
    with pytest.raises(IndexError):
        found.select(2000)


def test_near_minimal_space():
    ends = np.cumsum(np.random.default_rng(1).geometric(1 / 800, 20_000))
    raw = len(tokenfiles.EliasFano.of(ends).to_bytes())
    assert raw * 8 / len(ends) < 2 + math.log2(ends[-1] / len(ends)) + 1.1  # half a bit of it is the sample


def test_blocks_by_document():
    ids = [np.arange(n, dtype="<u4").tobytes() for n in (1, 5, 1, 70)]
    keys = pa.array([-7, -7, 2**62, None], pa.int64())
    raw = tokenfiles.pack_block(3, 2, 100, 2, keys, ids) + b"\n" + tokenfiles.pack_block(3, 3, 177, 4, pa.array(["a", "é"]), ids[:2]) + b"\n"
    first, second = tokenfiles.blocks(raw)
    assert first.keys(pa.int64()).to_pylist() == [-7, -7, 2**62, None] and second.keys(pa.string()).to_pylist() == ["a", "é"]
    assert [first.document(k).tobytes() for k in range(4)] == ids
    assert (first.part, first.base, second.base, second.document(1).tolist()) == (3, 100, 177, [0, 1, 2, 3, 4])
    with pytest.raises(ValueError):
        list(tokenfiles.blocks(raw[:-1]))


def test_query_against_plain_loop(spark, tables):
    rows = sorted((r["doc_id"], r["text"]) for r in tables("documents").collect())
    assert _got(queries.op13_tokenids(spark, "/root/testdata/sf0.001")) == _plain(rows)


def test_hard_rows(spark, hard_docs):
    setting = tokenfiles.Settings(block_ids=5000, blocks_per_file=2)
    found = tokenfiles.listed(spark, tokenfiles.write(hard_docs, queries.tokenizer_path(), setting))
    got = _got(found)
    assert [r[0] for r in got] == [1, 1, 2, 3, 4, 5, 6, 7, 8, None, None]
    texts = {r["doc_id"]: r["text"] for r in hard_docs.where("doc_id IS NOT NULL").collect()}
    known = [(k, texts[k]) for k in (1, 1, 2, 3, 4, 5, 6, 7, 8)]
    assert got[:9] == _plain(known)
    assert {r[2] for r in got[9:]} == {1, got[0][2]}
    assert got[10][1] == got[9][1] + got[9][2]
    empty = tokenfiles.listed(spark, tokenfiles.write(hard_docs.where("false"), queries.tokenizer_path()))
    assert empty.count() == 0 and empty.columns[:4] == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_doc_ids_as_text_and_one_id_over_many_parts(spark):
    df = spark.createDataFrame([("same", f"text number {i % 40}") for i in range(400)] + [("a", "first"), ("z", "last")],
                               "doc_id string, text string").repartition(4)
    found = tokenfiles.listed(spark, tokenfiles.write(df, queries.tokenizer_path()), "string").collect()
    order = sorted(found, key=lambda r: r["start"])
    assert [r["doc_id"] for r in order] == ["a"] + ["same"] * 400 + ["z"]
    assert [r["start"] for r in order[1:]] == [r["start"] + r["n_tokens"] for r in order[:-1]]
    assert len({r["part"] for r in found}) > 2


def test_ids_are_those_of_the_library():
    texts = ["a <|endoftext|> b", "it's  12 x y\n\n z", "x" * 3000 + " y", "", " ", "é中\U0001f600 ́a", "don't 'LL 3rd\t\t"]
    own = Tokenizer.from_file(queries.tokenizer_path())
    wanted = [np.array(own.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    small = bpe.Encoder(queries.tokenizer_path(), 1500)
    for _ in range(3):
        assert small(texts) == wanted
        assert small([t + " more words" for t in texts[3:]]) == [
            np.array(own.encode(t + " more words", add_special_tokens=False).ids, "<u4").tobytes() for t in texts[3:]]
    other = bpe.Encoder(queries.tokenizer_path().replace("byte_bpe_50k", "word_bpe_49k"), 1500)
    assert other(["Hello there"]) == [np.array(other.own.encode("Hello there", add_special_tokens=False).ids, "<u4").tobytes()]
