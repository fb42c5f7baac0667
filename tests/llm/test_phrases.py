"""Phrases against counts in plain Python, and the index against its text."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quire.llm import phrases, queries, store


def _plain(rows, least=30, best=2000):
    """The contract in plain Python: rows of (lang, text)."""
    total, count = Counter(), {k: Counter() for k in range(1, 5)}
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k, c in count.items():
                c.update((lang, *w[i:i + k]) for i in range(len(w) - k + 1))
    found, out = {p: a for k in (2, 3, 4) for p, a in count[k].items() if a >= least}, []
    for (lang, *w), a in found.items():
        longer = [b for (other, *v), b in found.items() if other == lang and len(v) > len(w)
                  and any(v[i:i + len(w)] == w for i in range(len(v) - len(w) + 1))] if len(w) < 4 else []
        if any(100 * b >= 80 * a for b in longer):
            continue
        cuts = []
        for k in range(1, len(w)):
            left, right = count[k][lang, *w[:k]], count[len(w) - k][lang, *w[k:]]
            cuts.append((2_000_000 * a // (left + right), k, left, right))
        score, _, left, right = min(cuts)
        out.append((lang, -score, -a, " ".join(w).encode(), left, right))
    rank, listed = Counter(), []
    for lang, score, a, phrase, left, right in sorted(out):
        rank[lang] += 1
        if rank[lang] <= best:
            listed.append((lang, rank[lang], phrase.decode(), -a, left, right, total[lang], -score))
    return listed


def _got(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_index_extends_both_ways():
    rng = np.random.default_rng(3)
    for top in (2, 5, 40):
        text = np.r_[0, rng.integers(0, top, 400), 0].astype(np.int32)
        plain = {k: Counter(tuple(text[i:i + k].tolist()) for i in range(len(text) - k + 1)) for k in range(1, 5)}
        index = phrases.BidirectionalIndex.of(text, 4)
        for order in ([True] * 4, [False] * 4, [True, False, False, True], [False, True, True, False]):
            found = index.root()
            for k, left in enumerate(order, 1):
                found = index.extend(found, left)
                got = dict(zip(map(tuple, found.words.tolist()), found.count.tolist()))
                assert got == {p: c for p, c in plain[k].items() if 0 not in p}


@pytest.mark.parametrize("chunk", [3, 10, 40])
def test_long_texts_in_chunks(chunk):
    rng = np.random.default_rng(chunk)
    for _ in range(60):
        text = "".join(rng.choice(list("aab  \t.bc"), rng.integers(1, 120)))
        count = Counter()
        for weight, found in phrases.long_text(np.frombuffer(text.encode(), np.uint8), chunk, 3):
            words = [found.dictionary[int(n) - 1].as_py() if n else None for n in found.text]
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    if None not in words[i:i + k]:
                        count[tuple(words[i:i + k])] += weight
        plain = Counter()
        for piece in re.split("[.]", text):
            w = [x.encode() for x in re.findall("[^ \t]+", piece)]
            plain.update(tuple(w[i:i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
        assert {p: c for p, c in count.items() if c} == dict(plain), text


def test_query_against_plain_counts(spark, tables):
    rows = [(r["lang"], r["text"]) for r in tables("documents").collect()]
    wanted = _plain(rows)
    assert len(wanted) >= 50
    assert _got(queries.op12_phrases(spark, "/root/testdata/sf0.001")) == wanted


def test_small_shards_small_tables_and_few_ranks(spark, tables):
    docs = tables("documents")
    setting = phrases.Settings(shard=300, chunk=700, table_bits=10, best=7, least=20)
    rows = [(r["lang"], r["text"]) for r in docs.collect()]
    assert _got(phrases.collocations(docs.repartition(5), setting)) == _plain(rows, 20, 7)


def test_rare_pairs_are_not_sent_as_phrases(spark, tables, monkeypatch):
    monkeypatch.setattr(phrases, "_SIEVE_HELD", 100)
    setting = phrases.Settings(shard=3000, chunk=700)
    shards = phrases.build(tables("documents").repartition(5), setting)
    word = phrases._level(shards, 1, {}, None, setting)
    known = {1: spark.sparkContext.broadcast(phrases._bits(word, setting))}
    sieve = spark.sparkContext.broadcast(phrases._sieve(shards, 2, known, setting))
    through = phrases._level(shards, 2, known, sieve, phrases.Settings(least=1))
    every = {(r.lang, r.phrase): r.a for r in phrases._level(shards, 2, known, None, phrases.Settings(least=1)).collect()}
    kept = {(r.lang, r.phrase): r.a for r in through.collect()}
    assert {p for p, a in every.items() if a >= setting.least} <= set(kept) and kept.items() <= every.items()
    assert len(kept) < len(every) / 4


def test_hard_rows(spark, hard_docs):
    more = spark.createDataFrame(
        [(20, "Big Cat,big cat\tBIG  cat. big\x0bcat" * 12, None, "a", 1), (21, "É É É É É É É" * 9, "fr", "a", 1), (22, ",,, ..", "fr", "a", 1),
         (23, "a b c d e " * 40, "de", "a", 1), (24, "a b c d e " * 40, "de", "a", 1)],
        "doc_id long, text string, lang string, source string, n_chars long")
    docs = hard_docs.unionByName(more, allowMissingColumns=True)
    rows = [(r["lang"], r["text"]) for r in docs.collect()]
    setting = phrases.Settings(least=3, chunk=1000)
    found = _got(phrases.collocations(docs, setting))
    assert found == _plain(rows, 3) and {r[0] for r in found} == {"und", "fr", "de", "en"}
    empty = phrases.collocations(docs.where("false"))
    assert empty.count() == 0 and empty.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_places_in_order():
    rng = np.random.default_rng(5)
    for top in (1, 7, 1 << 20, 1 << 40, (1 << 63) - 1):  # the last has no room for places beside the values
        key = rng.integers(0, top, 3000)
        assert (phrases.ordered(key) == np.argsort(key, kind="stable")).all()
    assert phrases.ordered(key[:1]).tolist() == [0] and len(phrases.ordered(key[:0])) == 0


def test_words_are_counted_and_marked_without_sorting(monkeypatch):
    text = np.array([0, 3, 1, 3, 0, 2, 3, 0], np.int32)
    index = phrases.BidirectionalIndex.of(text, 4)
    listed = pa.array([b"z", b"x" * 9000, "é".encode(), b"a b"], pa.binary())
    with monkeypatch.context() as patched:
        for name in ("argsort", "sort"):
            patched.setattr(phrases.np, name, None)
        for left in (True, False):
            found = index.extend(index.root(), left)
            assert dict(zip(found.words[:, 0].tolist(), found.count.tolist())) == {1: 1, 2: 1, 3: 3}
        mark = phrases._mark("de", listed)
    assert len(set(mark.tolist())) == 5 and (phrases._mark("de", listed[2:])[1:] == mark[3:]).all()
    assert (phrases._mark("fr", listed) != mark).all()


def test_shards_are_written_and_read_a_few_at_a_time(spark, monkeypatch):
    import pyarrow.parquet as pq

    monkeypatch.setitem(store.LARGE_ROWS, "parquet.block.size", "1000")
    docs = spark.createDataFrame([(f"l{k}", " ".join(f"w{k * n % 91}" for n in range(150))) for k in range(1, 40)],
                                 "lang string, text string").coalesce(1)
    shards = phrases.build(docs, phrases.Settings())
    groups = sum(pq.ParquetFile(f.removeprefix("file:")).num_row_groups for f in shards.inputFiles())
    assert groups == shards.count() > 10
