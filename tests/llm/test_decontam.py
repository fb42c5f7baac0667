import random

import numpy as np
import pytest

from quire.llm import decontam


def smith_waterman(a, b, s):
    h, best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)], 0
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (s.match if x == y else -s.mismatch), h[i - 1][j] - s.gap, h[i][j - 1] - s.gap)
            best = max(best, h[i][j])
    return best / (s.match * len(a))


def test_alignment_is_smith_waterman():
    rng, s = random.Random(0), decontam.Settings()
    for _ in range(40):
        item = [rng.randrange(6) for _ in range(rng.randrange(1, 15))]
        passages = [[rng.randrange(6) for _ in range(rng.randrange(1, 30))] for _ in range(5)]
        got = decontam.align(np.array(item, np.uint64), [np.array(p, np.uint64) for p in passages], s)
        assert got.tolist() == pytest.approx([smith_waterman(item, p, s) for p in passages])


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)] + ["the", "of", "and"] * 700
    items = [[rng.choice(words) for _ in range(rng.randrange(15, 50))] for _ in range(30)] + [["only", "two"], ["one"]]
    docs, truth = [], set()
    for d in range(120):
        text = [rng.choice(words) for _ in range(rng.randrange(20, 400))]
        if d % 4 == 0:
            k = rng.randrange(30)
            own = list(items[k])
            for _ in range(len(own) // 8 if d % 8 else 0):
                own[rng.randrange(len(own))] = "changed"
            at = rng.randrange(len(text))
            text[at:at] = own
            truth.add((d, k))
        docs.append((d, " ".join(text)))
    docs.append((500, "here are Only, two!"))
    truth.add((500, 30))
    return (spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
            spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string"), truth)


@pytest.mark.parametrize("block_words", [200_000, 300])
def test_planted_passages(planted, block_words):
    docs, items, truth = planted
    found = decontam.contaminated(docs, items, decontam.Settings(block_words=block_words)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == truth
    left = decontam.drop_contaminated(docs, items)
    assert {r["doc_id"] for r in left.collect()} == {r["doc_id"] for r in docs.collect()} - {d for d, _ in truth}


def test_a_passage_in_most_documents_keeps_its_rare_half(spark):
    item = " ".join(f"p{i}" for i in range(20))
    docs = spark.createDataFrame([(d, f"x{d} y {item} z") for d in range(60)] + [(99, "p1 p2 p3 only")], "doc_id long, text string")
    found = decontam.contaminated(docs, spark.createDataFrame([(1, item), (2, None), (None, item)], "item_id long, text string"))
    assert sorted(r["doc_id"] for r in found.collect()) == list(range(60))


@pytest.mark.parametrize("share", [0.2, 0.25, 0.3])
def test_edited_copies_alone_and_in_thousands(spark, share):
    """Every edit is found by its own text: what plain Smith-Waterman finds, however often the edit occurs."""
    rng, s = random.Random(7), decontam.Settings()
    items = [[f"i{k}w{j}" for j in range(rng.randrange(25, 45))] for k in range(8)]
    docs, want = [], set()
    for k, item in enumerate(items):
        own = list(item)
        for j in range(len(own)) if share == 0.2 else rng.sample(range(len(own)), int(share * len(own))):
            if share > 0.2 or j % 5 == 4:
                own[j] = "changed"
        for _ in range(2500 if k == 0 else 1):
            around = [f"f{rng.randrange(900)}" for _ in range(20)]
            docs.append((len(docs), " ".join(around[:10] + own + around[10:])))
            if smith_waterman(item, own, s) >= s.threshold:
                want.add((len(docs) - 1, k))
    docs.append((len(docs), " ".join(items[1][:len(items[1]) // 2 + 1] + ["own", "end"])))
    want.add((len(docs) - 1, 1))
    assert len(want) == len(docs)
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(table, bench).collect()} == want


def test_hard_rows(spark, hard_docs, tables):
    items = tables("benchmark")
    assert decontam.contaminated(hard_docs, items).columns == ["doc_id", "item_id", "score", "start_word", "end_word"]
    left = decontam.drop_contaminated(hard_docs, items)
    assert left.columns == hard_docs.columns and left.count() == hard_docs.count()
    assert decontam.contaminated(hard_docs, items.limit(0)).count() == 0
    assert decontam.contaminated(hard_docs.limit(0), items).count() == 0
    own = spark.createDataFrame([(7, "the cat sat on the mat and then the dog came in")], "item_id long, text string")
    assert {r["doc_id"] for r in decontam.contaminated(hard_docs, own).collect()} == {1, 8, None}
