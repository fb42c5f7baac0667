import zlib

import numpy as np
import pytest

from quire.llm import language, quality, toxicity

from .conftest import SMALL

MIDDLE = "/root/testdata/sf0.01"


def judged(frame, labels, label):
    own = {r["doc_id"]: r[label] for r in labels.collect()}
    return [(r, own[r["doc_id"]]) for r in frame if r["doc_id"] in own]


@pytest.mark.parametrize("operator, label, modulus, rest, least", [
    (toxicity.toxicity, "toxic", 3, 1, 0.85), (quality.quality, "quality", 4, 2, 0.93)])
def test_held_out_accuracy(tables, operator, label, modulus, rest, least):
    docs, labels = tables("documents", MIDDLE), tables("labels", MIDDLE)
    rows = operator(docs, labels).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == rest)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    held = [(r["predicted"], y) for r, y in judged(rows, labels, label) if r["held_out"]]
    assert np.mean([p == y for p, y in held]) >= least
    assert rows == operator(docs, labels).collect()


def test_language_held_out(tables):
    docs = tables("documents", MIDDLE)
    rows = language.languages(docs).collect()
    own = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [r["lang_pred"] == own[r["doc_id"]] for r in rows if r["held_out"]]
    assert np.mean(held) > 0.98 and len(rows) == len(own)


def test_labels_and_ids_are_not_inputs(tables):
    docs, labels = tables("documents"), tables("labels")
    model = toxicity.fit(docs, labels)
    one = docs.select(toxicity.scorer(docs, model)("text").alias("s")).collect()
    assert one == docs.drop("doc_id", "lang", "source").select(toxicity.scorer(docs, model)("text").alias("s")).collect()


@pytest.mark.parametrize("operator", [toxicity.toxicity, quality.quality])
def test_hard_rows(hard_docs, hard_labels, operator):
    rows = operator(hard_docs, hard_labels).collect()
    assert len(rows) == hard_docs.count()
    assert all(0 <= r["score"] <= 1 for r in rows)
    same = [r["score"] for r in rows if r["doc_id"] == 1]
    assert len(same) == 2 and same[0] == same[1]
    assert all(r["held_out"] for r in rows if r["doc_id"] is None)
    assert operator(hard_docs.limit(0), hard_labels).count() == 0
    unlabelled = operator(hard_docs, hard_labels.limit(0)).collect()
    assert {r["score"] for r in unlabelled} == {0.0}


@pytest.mark.parametrize("stage", [toxicity.drop_toxic, quality.keep_good])
def test_stages_keep_columns(hard_docs, hard_labels, stage):
    assert stage(hard_docs, hard_labels).columns == hard_docs.columns


def test_language_hard_rows(hard_docs):
    rows = language.languages(hard_docs).collect()
    assert len(rows) == hard_docs.count()
    for r in rows:
        if r["doc_id"] in (2, 3, 4, 7):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        assert 0 <= r["score"] <= 1
    assert language.languages(hard_docs.limit(0)).count() == 0


def test_machine_equals_the_sum_over_pairs():
    import pyarrow as pa

    rng = np.random.default_rng(0)
    setting = quality.Settings(bits=6, rank=3, bins=4)
    width = quality._columns(setting)
    model = quality.Model(np.sort(rng.random((len(quality.STATISTICS), 3)), axis=1), 0.1,
                          rng.normal(size=width).astype(np.float32), rng.normal(size=(width, 3)).astype(np.float32), setting)
    found = quality.features(pa.array(["a b c a", "d", ""], pa.large_string()), np.array([3.0, np.nan, 0]), 6)
    bins = quality._bins(found.statistics, model.edges, setting)
    for i, score in enumerate(quality.machine(found, model)):
        index = np.r_[found.column[found.row == i], bins[i]]
        x = np.r_[np.full((found.row == i).sum(), 1 / np.sqrt(max(found.size[i], 1))), np.ones(bins.shape[1])]
        z = model.bias + (model.weight[index] * x).sum()
        for j in range(len(index)):
            for k in range(j):
                z += model.factor[index[j]] @ model.factor[index[k]] * x[j] * x[k]
        assert score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-4)


def test_kernel_is_the_presence_kernel():
    import pyarrow as pa

    rows = language.presence(pa.array(["abcd", "bcde", ""], pa.large_string()), 14)
    grams = [{t[i:i + n] for n in (2, 3, 4) for i in range(len(t) - n + 1)} for t in ("abcd", "bcde", "")]
    kernel = language.kernel(rows, rows)
    assert rows.sum(axis=1).tolist() == [6, 6, 0]
    assert kernel[0, 1] == pytest.approx(len(grams[0] & grams[1]) / 6)
    assert kernel[2].tolist() == [0, 0, 0]


def test_small_sample_bound(tables):
    docs, labels = tables("documents", SMALL), tables("labels", SMALL)
    assert toxicity.fit(docs, labels, toxicity.Settings(sample_rows=5)).bias is not None


def test_a_small_share_of_very_many_rows_is_drawn(spark):
    """Counts of a large language or label table; the rows stand for a part of them."""
    from quire.llm import store

    assert store.cut(46, 700_000_000_000) > 0 and store.cut(3, 2) == 1_000_000 * store.FINE
    share = store.cut(600, 1_500_000_000)  # 4e-7, less than a millionth
    assert 5 <= spark.range(50_000_000).where(store.draw("id", 23) < share).count() <= 45
