import random

import pytest

from quire.llm import neardup

from .test_words import plain


def brute(rows, width, percent):
    sets = {}
    for doc, text in rows:
        w = plain(text)
        sets[doc] = ({tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width
                     else {("short", *w)} if w else set())
    low = {d: d for d in sets}

    def root(d):
        while low[d] != d:
            d = low[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((root(a), root(b)))
                low[q] = p
    return {d: (len(s), root(d)) for d, s in sets.items()}


def family(seed=3):
    rng = random.Random(seed)
    rows, doc = [], 0
    for base in range(25):
        text = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([5, 60, 120, 300]))]
        for _ in range(rng.choice([1, 2, 12])):
            own = list(text)
            for _ in range(rng.randrange(0, max(1, len(text) // 18))):
                own[rng.randrange(len(own))] = f"e{rng.randrange(10**6)}"
            rows.append((doc * 7 % 997, " ".join(own)))
            doc += 1
    return rows


@pytest.mark.parametrize("width, percent", [(3, 85), (5, 80)])
def test_same_groups_as_brute_force(spark, width, percent):
    rows = family() + [(2001, None), (2002, ""), (2003, "a b"), (2004, "A  b"), (2005, "b a")]
    want = brute(rows, width, percent)
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4),
                                    neardup.Settings(width=width, percent=percent)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == want
    assert all(r["kept"] == (r["component_id"] == r["doc_id"]) for r in found)


def test_what_is_apart_is_found_without_turns(spark):
    rows = family(11)
    want = brute(rows, 3, 85)
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"),
                                    neardup.Settings(width=3, percent=85, rounds=0, broadcast_nodes=0)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == want


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 102)], "a long, b long")
    roots = {r["node"]: r["root"] for r in neardup.components(links).collect()}
    assert len({roots[i] for i in range(61)}) == 1 and roots[100] == roots[102] != roots[0]


def test_hard_rows(hard_docs):
    rows = neardup.near_duplicates(hard_docs, neardup.Settings()).collect()
    assert len(rows) == hard_docs.count()
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by_id[8]["component_id"] == 1 and not by_id[8]["kept"]
    assert all(by_id[d]["n_shingles"] == 0 and by_id[d]["kept"] for d in (2, 3, 4))
    assert all(r["component_id"] is None and r["kept"] for r in rows if r["doc_id"] is None)
    left = neardup.drop_copies(hard_docs)
    assert left.columns == hard_docs.columns
    ids = sorted(r["doc_id"] or 0 for r in left.collect())
    assert ids == [0, 0, 1, 2, 3, 4, 5, 6, 7]
    assert neardup.drop_copies(hard_docs.limit(0)).count() == 0


def test_tensored_keys_pair_every_band():
    import numpy as np

    setting = neardup.Settings()
    low = np.random.default_rng(1).integers(0, 1 << 32, (2, setting.hashes), dtype=np.uint64).astype(np.uint32)
    low[1] = low[0]
    low[1, setting.rows * setting.bands:] += 1
    low[1, setting.rows * setting.bands:setting.rows * (setting.bands + 1)] = low[0, setting.rows * setting.bands:setting.rows * (setting.bands + 1)]
    keys = neardup.table_keys(low, setting)
    assert keys.shape == (2, setting.bands ** 2) and (keys[0] == keys[1]).sum() == setting.bands
