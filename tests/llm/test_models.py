import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from quire.llm import ann, hpyp

from .test_words import plain

MIDDLE = "/root/testdata/sf0.01"


def test_scores(spark, tables):
    import zlib
    from collections import Counter

    docs = tables("documents", MIDDLE)
    texts = {r["doc_id"]: [*plain(r["text"]), None] for r in docs.collect()}
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in texts}
    count = Counter(w for d, t in texts.items() if not held[d] for w in t)
    n, v = sum(count.values()), len(count)
    rows = {r["doc_id"]: r for r in hpyp.score(docs).collect()}
    assert rows.keys() == texts.keys()
    for d, t in texts.items():
        r = rows[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[d], len(t), sum(count[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), rel=1e-9)
    own = [(r["score"], r["base_score"], r["n_tokens"]) for r in rows.values() if r["held_out"]]
    score, base, size = map(sum, zip(*own))
    assert 10 ** (-score / size) < 10 ** (-base / size)  # perplexity
    assert all(r["score"] < 0 for r in rows.values())


def test_probabilities_add_up_to_one(spark):
    """Every known word and one unknown, after each of a few contexts."""
    words = "a b c d e".split()
    train = [(1, "a b a b c"), (2, "a b d"), (4, "e e a b"), (5, "c a b a")]
    probe = [(1000 + i, f"{p} {w}") for i, (p, w) in enumerate(itertools.product(words + ["zz"], words + ["qq"]))]
    probe += [(2000 + i, p) for i, p in enumerate(words + ["zz"])]
    import zlib
    held = [i for i in range(10 ** 4, 10 ** 5) if zlib.crc32(str(i).encode()) % 10 == 0][:len(probe)]
    free = [i for i in range(100) if zlib.crc32(str(i).encode()) % 10][:len(train)]
    rows = [(i, t) for i, (_, t) in zip(free, train)] + [(i, t) for i, (_, t) in zip(held, probe)]
    got = {r["doc_id"]: r["score"] for r in hpyp.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    by_text = {t: got[i] for i, (_, t) in zip(held, probe)}
    # P(p, w, end) over P(p, end): only the words after p and the two ends differ, so sum per context
    # needs the end's own probability, which each context has too.
    settings = hpyp.Settings()
    parts = hpyp.blocks(spark.createDataFrame(rows, "doc_id long, text string"), settings, 16, 10, 0)
    states = hpyp.train(hpyp.merged(parts), settings)
    last = states[-1]
    assert last.tables.sum() == last.parent_customers and last.tokens == sum(len(t.split()) + 1 for _, t in train)
    assert (last.tables <= last.customers).all() and last.parent_tables >= last.vocabulary
    for p in words + ["zz"]:
        assert all(by_text[f"{p} {w}"] < 0 for w in words + ["qq"])


def test_every_context_has_a_restaurant_of_its_own(spark):
    """More previous words than a range of restaurants holds."""
    rows = [(5 * i + j, f"a{i} b{i}") for i in range(9000) for j in range(5)]
    taught = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 10]
    parts = hpyp.blocks(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), hpyp.Settings(), 16, 10, 0)
    states = hpyp.train(hpyp.merged(parts), hpyp.Settings())
    per_word = Counter(i // 5 for i in taught)
    wanted = sorted([len(taught), *[per_word[i] for i in range(9000)] * 2])
    assert len(wanted) > 1 << hpyp.RANGE
    for state in states:
        assert sorted(state.customers.tolist()) == wanted and state.tables.sum() == state.parent_customers
    # a table at least for each word that follows: one after all of them, but the start
    assert (states[-1].tables >= np.minimum(states[-1].customers, 1)).all() and states[-1].tables.max() >= len(per_word)


def test_probabilities_of_all_words_add_up_to_one_after_every_context(spark):
    known, other, new = "a b c d e".split(), "zz", "qq"
    held = [i for i in range(10 ** 5) if zlib.crc32(str(i).encode()) % 10 == 0]
    free = [i for i in range(100) if zlib.crc32(str(i).encode()) % 10]
    probes = [f"{p} {w}" for p in [*known, other] for w in [*known, new]] + [*known, other]
    rows = [*zip(free, ["a b a b c", "a b d", "e e a b", "c a b a"]), *zip(held, probes)]
    docs, setting = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), hpyp.Settings()
    parts = hpyp.blocks(docs, setting, 16, 10, 0)
    model = hpyp.merged(parts)
    block, = parts.where("bucket < 0").collect()
    answers = sorted(hpyp._answers(model, hpyp.train(model, setting), setting).collect(), key=lambda r: r["bucket"])
    p = 10 ** np.concatenate([hpyp.floats(r["logs"], r["size"]) for r in answers]).astype(float)
    number = hpyp.unpress(block["refs"], block["n_refs"]).astype(int)
    word, before, refs = hpyp.pairs(number, np.array(block["sizes"]), block["start"])
    assert len(p) == len(word) and ((word[refs] == number).all())
    texts = [t.split() + [None] for i, t in sorted(rows, key=lambda r: block["ids"].index(r[0]))]
    names = dict(zip(number.tolist(), [w for t in texts for w in t])) | {block["start"]: "start"}
    for context in [*known, other]:
        own = {names[w]: x for w, b, x in zip(word.tolist(), before.tolist(), p) if names[b] == context}
        assert own.keys() == {*known, new, None} and sum(own.values()) == pytest.approx(1, abs=1e-5)


@pytest.mark.parametrize("count, strength, chance, discount", [(5, 1.5, 0.3, 0.5), (4, 20.0, 0.05, 0.8), (6, 0.3, 0.9, 0.2)])
def test_seating_has_the_exact_distribution(count, strength, chance, discount):
    """Against all set partitions of the customers."""
    def partitions(n):
        if n == 0:
            yield []
            return
        for rest in partitions(n - 1):
            for k in range(len(rest)):
                yield [*rest[:k], rest[k] + 1, *rest[k + 1:]]
            yield [*rest, 1]

    odds = np.zeros(count + 1)
    for sizes in partitions(count):
        t = len(sizes)
        weight = chance ** t * np.prod([strength + discount * k for k in range(t)])
        odds[t] += weight * np.prod([np.prod([j - discount for j in range(1, s)]) for s in sizes])
    many = 60_000
    got = hpyp.seat(np.full(many, count), np.full(many, strength), np.full(many, chance), discount, 48, np.random.default_rng(1))
    assert np.bincount(got, minlength=count + 1) / many == pytest.approx(odds / odds.sum(), abs=0.01)


@pytest.mark.parametrize("count, strength, chance, discount", [
    (200, 8.0, 0.2, 0.6), (400, 300.0, 0.3, 0.7), (390, 5000.0, 0.05, 0.8), (350, 50.0, 1e-6, 0.5), (300, 40.0, 0.9, 0.3)])
def test_seating_of_large_dishes_follows_the_exact_weights(count, strength, chance, discount):
    args = np.full(4000, count), np.full(4000, strength), np.full(4000, chance), discount
    fast, slow = (hpyp.seat(*args, exact, np.random.default_rng(3)) for exact in (20, 400))
    assert fast.mean() == pytest.approx(slow.mean(), rel=0.04)
    assert fast.std() == pytest.approx(slow.std(), rel=0.15, abs=0.05)


def test_packed_numbers_come_back():
    values = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 1000, dtype=np.uint64))
    assert (hpyp.unpress_sorted(hpyp.press_sorted(values), 1000) == values).all()


def test_lm_hard_rows(hard_docs):
    rows = hpyp.score(hard_docs).collect()
    assert len(rows) == hard_docs.count() and all(np.isfinite(r["score"]) for r in rows)
    assert all(r["n_tokens"] == 1 for r in rows if r["doc_id"] in (2, 3, 4))
    assert all(r["held_out"] for r in rows if r["doc_id"] is None)
    assert hpyp.score(hard_docs.limit(0)).count() == 0
    nothing = hpyp.score(hard_docs.where("doc_id IS NULL")).collect()
    assert all(r["score"] == pytest.approx(0, abs=1e-6) and r["base_score"] == pytest.approx(0) for r in nothing)


def brute(rows, k, every):
    rows = [(i, np.array(v, float)) for i, v in rows]
    out = {}
    for q, x in rows:
        if q % every == 0:
            out[q] = sorted((float(np.sqrt(((x - y) ** 2).sum())), i) for i, y in rows if i != q)[:k]
    return out


def test_recall(spark, tables):
    vectors = tables("embeddings", "/root/testdata/sf0.1")
    want = brute([(r["vec_id"], r["embedding"]) for r in vectors.collect()], 10, 100)
    got = {}
    for r in ann.nearest(vectors).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["score"], r["vec_id"])
    assert got.keys() == want.keys()
    hits = sum(len({i for _, i in want[q]} & {i for _, i in g.values()}) for q, g in got.items())
    assert hits >= 0.95 * sum(map(len, want.values()))
    for g in got.values():
        ranked = [g[k] for k in range(1, 11)]
        assert ranked == sorted(ranked)


def test_graph_is_close_to_the_true_one(spark, tables):
    nodes = ann._classes(ann.usable(tables("embeddings")), ann.Settings())[0]
    x = {r["node"]: np.array(r["vec"]) for r in nodes.collect()}
    names, m = list(x), np.stack(list(x.values()))
    d = ((m[:, None] - m[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    near = {names[i]: {names[j] for j in np.argsort(d[i])[:10]} for i in range(len(names))}
    graph = {}
    for r in ann.neighbour_graph(nodes).collect():
        graph.setdefault(r["u"], set()).add(r["v"])
    assert all(len(v) <= ann.Settings().degree for v in graph.values())
    assert np.mean([len(near[u] & graph[u]) / 10 for u in names]) > 0.9


@pytest.mark.parametrize("factor", [100.0, 1e4, 1e200])
def test_a_few_huge_rows_leave_the_graph_of_the_others_as_it_is(spark, tables, factor):
    rows = [(r["vec_id"], [float(x) for x in r["embedding"]]) for r in tables("embeddings").collect()]
    size = len(rows[0][1])
    rows += [(10 ** 6 + i, [factor * (1 + i) if j == i else 0.0 for j in range(size)]) for i in range(3)]
    nodes = ann._classes(ann.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), ann.Settings())[0]
    x = {r["node"]: np.array(r["vec"]) for r in nodes.collect() if max(map(abs, r["vec"])) < factor}
    names, m = list(x), np.stack(list(x.values()))
    d = ((m[:, None] - m[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    near = {names[i]: {names[j] for j in np.argsort(d[i])[:10]} for i in range(len(names))}
    graph = {}
    for r in ann.neighbour_graph(nodes).collect():
        graph.setdefault(r["u"], set()).add(r["v"])
    assert len(graph) == len(names) + 3
    assert np.mean([len(near[u] & graph[u]) / 10 for u in names]) > 0.9


def test_ann_hard_rows(spark):
    rows = ([(i, [1.0, 0.0], 0) for i in range(0, 60)] + [(100, [0.0, 1.0], 0), (200, None, 1), (300, [0.0, 0.0], 1),
            (400, [float("nan"), 1.0], 1), (500, [None, 1.0], 1), (600, [1.0, 2.0, 3.0], 1), (None, [1.0, 1.0], 1), (700, [float("inf"), 0.0], 1),
            (100, [0.0, 1.0], 0)])
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    found = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(table).collect())
    assert found == ([(0, k, k) for k in range(1, 11)] + [(100, k, k - 1) for k in range(1, 11)])
    assert ann.nearest(table.limit(0)).count() == 0
    few = ann.nearest(table.where("vec_id IN (100, 3, 4)")).collect()
    assert sorted((r["query_id"], r["vec_id"]) for r in few) == [(100, 3), (100, 4)]
