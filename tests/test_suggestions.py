"""Suggested positions on odd names, held against a plain loop over all pairs."""

import random
import re
from collections import defaultdict

from quire.operators import history


def _stem(name):
    return re.sub(r"(.)\.[^.]*$", r"\1", name).lower()


def _similar(page, correction):
    one, other = _stem(page[1])[:5], _stem(correction[0])[:5]
    size = min(len(one), len(other))
    numbers = [re.search("[0-9]+", _stem(n)) for n in (page[1], correction[0])]
    near = all(numbers) and abs(int(numbers[0].group()) - int(numbers[1].group())) <= 3
    return (size > 0 and one[:size] == other[:size]) or near or (page[2] is not None and abs(page[2] - correction[1]) <= 2)


def test_all_pairs(spark, capsys):
    draw = random.Random(5)
    names = ["v1.png", "v12.png", "v123.png", "Page_001.jpg", "Page_2.tif", "scan7.tif", "cover.png", "a.b", "x", "7.jpg", "v.png"]
    pages = [(k, draw.choice(names), draw.choice([None, *range(1, 30)])) for k in range(60)]
    corrections = [(draw.choice(names), draw.randint(1, 30), draw.randint(-4, 4), k) for k in range(300)]
    found = history.suggest_positions(
        spark.createDataFrame(pages, "page_id long, page_name string, position int"),
        spark.createDataFrame(corrections, "page_name string, original_position int, position_change int, seq long"))
    expected = {}
    for page in pages:
        counts, seen = defaultdict(int), {}
        for c in corrections:
            if _similar(page, c):
                counts[c[2]] += 1
                seen.setdefault(c[2], c[3])
        if sum(counts.values()) >= 3:
            best = min(counts, key=lambda change: (-counts[change], seen[change]))
            expected[page[0]] = (sum(counts.values()), None if page[2] is None else page[2] + best)
    assert {r.page_id: (r.similar, r.suggested) for r in found.collect()} == expected
    # a page is unfolded once, by the numbers around it, not for every mix of conditions
    capsys.readouterr()
    found.explain("simple")
    assert capsys.readouterr().out.count("Generate explode") <= 12  # 32 before
