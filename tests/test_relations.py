"""Edges counted without listing pairs, against all pairs of a small book."""

import random

import pytest
from pyspark.sql import functions as F

from quire.functions import text as t
from quire.operators import content as c
from quire.plans import ranks


def library(spark):
    """A book whose pages repeat few words and headings, with copies, a page without words and one word on every page."""
    draw = random.Random(5)
    rows = []
    for book, count in (("hot", 90), ("cold", 9), ("one", 1)):
        for page in range(count):
            words = ["river"] + [draw.choice(["stone", "bridge", "water", "valley", "mill", "forest"]) for _ in range(draw.randint(1, 7))]
            heads = [f"Chapter {draw.randint(1, 4)}" for _ in range(draw.randint(0, 3))]
            cited = [f"see page {draw.randint(1, count + 2)}"] if draw.random() < 0.4 else []
            text = "" if page == 4 else "\n".join([*heads, " ".join([*words, *cited])])
            rows.append((book, page, text))
    # copies of a page
    rows += [("hot", 90 + k, rows[2][2]) for k in range(6)]
    return spark.createDataFrame(rows, "book_id string, scan_index int, full_text string")


def grouped(rows, *fields):
    found: dict = {}
    for row in rows:
        found.setdefault(row.book_id, {}).setdefault(row.scan_index, []).append(tuple(row[f] for f in fields))
    return found


def brute(pages, counted):
    """(relation, book) -> (edges, strong edges), one look at every pair."""
    out: dict = {}

    def add(relation, book, strong):
        edges, high = out.get((relation, book), (0, 0))
        out[(relation, book)] = (edges + 1, high + strong)

    words = {(r.book_id, r.scan_index): r for r in t.boundary_words(pages).collect()}
    heads = grouped(t.headings(pages).where("heading_number > 0").collect(), "heading_type", "heading_number")
    cites = grouped(t.references(pages).where("referenced_number IS NOT NULL").collect(), "referenced_number")
    sets = {(r.book_id, r.scan_index): set(r.words) for r in c.word_sets(pages).collect()}
    for book, size in counted.items():
        for a in range(size):
            for b in range(a + 1, size):
                last, first = words[book, a].last_words[::-1], words[book, b].first_words
                k = min(5, len(last), len(first))
                if k:
                    add("continuation", book, 2 * sum(x == y for x, y in zip(last[:k], first[:k], strict=True)) > k)
                later = heads.get(book, {}).get(b, [])
                if any((kind, number + 1) in later for kind, number in heads.get(book, {}).get(a, [])):
                    add("heading_sequence", book, True)
                if (b + 1,) in cites.get(book, {}).get(a, []) or (a + 1,) in cites.get(book, {}).get(b, []):
                    add("reference", book, False)
                x, y = sets.get((book, a), set()), sets.get((book, b), set())
                if x and y and len(x & y) / len(x | y) >= 0.3:
                    add("similar", book, False)
    return out


@pytest.mark.parametrize("wide", [False, True])
def test_counts_are_those_of_all_pairs(spark, monkeypatch, wide):
    monkeypatch.setattr(ranks, "CHUNK_KEYS", 16)
    pages = library(spark).cache()
    found = {(r.relation, r.book_id): (r.edges, r.strong_edges) for r in c.relation_edges(pages, wide).collect()}
    sizes = {r.book_id: r["count"] for r in pages.groupBy("book_id").count().collect()}
    assert found == brute(pages, sizes)
    assert {relation for relation, _ in found} == {"continuation", "heading_sequence", "reference", "similar"}
    assert found["continuation", "hot"][1] > 0
    pages.unpersist()


def test_no_pages_no_edges(spark):
    empty = library(spark).where(F.lit(False))
    assert c.relation_edges(empty, False).collect() == []
