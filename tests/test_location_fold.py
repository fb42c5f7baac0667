"""The fold in pieces equals the fold row by row."""

import random

import pytest

from quire.operators import location_fold
from quire.operators.learner import LEARNER_COLUMNS, REGIONS, Learner

HITS = "book_id string, seq long, location string, hit boolean, number_type string, extra int"


def drifting(seed, rows, stay):
    """A book whose numbers sit at a few places and wander on about every ``stay`` rows."""
    draw, place, out = random.Random(seed), 0, []
    for seq in range(rows):
        if draw.random() < 1 / stay:
            place = draw.randrange(len(REGIONS))
        at = place if draw.random() < 0.7 else draw.randrange(len(REGIONS))
        out.append((seq, REGIONS[at], draw.random() < 0.7, draw.choice(["roman", "arabic", "arabic", None])))
    return out


def one_by_one(rows):
    books = {}
    for book, _, location, hit, kind, _ in sorted(rows, key=lambda r: (r[0], r[1])):
        books.setdefault(book, Learner()).add(location, hit, kind)
    return sorted(map(str, (tuple(state.row(book)) for book, state in books.items())))


def in_pieces(spark, rows, parts):
    found = location_fold.location_learner(spark.createDataFrame(rows, HITS).repartition(3), parts)
    assert found.columns == LEARNER_COLUMNS
    return sorted(str(tuple(r)) for r in found.collect())


@pytest.mark.parametrize("stay", [4, 40, 900])
def test_hot_book_over_many_tasks(spark, stay):
    rows = [("hot", *r, 1) for r in drifting(stay, 3000, stay)]
    for k in range(40):
        rows += [(f"b{k:02}", *r, 1) for r in drifting(1000 + k, 5 * k + 1, stay)]
    rows += [("zz", *r, 1) for r in drifting(7, 1500, stay)]
    assert in_pieces(spark, rows, 13) == one_by_one(rows)
    assert in_pieces(spark, rows, 1) == one_by_one(rows)


def test_hot_book_lies_in_many_tasks(spark):
    rows = [("hot", *r, 1) for r in drifting(5, 3000, 40)] + [(f"b{k}", *r, 1) for k in range(60) for r in drifting(k, 50, 40)]
    found, turns = location_fold.pieces(spark.createDataFrame(rows, HITS), 12)
    sizes = [r["n"] for r in found.where("book_id = 'hot'").selectExpr("aggregate(tried, 0L, (s, x) -> s + x) AS n").collect()]
    assert len(sizes) >= 5 and max(sizes) < 1000 and sum(sizes) == 3000
    assert turns <= 12


def test_pieces_of_any_length():
    rows = drifting(3, 700, 15)
    whole = Learner()
    for _, location, hit, kind in rows:
        whole.add(location, hit, kind)
    for cut in (1, 2, 9, 64, 699):
        state, types = location_fold.Start(), [(0, False)] * 2
        for low in range(0, len(rows), cut):
            piece = location_fold.Piece(state)
            piece.add(*encoded(rows[low:low + cut]))
            summary = piece.summary("b", 0, True, True)
            state, types = state.after(summary), [location_fold.after_piece(*types[k], summary, k) for k in range(2)]
        assert types == [(whole.progress[k], whole.learned[k]) for k in ("roman", "arabic")]
        assert REGIONS[state.location] == whole.location
        assert state.done.tolist() == whole.table[:, 0].tolist() and state.tried.tolist() == whole.table[:, 1].tolist()


def encoded(rows):
    import numpy as np

    kinds = {"roman": 0, "arabic": 1}
    return (np.array([REGIONS.index(r[1]) for r in rows]), np.array([r[2] for r in rows], bool),
            np.array([kinds.get(r[3], -1) for r in rows]))


def test_nulls_unknown_places_ties_and_no_rows(spark):
    rows = [("b", 1, "top_left", True, "roman", 1), ("b", 1, "top_left", True, "roman", 1), ("b", 2, None, True, "roman", 1),
            ("b", 3, "nowhere", True, "roman", 1), ("b", None, "top_right", None, None, 1), (None, 4, "top_left", True, "roman", 1)]
    assert in_pieces(spark, rows, 4) == [str(("b", 3, 2, 0, False, False, "top_left", None, 0))]
    assert in_pieces(spark, [], 4) == []
