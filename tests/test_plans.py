"""The wide forms answer like the SQL, and no plan holds a nested-loop or Cartesian join."""

import pytest

import __spark_entry__ as entry
from checks import fixtures as fx
from checks.compare import compare, duck
from tests.conftest import SMALL

WIDE = ["order_pages", "validate_order", "scheme_transitions", "sequence_profile", "text_continuity",
        "blank_removal", "natural_order", "duplicate_pages", "output_names"]


@pytest.mark.parametrize("name", WIDE)
def test_wide_form(spark, tiny_chunks, monkeypatch, name):
    monkeypatch.setattr(fx, "wide", lambda *_: True)
    monkeypatch.setattr("quire.plans.ranks.CHUNK_KEYS", 64)
    ok, note = compare(spark, duck(SMALL), SMALL, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, note


def test_no_nested_loops(spark):
    bad = {}
    for name, query in entry.queries().items():
        if name == "corner_classifier":  # fits a model to build its plan
            continue
        plan = query(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        hits = [w for w in ("CartesianProduct", "BroadcastNestedLoopJoin") if w in plan]
        if hits:
            bad[name] = hits
    assert not bad
