"""The memory read from its import log, against the same imports replayed on dictionaries."""

from itertools import permutations

import pytest
from pyspark.sql import functions as F

from quire.operators import memory

ROWS = "row long, section string, name string, key string, value string"
IMPORTS = {
    1: ("merge", "all", [(0, "corrections", None, "p1", "a"), (1, "patterns", "kind", "k", "old"), (2, "preferences", None, "x", "1")]),
    2: ("merge", "all", [(0, "corrections", None, "p1", "a"), (1, "patterns", "kind", "k", "new"), (2, "patterns", "kind", None, "n"),
                         (3, "preferences", None, "x", "2"), (4, "preferences", None, "x", "3")]),
    3: ("replace", "all", [(0, "corrections", None, None, "b"), (1, "patterns", "kind", "k", "third")]),
    4: ("clear", "patterns", []),
}


def replayed(imports):
    kept, seen = {}, []
    for number, (mode, section, rows) in sorted(imports.items()):
        if mode == "replace":
            kept, seen = {}, []
        if mode == "clear":
            kept = {k: v for k, v in kept.items() if section not in ("all", k[0])}
            seen = [] if section in ("all", "corrections") else seen
        for row, part, name, key, value in rows:
            if part == "corrections":
                seen.append((number, row, name, key, value))
            else:
                kept[(part, name, key)] = value
    return sorted(((*k, v) for k, v in kept.items()), key=str), sorted(seen, key=str)


def logged(spark, number, mode, section, rows):
    if mode == "clear":
        return memory.mark(spark, number, mode, section)
    return memory.import_batch(spark.createDataFrame(rows, ROWS), number, mode)


def state(log):
    return (sorted(map(tuple, memory.remembered(log).collect()), key=str),
            sorted(map(tuple, memory.corrections(log).collect()), key=str))


@pytest.mark.parametrize("modes", [
    {}, {3: ("merge", "all")}, {4: ("clear", "all")}, {4: ("clear", "corrections")}, {2: ("replace", "all"), 3: ("merge", "all")},
    {4: ("replace", "all")}])
def test_state_is_the_replay(spark, modes):
    imports = {n: (*modes.get(n, v[:2]), v[2]) for n, v in IMPORTS.items()}
    log = None
    for number, entry in imports.items():
        part = logged(spark, number, *entry)
        log = part if log is None else log.unionByName(part)
    assert state(log) == replayed(imports)


def test_order_of_writing_and_repeats_change_nothing(spark, tmp_path):
    expected = replayed(IMPORTS)
    for k, order in enumerate(list(permutations(IMPORTS))[::5]):
        folder = str(tmp_path / str(k))
        for number in order:
            logged(spark, number, *IMPORTS[number]).coalesce(1).write.mode("append").parquet(folder)
        logged(spark, order[0], *IMPORTS[order[0]]).where("row <> 1").coalesce(1).write.mode("append").parquet(folder)
        assert state(spark.read.parquet(folder)) == expected


def test_an_empty_import_replaces_and_an_empty_log_is_empty(spark):
    empty = spark.createDataFrame([], ROWS)
    first = logged(spark, 1, *IMPORTS[1])
    assert state(first.unionByName(memory.import_batch(empty, 2, "replace"))) == ([], [])
    assert state(first.unionByName(memory.import_batch(empty, 2))) == replayed({1: IMPORTS[1]})
    assert state(spark.createDataFrame([], memory.LOG)) == ([], [])
    with pytest.raises(ValueError):
        memory.mark(spark, 1, "forget")


def test_newest_examples_of_each_type(spark):
    rows = spark.range(400).select(
        F.when(F.col("id") % 4 > 0, "minor").alias("correction_type"), F.lit(1).alias("position_change"), F.lit(0.5).alias("confidence"),
        F.when(F.col("id") != 399, (F.col("id") % 10).cast("string")).alias("corrected_at"), F.col("id").alias("seq"))
    found = {r.correction_type: r for r in memory.correction_patterns(rows, 7).collect()}
    for kind, count in (("minor", 300), (None, 100)):
        ids = [n for n in range(400) if (n % 4 > 0) == (kind is not None)]
        newest = sorted(ids, key=lambda n: (n == 399, -(n % 10), -n))[:7]
        assert found[kind].corrections == count and [e.seq for e in found[kind].examples] == newest
