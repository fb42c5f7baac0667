"""Ordered work inside groups of any size.

A plain window puts a whole group into one task. One book may hold a third of
all pages, so every helper here has two exact ways:

* ``wide=False``: the plain window, for groups known to fit one task;
* ``wide=True``: the group is cut into chunks (by an integer key, or by a range
  sort when the order is composite), each chunk is worked on alone, and a small
  table with one row per chunk carries the totals across chunk borders;
* ``wide=None``: measure the largest group with one pre-aggregated count, then
  choose.

Operators that work on each group by itself go through :func:`by_width`, which sends only the
hot groups the wide way.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.plans.session import fix

WIDE_ROWS = 4_000_000
CHUNK_KEYS = 1 << 16
SALTS = 32
TASK_ROWS = 100_000
DEAL_FROM = 2_000_000


def is_wide(df: DataFrame, group: Sequence[str], limit: int | None = None) -> bool:
    """True when some group holds more rows than one task should sort."""
    bound = WIDE_ROWS if limit is None else limit
    counts = df.groupBy(*group).agg(F.count("*").alias("_n"))
    return not counts.where(F.col("_n") > bound).isEmpty()


def settle_width(df: DataFrame, group: Sequence[str], wide: bool | None) -> bool:
    """``wide`` itself, or the measured answer; operators of several steps ask once."""
    return is_wide(df, group) if wide is None else wide


@dataclass(frozen=True)
class Width:
    """``wide`` for :func:`settle_width` that also knows how many ``rows`` there are in all."""

    wide: bool
    rows: int

    def __bool__(self) -> bool:
        return self.wide


def dealt(df: DataFrame, keys: Sequence[str], wide: bool | Width | None) -> DataFrame:
    """``df`` dealt by ``keys`` over tasks of about ``TASK_ROWS`` rows, when ``wide`` tells their number.

    The plain windows and joins that follow on these keys keep this dealing, so the memory of a
    task is bounded by its rows, however large the input. Below ``DEAL_FROM`` rows, and the wide
    way, the session's own number of partitions does.
    """
    if not isinstance(wide, Width) or wide.wide or wide.rows < DEAL_FROM:
        return df
    return df.repartition(-(-wide.rows // TASK_ROWS), *keys)


def by_width(df: DataFrame, group: Sequence[str], wide: bool | None,
             work: Callable[[DataFrame, bool], DataFrame]) -> DataFrame:
    """``work(rows, wide)`` on all groups; without a given ``wide``, the groups of more rows than
    one task should sort go the wide way and all others the plain one.

    One pre-aggregated count finds the hot groups. They are few, since each has over
    ``WIDE_ROWS`` rows, so their names are sent to all tasks and no row is moved to tell the two
    kinds apart; the checkpoints of the wide way hold rows of hot groups only.
    """
    if wide is not None:
        return work(df, wide)
    group = list(group)
    sizes = fix(df.groupBy(*group).agg(F.count("*").alias("_n")))
    hot = sizes.where(F.col("_n") > WIDE_ROWS).select(*[F.col(g).alias(f"__{g}") for g in group])
    rows = sizes.where(F.col("_n") <= WIDE_ROWS).agg(F.coalesce(F.sum("_n"), F.lit(0))).head()[0]
    plain = Width(False, rows)
    if hot.isEmpty():
        return work(dealt(df, group[:1], plain), False)
    same = [df[g].eqNullSafe(hot[f"__{g}"]) for g in group]
    few = F.broadcast(hot)
    cold = dealt(df.join(few, same, "left_anti"), group[:1], plain)
    return work(cold, False).unionByName(work(df.join(few, same, "left_semi"), True))


def _chunk(key: str) -> Column:
    return F.floor(F.col(key) / F.lit(CHUNK_KEYS))


def number_rows(df: DataFrame, group: Sequence[str], order: Sequence[Column | str],
                name: str, wide: bool | None = None) -> DataFrame:
    """1-based row number per group; ``order`` must be a total order.

    Wide form: one range sort over (group, order), which spreads a hot group over
    many partitions, fixed by a reliable checkpoint so that both readers see the
    same row ids; then one offset per (group, partition).
    """
    group = list(group)
    if not settle_width(df, group, wide):
        df = dealt(df, group[:1], wide)
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    rows = fix(df.sort(*group, *order)
               .withColumn("__id", F.monotonically_increasing_id())
               .withColumn("__part", F.shiftright("__id", 33)))
    spans = rows.groupBy(*group, "__part").agg(
        F.min("__id").alias("__low"), F.count("*").alias("__size"))
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("__before", F.coalesce(F.sum("__size").over(before), F.lit(0))).drop("__size")
    return (rows.join(spans, [*group, "__part"])
            .withColumn(name, (F.col("__id") - F.col("__low") + F.col("__before") + 1).cast("int"))
            .drop("__id", "__part", "__low", "__before"))


def running(df: DataFrame, group: Sequence[str], key: str, values: dict[str, tuple[str, Column]],
            wide: bool | None = None, order: Sequence[Column | str] | None = None) -> DataFrame:
    """Running totals up to and with this row.

    ``values`` maps a new column to ("sum" or "max", expression); ``key`` is an
    integer, unique per group. When ``key`` is the row number of an ``order``, the
    plain form sorts by that order, which the rows already have.
    """
    group = list(group)
    aggs = {"sum": F.sum, "max": F.max}
    if not settle_width(df, group, wide):
        df = dealt(df, group[:1], wide)
        w = Window.partitionBy(*group).orderBy(*(order or [key])).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({name: aggs[how](value).over(w) for name, (how, value) in values.items()})
    df = fix(df.withColumns({f"__in_{name}": value for name, (_, value) in values.items()})
             .withColumn("__chunk", _chunk(key)))
    inside = Window.partitionBy(*group, "__chunk").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*group).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*group, "__chunk").agg(
        *[aggs[how](f"__in_{name}").alias(f"__t_{name}") for name, (how, _) in values.items()])
    carry = totals.select(*group, "__chunk", *[
        aggs[how](f"__t_{name}").over(earlier).alias(f"__c_{name}") for name, (how, _) in values.items()])
    out = (df.withColumns({f"__l_{name}": aggs[how](f"__in_{name}").over(inside)
                           for name, (how, _) in values.items()})
           .join(carry, [*group, "__chunk"]))
    for name, (how, _) in values.items():
        local, before = F.col(f"__l_{name}"), F.col(f"__c_{name}")
        both = F.coalesce(before + local, local, before) if how == "sum" else F.greatest(before, local)
        out = out.withColumn(name, both).drop(f"__in_{name}", f"__l_{name}", f"__c_{name}")
    return out.drop("__chunk")


def last_seen(df: DataFrame, group: Sequence[str], key: str, value: str, name: str,
              wide: bool | None = None, order: Sequence[Column | str] | None = None) -> DataFrame:
    """Last non-null ``value`` on an earlier row; ``key`` as in :func:`running`."""
    group = list(group)
    if not settle_width(df, group, wide):
        df = dealt(df, group[:1], wide)
        w = Window.partitionBy(*group).orderBy(*(order or [key])).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(name, F.last(value, ignorenulls=True).over(w))
    df = fix(df.withColumn("__chunk", _chunk(key)))
    inside = Window.partitionBy(*group, "__chunk").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*group).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    final = F.max_by(value, F.when(F.col(value).isNotNull(), F.col(key)))
    carry = (df.groupBy(*group, "__chunk").agg(final.alias("__final"))
             .withColumn("__carry", F.last("__final", ignorenulls=True).over(earlier)).drop("__final"))
    return (df.withColumn("__local", F.last(value, ignorenulls=True).over(inside))
            .join(carry, [*group, "__chunk"])
            .withColumn(name, F.coalesce("__local", "__carry"))
            .drop("__chunk", "__local", "__carry"))


def next_seen(df: DataFrame, group: Sequence[str], key: str, value: str, name: str,
              wide: bool | None = None) -> DataFrame:
    """First non-null ``value`` on a later row; mirror of :func:`last_seen`."""
    mirrored = df.withColumn("__mirror", -F.col(key).cast("long"))
    return last_seen(mirrored, group, "__mirror", value, name, wide).drop("__mirror")


def attach(df: DataFrame, small: DataFrame, group: Sequence[str], spread: str,
           wide: bool | None = None, how: str = "inner") -> DataFrame:
    """Join one-row-per-group facts to their rows.

    Wide form: the facts are repeated ``SALTS`` times and the rows of a hot group
    are salted by the hash of ``spread``, so no task receives a whole hot group.
    """
    group = list(group)
    if not settle_width(df, group, wide):
        return df.join(small, group, how)
    salted = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return (df.withColumn("__salt", F.pmod(F.hash(spread), F.lit(SALTS)))
            .join(salted, [*group, "__salt"], how).drop("__salt"))


def with_totals(df: DataFrame, group: Sequence[str], totals: dict[str, Column], spread: str,
                wide: bool | None = None) -> DataFrame:
    """Add aggregates over the whole group to each of its rows.

    Plain form: window aggregates, which share the shuffle of later windows on the
    same group. Wide form: a partial aggregate, joined back with salt.
    """
    group = list(group)
    if not settle_width(df, group, wide):
        df = dealt(df, group[:1], wide)
        return df.withColumns({name: value.over(Window.partitionBy(*group)) for name, value in totals.items()})
    df = fix(df)
    facts = df.groupBy(*group).agg(*[value.alias(name) for name, value in totals.items()])
    return attach(df, facts, group, spread, True)
