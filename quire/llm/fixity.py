"""Fixity audit of WARC replicas by Merkle trees over ordered offset ranges.

Each replica is a table of records (archive, offset, length, content). A record's leaf is the
SHA-256 of its content; a range of ``leaf_bytes`` of an archive hashes the ordered offsets,
lengths and hashes of the records that begin in it; ``fan_out`` ranges hash into one above, up
to one root per archive. Two replicas compare roots first and then descend only under nodes
that differ, so a sound archive costs one comparison and damage is found in as many steps as
the tree is high. A missing record changes its own range alone, because offsets are those of
the archive's index.

All of it is DataFrame operations. A node reads at most ``fan_out`` children, a range the records
of ``leaf_bytes`` bytes.

Defined results: null content hashes as missing content and equals only itself; repeated
records of one offset hash together and are reported once; null archives form an
archive of their own; two empty replicas agree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import store


@dataclass(frozen=True)
class Settings:
    leaf_bytes: int = 1 << 16
    fan_out: int = 16
    archive_ids: int = 4096


def records(pages: DataFrame, setting: Settings = Settings()) -> DataFrame:
    """WARC response records of pages: archive, offset, length, page_id, content.

    An archive holds ``archive_ids`` consecutive page ids, so its size is bounded; a page without
    an id gets an archive by its hash. Offsets follow page id, then url and content.
    """
    from pyspark.sql import Window

    body = F.coalesce("html", F.lit(""))
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"),
                    F.coalesce(F.col("page_id").cast("string"), F.lit("none")),
                    F.lit(">\r\nWARC-Target-URI: "), F.coalesce("url", F.lit("")),
                    F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    order = Window.partitionBy("archive").orderBy("page_id", "_mark").rowsBetween(Window.unboundedPreceding, -1)
    made = (pages.select("page_id", F.concat(head, body, F.lit("\r\n\r\n")).cast("binary").alias("content"))
            .withColumn("_mark", F.xxhash64("content")).withColumn("length", F.octet_length("content").cast("long"))
            .withColumn("archive", F.floor(F.coalesce("page_id", "_mark") / setting.archive_ids)))
    index = (made.select("archive", "page_id", "_mark", "length")
             .withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0))))
    # Only the index is sorted and windowed; contents are joined back by id and mark. Rows that
    # repeat id and content are one record each, at the first of their offsets and after it.
    first = index.groupBy("archive", "page_id", "_mark").agg(F.min("offset").alias("_at"), F.count("*").alias("_n"))
    found = made.join(first.withColumnsRenamed({"archive": "_a", "page_id": "_p", "_mark": "_m"}),
                      F.col("archive").eqNullSafe(F.col("_a")) & F.col("page_id").eqNullSafe(F.col("_p")) & (F.col("_mark") == F.col("_m")))
    return found.select("archive", F.col("_at").alias("offset"), "length", "page_id", "content")


def _leaves(replica: DataFrame, setting: Settings) -> DataFrame:
    """archive, offset, length, hash, range of every record, written once; no content."""
    return store.keep(replica.select(
        F.coalesce(F.col("archive").cast("string"), F.lit("")).alias("archive"), "offset", "length",
        F.coalesce(F.sha2(F.col("content"), 256), F.lit("missing")).alias("hash"),
        F.floor(F.col("offset") / setting.leaf_bytes).alias("node")))


def _digest(items: Column) -> Column:
    return F.sha2(F.to_json(F.array_sort(items)), 256)


def tree(leaves: DataFrame, levels: int, setting: Settings) -> list[DataFrame]:
    """Node tables (archive, node, hash) from the ranges up to the roots."""
    items = F.collect_list(F.struct("offset", "length", F.col("hash").alias("h")))
    out = [store.keep(leaves.groupBy("archive", "node").agg(_digest(items).alias("hash")))]
    for _ in range(levels):
        above = out[-1].withColumn("_child", F.col("node")).withColumn("node", F.floor(F.col("node") / setting.fan_out))
        items = F.collect_list(F.struct(F.col("_child").alias("c"), F.col("hash").alias("h")))
        out.append(store.keep(above.groupBy("archive", "node").agg(_digest(items).alias("hash"))))
    return out


def _differing(left: DataFrame, right: DataFrame) -> DataFrame:
    """(archive, node) whose hash is not the same on both sides, or is on one side only."""
    both = left.join(right.withColumnRenamed("hash", "_other"), ["archive", "node"], "full")
    return both.where(~F.col("hash").eqNullSafe(F.col("_other"))).select("archive", "node")


def audit(left: DataFrame, right: DataFrame, setting: Settings = Settings()) -> DataFrame:
    """archive, offset, length, kind of every damaged record: missing (not on the right), extra
    (not on the left), changed. ``archive`` is text; lengths are the left's where it has one."""
    a, b = _leaves(left, setting), _leaves(right, setting)
    highest = a.select("node").union(b.select("node")).agg(F.max("node")).first()[0] or 0
    levels = 0
    while highest > 0:
        highest, levels = highest // setting.fan_out, levels + 1
    own, other = tree(a, levels, setting), tree(b, levels, setting)
    bad = store.keep(_differing(own[levels], other[levels]))
    for k in range(levels - 1, -1, -1):
        above = F.floor(F.col("node") / setting.fan_out)
        parents = bad.withColumnRenamed("node", "_up")
        under = [side[k].withColumn("_up", above).join(parents, ["archive", "_up"], "left_semi").drop("_up")
                 for side in (own, other)]
        bad = store.keep(_differing(*under))
    one, two = (side.join(bad, ["archive", "node"], "left_semi").groupBy("archive", "offset").agg(
        F.sort_array(F.collect_list(F.struct("length", "hash"))).alias(name)) for side, name in ((a, "_l"), (b, "_r")))
    both = one.join(two, ["archive", "offset"], "full").where(~F.col("_l").eqNullSafe(F.col("_r")))
    kind = F.when(F.col("_r").isNull(), "missing").when(F.col("_l").isNull(), "extra").otherwise("changed")
    return both.select("archive", "offset", F.coalesce(F.get("_l", F.lit(0)), F.get("_r", F.lit(0))).getField("length").alias("length"),
                       kind.alias("kind"))


def damaged(replica: DataFrame) -> DataFrame:
    """A replica with planted damage, for audits over given tables: of every 101 page ids, one
    record has a byte overwritten, one has lost its last byte, and one is gone."""
    turn = F.pmod(F.col("page_id") * 7919, F.lit(101))
    middle = F.expr("concat(substring(content, 1, length div 2), unhex('FF'), substring(content, length div 2 + 2))")
    short = F.expr("substring(content, 1, octet_length(content) - 1)")
    return (replica.where(turn.isNull() | (turn != 11))
            .withColumn("content", F.when(turn == 3, middle).when(turn == 7, short).otherwise(F.col("content"))))
