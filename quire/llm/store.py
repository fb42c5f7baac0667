"""Tables written to the shared checkpoint folder, and shares of ids that fix what is learned."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.plans.session import bound_batches, checkpoint_folder


#: For rows of megabytes. Parquet's writer looks at the size of what it holds after 100 rows only, and
#: its reader takes all rows of a group at once.
LARGE_ROWS = {"parquet.block.size": str(8 << 20), "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "1",
              "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}


def keep(df: DataFrame, large_rows: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet to the shared folder and read it back.

    Cuts the lineage: a lost executor costs only the tasks that were running on it. ``large_rows``: rows may have
    megabytes, so that a task holds a few of them at a time, however many it writes or reads.
    """
    spark, schema = df.sparkSession, df.schema
    bound_batches(spark)
    path = f"{checkpoint_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **(LARGE_ROWS if large_rows else {})).parquet(path)
    return spark.read.schema(schema).parquet(path)


def remainder(key: str, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``; null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % modulus


def held_out(key: str, modulus: int, rest: int) -> Column:
    """True where the remainder is ``rest``; a row without a key is never learned from: true."""
    return F.coalesce(remainder(key, modulus) == rest, F.lit(True))


#: A draw has this many steps for each millionth, so that a share of one row in 10**15 is still drawn.
FINE = 1 << 40


def draw(key: str, seed: int) -> Column:
    """A number below 1,000,000 * FINE for each key, the same on every run."""
    coarse = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000))
    return coarse * F.lit(FINE) + F.pmod(F.xxhash64(F.col(key), F.lit(seed + 1000)), F.lit(FINE))


def cut(size: int, count: int) -> int:
    """Below it lie the draws of about ``size`` of ``count`` keys; never 0 for a ``size`` of one or more."""
    return min(1_000_000 * FINE, size * 1_000_000 * FINE // max(count, 1))


def sample_of(rows: DataFrame, key: str, size: int) -> DataFrame:
    """About ``size`` rows, chosen by a hash of the key alone: the same rows on every run."""
    count = rows.count()
    if count <= size:
        return rows
    return rows.where(draw(key, 17) < F.lit(cut(size, count)))


def labelled(docs: DataFrame, labels: DataFrame, label: str, modulus: int, rest: int,
             size: int) -> DataFrame:
    """(text and the other columns of ``docs``, _label) of about ``size`` labelled rows.

    A doc_id with two different labels, or with a null one, teaches nothing. The labels
    drawn are bounded by ``size``, so they are broadcast; the texts are not moved.
    """
    bound_batches(docs.sparkSession)
    own = (labels.select("doc_id", F.col(label).cast("int").alias("_label"))
           .where(F.col("_label").isin(0, 1) & ~held_out("doc_id", modulus, rest))
           .groupBy("doc_id").agg(F.min("_label").alias("_label"), F.max("_label").alias("_other"))
           .where("_label = _other").drop("_other"))
    return docs.join(F.broadcast(sample_of(own, "doc_id", size)), "doc_id")
