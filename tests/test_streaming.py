"""Batch and stream give the same state and windows."""

import pytest
from pyspark.sql import functions as F

from checks.history import f_hits, f_sessions
from quire.operators import history, learner, location_fold
from quire.streaming import jobs
from tests.conftest import SMALL


def replay(spark, frame, folder, parts, order):
    """Write ``frame`` as ``parts`` files in order, so a file stream reads them one per batch."""
    cuts = frame.stat.approxQuantile(order, [k / parts for k in range(1, parts)], 0.0)
    low = None
    for cut in [*cuts, None]:
        part = frame
        if low is not None:
            part = part.where(F.col(order) > low)
        if cut is not None:
            part = part.where(F.col(order) <= cut)
        part.coalesce(1).write.mode("append").parquet(folder)
        low = cut
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_learner_stream_equals_batch(spark, tmp_path):
    _rocks(spark)
    hits = f_hits(spark, SMALL).select("book_id", "seq", "location", "hit", "number_type")
    stream = replay(spark, hits, str(tmp_path / "hits"), 3, "seq")
    query = (jobs.learner_stream(stream).writeStream.format("memory").queryName("learned").outputMode("update")
             .option("checkpointLocation", str(tmp_path / "state")).start())
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    last = spark.table("learned").groupBy("book_id").agg(F.max_by(F.struct("*"), "events").alias("r")).select("r.*")
    batch = location_fold.location_learner(hits)
    assert sorted(map(str, last.select(batch.columns).collect())) == sorted(map(str, batch.collect()))


def _rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def test_reordered_stream_equals_batch(spark, tmp_path):
    """Batches shuffled within the watermark; the rows behind it come out beside the states."""
    _rocks(spark)
    columns = ["book_id", "seq", "location", "hit", "number_type", "ts"]
    # event ids a second apart
    hits = f_hits(spark, SMALL).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq"))).select(columns)
    top = hits.agg(F.max("seq")).first()[0]
    folder, out = str(tmp_path / "hits"), str(tmp_path / "out")
    # row k goes to the batch of its own part or the one after: at most two parts behind
    part = F.floor(F.col("seq") * 6 / (top + 1)) + F.when(F.hash("seq") % 2 == 0, 1).otherwise(0)
    dealt = hits.withColumn("_part", part).cache()
    long = 2**60 + 1  # not a double
    late = spark.createDataFrame([("1", long, "top_left", True, "roman")], "book_id string, seq long, location string, hit boolean, number_type string")
    late = late.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_003)))
    nowhere = late.withColumns({"ts": F.lit(None).cast("timestamp"), "seq": F.lit(None).cast("long")})
    beyond = late.withColumns({"book_id": F.lit("end"), "ts": F.timestamp_seconds(F.lit(1_800_000_000))})
    steps = [dealt.where(F.col("_part") == k).select(columns).orderBy(F.rand(k)) for k in range(7)]
    steps += [beyond, late.unionByName(nowhere), nowhere, nowhere.withColumn("book_id", F.lit("end"))]
    width = f"{top // 6 * 2 + 60} seconds"
    spark.createDataFrame([], hits.schema).write.parquet(folder)
    stream = spark.readStream.schema(hits.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    updates = jobs.reordering_learner_stream(stream, width, "30 seconds")
    query = jobs.write_learner(updates, out, str(tmp_path / "state")).start()
    try:
        for rows in steps:
            rows.coalesce(1).write.mode("append").parquet(folder)
            query.processAllAvailable()
    finally:
        query.stop()
    written = spark.read.parquet(out)
    batch = location_fold.location_learner(hits.drop("ts"))
    found = jobs.latest_learners(written).select(batch.columns)
    assert sorted(map(str, found.collect())) == sorted(map(str, batch.collect()))
    aside = [(r.outcome, r.book_id, r.seq, r.location) for r in jobs.set_aside(written).collect()]
    assert sorted(aside, key=str) == sorted([("late", "1", long, "top_left"), ("unplaced", "end", None, "top_left"),
                                             *[("unplaced", "1", None, "top_left")] * 2], key=str)
    dealt.unpersist()


def test_shift_is_learned():
    state = learner.Learner()
    for _ in range(10):
        state.add("top_left", True, "roman")
    assert (state.location, state.kind, state.learned["roman"]) == ("top_left", "roman", True)
    for _ in range(3):
        state.add("top_right", True, "roman")
    assert state.moves == 1 and not state.learned["roman"] and state.progress["roman"] == 8
    standing = dict(zip(learner.REGIONS, state.standing()))
    assert abs(standing["top_right"] - 1.2) < 1e-9 and abs(standing["top_left"] - 0.7) < 1e-9
    assert state.location == "top_right"


def test_session_windows_stream_equals_batch(spark, tmp_path):
    sessions = f_sessions(spark, SMALL).select(
        "session_id", F.col("ts").cast("timestamp").alias("ts"), "pages", "seconds", "success", "user_id")
    stream = replay(spark, sessions, str(tmp_path / "sessions"), 3, "session_id")
    query = (jobs.session_stream(stream).writeStream.format("memory").queryName("windows").outputMode("update")
             .option("checkpointLocation", str(tmp_path / "state")).start())
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    seen = spark.table("windows").groupBy("window_start").agg(F.max("sessions").alias("sessions"), F.max("pages").alias("pages"))
    batch = history.session_windows(sessions).select("window_start", "sessions", "pages")
    assert sorted(map(str, seen.collect())) == sorted(map(str, batch.collect()))


def test_each_file_once(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-02 00:00:00"), ("b", "2024-01-02 00:00:00")],
                                 "content_key string, created string").withColumn("created", F.to_timestamp("created"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = (jobs.new_files(stream).writeStream.format("memory").queryName("files").outputMode("append")
             .option("checkpointLocation", str(tmp_path / "state")).start())
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert sorted(r.content_key for r in spark.table("files").collect()) == ["a", "b"]


@pytest.mark.parametrize("gap", ["30 minutes"])
def test_user_sessions_batch(spark, gap):
    rows = jobs.user_sessions(f_sessions(spark, SMALL), gap)
    assert rows.agg(F.sum("sessions")).first()[0] == 1000
