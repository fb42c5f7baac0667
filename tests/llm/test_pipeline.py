import zlib

import corpus_pipeline
from quire.llm import decontam, neardup, packing, quality, queries, store, toxicity

from .conftest import SMALL


def test_every_stage_decides_on_what_the_one_before_kept(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels, items = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("labels", "benchmark"))
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        after = {r["doc_id"] for r in out.select("doc_id").collect()}
        if name == "toxicity":
            want = {r["doc_id"] for r in toxicity.toxicity(docs, labels).collect() if not r["predicted"]}
        elif name == "quality":
            want = {r["doc_id"] for r in quality.quality(docs, labels).collect() if r["predicted"]}
        elif name == "near_dedup":
            want = {r["doc_id"] for r in neardup.near_duplicates(docs, neardup.Settings(bands=13)).collect() if r["kept"]}
        elif name == "decontamination":
            want = before - {r["doc_id"] for r in decontam.contaminated(docs, items).collect()}
        else:
            want = before
        assert after == want, name
        if name != "packing":
            assert out.columns == columns
        kept.append(len(after))
        docs = out
    assert kept == sorted(kept, reverse=True) and kept[-1] > 0
    run = corpus_pipeline.run(spark, SMALL).select("doc_id", "piece", "ids_crc32").collect()
    assert sorted(run) == sorted(docs.select("doc_id", "piece", "ids_crc32").collect())


def test_pipeline_on_hard_rows(spark, hard_docs):
    docs = hard_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = store.keep(stage(spark, docs, SMALL))
    assert docs.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    empty = hard_docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = store.keep(stage(spark, empty, SMALL))
    assert empty.count() == 0


def test_copies_go_by_row(spark):
    a, b = (" ".join(f"{w}{i}" for i in range(40)) for w in "ab")
    near = a.replace("a39", "other")
    rows = [(1, a, 0), (5, a, 1), (5, b, 2), (5, b, 3), (None, a, 4), (5, None, 5), (7, near, 6), (8, "", 7), (8, b, 8), (0, near + " x y", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, root int").repartition(4)
    left = sorted(r["root"] for r in neardup.drop_copies(docs).collect())
    assert left in ([2, 4, 5, 7, 9], [3, 4, 5, 7, 9])


def test_contamination_goes_by_row(spark):
    item = " ".join(f"word{i}" for i in range(30))
    rows = [(1, f"start {item} end", 0), (1, "all clean words here", 1), (None, item, 2), (None, "clean too", 3), (None, None, 4), (2, "", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _text int")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert sorted(r["_text"] for r in decontam.drop_contaminated(docs, items).collect()) == [1, 3, 4, 5]
    assert decontam.drop_contaminated(docs, items.where("false")).count() == 6


def test_ids_are_marked_by_crc32(spark):
    rows = spark.range(30).select("id", store.remainder("id", 10).alias("r")).collect()
    assert all(r["r"] == zlib.crc32(str(r["id"]).encode()) % 10 for r in rows)


def test_all_are_registered():
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{k}" for k in range(1, 14)}
    assert set(queries.ORACLES) <= set(queries.QUERIES) and packing.Settings().capacity == 2048
