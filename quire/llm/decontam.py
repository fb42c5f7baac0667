"""Benchmark passages in documents: n-gram seeds, then Smith-Waterman alignment.

Every test item is the sequence of its words (lower-cased, punctuation parts words) and the
set of its ``gram``-word grams. One pass over the documents finds where grams of items occur,
cuts one passage around each run of them, one item length wider on both sides, and aligns the
passage with its item; the local alignment score (match 2, mismatch and gap -1) over that of
the whole item is 1.0 for an exact copy. Rows from ``threshold`` on are contaminated. Only
passages that cannot reach it are left unaligned: those that hold too few of the item's words,
each counted as often as both have it, even if all of them matched. So whether a document is
found depends on its own text and the item alone, not on what other documents hold.

Items are taken in blocks of ``block_words`` words, so what is broadcast is bounded however
large the benchmark is; each block reads the documents once.

Defined results: items and documents without words match nothing; items shorter than ``gram``
use their whole sequence as the one gram; repeated items are reported under each item_id; a null item_id teaches
nothing. A null doc_id is reported as null and cannot be dropped by ``drop_contaminated``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import store, words


@dataclass(frozen=True)
class Settings:
    gram: int = 3
    match: int = 2
    mismatch: int = 1
    gap: int = 1
    threshold: float = 0.5
    block_words: int = 200_000
    broadcast_docs: int = 2_000_000


@dataclass(frozen=True)
class Block:
    """Items of one block: words end to end, and where each distinct gram occurs in them."""

    ids: np.ndarray
    at: np.ndarray
    words: np.ndarray
    grams: np.ndarray
    first: np.ndarray
    item: np.ndarray
    short: int
    bag_at: np.ndarray
    bag: np.ndarray
    times: np.ndarray

    def size(self, item: np.ndarray) -> np.ndarray:
        return self.at[item + 1] - self.at[item]

    def common(self, item: int, passage: np.ndarray) -> int:
        """Words that item and passage share, each as often as both have it: no alignment matches more."""
        own = slice(self.bag_at[item], self.bag_at[item + 1])
        bag = self.bag[own]
        near = np.minimum(np.searchsorted(bag, passage), len(bag) - 1)
        got = np.bincount(near[bag[near] == passage], minlength=len(bag))
        return int(np.minimum(got, self.times[own]).sum())


def _grams(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of every n-gram that stays inside one text."""
    if len(h) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    acc = h[:len(h) - n + 1] ^ np.uint64(n)
    for k in range(1, n):
        acc = words.pair(acc, h[k:len(h) - n + 1 + k])
    at = np.flatnonzero(row[:len(acc)] == row[n - 1:])
    return at, acc[at]


def block_of(ids: list[int], texts: list[str], gram: int) -> Block:
    """The index of a few items; ``texts`` are lower-cased."""
    h, row = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for first, piece in words.slices(pa.array(texts, pa.string())):
        text = words.split(piece, letters=True)
        h.append(text.hash)
        row.append(text.row + first)
    h, row = np.concatenate(h), np.concatenate(row)
    count = np.bincount(row, minlength=len(ids))
    at = np.r_[0, np.cumsum(count)]
    hashes, items, short = [], [], gram
    for n in range(1, gram + 1):
        place, g = _grams(h, row, n)
        own = row[place]
        used = (count[own] == n) if n < gram else (count[own] >= gram)
        if n < gram and used.any():
            short = min(short, n)
        hashes.append(g[used])
        items.append(own[used])
    code = np.rec.fromarrays([np.concatenate(hashes), np.concatenate(items)], names="g,i")
    code = np.unique(code)
    grams, first = np.unique(code.g, return_index=True)
    bag, times = np.unique(np.rec.fromarrays([row, h], names="i,h"), return_counts=True)
    return Block(np.asarray(ids, np.int64), at, h, grams, np.r_[first, len(code)], code.i.astype(np.int64), short,
                 np.searchsorted(bag.i, np.arange(len(ids) + 1)), np.ascontiguousarray(bag.h), times)


def passages(texts: pa.Array, block: Block, setting: Settings) -> dict[str, list]:
    """Runs of item grams in a slice of lower-cased texts that may reach the threshold, as columns: row, item, start, stop, passage."""
    gram = setting.gram
    text = words.split(texts, letters=True)
    places, found = [], []
    for n in range(block.short, gram + 1):
        at, h = _grams(text.hash, text.row, n)
        near = np.minimum(np.searchsorted(block.grams, h), max(len(block.grams) - 1, 0))
        hit = block.grams[near] == h if len(block.grams) else np.zeros(len(h), bool)
        places.append(at[hit])
        found.append(near[hit])
    place, g = np.concatenate(places), np.concatenate(found)
    times = block.first[g + 1] - block.first[g]
    place, gram_no = np.repeat(place, times), np.repeat(g, times)
    within = np.arange(len(place)) - np.repeat(np.cumsum(times) - times, times)
    item = block.item[block.first[gram_no] + within] if len(place) else place
    row = text.row[place]
    order = np.lexsort((place, item, row))
    row, item, place = row[order], item[order], place[order]
    out = {k: [] for k in ("row", "item", "start", "stop", "passage")}
    if not len(place):
        return out
    size = block.size(item)
    new = np.r_[True, (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (place[1:] - place[:-1] > size[1:])]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(place)]
    begin = np.searchsorted(text.row, np.arange(text.rows + 1))
    for i, j in zip(first, last):
        r, m = row[i], size[i]
        start = max(begin[r], place[i] - m)
        stop = min(begin[r + 1], place[j - 1] + gram + m)
        if block.common(item[i], text.hash[start:stop]) / m < setting.threshold:
            continue
        out["row"].append(int(r))
        out["item"].append(int(item[i]))
        out["start"].append(int(start - begin[r]))
        out["stop"].append(int(stop - begin[r]))
        out["passage"].append(text.hash[start:stop])
    return out


def align(item: np.ndarray, passages_: list[np.ndarray], setting: Settings) -> np.ndarray:
    """Best local alignment score of one item with each passage, over the item's own score.

    One row of the score matrix at a time for all passages together. A gap along the row is
    a running maximum: H[j] = max over k <= j of T[k] - gap * (j - k).
    """
    width = max(map(len, passages_))
    table = np.zeros((len(passages_), width), np.uint64)
    real = np.zeros(table.shape, bool)
    for i, p in enumerate(passages_):
        table[i, :len(p)] = p
        real[i, :len(p)] = True
    ramp = setting.gap * np.arange(width, dtype=np.int32)
    above = np.zeros((len(passages_), width), np.int32)
    best = np.zeros(len(passages_), np.int32)
    for word in item:
        step = np.where((table == word) & real, setting.match, -setting.mismatch).astype(np.int32)
        step[:, 1:] += above[:, :-1]
        np.maximum(step, above - setting.gap, out=step)
        np.maximum(step, 0, out=step)
        above = np.maximum.accumulate(step + ramp, axis=1) - ramp
        np.maximum(best, above.max(axis=1), out=best)
    return best / (setting.match * len(item))


def _block_matches(docs: DataFrame, block: Block, setting: Settings) -> DataFrame:
    """doc_id, item_id, score, start_word, end_word for one block of items, and a hash of the text
    (``_text``) that tells the rows of a repeated doc_id apart."""
    context = docs.sparkSession.sparkContext
    sent = context.broadcast(block)

    def find(batches):
        own: Block = sent.value
        for batch in batches:
            ids = batch["doc_id"]
            for begin, piece in words.slices(batch["text"]):
                got = passages(piece, own, setting)
                item, raw = np.array(got["item"], np.int64), got["passage"]
                value = np.zeros(len(item))
                for by_item in _runs(np.lexsort((np.array([len(p) for p in raw], np.int64), item)), item, raw):
                    words_of = own.words[own.at[item[by_item[0]]]:own.at[item[by_item[0]] + 1]]
                    value[by_item] = align(words_of, [raw[i] for i in by_item], setting)
                over = np.flatnonzero(value >= setting.threshold)
                if len(over):
                    row, start, stop = (np.array(got[c], np.int64)[over] for c in ("row", "start", "stop"))
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(begin + row)), batch["_text"].take(pa.array(begin + row)), pa.array(own.ids[item[over]]), pa.array(value[over]),
                         pa.array(start), pa.array(stop)],
                        ["doc_id", "_text", "item_id", "score", "start_word", "end_word"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("_text"), F.lower("text").alias("text")).mapInArrow(
        find, f"doc_id {kind}, _text long, item_id long, score double, start_word long, end_word long")


def _runs(order: np.ndarray, item: np.ndarray, raw: list[np.ndarray], cells: int = 1 << 18):
    """Rows of one item at a time, so many that their padded passages have a bounded size."""
    start = 0
    while start < len(order):
        stop = start + 1
        while (stop < len(order) and item[order[stop]] == item[order[start]]
               and (stop - start + 1) * len(raw[order[stop]]) <= cells):
            stop += 1
        yield order[start:stop]
        start = stop


def _blocks(benchmark: DataFrame, setting: Settings):
    """Items in blocks of a bounded number of words, one block at a time on the driver."""
    items = store.keep(benchmark.where("item_id IS NOT NULL AND text IS NOT NULL")
                       .select(F.col("item_id").cast("long").alias("item_id"), F.lower("text").alias("text"))
                       .withColumn("_w", F.size(F.split("text", r"\s+"))))
    total = items.agg(F.coalesce(F.sum("_w"), F.lit(0))).first()[0]
    parts = max(1, -(-2 * total // setting.block_words))
    for k in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).distinct().orderBy("item_id", "text").collect()
        if rows:
            yield block_of([r["item_id"] for r in rows], [r["text"] for r in rows], setting.gram)


def _matches(docs: DataFrame, benchmark: DataFrame, setting: Settings) -> DataFrame | None:
    """The passages of all blocks; None for a benchmark without items."""
    store.bound_batches(docs.sparkSession)
    found = None
    for block in _blocks(benchmark, setting):
        own = _block_matches(docs, block, setting)
        found = own if found is None else found.unionByName(own)
    return found


def contaminated(docs: DataFrame, benchmark: DataFrame, setting: Settings = Settings()) -> DataFrame:
    """doc_id, item_id, score, start_word, end_word: each document's best passage per item."""
    found = _matches(docs, benchmark, setting)
    if found is None:
        return docs.select("doc_id", F.lit(0).cast("long").alias("item_id"), F.lit(0.0).alias("score"),
                           F.lit(0).cast("long").alias("start_word"), F.lit(0).cast("long").alias("end_word")).where("false")
    best = F.max(F.struct("score", (-F.col("start_word")).alias("s"), (-F.col("end_word")).alias("e"))).alias("_b")
    return (found.groupBy("doc_id", "item_id").agg(best)
            .select("doc_id", "item_id", "_b.score", (-F.col("_b.s")).alias("start_word"), (-F.col("_b.e")).alias("end_word")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, setting: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` that hold no passage of the benchmark, all columns as they are. Each row
    is judged by its own text, also where its doc_id is null or repeats."""
    found = _matches(docs, benchmark, setting)
    if found is None:
        return docs
    gone = store.keep(found.select(F.col("doc_id").alias("_gone_id"), F.col("_text").alias("_gone_text")).distinct())
    if gone.count() <= setting.broadcast_docs:
        gone = F.broadcast(gone)
    same = docs["doc_id"].eqNullSafe(F.col("_gone_id")) & (F.xxhash64(docs["text"]) == F.col("_gone_text"))
    return docs.join(gone, same, "left_anti").select(*docs.columns)
