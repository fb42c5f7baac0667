"""Collocations from word indexes: which phrases of each language hold together.

Texts are cut at punctuation and line ends into pieces and these into words. Per task and
language, texts are gathered into *shards* of bounded size; a shard is an FM-index over word
numbers, kept in both directions and written once to the shared folder. Suffixes are sorted only
as deep as phrases are long, which is all that intervals of such phrases need.

Phrases are counted level by level. A phrase of k words can be frequent only if both phrases of
k - 1 words in it are, so the index walks from the words in the middle: it extends their
intervals to the right, drops what is not frequent, extends to the left, and drops again. It asks
a bit table of the frequent phrases, of bounded size, which may let too much through but never
loses a phrase. Pairs of words are first counted by hash alone, in a few bytes each, which tells
most of the rare ones. Counts of all shards are added in Spark, where the phrase itself is the key, so
no two phrases are ever mixed up, and the exact minimum is applied to the sums.

Scores, the search for longer phrases and the ranks are joins and windows over frequent phrases.

Defined results: a null lang is ``und``; null, empty and wordless texts add nothing; repeated
rows count as often as they occur; an empty table gives no rows; columns of any other name pass
by. A text of any length is worked on in chunks; phrases over a cut are counted from the few words
around it, and the phrases that this counts twice are shards of weight -1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import store, words
from quire.llm.hpyp import press, press_sorted, unpress, unpress_sorted
from quire.llm.words import ordered


@dataclass(frozen=True)
class Settings:
    longest: int = 4
    least: int = 30
    inside_percent: int = 80
    scale: int = 2_000_000
    best: int = 2000
    #: Words (and borders of pieces) of a shard.
    shard: int = 1 << 19
    #: Bytes of a text worked on at a time.
    chunk: int = 2 << 20
    #: Bits of the table that sends frequent phrases to the tasks, at most; 16 a phrase below that.
    table_bits: int = 27


# What ends a piece, and what parts words.
_ENDS, _GAPS = b".,;:!?\n\x0b\x0c\r", b" \t"
_KIND = np.zeros(256, np.uint8)
_KIND[list(_GAPS)] = 1
_KIND[list(_ENDS)] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Numbered:
    """A sequence of word numbers from 1 in reading order, with a 0 between pieces; word w is
    ``dictionary[w - 1]``, as bytes. ``opened`` and ``closed``: does a piece end come before the
    first word, or after the last one?"""

    text: np.ndarray
    dictionary: pa.Array
    opened: bool
    closed: bool


def numbered(raw: np.ndarray, offsets: np.ndarray) -> Numbered:
    """The words of texts that stand end to end in ``raw``."""
    kind = _KIND[raw]
    solid = kind == 0
    if not solid.any():
        ended = bool((kind == 2).any())
        return Numbered(np.zeros(0, np.int32), pa.array([], pa.large_binary()), ended, ended)
    border = np.zeros(len(raw) + 1, bool)
    border[offsets] = True
    starts = np.flatnonzero(solid & np.r_[True, ~solid[:-1] | border[1:len(raw)]])
    # words end to end in one buffer, so that they can be looked up as bytes
    packed = _LOWER[raw[solid]]
    at = np.r_[np.cumsum(solid, dtype=np.int64)[starts] - 1, len(packed)]
    coded = pa.Array.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(packed)]).dictionary_encode()
    breaks = np.cumsum((kind == 2) + border[:len(raw)])[starts]
    new = np.r_[False, breaks[1:] != breaks[:-1]]
    out = np.zeros(len(starts) + int(new.sum()), np.int32)
    out[np.arange(len(starts)) + np.cumsum(new)] = coded.indices.to_numpy() + 1
    last = len(raw) - 1 - int(solid[::-1].argmax())
    return Numbered(out, coded.dictionary, bool((kind[:starts[0]] == 2).any()), bool((kind[last:] == 2).any()))


def long_text(raw: np.ndarray, chunk: int, overlap: int) -> Iterator[tuple[int, Numbered]]:
    """(weight, words) of one text of any length, cut between words into chunks of about ``chunk``
    bytes. Where a cut is inside a piece, the phrases over it are those of the ``overlap`` words
    on both sides together, less those of each side alone."""
    start, tail = 0, []
    while start < len(raw):
        stop = min(len(raw), start + chunk)
        if stop < len(raw):
            gaps = np.flatnonzero(_KIND[raw[start:stop]])
            if not len(gaps):  # a word longer than a chunk: as far as it goes
                while stop < len(raw) and not _KIND[raw[stop:stop + chunk]].any():
                    stop += chunk
                gaps = np.flatnonzero(_KIND[raw[start:stop + chunk]])
            stop = start + int(gaps[-1]) + 1 if len(gaps) else len(raw)
        found = numbered(raw[start:stop], np.array([0]))
        yield 1, found
        if found.opened:
            tail = []
        if len(found.text):
            ends = np.flatnonzero(found.text == 0)
            head = found.text[:min(overlap, ends[0] if len(ends) else overlap)]
            head = found.dictionary.take(pa.array(head - 1)).to_pylist()
            if tail:
                yield from ((1, _listed(tail + head)), (-1, _listed(tail)), (-1, _listed(head)))
            rest = found.text[(ends[-1] + 1 if len(ends) else 0):][-overlap:]
            rest = found.dictionary.take(pa.array(rest - 1)).to_pylist()
            tail = [] if found.closed else ((tail if not len(ends) else []) + rest)[-overlap:]
        start = stop


def _listed(listed: list[bytes]) -> Numbered:
    coded = pa.array(listed, pa.large_binary()).dictionary_encode()
    return Numbered(coded.indices.to_numpy() + 1, coded.dictionary, False, False)


def sorted_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """The places of ``text``, read around its end, in order of their first ``depth`` symbols or
    more, by doubling; places that agree so far stay in order."""
    rank, known = text.astype(np.int64), 1
    while True:
        key = rank * (int(rank.max(initial=0)) + 1) + np.roll(rank, -known)
        order = ordered(key)
        known *= 2
        if known >= depth:
            return order
        key = key[order]
        changed = np.r_[0, np.cumsum(key[1:] != key[:-1])]
        rank = np.empty_like(rank)
        rank[order] = changed


@dataclass
class Intervals:
    """Phrases of equal length: their words, rows in the forward and in the backward index."""

    words: np.ndarray
    forward: np.ndarray
    backward: np.ndarray
    count: np.ndarray

    def take(self, keep: np.ndarray) -> Intervals:
        return Intervals(self.words[keep], self.forward[keep], self.backward[keep], self.count[keep])


class BidirectionalIndex:
    """Last columns of the sorted suffixes of a word sequence and of its reverse.

    A phrase is an interval of rows in both. Extending it by a word on the left reads the forward
    last column: the rows that hold the word move, in order, to one run of rows, whose length is
    the count of the longer phrase; in the backward index the run lies after those of smaller words.
    """

    def __init__(self, forward: np.ndarray, backward: np.ndarray) -> None:
        self.last = (forward, backward)
        self._steps: dict[int, np.ndarray] = {}

    @classmethod
    def of(cls, text: np.ndarray, depth: int) -> BidirectionalIndex:
        back = text[::-1]
        return cls(text[sorted_suffixes(text, depth) - 1], back[sorted_suffixes(back, depth) - 1])

    def step(self, side: int) -> np.ndarray:
        """Row -> row of the suffix that begins one symbol earlier."""
        if side not in self._steps:
            self._steps[side] = np.empty(len(self.last[side]), np.int64)
            self._steps[side][ordered(self.last[side])] = np.arange(len(self.last[side]))
        return self._steps[side]

    def root(self) -> Intervals:
        """The empty phrase."""
        return Intervals(np.zeros((1, 0), np.int32), np.zeros(1, np.int64), np.zeros(1, np.int64), np.array([len(self.last[0])]))

    def extend(self, phrases: Intervals, left: bool) -> Intervals:
        """Every phrase with every word that precedes (or follows) it; never over a border."""
        own, other = (phrases.forward, phrases.backward) if left else (phrases.backward, phrases.forward)
        last = self.last[0 if left else 1]
        if phrases.words.shape[1] == 0:  # rows are in order of their first word: no need to look for it
            count = np.bincount(last)
            begin, word = np.cumsum(count) - count, np.flatnonzero(count)
            word = word[word > 0] if len(phrases.count) else word[:0]
            return Intervals(word[:, None].astype(np.int32), begin[word], begin[word], count[word])
        begin = np.cumsum(phrases.count) - phrases.count
        parent = np.repeat(np.arange(len(own)), phrases.count)
        row = np.arange(len(parent)) - begin[parent] + own[parent]
        key = parent * (int(last.max(initial=0)) + 1) + last[row]
        order = ordered(key)
        key = key[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        count = np.diff(np.r_[first, len(key)])
        at = row[order[first]]
        up, word = parent[order[first]], last[at]
        moved, stayed = self.step(0 if left else 1)[at], other[up] + first - begin[up]
        grown = np.column_stack([word, phrases.words[up]] if left else [phrases.words[up], word])
        made = Intervals(grown.astype(np.int32), moved if left else stayed, stayed if left else moved, count)
        return made.take(word > 0)


def _hashes(listed: pa.Array) -> np.ndarray:
    """A hash of each word, the same wherever it occurs."""
    raw, at = words.raw_bytes(listed.cast(pa.large_binary()))
    return words.hashes(raw, at[:-1], at[1:])


def _mark(lang: str, dictionary: pa.Array) -> np.ndarray:
    """A hash per word number, the border's first, that is the same in all shards of a language."""
    return np.r_[np.uint64(0), _hashes(dictionary)] ^ np.uint64(xxhash.xxh64_intdigest(lang.encode()))


def _hash(mark: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    out = mark[numbers[:, 0]]
    for k in range(1, numbers.shape[1]):
        out = words.pair(out, mark[numbers[:, k]])
    return out


def phrases_of(index: BidirectionalIndex, k: int, frequent) -> Intervals:
    """The phrases of k words whose two phrases of k - 1 words pass ``frequent(word numbers)``."""
    found = index.root()
    for size in range(1, k):  # the middle words, and one to the right of them
        found = index.extend(found, left=False)
        found = found.take(frequent(found.words))
    found = index.extend(found, left=k > 1)
    return found.take(frequent(found.words[:, :-1])) if k > 1 else found


def build(docs: DataFrame, setting: Settings) -> DataFrame:
    """lang, weight, size (words), forward, backward, dictionary of every shard."""

    def shard(lang: str, weight: int, held: list[Numbered]) -> pa.RecordBatch:
        every = pa.chunked_array([h.dictionary for h in held]).combine_chunks().dictionary_encode()
        renamed, at, parts = every.indices.to_numpy() + 1, 0, [np.zeros(1, np.int32)]
        for h in held:
            own = len(h.dictionary)
            parts += [np.r_[0, renamed[at:at + own]][h.text], np.zeros(1, np.int32)]
            at += own
        text = np.concatenate(parts).astype(np.int32)
        index = BidirectionalIndex.of(text, setting.longest)
        known = every.dictionary.cast(pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array([lang]), pa.array([weight], pa.int32()), pa.array([int((text > 0).sum())]),
             *(pa.array([last.astype("<i4").tobytes()]) for last in index.last),
             pa.ListArray.from_arrays(pa.array([0, len(known)], pa.int32()), known)],
            ["lang", "weight", "size", "forward", "backward", "dictionary"])

    def parts(texts: pa.Array) -> Iterator[tuple[int, Numbered]]:
        for _, piece in words.slices(texts):
            raw, offsets = words.raw_bytes(piece)
            if len(raw) > setting.chunk:
                for a, b in zip(offsets, offsets[1:]):
                    yield from long_text(raw[a:b], setting.chunk, setting.longest - 1)
            else:
                yield 1, numbered(raw, offsets)

    def gather(batches):
        held, sizes = {}, {}
        for batch in batches:
            langs = batch["lang"].dictionary_encode()
            for code, lang in enumerate(langs.dictionary.to_pylist()):
                for weight, found in parts(batch["text"].filter(pc.equal(langs.indices, code))):
                    if not len(found.text):
                        continue
                    key = lang, weight
                    if key in held and sizes[key] + len(found.text) > setting.shard:
                        yield shard(*key, held.pop(key))
                    held.setdefault(key, []).append(found)
                    sizes[key] = (sizes[key] if len(held[key]) > 1 else 0) + len(found.text) + 1
        for key, own in held.items():
            yield shard(*key, own)

    return store.keep(docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(
        gather, "lang string, weight int, size long, forward binary, backward binary, dictionary array<binary>"), large_rows=True)


def _power(count: int, setting: Settings) -> int:
    return min(setting.table_bits, max(10, (16 * count).bit_length()))


def _table(places: DataFrame, power: int) -> np.ndarray:
    """A bit table of 2**``power`` bits with the bits ``p`` set, gathered as words of 64 bits."""
    found = (places.groupBy(F.expr("shiftright(p, 6) AS i"))
             .agg(F.expr("bit_or(shiftleft(1L, CAST(p & 63 AS INT))) AS bits")).toArrow())
    out = np.zeros(1 << power - 6, np.uint64)
    out[found["i"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def _bits(level: DataFrame, setting: Settings) -> np.ndarray:
    """The hashes of frequent phrases as a bit table."""
    power = _power(level.count(), setting)

    def places(batches):
        for batch in batches:
            split = [p.split(b" ") for p in batch["phrase"].cast(pa.binary()).to_pylist()]
            start = np.array([xxhash.xxh64_intdigest(lang.encode()) for lang in batch["lang"].to_pylist()], np.uint64)
            out = None
            for own in zip(*split):
                mark = _hashes(pa.array(own, pa.binary())) ^ start
                out = mark if out is None else words.pair(out, mark)
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array((out & np.uint64((1 << power) - 1)).view(np.int64))], ["p"])

    return _table(level.select("lang", "phrase").mapInArrow(places, "p long"), power)


def frequent(shards: DataFrame, setting: Settings) -> DataFrame:
    """lang, words (how many), phrase, a: all phrases of at most ``longest`` words that occur
    ``least`` times or more."""
    found, tables = None, {}
    context = shards.sparkSession.sparkContext
    for k in range(1, setting.longest + 1):
        # most pairs of frequent words are rare, and they are most of what would be shuffled
        sieve = context.broadcast(_sieve(shards, k, dict(tables), setting)) if k == 2 else None
        level = store.keep(_level(shards, k, dict(tables), sieve, setting))
        found = level if found is None else found.unionByName(level)
        if k < setting.longest:
            if level.isEmpty():
                break
            tables[k] = context.broadcast(_bits(level, setting))
    return found


def _in(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    h = h & np.uint64(64 * len(bits) - 1)
    return bits[(h >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63)) & np.uint64(1) > 0


def _walk(batches, k: int, tables: dict) -> Iterator[tuple[str, int, pa.Array, np.ndarray, Intervals]]:
    """(lang, weight, dictionary, hashes of its words, phrases of k words that can be frequent) of each shard."""
    for batch in batches:
        for row in range(batch.num_rows):
            lang, weight = batch["lang"][row].as_py(), batch["weight"][row].as_py()
            dictionary = batch["dictionary"][row].values
            last = [np.frombuffer(batch[c][row].as_buffer(), "<i4") for c in ("forward", "backward")]
            mark = _mark(lang, dictionary)

            def passes(numbers: np.ndarray) -> np.ndarray:
                return _in(tables[numbers.shape[1]].value, _hash(mark, numbers))

            yield lang, weight, dictionary, mark, phrases_of(BidirectionalIndex(*last), k, passes)


_WALKED = ("lang", "weight", "forward", "backward", "dictionary")
#: Bits of a hash that the sieve counts by, and hashes a task holds before it sends their counts on.
_SIEVE_BITS, _SIEVE_HELD = 40, 1 << 21


def _sieve(shards: DataFrame, k: int, tables: dict, setting: Settings) -> np.ndarray:
    """A bit table that every phrase of k words passes whose count can reach ``least``: counts are
    added by hash, in buckets of hashes, where phrases of one hash only make each other pass."""
    buckets = max(64, shards.count() // 2)

    def send(held: list) -> Iterator[pa.RecordBatch]:
        h, n = _added(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
        edges = np.searchsorted(h * np.uint64(buckets) >> np.uint64(_SIEVE_BITS), np.arange(buckets + 1, dtype=np.uint64))
        own = np.flatnonzero(np.diff(edges))
        for part in range(0, len(own), 256):
            cuts = [slice(edges[i], edges[i + 1]) for i in own[part:part + 256]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(own[part:part + 256], pa.int32()), pa.array([c.stop - c.start for c in cuts], pa.int64()),
                 pa.array([press_sorted(h[c]) for c in cuts], pa.binary()), pa.array([press(n[c]) for c in cuts], pa.binary())],
                ["bucket", "size", "hashes", "counts"])

    def count(batches):
        held, size = [], 0
        for _, weight, _, mark, got in _walk(batches, k, tables):
            if len(got.count):
                held.append((_hash(mark, got.words) & np.uint64((1 << _SIEVE_BITS) - 1), got.count * weight))
                size += len(got.count)
            if size >= _SIEVE_HELD:
                yield from send(held)
                held, size = [], 0
        if held:
            yield from send(held)

    def merge(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        h, n = _added(np.concatenate([unpress_sorted(r["hashes"], r["size"]) for r in rows]),
                      np.concatenate([unpress(r["counts"], r["size"]).view(np.int64) for r in rows]))
        return pa.table({"p": pa.array(h[n >= setting.least].view(np.int64))})

    sent = shards.select(*_WALKED).mapInArrow(count, "bucket int, size long, hashes binary, counts binary")
    places = store.keep(sent.groupBy("bucket").applyInArrow(merge, "p long"))
    power = _power(places.count(), setting)
    return _table(places.select(F.col("p").bitwiseAND(F.lit((1 << power) - 1)).alias("p")), power)


def _added(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each hash once, in order, with the sum of its counts."""
    order = np.argsort(h)
    h, n = h[order], n[order]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    return h[first], np.add.reduceat(n, first)


def _level(shards: DataFrame, k: int, tables: dict, sieve, setting: Settings) -> DataFrame:
    def count(batches):
        for lang, weight, dictionary, mark, got in _walk(batches, k, tables):
            if sieve is not None:
                got = got.take(_in(sieve.value, _hash(mark, got.words)))
            for start in range(0, len(got.count), 1 << 16):
                part = got.take(slice(start, start + (1 << 16)))
                texts = [dictionary.take(pa.array(part.words[:, j] - 1)).cast(pa.string()) for j in range(k)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part.count)), pc.binary_join_element_wise(*texts, " "),
                     pa.array(part.count * weight)], ["lang", "phrase", "n"])

    return (shards.select(*_WALKED)
            .mapInArrow(count, "lang string, phrase string, n long")
            .groupBy("lang", "phrase").agg(F.sum("n").alias("a"))
            .where(F.col("a") >= setting.least).select("lang", F.lit(k).alias("words"), "phrase", "a"))


def collocations(docs: DataFrame, setting: Settings = Settings()) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best phrases of every language."""
    shards = build(docs, setting)
    counted = store.keep(frequent(shards, setting))
    whole = shards.groupBy("lang").agg(F.sum(F.col("size") * F.col("weight")).alias("n"))

    def part(first, last):
        """Words first to last (from 1, last included) of the phrase."""
        return F.array_join(F.slice(F.split("phrase", " ", -1), first, last - first + 1), " ")

    candidates = counted.where("words > 1")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    sides = counted.select("lang", F.col("phrase").alias("_part"), F.col("a").alias("_f"))
    cuts = cuts.select("lang", "phrase", "words", "a", "k", part(F.lit(1), F.col("k")).alias("_left"),
                       part(F.col("k") + 1, F.col("words")).alias("_right"))
    cuts = (cuts.join(sides.toDF("lang", "_left", "l"), ["lang", "_left"])
            .join(sides.toDF("lang", "_right", "r"), ["lang", "_right"]))
    score = F.expr(f"(CAST(a AS DECIMAL(25,0)) * {setting.scale}) DIV (CAST(l AS DECIMAL(25,0)) + r)")
    scored = (cuts.select("lang", "phrase", "a", F.struct(score.alias("score"), "k", "l", "r").alias("_cut"))
              .groupBy("lang", "phrase", "a").agg(F.min("_cut").alias("_cut")))
    inner = candidates.where("words > 2").select(
        "lang", F.col("a").alias("_longer"), F.col("words").alias("_w"), "phrase",
        F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("_size"))
    inner = (inner.select("lang", "_longer", "phrase", "_size", F.explode(F.expr("sequence(1, _w - _size + 1)")).alias("_at"))
             .select("lang", "_longer", part(F.col("_at"), F.col("_at") + F.col("_size") - 1).alias("phrase"))
             .groupBy("lang", "phrase").agg(F.max("_longer").alias("_longer")))
    kept = (scored.join(inner, ["lang", "phrase"], "left")
            .where(F.col("_longer").isNull() | (F.expr(f"CAST(100 AS DECIMAL(3,0)) * CAST(_longer AS DECIMAL(25,0)) < CAST({setting.inside_percent} AS DECIMAL(3,0)) * CAST(a AS DECIMAL(25,0))")))
            .select("lang", "phrase", "a", "_cut.l", "_cut.r", F.col("_cut.score").alias("score")))
    top = kept.withColumn("_share", F.pmod(F.xxhash64("phrase"), F.lit(64)))  # so that a language is 64 groups first
    for group in (["lang", "_share"], ["lang"]):
        rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("score"), F.desc("a"), "phrase"))
        top = top.withColumn("rank", rank.cast("long")).where(F.col("rank") <= setting.best)
    return top.join(whole, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
