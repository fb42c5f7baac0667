"""Language model scoring by a hierarchical Pitman-Yor process over words.

Each context has a Chinese restaurant; every restaurant's tables are customers of one shared
parent, the restaurant of all words, whose own base is uniform over the known words and one
unknown. A context is the previous word, or the start; every word has a restaurant of its own.
Seating is sampled by
blocked Gibbs sweeps: the customers of one dish in one restaurant are reseated together,
with the number of tables drawn from its conditional given all other tables (generalised
Stirling numbers; a saddle point for dishes of many customers and tables). The predictive probability of a word is averaged over the last
``samples`` sweeps; in each of them probabilities add up to one.

How it runs: one pass cuts the texts into blocks of about ``block_words`` tokens and keeps, per
block, its distinct words by range of their hash, and its tokens as places among them. Words of a
range meet in one bucket, which numbers them; with these numbers each block counts its distinct
(word, previous word) pairs and sends them to the word's bucket, so all contexts of a word meet
there. A sweep reads every bucket once. It knows the tables of its own pairs only, so the sums per
restaurant are an exchange: each bucket sends its share of them by range of the restaurant's
number, ranges add them up, and every bucket gets back the restaurants that its pairs are in. At the end
each bucket answers its blocks with a probability per pair, and blocks add them up per document.
Words, counts and restaurants grow with the corpus and stay in Spark; the driver sees totals,
and one number per bucket.

A word is known by 64 bits of its hash.

Defined results: a null or empty text is the end token alone; a null doc_id is never learned
from; repeated rows are learned from and scored each; with nothing to learn from every token
has probability one, as in the base score.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import store, words


@dataclass(frozen=True)
class Settings:
    block_words: int = 1 << 20
    sweeps: int = 3
    samples: int = 2
    inner: int = 2
    strength: float = 5.0
    parent_strength: float = 50.0
    exact: int = 100
    seed: int = 31


#: Large dishes of fewer tables than FEW are drawn by exact weights of up to WIDTH tables; the ratios of
#: Stirling numbers hardly change beyond ROWS customers.
FEW, WIDTH, ROWS = 40, 128, 4096

#: Low bits of a pair's key that hold the previous word's number, and those of them within a range of restaurants.
CONTEXT, RANGE = 32, 14

END, START = np.uint64(0x6C62272E07BB0142), np.uint64(0x62B821756295C58D)


def press(values: np.ndarray) -> bytes:
    """64-bit numbers, byte plane by byte plane, compressed."""
    raw = np.ascontiguousarray(values.astype(np.uint64).view(np.uint8).reshape(-1, 8).T)
    return pa.compress(raw.tobytes(), codec="zstd", asbytes=True)


def unpress(blob: bytes, size: int) -> np.ndarray:
    raw = pa.decompress(blob, decompressed_size=8 * size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, size).T).view(np.uint64).ravel()


def floats(blob: bytes, size: int) -> np.ndarray:
    """32-bit floats that were pressed as numbers."""
    return unpress(blob, size).astype(np.uint32).view(np.float32)


def press_sorted(keys: np.ndarray) -> bytes:
    return press(np.diff(keys, prepend=np.uint64(0)))


def unpress_sorted(blob: bytes, size: int) -> np.ndarray:
    return np.cumsum(unpress(blob, size), dtype=np.uint64)


def tokens(text: words.Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every token, the end included."""
    count = text.counts()
    token = np.empty(len(text.hash) + text.rows, np.uint64)
    token[np.arange(len(text.hash)) + text.row] = text.hash
    token[np.cumsum(count + 1) - 1] = END
    return np.repeat(np.arange(text.rows), count + 1), token


def pairs(token: np.ndarray, sizes: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, previous word) of the distinct pairs in order, and the pair of each token; ``start``
    stands before the first token of each of the texts of ``sizes`` tokens."""
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[(np.cumsum(sizes) - sizes)[sizes > 0]] = start
    wide = max(int(token.max(initial=0)), start) + 1
    key = token * wide + before
    order = words.ordered(key)
    key = key[order]
    new = np.r_[True, key[1:] != key[:-1]][:len(key)]
    refs = np.empty(len(key), np.int64)
    refs[order] = np.cumsum(new) - 1
    return key[new] // wide, key[new] % wide, refs


def bucket_edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins in sorted keys, by equal ranges of the top 32 bits."""
    of = (keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    return np.searchsorted(of, np.arange(buckets + 1, dtype=np.uint64))


_BLOCKS = ("block long, bucket int, size long, words binary, "
           "ids array<{kind}>, held array<boolean>, sizes array<int>, start long, refs binary, n_refs long")


def blocks(docs: DataFrame, setting: Settings, buckets: int, modulus: int, rest: int) -> DataFrame:
    """One row per block and bucket (its distinct words), and one per block (its documents and tokens)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def flush(number, ids, held, row, token):
        sizes = np.bincount(row, minlength=len(ids)) if len(row) else np.zeros(len(ids), np.int64)
        known, refs = np.unique(np.r_[START, token], return_inverse=True)
        edges = bucket_edges(known, buckets)
        own = np.flatnonzero(np.diff(edges))
        parts = [slice(edges[k], edges[k + 1]) for k in own]
        n, none = len(own), [None] * len(own)
        yield pa.RecordBatch.from_arrays([
            pa.array([number] * (n + 1), pa.int64()), pa.array([*own.tolist(), -1], pa.int32()),
            pa.array([*(p.stop - p.start for p in parts), len(known)], pa.int64()),
            pa.array([*(press_sorted(known[p]) for p in parts), None], pa.binary()),
            pa.array([*none, ids], pa.list_(ids_type)), pa.array([*none, held.tolist()], pa.list_(pa.bool_())),
            pa.array([*none, sizes.tolist()], pa.list_(pa.int32())), pa.array([*none, int(refs[0])], pa.int64()),
            pa.array([*none, press(refs[1:])], pa.binary()), pa.array([*none, len(token)], pa.int64()),
        ], ["block", "bucket", "size", "words", "ids", "held", "sizes", "start", "refs", "n_refs"])

    ids_type = pa.string() if kind == "string" else {"int": pa.int32(), "bigint": pa.int64()}.get(kind, pa.int64())

    def cut(batches):
        base, made = TaskContext.get().partitionId() << 32, 0
        ids, held, rows, found, total = [], [], [], [], 0
        for batch in batches:
            own_ids, own_held = batch["doc_id"].to_pylist(), batch["held"].to_numpy(zero_copy_only=False)
            for begin, piece in words.slices(batch["text"]):
                row, token = tokens(words.split(piece))
                rows.append(row + len(ids))
                found.append(token)
                ids += own_ids[begin:begin + len(piece)]
                held.append(own_held[begin:begin + len(piece)])
                total += len(token)
                if total >= setting.block_words:
                    yield from flush(base + made, ids, np.concatenate(held), np.concatenate(rows), np.concatenate(found))
                    made, ids, held, rows, found, total = made + 1, [], [], [], [], 0
        if ids:
            yield from flush(base + made, ids, np.concatenate(held), np.concatenate(rows), np.concatenate(found))

    return store.keep(docs.select("doc_id", "text", store.held_out("doc_id", modulus, rest).alias("held"))
                      .mapInArrow(cut, _BLOCKS.format(kind=kind)))


def numbered(parts: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """Per block and bucket the places of the block's words among the bucket's, in order of their
    hashes; and the number of each bucket's first word."""
    def number(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        own = [unpress_sorted(r["words"], r["size"]) for r in rows]
        every = np.unique(np.concatenate(own))
        return pa.table({
            "block": table["block"], "bucket": table["bucket"], "size": table["size"],
            "places": pa.array([press_sorted(np.searchsorted(every, w).astype(np.uint64)) for w in own], pa.binary()),
            "total": pa.array([len(every)] * len(rows), pa.int64())})

    places = store.keep(parts.where("bucket >= 0").select("block", "bucket", "size", "words").groupBy("bucket").applyInArrow(
        number, "block long, bucket int, size long, places binary, total long"))
    first, known = {}, 0
    for bucket, total in sorted(places.groupBy("bucket").agg(F.max("total")).collect()):
        first[bucket], known = known, known + total
    if known > 1 << CONTEXT:
        raise ValueError(f"{known} distinct words, more than pairs have room for")
    return places, first


def merged(parts: DataFrame) -> DataFrame:
    """One row per bucket: its distinct pairs with their training counts (0: in held-out texts only),
    and which of them each block asks for."""
    places, first = numbered(parts)

    def count(own: pa.Table, replies: pa.Table) -> pa.Table:
        block, rows = own.to_pylist()[0], sorted(replies.to_pylist(), key=lambda r: r["bucket"])
        # Numbers follow hashes, in a block as in all: pairs in order of places are in order of numbers.
        number = np.concatenate([unpress_sorted(r["places"], r["size"]) + np.uint64(first[r["bucket"]]) for r in rows])
        sizes = np.array(block["sizes"], np.int64)
        word, before, refs = pairs(unpress(block["refs"], block["n_refs"]).astype(np.int64), sizes, block["start"])
        learned = ~np.repeat(np.array(block["held"], bool), sizes)
        counts = np.bincount(refs, weights=learned, minlength=len(word)).astype(np.uint64)
        keys = number[word] << np.uint64(CONTEXT) | number[before]
        edges = np.searchsorted(word, np.cumsum([0, *(r["size"] for r in rows)]))
        cuts = [(r["bucket"], slice(a, b)) for r, a, b in zip(rows, edges, edges[1:]) if b > a]
        return pa.table({
            "block": pa.array([block["block"]] * len(cuts), pa.int64()), "bucket": pa.array([b for b, _ in cuts], pa.int32()),
            "size": pa.array([c.stop - c.start for _, c in cuts], pa.int64()),
            "keys": pa.array([press_sorted(keys[c]) for _, c in cuts], pa.binary()),
            "counts": pa.array([press(counts[c]) for _, c in cuts], pa.binary())})

    def merge(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["block"])
        key = np.concatenate([unpress_sorted(r["keys"], r["size"]) for r in rows])
        n = np.concatenate([unpress(r["counts"], r["size"]) for r in rows]).astype(np.int64)
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.r_[True, key[1:] != key[:-1]]
        place = np.empty(len(key), np.uint64)
        place[order] = np.cumsum(new) - 1
        key, n = key[new], np.add.reduceat(n[order], np.flatnonzero(new))
        cuts = np.cumsum([r["size"] for r in rows])[:-1]
        return pa.table({
            "bucket": pa.array([rows[0]["bucket"]], pa.int32()), "size": pa.array([len(key)], pa.int64()),
            "keys": pa.array([press_sorted(key)], pa.binary()), "counts": pa.array([press(n)], pa.binary()),
            "blocks": pa.array([[r["block"] for r in rows]], pa.list_(pa.int64())),
            "sizes": pa.array([[r["size"] for r in rows]], pa.list_(pa.int64())),
            "asked": pa.array([[press_sorted(p) for p in np.split(place, cuts)]], pa.list_(pa.binary()))})

    owners = parts.where("bucket < 0").select("block", "held", "sizes", "start", "refs", "n_refs")
    asked = owners.groupBy("block").cogroup(places.select("block", "bucket", "size", "places").groupBy("block")).applyInArrow(
        count, "block long, bucket int, size long, keys binary, counts binary")
    return store.keep(asked.groupBy("bucket").applyInArrow(
        merge, "bucket int, size long, keys binary, counts binary, blocks array<long>, sizes array<long>, asked array<binary>"))


@dataclass(frozen=True)
class State:
    """What restaurants share: totals, and for each bucket the restaurants that its pairs are in: their
    customers (in ``opened``, the same in all states) and tables (last of the sums in ``seated``)."""

    tokens: int
    vocabulary: int
    discount: float
    parent_discount: float
    opened: DataFrame | None
    seated: DataFrame | None
    parent_customers: int
    parent_tables: int

    @property
    def customers(self) -> np.ndarray:
        """Of every restaurant; collected, to look at small models only."""
        return _restaurants(self.opened.where("bucket < 0").collect(), 0)

    @property
    def tables(self) -> np.ndarray:
        """Of every restaurant; collected, to look at small models only."""
        return _restaurants(self.seated.where("bucket < 0").collect(), -1)

    def alone(self) -> State:
        """The totals without the tables, to be sent to tasks."""
        return replace(self, opened=None, seated=None)


@functools.lru_cache(maxsize=8)
def _log_stirling(size: int, width: int, discount: float) -> np.ndarray:
    """log of generalised Stirling numbers [n, t] for n <= size and 1 <= t <= width."""
    out = np.full((size + 1, width + 1), -np.inf)
    out[1, 1] = 0.0
    t = np.arange(1, width + 1)
    for n in range(1, size):
        out[n + 1, 1:] = np.logaddexp(out[n, :-1], out[n, 1:] + np.log(np.maximum(n - t * discount, 1e-300)))
    return out


def _draw(row: np.ndarray, strength: np.ndarray, chance: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables from 1 to len(row), by log Stirling numbers ``row`` (or one row per dish)."""
    width = row.shape[-1]
    odds = np.cumsum(np.log(strength[:, None] + discount * np.arange(width)), axis=1) + np.log(chance[:, None]) * np.arange(1, width + 1)
    odds += row
    total = np.cumsum(np.exp(odds - odds.max(axis=1, keepdims=True)), axis=1)
    return 1 + (total < rng.random((len(total), 1)) * total[:, -1:]).sum(axis=1)


def _peak(count: np.ndarray, strength: np.ndarray, chance: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray]:
    """Mode and variance of the number of tables of large dishes, by the saddle point of the
    Stirling numbers' generating function ((1 - y**d) / d)**t, found by halving log y."""
    def at(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        t = count * -np.expm1(discount * u) * np.exp((1 - discount) * u) / (discount * -np.expm1(u))
        return t, np.log(-np.expm1(discount * u) / discount) + np.log((strength + discount * t) * chance / (t + 0.5))

    low, high = np.full(len(count), -60.0), np.full(len(count), -1e-9)
    for _ in range(45):
        middle = (low + high) / 2
        up = at(middle)[1] > 0
        low, high = np.where(up, middle, low), np.where(up, high, middle)
    t, slope = at(low)
    t2, slope2 = at(low + np.minimum(0.01, -low / 2))
    return t, np.maximum((t2 - t) / np.maximum(slope - slope2, 1e-12), 0.0)


def seat(count: np.ndarray, strength: np.ndarray, chance: np.ndarray, discount: float, exact: int,
         rng: np.random.Generator) -> np.ndarray:
    """Number of tables of each dish, drawn from its conditional. ``strength``: concentration plus
    discount times the tables of all other dishes of its restaurant; ``chance``: the dish's
    probability in the parent. Dishes of up to ``exact`` customers, and larger ones of few tables,
    are drawn by exact weights; larger ones of many tables by the normal law at the mode."""
    tables = np.ones(len(count), np.int64)
    several = np.flatnonzero((count > 1) & (count <= exact))
    if len(several):
        order = several[np.argsort(count[several], kind="stable")]
        level = count[order]
        stirling = _log_stirling(exact, exact, discount)
        edges = np.flatnonzero(np.r_[True, level[1:] != level[:-1], True])
        for low, high in zip(edges, edges[1:]):
            n = int(level[low])
            step = max(1, (1 << 19) // n)
            for start in range(low, high, step):
                at = order[start:min(high, start + step)]
                tables[at] = _draw(stirling[n, 1:n + 1], strength[at], chance[at], discount, rng)
    large = np.flatnonzero(count > exact)
    if len(large):
        mode, spread = _peak(count[large].astype(float), strength[large], chance[large], discount)
        many = mode >= FEW
        at = large[many]
        drawn = np.rint(mode[many] + np.sqrt(spread[many]) * rng.standard_normal(len(at)))
        tables[at] = np.clip(drawn, 1, count[at]).astype(np.int64)
        few = large[~many]
        if len(few):
            stirling = _log_stirling(ROWS, WIDTH, discount)
            for start in range(0, len(few), 4096):
                at = few[start:start + 4096]
                tables[at] = _draw(stirling[np.minimum(count[at], ROWS), 1:], strength[at], chance[at], discount, rng)
    return tables


@dataclass(frozen=True)
class Bucket:
    """Pairs of a bucket in order, and the place of each one's restaurant among ``contexts``."""

    number: int
    key: np.ndarray
    count: np.ndarray
    contexts: np.ndarray
    context: np.ndarray

    @classmethod
    def of(cls, row: dict) -> Bucket:
        key = unpress_sorted(row["keys"], row["size"])
        contexts, context = np.unique(key & np.uint64((1 << CONTEXT) - 1), return_inverse=True)
        return cls(row["bucket"], key, unpress(row["counts"], row["size"]).astype(np.int64), contexts, context)

    def learned(self) -> Bucket:
        """The pairs that training texts hold."""
        at = self.count > 0
        return Bucket(self.number, self.key[at], self.count[at], self.contexts, self.context[at])

    def words(self) -> np.ndarray:
        """Where the pairs of each word begin."""
        word = self.key >> np.uint64(CONTEXT)
        return np.flatnonzero(np.r_[True, word[1:] != word[:-1]][:len(word)])

    def per_context(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.context, weights=values, minlength=len(self.contexts)).astype(np.int64)


def _sweep(own: Bucket, seated: np.ndarray, now: State, setting: Settings, turn: int):
    """(first pair of each word, word of each pair, its tables, customers and tables of each word in the
    parent) for learned pairs, with ``seated`` tables in each restaurant so far."""
    rng = np.random.default_rng([setting.seed, own.number, turn])
    first = own.words()
    word = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(own.key)]))
    base = 1 / (now.vocabulary + 1)
    tables = np.ones(len(own.key), np.int64)

    def parent():
        customers = np.add.reduceat(tables, first) if len(first) else tables
        strength = np.full(len(customers), setting.parent_strength + now.parent_discount * max(now.parent_tables - 1, 0))
        return customers, seat(customers, strength, np.full(len(customers), base), now.parent_discount, setting.exact, rng)

    customers, above = parent()
    for _ in range(setting.inner):
        chance = _parent_chance(customers, above, now, setting)
        others = np.maximum(seated[own.context] - tables, 0)
        tables = seat(own.count, setting.strength + now.discount * others, chance[word], now.discount, setting.exact, rng)
        customers, above = parent()
    return first, word, tables, customers, above


def _parent_chance(own: np.ndarray, above: np.ndarray, state: State, setting: Settings) -> np.ndarray:
    left = (setting.parent_strength + state.parent_discount * state.parent_tables) / (state.vocabulary + 1)
    return (own - state.parent_discount * above + left) / (setting.parent_strength + state.parent_customers)


_SHARES = "range long, bucket int, size long, contexts binary, shares array<binary>, totals array<long>"


def _shares(own: Bucket, values: list[np.ndarray], totals: list[int]) -> pa.Table:
    """What a bucket adds to its restaurants, by ranges of their numbers; the totals go with the first."""
    ranges, begin = np.unique(own.contexts >> np.uint64(RANGE), return_index=True)
    cuts = [slice(a, b) for a, b in zip(begin, np.r_[begin[1:], len(own.contexts)])]
    return pa.table({
        "range": pa.array(ranges.astype(np.int64)), "bucket": pa.array([own.number] * len(cuts), pa.int32()),
        "size": pa.array([c.stop - c.start for c in cuts], pa.int64()),
        "contexts": pa.array([press_sorted(own.contexts[c]) for c in cuts], pa.binary()),
        "shares": pa.array([[press(v[c]) for v in values] for c in cuts], pa.list_(pa.binary())),
        "totals": pa.array([totals, *[[0] * len(totals)] * (len(cuts) - 1)], pa.list_(pa.int64()))})


def _added(shares: DataFrame) -> DataFrame:
    """The sums per restaurant, sent back to each bucket in order of its contexts; and each range's
    own list of them as bucket -1."""
    def add(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        low, sums = rows[0]["range"] << RANGE, np.zeros((len(rows[0]["shares"]), 1 << RANGE), np.int64)
        at = [unpress_sorted(r["contexts"], r["size"]).astype(np.int64) - low for r in rows]
        there = np.zeros(1 << RANGE, bool)
        for r, own in zip(rows, at):
            there[own] = True
            for k, blob in enumerate(r["shares"]):
                sums[k, own] += unpress(blob, r["size"]).astype(np.int64)
        at.append(np.flatnonzero(there))
        return pa.table({
            "bucket": pa.array([*(r["bucket"] for r in rows), -1], pa.int32()),
            "range": pa.array([rows[0]["range"]] * len(at), pa.int64()), "size": pa.array([len(own) for own in at], pa.int64()),
            "sums": pa.array([[press(s[own]) for s in sums] for own in at], pa.list_(pa.binary())),
            "totals": pa.array([*(r["totals"] for r in rows), [0] * len(rows[0]["totals"])], pa.list_(pa.int64()))})

    return store.keep(shares.groupBy("range").applyInArrow(
        add, "bucket int, range long, size long, sums array<binary>, totals array<long>"))


def _totals(added: DataFrame, size: int) -> list[int]:
    return [int(x or 0) for x in added.agg(*(F.sum(F.col("totals")[k]) for k in range(size))).first()]


def _restaurants(rows: list, value: int) -> np.ndarray:
    """One of the sums of the restaurants that one bucket's pairs are in."""
    rows = sorted(rows, key=lambda r: r["range"])
    return np.concatenate([np.zeros(0, np.int64), *(unpress(r["sums"][value], r["size"]).astype(np.int64) for r in rows)])


def train(model: DataFrame, setting: Settings) -> list[State]:
    """The shared state before the first sweep and after each one."""
    def begin(batches):
        for batch in batches:
            for r in batch.to_pylist():
                own = Bucket.of(r).learned()
                fans = np.diff(np.r_[own.words(), len(own.key)])
                totals = [len(fans), (own.count == 1).sum(), (own.count == 2).sum(), (fans == 1).sum(), (fans == 2).sum(), own.count.sum(),
                          len(own.key)]
                sent = _shares(own, [own.per_context(own.count), own.per_context(np.ones(len(own.key)))], [int(x) for x in totals])
                yield from sent.to_batches()

    held = model.select("bucket", "size", "keys", "counts")
    added = _added(held.mapInArrow(begin, _SHARES))
    words_, one, two, fan_one, fan_two, tokens_, pairs_ = _totals(added, 7)

    def discount(a: int, b: int) -> float:
        return float(np.clip(a / max(a + 2 * b, 1), 0.05, 0.95))

    states = [State(tokens_, words_, discount(one, two), discount(fan_one, fan_two), added, added, pairs_, words_)]
    def sweep(now: State, turn: int):
        def once(bucket: pa.Table, replies: pa.Table) -> pa.Table:
            own = Bucket.of(bucket.to_pylist()[0]).learned()
            _, _, tables, customers, above = _sweep(own, _restaurants(replies.to_pylist(), -1), now, setting, turn)
            return _shares(own, [own.per_context(tables)], [int(customers.sum()), int(above.sum())])

        return once

    for turn in range(setting.sweeps):
        now = states[-1]
        shares = held.groupBy("bucket").cogroup(_replies(now.seated).groupBy("bucket")).applyInArrow(sweep(now.alone(), turn), _SHARES)
        added = _added(shares)
        customers, above = _totals(added, 2)
        states.append(replace(now, seated=added, parent_customers=customers, parent_tables=above))
    return states


def _replies(added: DataFrame, turn: int = 0) -> DataFrame:
    return added.where("bucket >= 0").select("bucket", "range", "size", "sums", F.lit(turn).alias("turn"))


def _answers(model: DataFrame, states: list[State], setting: Settings) -> DataFrame:
    """(block, bucket, size, logs, words, counts): log10 probability of each asked pair (32-bit floats, as
    numbers), training count of each of their words."""
    turns = range(setting.sweeps - setting.samples, setting.sweeps)
    shared = [state.alone() for state in states]
    replies = functools.reduce(DataFrame.unionAll, [_replies(states[0].opened, -1),
                                                    *(_replies(states[t].seated, t) for t in [*turns, setting.sweeps])])

    def answer(bucket: pa.Table, replies: pa.Table) -> pa.Table:
        r, rows = bucket.to_pylist()[0], replies.to_pylist()
        every = Bucket.of(r)
        own, learned = every.learned(), every.count > 0
        guests = _restaurants([x for x in rows if x["turn"] < 0], 0)
        seated = {t: _restaurants([x for x in rows if x["turn"] == t], -1) for t in [*turns, setting.sweeps]}
        word, known = every.key >> np.uint64(CONTEXT), own.key[own.words()] >> np.uint64(CONTEXT)
        at = np.minimum(np.searchsorted(known, word), max(len(known) - 1, 0))
        at = np.where(known[at] == word, at, len(known)) if len(known) else np.zeros(len(word), np.int64)
        total = np.r_[np.add.reduceat(own.count, own.words()) if len(known) else own.count, 0][at]
        p = np.zeros(len(word))
        for turn in turns:
            # The same sweep as in training, so the totals of the state after it are its own.
            _, _, tables, customers, above = _sweep(own, seated[turn], shared[turn], setting, turn)
            after = shared[turn + 1]
            left = (setting.strength + after.discount * seated[turn + 1]) / (setting.strength + guests)
            chance = np.r_[_parent_chance(customers, above, after, setting), _parent_chance(np.zeros(1), np.zeros(1), after, setting)]
            p += left[every.context] * chance[at]
            p[learned] += (own.count - after.discount * tables) / (setting.strength + guests[own.context])
        logs = np.log10(p / len(turns)).astype(np.float32).view(np.uint32)
        asked = [unpress_sorted(blob, size).astype(np.int64) for size, blob in zip(r["sizes"], r["asked"])]
        firsts = [a[np.r_[True, word[a[1:]] != word[a[:-1]]]] for a in asked]
        return pa.table({
            "block": pa.array(r["blocks"], pa.int64()), "bucket": pa.array([every.number] * len(asked), pa.int32()),
            "size": pa.array(r["sizes"], pa.int64()), "logs": pa.array([press(logs[a]) for a in asked], pa.binary()),
            "words": pa.array([len(f) for f in firsts], pa.int64()), "counts": pa.array([press(total[f]) for f in firsts], pa.binary())})

    return model.groupBy("bucket").cogroup(replies.groupBy("bucket")).applyInArrow(
        answer, "block long, bucket int, size long, logs binary, words long, counts binary")


def score(docs: DataFrame, setting: Settings = Settings(), modulus: int = 10, rest: int = 0) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    spark = docs.sparkSession
    buckets = max(16, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = blocks(docs, setting, buckets, modulus, rest)
    model = merged(parts)
    states = train(model, setting)
    answers = _answers(model, states, setting)
    total, vocabulary = states[0].tokens, states[0].vocabulary
    kind = docs.schema["doc_id"].dataType.simpleString()

    def add_up(own: pa.Table, replies: pa.Table) -> pa.Table:
        block = own.to_pylist()[0]
        rows = sorted(replies.to_pylist(), key=lambda r: r["bucket"])
        logs = np.concatenate([floats(r["logs"], r["size"]) for r in rows]).astype(np.float64)
        sizes = np.array(block["sizes"], np.int64)
        word, _, refs = pairs(unpress(block["refs"], block["n_refs"]).astype(np.int64), sizes, block["start"])
        counts = np.concatenate([unpress(r["counts"], r["words"]) for r in rows]).astype(np.float64)
        counts = counts[np.cumsum(np.r_[False, word[1:] != word[:-1]])]
        row = np.repeat(np.arange(len(sizes)), sizes)
        base = np.log10((counts + 0.1) / (total + 0.1 * (vocabulary + 1)))
        return pa.table({
            "doc_id": own["ids"].combine_chunks().flatten(), "held_out": pa.array(block["held"], pa.bool_()),
            "n_tokens": pa.array(sizes), "n_known": pa.array(words.group_sums((counts > 0)[refs].astype(float), row, len(sizes)).astype(np.int64)),
            "train_tokens": pa.array(np.full(len(sizes), total)), "base_score": pa.array(words.group_sums(base[refs], row, len(sizes))),
            "score": pa.array(words.group_sums(logs[refs], row, len(sizes)))})

    owners = parts.where("bucket < 0").select("block", "ids", "held", "sizes", "start", "refs", "n_refs")
    return owners.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        add_up, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
