"""Near-duplicate documents by MinHash with tensored banding, links confirmed on full sets.

A document is the set of its ``width``-word shingles (A-Z lower-cased). Two collections of
``bands`` short bands of ``rows`` minhashes each are computed; every pair of a band of the
first and a band of the second makes one table key. So ``bands**2`` keys of ``2 * rows``
minhashes cost only ``2 * bands * rows`` minhashes, about a square root of what as many
independent keys need. A pair of similarity s is missed by all keys with probability
``1 - (1 - (1 - s**rows)**bands)**2``: 1.5e-4 at s = 0.85 and 1e-8 at 0.95 with the settings
below (3 rows, 10 bands).

Equal sets are one node, so exact copies never meet each other. Inside a key, nodes meet one
centre first; in ``rounds`` further turns a centre is drawn anew for each key; what
confirmed links have merged by then needs no more comparing. What is still apart though it shares a key meets by the order of its rarest shingles, across
components only, which finds every link that is left; no key is capped. Sizes that rule a link out, and sketches that agree far too little for one (more than five standard
deviations), are put aside before the texts are compared. Components come from repeated
contraction in Spark; nothing of the corpus is gathered on the driver.

Defined results: a document without words (null, empty, blank) has n_shingles 0 and is linked
with nothing; with fewer words than ``width`` the whole sequence is its one shingle. A null
doc_id is never linked: its component_id is null and it is kept. Rows that repeat a doc_id
are judged by their own texts. Columns of any other name pass by.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import store, words


@dataclass(frozen=True)
class Settings:
    width: int = 5
    percent: int = 80
    rows: int = 3
    bands: int = 10
    rounds: int = 1
    order_bits: int = 18
    order_sample: int = 20_000
    broadcast_nodes: int = 2_000_000

    @property
    def hashes(self) -> int:
        return 2 * self.rows * self.bands

    @property
    def least_agreeing(self) -> int:
        """Of the sketch's hashes, how many agree at least in a pair at the threshold."""
        s = self.percent / 100
        return max(1, int(self.hashes * s - 5.5 * (self.hashes * s * (1 - s)) ** 0.5))


def shingles(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of a slice of texts, sorted by both."""
    text = words.split(texts)
    h, row, count = text.hash, text.row, text.counts()
    parts, rows = [], []
    if len(h) >= width:
        acc = h[:len(h) - width + 1]
        for k in range(1, width):
            acc = words.pair(acc, h[k:len(h) - width + 1 + k])
        same = row[:len(acc)] == row[width - 1:]
        parts.append(acc[same])
        rows.append(row[:len(acc)][same])
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        first = np.searchsorted(row, short)
        for n in range(1, width):
            own = first[count[short] == n]
            acc = h[own] ^ np.uint64(0x5EED + n)
            for k in range(1, n):
                acc = words.pair(acc, h[own + k])
            parts.append(acc)
            rows.append(row[own])
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h, row = np.concatenate(parts), np.concatenate(rows)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[new], h[new]


def _multipliers(count: int) -> np.ndarray:
    return np.random.default_rng(4242).integers(1, 1 << 62, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sketches(texts: pa.Array, setting: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text of a slice: size of its set, the set's hash, its minhashes (uint32 rows)."""
    row, h = shingles(texts, setting.width)
    size = np.bincount(row, minlength=len(texts))
    node = np.zeros(len(texts), np.uint64)
    low = np.zeros((len(texts), setting.hashes), np.uint32)
    if len(row):
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        own = row[first]
        node[own] = words.pair(np.add.reduceat(words.mix(h), first), size[own].astype(np.uint64))
        for k, a in enumerate(_multipliers(setting.hashes)):
            low[own, k] = np.minimum.reduceat(((h * a) >> np.uint64(32)).astype(np.uint32), first)
    return size, node, low


def _signed(docs: DataFrame, setting: Settings) -> DataFrame:
    """doc_id, n_shingles, node, sketch of every row; node is null where nothing can be linked."""
    shape = T.StructType([T.StructField("n", T.LongType()), T.StructField("node", T.LongType()),
                          T.StructField("sketch", T.BinaryType())])

    @F.arrow_udf(shape)
    def sign(text: pa.Array) -> pa.Array:
        sizes, nodes, lows = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], []
        for _, piece in words.slices(text):
            size, node, low = sketches(piece, setting)
            sizes.append(size)
            nodes.append(node)
            lows += [r.tobytes() for r in low]
        size = np.concatenate(sizes)
        return pa.StructArray.from_arrays(
            [pa.array(size), pa.array(np.concatenate(nodes).view(np.int64), mask=size == 0),
             pa.array(lows, pa.binary())], ["n", "node", "sketch"])

    return (docs.select("doc_id", sign("text").alias("_s"))
            .select("doc_id", F.col("_s.n").alias("n_shingles"),
                    F.when(F.col("doc_id").isNotNull(), F.col("_s.node")).alias("node"), F.col("_s.sketch").alias("sketch")))


def table_keys(low: np.ndarray, setting: Settings) -> np.ndarray:
    """(texts x bands**2) keys: each band of the first half with each band of the second."""
    bands = low.reshape(len(low), 2 * setting.bands, setting.rows).astype(np.uint64)
    acc = np.broadcast_to(words.mix(np.arange(2 * setting.bands, dtype=np.uint64) + np.uint64(1)), bands.shape[:2])
    for k in range(setting.rows):
        acc = words.pair(acc, bands[:, :, k])
    left, right = acc[:, :setting.bands, None], acc[:, None, setting.bands:]
    return words.pair(left, right).reshape(len(low), -1)


def _keys(nodes: DataFrame, setting: Settings) -> DataFrame:
    """(key, node, n) for every key of every node."""
    per = setting.bands ** 2

    def emit(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            low = np.frombuffer(b"".join(batch["sketch"].to_pylist()), np.uint32).reshape(batch.num_rows, -1)
            for start in range(0, len(low), 512):
                part = slice(start, start + 512)
                keys = table_keys(low[part], setting).ravel().view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), pa.array(np.repeat(batch["node"].to_numpy()[part], per)),
                     pa.array(np.repeat(batch["n"].to_numpy()[part], per))], ["key", "node", "n"])

    return nodes.select("node", "n", "sketch").mapInArrow(emit, "key long, node long, n long")


def _may_link(setting: Settings):
    """n, m: can sets of these sizes be similar enough?"""
    small, large = F.least("n", "m"), F.greatest("n", "m")
    return 100 * small >= setting.percent * large


def _texts(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, setting: Settings) -> DataFrame:
    """(node, text, sketch) of the nodes in ``pairs``: broadcast ids up to a bound, a shuffled join beyond it."""
    wanted = (pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
              .join(nodes.select("node", "doc_id", "sketch"), "node"))
    wanted = store.keep(wanted)
    ids = wanted.select("node", "doc_id")
    if wanted.count() <= setting.broadcast_nodes:
        ids = F.broadcast(ids)

    @F.arrow_udf("long")
    def node_of(text: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.zeros(0, np.uint64), *(
            sketch_node(piece, setting) for _, piece in words.slices(text))]).view(np.int64))

    texts = (docs.select("doc_id", "text").join(ids, "doc_id").where(node_of("text") == F.col("node"))
             .groupBy("node").agg(F.first("text").alias("text")))
    return texts.join(wanted.select("node", "sketch"), "node")


def sketch_node(piece: pa.Array, setting: Settings) -> np.ndarray:
    """The set hash alone of each text of a slice, as in ``sketches``."""
    row, h = shingles(piece, setting.width)
    size = np.bincount(row, minlength=len(piece))
    node = np.zeros(len(piece), np.uint64)
    if len(row):
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        node[row[first]] = words.pair(np.add.reduceat(words.mix(h), first), size[row[first]].astype(np.uint64))
    return node


def similar(left: pa.Array, right: pa.Array, setting: Settings) -> np.ndarray:
    """For each pair of texts: 100 * intersection >= percent * union, on full sets."""
    out = np.zeros(len(left), bool)
    for start in range(0, len(left), 64):
        sets = []
        for side in (left, right):
            for _, piece in words.slices(side.slice(start, 64)):
                row, h = shingles(piece, setting.width)
                at = np.searchsorted(row, np.arange(len(piece) + 1))
                sets += [h[at[i]:at[i + 1]] for i in range(len(piece))]
        half = len(sets) // 2
        for i in range(half):
            a, b = sets[i], sets[half + i]
            common = len(np.intersect1d(a, b, assume_unique=True))
            out[start + i] = 100 * common >= setting.percent * (len(a) + len(b) - common) and common > 0
    return out


def _confirmed(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, setting: Settings) -> DataFrame:
    """The pairs (a, b) that are links. Each pair meets its texts and sketches once; texts are
    compared where the sketches agree well enough."""
    if pairs.isEmpty():
        return pairs
    sides = store.keep(_texts(docs, nodes, pairs, setting))
    least = setting.least_agreeing

    @F.arrow_udf("boolean")
    def linked(left: pa.Array, right: pa.Array, one: pa.Array, other: pa.Array) -> pa.Array:
        a, b = (np.frombuffer(b"".join(c.to_pylist()), np.uint32).reshape(len(c), -1) for c in (one, other))
        out, likely = np.zeros(len(left), bool), np.flatnonzero((a == b).sum(axis=1) >= least)
        at = pa.array(likely)
        out[likely] = similar(left.take(at), right.take(at), setting)
        return pa.array(out)

    both = (pairs.join(sides.toDF("a", "_left", "_one"), "a").join(sides.toDF("b", "_right", "_other"), "b"))
    return store.keep(both.where(linked("_left", "_right", "_one", "_other")).select("a", "b"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link. Each round, a node joins the neighbour that
    comes first in a random order, and the graph is contracted: a few rounds for any shape."""
    edges = links.where("a <> b")
    found, rounds = None, 0
    while not edges.isEmpty():
        def rank(name: str, seed: int = rounds):
            return F.struct(F.xxhash64(F.col(name), F.lit(seed)).alias("h"), F.col(name).alias("v"))

        hook = store.keep(
            edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            .groupBy(F.col("a").alias("v")).agg(F.min(rank("b")).alias("_low"))
            .select("v", F.least(F.col("_low"), rank("v")).getField("v").alias("p")))
        if found is None:
            found = hook.select(F.col("v").alias("node"), F.col("p").alias("root"))
        else:
            found = store.keep(found.join(hook, F.col("root") == F.col("v"), "left")
                               .select("node", F.coalesce("p", "root").alias("root")))
        edges = store.keep(
            edges.join(hook.toDF("a", "_a"), "a").join(hook.toDF("b", "_b"), "b")
            .select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
            .where("a <> b").distinct())
        rounds += 1
    return found if found is not None else links.selectExpr("a AS node", "b AS root").where("false")


def near_duplicates(docs: DataFrame, setting: Settings = Settings()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, and the row's ``node`` and the ``root`` of its component, of every row."""
    signed = store.keep(_signed(docs, setting))
    nodes = store.keep(
        signed.where("node IS NOT NULL").groupBy("node")
        .agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")))
    keys = _keys(nodes, setting)
    shared = (keys.groupBy("key").agg(F.count("*").alias("_c"), F.min(F.struct("node", "n")).alias("_low"))
              .where("_c > 1").select("key", F.col("_low.node").alias("centre"), F.col("_low.n").alias("m")))
    met = store.keep(keys.join(shared, "key").select("key", "node", "n", "centre", "m"))
    pairs = store.keep(met.where((F.col("node") != F.col("centre")) & _may_link(setting))
                       .select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct())
    met, tried = met.select("key", "node", "n"), pairs
    links = _confirmed(docs, nodes, pairs, setting)
    for turn in range(setting.rounds + 1):
        apart = _apart(met, components(links))
        if turn < setting.rounds:
            pairs = store.keep(_to_centres(apart, turn, setting).join(tried, ["a", "b"], "left_anti"))
        else:
            pairs = store.keep(_rest(docs, nodes, apart, setting).join(tried, ["a", "b"], "left_anti"))
        links = links.unionByName(_confirmed(docs, nodes, pairs, setting))
        tried = tried.unionByName(pairs)
    roots = components(links)
    named = (nodes.select("node", "doc_id").join(roots, "node", "left")
             .withColumn("root", F.coalesce("root", "node")))
    ids = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_node = named.join(ids, "root").select("node", "component_id", "root")
    return (signed.join(of_node, "node", "left")
            .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
                    F.coalesce(F.coalesce("component_id", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"), "node", "root"))


def _apart(met: DataFrame, roots: DataFrame) -> DataFrame:
    """key, node, n, root of the keys whose nodes are not yet one component."""
    placed = met.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = (placed.groupBy("key").agg(F.min("root").alias("_a"), F.max("root").alias("_b"))
               .where("_a <> _b").select("key"))
    return store.keep(placed.join(several, "key", "left_semi").select("key", "node", "n", "root"))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _to_centres(apart: DataFrame, turn: int, setting: Settings) -> DataFrame:
    """Each node with one node per key, drawn anew for every key and turn, of another component."""
    drawn = F.min(F.struct(F.xxhash64("node", "key", F.lit(turn)), "node", "n", "root")).alias("_c")
    centres = apart.groupBy("key").agg(drawn).select(
        "key", F.col("_c.node").alias("a"), F.col("_c.n").alias("m"), F.col("_c.root").alias("_root"))
    return _ordered(apart.join(centres, "key").where((F.col("root") != F.col("_root")) & _may_link(setting))
                    .select("a", F.col("node").alias("b")))


def _frequencies(texts: DataFrame, setting: Settings) -> np.ndarray:
    """About how often shingles occur, by hash bucket, from a bounded sample of texts. It only
    decides the order of shingles in ``_rest``; any order gives the same pairs."""
    bits = setting.order_bits

    def count(batches):
        for batch in batches:
            for _, piece in words.slices(batch["text"]):
                _, h = shingles(piece, setting.width)
                bucket, times = np.unique((h >> np.uint64(64 - bits)).astype(np.int32), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(times)], ["bucket", "n"])

    found = (store.sample_of(texts, "node", setting.order_sample).select("text")
             .mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow())
    out = np.zeros(1 << bits, np.int64)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def _rest(docs: DataFrame, nodes: DataFrame, apart: DataFrame, setting: Settings) -> DataFrame:
    """Every pair of nodes of different components that may be a link.

    With shingles in one order for all, rarest first, linked sets share a shingle among the first
    ``n - ceil(s * n) + 1`` of both; the places of the first shared one bound the overlap.
    """
    own = store.keep(apart.select("node", "n", "root").distinct())
    pairs = own.select(F.col("node").alias("a"), F.col("node").alias("b"))
    texts = store.keep(_texts(docs, nodes, pairs, setting).drop("sketch"))
    sent = docs.sparkSession.sparkContext.broadcast(_frequencies(texts, setting))
    bits, percent = setting.order_bits, setting.percent

    def prefixes(batches):
        often = sent.value
        for batch in batches:
            node = batch["node"].to_numpy()
            for begin, piece in words.slices(batch["text"]):
                row, h = shingles(piece, setting.width)
                order = np.lexsort((h, often[(h >> np.uint64(64 - bits)).astype(np.int64)], row))
                h, size = h[order], np.bincount(row, minlength=len(piece))
                place = np.arange(len(h)) - (np.cumsum(size) - size)[row]
                early = place <= (size - -(-percent * size // 100))[row]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[early].view(np.int64)), pa.array(node[begin + row[early]]), pa.array(place[early])],
                    ["shingle", "node", "place"])

    rows = (texts.select("node", "text").mapInArrow(prefixes, "shingle long, node long, place long").join(own, "node"))
    rows = store.keep(rows)
    # Of each shingle's components one is the largest; the rows of the others meet all rows. So two
    # rows of one component are looked at no more often than two of different ones.
    largest = (rows.groupBy("shingle", "root").agg(F.count("*").alias("_c")).groupBy("shingle")
               .agg(F.max(F.struct("_c", "root")).alias("_top"), F.count("*").alias("_roots")).where("_roots > 1")
               .select("shingle", F.col("_top.root").alias("_largest")))
    shared = rows.join(largest, "shingle")
    left = shared.where("root <> _largest").select(
        "shingle", F.col("node").alias("a"), "n", F.col("root").alias("_ra"), F.col("place").alias("_i"))
    right = shared.select("shingle", F.col("node").alias("b"), F.col("n").alias("m"), F.col("root").alias("_rb"), F.col("place").alias("_j"))
    most = F.least(F.col("n") - F.col("_i"), F.col("m") - F.col("_j"))
    return _ordered(left.join(right, "shingle").where(
        (F.col("_ra") != F.col("_rb")) & (100 * most >= percent * (F.col("n") + F.col("m") - most))).select("a", "b"))


def drop_copies(docs: DataFrame, setting: Settings = Settings()) -> DataFrame:
    """One row of every group of near copies, all columns as they are.

    The row of the smallest doc_id stays; of its rows, where it repeats, one with the smallest
    set hash. Rows are judged each by its own text, so a doc_id that also stands for a different text keeps
    that one. Rows without words and rows without a doc_id all stay.
    """
    found = store.keep(near_duplicates(docs, setting).select("doc_id", "node", "root"))
    first = (found.where("node IS NOT NULL").groupBy("root").agg(F.min(F.struct("doc_id", "node")).alias("_first")))
    judged = store.keep(found.join(first, "root", "left").select(
        "doc_id", "node", (F.col("node").isNull() | (F.col("_first") == F.struct("doc_id", "node"))).alias("_stays")))
    by_id = store.keep(judged.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.count("*").alias("_n"), F.count_if("_stays").alias("_k")).where("_n > 1 OR _k = 0"))
    gone, several = by_id.where("_k = 0").select("doc_id"), by_id.where("_k > 0").select("doc_id")

    def bounded(ids: DataFrame) -> DataFrame:
        return F.broadcast(ids) if ids.count() <= setting.broadcast_nodes else ids

    left = docs.join(bounded(gone), "doc_id", "left_anti")
    if several.isEmpty():
        return left.select(*docs.columns)

    @F.arrow_udf("long")
    def node_of(text: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.zeros(0, np.uint64), *(
            sketch_node(piece, setting) for _, piece in words.slices(text))]).view(np.int64))

    several = bounded(several)
    stay = judged.where("_stays AND node IS NOT NULL").select("doc_id", F.col("node").alias("_own_node")).join(
        several, "doc_id", "left_semi").distinct()
    rows = left.join(several, "doc_id", "left_semi").withColumn("_own_node", node_of("text"))
    once = rows.join(stay, ["doc_id", "_own_node"], "left_semi").dropDuplicates(["doc_id", "_own_node"])
    wordless = rows.where("_own_node = 0")
    return (left.join(several, "doc_id", "left_anti").select(*docs.columns)
            .unionByName(once.select(*docs.columns)).unionByName(wordless.select(*docs.columns)))
