"""Approximate nearest neighbours: NN-descent builds a neighbour graph, greedy search walks it.

Equal vectors are one node of the graph; of a node's rows only the ``k + 1`` smallest ids can
be among anyone's ``k`` nearest, so copies never crowd a neighbourhood. Building starts from
random small groups and repeats one local join: every node gathers a sample of its fresh
and old neighbours in both directions (``sample`` each), all gathered pairs with a fresh side
are compared, and each node keeps its ``degree`` nearest. Vectors travel in single precision while
building, on the scale of the median row, so rows of any size leave the others' distances as they
are. A search starts at a few fixed entries and, if its vector is in the index, at its
own node; each round expands everything in the beam of ``beam`` nearest that was not expanded, in
both directions of the graph, until nothing is left to expand. Search distances are
Euclidean, in double precision, on the original vectors. Every row is indexed.

The sample per round is the method's own; a pair not drawn in one round may be drawn in
another, and recall is measured against brute force in the tests.

Defined results: vectors that are null, zero, or hold a null or non-finite number take no part,
nor do those of another length than most; ties go to the smaller id; with fewer candidates
than ``k`` all are returned; a null id takes no part; rows that repeat an id count once per vector.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import store


@dataclass(frozen=True)
class Settings:
    k: int = 10
    degree: int = 24
    sample: int = 16
    offers: int = 6
    start_group: int = 48
    start_rounds: int = 3
    rounds: int = 9
    settled: float = 0.04
    beam: int = 400
    entries: int = 32
    seed: int = 5


def usable(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, vec) of the rows that take part, as long and array<double>."""
    own = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec"))
    sound = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    own = own.where(F.col("id").isNotNull() & F.col("vec").isNotNull() & sound).withColumn(
        "vec", F.transform("vec", lambda x: x + F.lit(0.0)))
    sizes = own.groupBy(F.size("vec").alias("s")).count().orderBy(F.desc("count"), "s").limit(1).collect()
    return own.where(F.size("vec") == (sizes[0]["s"] if sizes else 0))


def _matrix(vectors: pa.Array) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(vectors), -1)


def _classes(rows: DataFrame, setting: Settings) -> tuple[DataFrame, DataFrame]:
    """(node, vec) of the distinct vectors, and (node, id) of the ids that may be returned."""
    by_id = Window.partitionBy("vec").orderBy("id")
    few = store.keep(rows.withColumn("_r", F.row_number().over(by_id)).where(F.col("_r") <= setting.k + 1))
    nodes = store.keep(few.where("_r = 1").select(F.xxhash64("vec").alias("node"), "vec"))
    return nodes, few.select(F.xxhash64("vec").alias("node"), "id")


#: Scaled components beyond this are cut to it while the graph is built: their rows stay far from all others.
FAR = 1e30


def _small(nodes: DataFrame) -> DataFrame:
    """(node, q): vectors in single precision, the median row's largest component being 1."""
    largest = F.array_max(F.transform("vec", lambda x: F.abs(x)))
    scale = nodes.agg(F.percentile_approx(largest, 0.5)).first()[0] or 1.0

    @F.arrow_udf("binary")
    def shrink(vec: pa.Array) -> pa.Array:
        with np.errstate(over="ignore"):  # cut below
            scaled = np.clip(_matrix(vec) / scale, -FAR, FAR).astype(np.float32)
        return pa.array([r.tobytes() for r in scaled], pa.binary())

    return store.keep(nodes.select("node", shrink("vec").alias("q")))


def _offers(group: np.ndarray, node: np.ndarray, fresh: np.ndarray, radius: np.ndarray, q: np.ndarray, best: int):
    """(u, v, d) for whole groups of rows: each member's nearest other members with a fresh side."""
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[first, len(group)])
    for width in np.unique(size):
        if width < 2:
            continue
        starts = first[size == width]
        for begin in range(0, len(starts), max(1, (1 << 21) // (width * max(width, q.shape[1])))):
            at = starts[begin:begin + max(1, (1 << 21) // (width * max(width, q.shape[1])))][:, None] + np.arange(width)
            x = q[at].astype(np.float64)
            norm = (x * x).sum(-1)
            d = norm[:, :, None] + norm[:, None, :] - 2 * np.matmul(x, x.transpose(0, 2, 1))
            d = np.sqrt(np.maximum(d, 0, out=d), out=d)
            f, m = fresh[at], node[at]
            d[~(f[:, :, None] | f[:, None, :]) | (m[:, :, None] == m[:, None, :])] = np.inf
            d[d >= radius[at][:, :, None]] = np.inf
            take = min(best, width - 1)
            near = np.argpartition(d, take - 1, axis=2)[:, :, :take]
            value = np.take_along_axis(d, near, 2)
            g, i, j = np.nonzero(np.isfinite(value))
            yield m[g, i], m[g, near[g, i, j]], value[g, i, j]


def _local_join(members: DataFrame, best: int) -> DataFrame:
    """(u, v, d) from rows (w, node, fresh, radius, q), at most a few dozen rows for each w."""
    def join(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if rest is not None:
                table = pa.concat_tables([rest, table])
            group = table["w"].to_numpy()
            if not len(group):
                continue
            cut = int(np.searchsorted(group, group[-1]))  # the last group may go on
            rest = table.slice(cut)
            yield from done(table.slice(0, cut))
        if rest is not None:
            yield from done(rest)

    def done(table):
        if table.num_rows:
            q = np.frombuffer(b"".join(table["q"].to_pylist()), np.float32).reshape(table.num_rows, -1)
            columns = (table[c].to_numpy() for c in ("w", "node", "fresh", "radius"))
            for u, v, d in _offers(*columns, q, best):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(d.astype(np.float32))], ["u", "v", "d"])

    return (members.select("w", "node", "fresh", "radius", "q").repartition("w").sortWithinPartitions("w")
            .mapInArrow(join, "u long, v long, d float"))


def _nearest(offers: DataFrame, setting: Settings) -> DataFrame:
    """The ``degree`` nearest distinct neighbours of each u; an edge known before is not fresh."""
    one = offers.groupBy("u", "v").agg(F.min("d").alias("d"), F.bool_and("fresh").alias("fresh"))
    place = F.row_number().over(Window.partitionBy("u").orderBy("d", "v"))
    return store.keep(one.withColumn("_r", place).where(F.col("_r") <= setting.degree).drop("_r"))


def neighbour_graph(nodes: DataFrame, setting: Settings = Settings()) -> DataFrame:
    """(u, v, d) of every node's nearest neighbours found, from (node, vec)."""
    small = _small(nodes)
    count = small.count()
    groups = max(1, count // setting.start_group)
    everywhere = F.lit(float("inf")).cast("float").alias("radius")
    start = None
    for turn in range(setting.start_rounds):
        own = small.select(F.pmod(F.xxhash64("node", F.lit(setting.seed + turn)), F.lit(groups)).alias("w"),
                           "node", F.lit(True).alias("fresh"), everywhere, "q")
        start = own.withColumn("w", F.col("w") * setting.start_rounds + turn) if start is None else start.unionByName(
            own.withColumn("w", F.col("w") * setting.start_rounds + turn))
    graph = _nearest(_local_join(start, setting.degree).withColumn("fresh", F.lit(True)), setting)
    for turn in range(setting.rounds):
        either = graph.select(F.col("u").alias("w"), F.col("v").alias("node"), "fresh").unionByName(
            graph.select(F.col("v").alias("w"), F.col("u").alias("node"), "fresh"))
        drawn = F.row_number().over(Window.partitionBy("w", "fresh").orderBy(F.xxhash64("w", "node", F.lit(turn)), "node"))
        some = either.withColumn("_r", drawn).where(F.col("_r") <= setting.sample)
        radius = graph.groupBy(F.col("u").alias("node")).agg(
            F.when(F.count("*") >= setting.degree, F.max("d")).otherwise(F.lit(float("inf"))).cast("float").alias("radius"))
        side = small.join(radius, "node", "left").withColumn("radius", F.coalesce("radius", F.lit(float("inf")).cast("float")))
        found = _local_join(some.join(side, "node"), setting.offers)
        graph = _nearest(found.withColumn("fresh", F.lit(True)).unionByName(
            graph.withColumn("fresh", F.lit(False))), setting)
        share = graph.agg(F.avg(F.col("fresh").cast("int"))).first()[0] or 0.0
        if share < setting.settled:
            break
    return graph.select("u", "v", "d")


def _distance():
    @F.arrow_udf("double")
    def distance(left: pa.Array, right: pa.Array) -> pa.Array:
        if not len(left):
            return pa.array([], pa.float64())
        gap = _matrix(left) - _matrix(right)
        return pa.array(np.sqrt((gap * gap).sum(axis=1)))

    return distance


def walk(queries: DataFrame, nodes: DataFrame, graph: DataFrame, setting: Settings = Settings()) -> DataFrame:
    """(query, node, d): the beam of every query (query, qvec) at the end of a greedy search."""
    links = store.keep(graph.select("u", "v").unionByName(graph.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    entries = [r["node"] for r in nodes.select("node").orderBy(F.xxhash64("node", F.lit(setting.seed)), "node").limit(setting.entries).collect()]
    begin = queries.select("query", F.explode(F.array([F.lit(e) for e in entries]).cast("array<long>")).alias("node"))
    own = queries.select("query", F.xxhash64("qvec").alias("node")).join(nodes.select("node"), "node", "left_semi")
    distance = _distance()

    def measured(pairs: DataFrame) -> DataFrame:
        return (pairs.join(nodes, "node").join(queries, "query")
                .select("query", "node", distance("qvec", "vec").alias("d"), F.lit(False).alias("done")))

    def beam_of(rows: DataFrame) -> DataFrame:
        one = rows.groupBy("query", "node").agg(F.min("d").alias("d"), F.bool_or("done").alias("done"))
        place = F.row_number().over(Window.partitionBy("query").orderBy("d", "node"))
        return store.keep(one.withColumn("_r", place).where(F.col("_r") <= setting.beam).drop("_r"))

    beam = beam_of(measured(begin.unionByName(own.select("query", "node")).distinct()))
    while not (frontier := beam.where("NOT done")).isEmpty():
        reached = (frontier.select("query", F.col("node").alias("u")).join(links, "u").select("query", F.col("v").alias("node"))
                   .distinct().join(beam.select("query", "node"), ["query", "node"], "left_anti"))
        beam = beam_of(measured(reached).unionByName(beam.withColumn("done", F.lit(True))))
    return beam.select("query", "node", "d")


def nearest(vectors: DataFrame, every: int = 100, setting: Settings = Settings()) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest other rows of every row whose id divides by ``every``."""
    rows = store.keep(usable(vectors))
    nodes, ids = _classes(rows, setting)
    graph = neighbour_graph(nodes, setting)
    queries = store.keep(rows.where(F.col("id") % every == 0).select(F.col("id").alias("query"), F.col("vec").alias("qvec")))
    found = walk(queries.dropDuplicates(["query"]), nodes, graph, setting)
    place = F.row_number().over(Window.partitionBy("query").orderBy("d", "id"))
    return (found.join(ids, "node").where(F.col("id") != F.col("query")).withColumn("rank", place)
            .where(F.col("rank") <= setting.k)
            .select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), F.col("d").alias("score")))
