"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Every text is the set of its words, its pairs of neighbours and its pairs with one word
between, each hashed into ``2**bits`` coordinates. FTRL-proximal keeps a learning rate per
coordinate and an L1 penalty, so most weights are exactly zero; what is broadcast is the
list of the others, at most ``2**bits`` numbers. Training reads a bounded sample of
labelled rows (``sample_rows`` rows of at most ``sample_features`` features); scoring reads
every whole text.

Defined results: a null, empty or blank text has no feature and gets the score of the bias
alone; without labelled rows of both classes every score is the share of label 1 (0.0
without labels). Repeated rows get equal scores, and columns of any other name pass by.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import store, words


@dataclass(frozen=True)
class Settings:
    bits: int = 20
    sample_rows: int = 10000
    sample_features: int = 8192
    passes: int = 5
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 12.0
    l2: float = 1.0
    rare_weight: float = 4.0
    threshold: float = 0.7


@dataclass(frozen=True)
class Model:
    """Coordinates with a weight, in ascending order, their weights, and the bias."""

    bits: int
    index: np.ndarray
    weight: np.ndarray
    bias: float


def features(text: words.Words, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, coordinate) of every word, neighbour pair and skip pair; not yet distinct."""
    h, row = text.hash, text.row
    kinds, rows = [words.mix(h ^ np.uint64(0x51))], [row]
    for gap, salt in ((1, 0xA7), (2, 0xC3)):
        if len(h) > gap:
            same = row[:-gap] == row[gap:]
            kinds.append(words.pair(h[:-gap][same], h[gap:][same] ^ np.uint64(salt)))
            rows.append(row[gap:][same])
    return np.concatenate(rows), (np.concatenate(kinds) >> np.uint64(64 - bits)).astype(np.int64)


def _distinct(row: np.ndarray, index: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    code = np.unique((row.astype(np.int64) << bits) | index)
    return code >> bits, code & ((1 << bits) - 1)


def feature_lists(texts: pa.Array, bits: int) -> pa.Array:
    """The distinct coordinates of every text as a list column."""
    parts = []
    for _, piece in words.slices(texts):
        row, index = _distinct(*features(words.split(piece), bits), bits)
        at = np.r_[0, np.cumsum(np.bincount(row, minlength=len(piece)))]
        parts.append(pa.ListArray.from_arrays(at.astype(np.int32), index.astype(np.int32)))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))


def train(rows: list[np.ndarray], labels: np.ndarray, setting: Settings) -> Model:
    """FTRL-proximal over the rows, one at a time, ``passes`` times in a fixed random order."""
    share = float(labels.mean()) if len(labels) else 0.0
    if not 0 < share < 1:
        return Model(setting.bits, np.zeros(0, np.int64), np.zeros(0), np.inf if share else -np.inf)
    z, n = np.zeros(1 << setting.bits), np.zeros(1 << setting.bits)
    z_bias, n_bias, bias = 0.0, 0.0, float(np.log(share / (1 - share)))
    start = bias
    rng = np.random.default_rng(7)

    def weights(at: np.ndarray) -> np.ndarray:
        gone = np.maximum(np.abs(z[at]) - setting.l1, 0.0)
        return -np.sign(z[at]) * gone / ((setting.beta + np.sqrt(n[at])) / setting.alpha + setting.l2)

    for _ in range(setting.passes):
        for i in rng.permutation(len(rows)):
            at = rows[i]
            own = weights(at)
            slope = 1 / (1 + np.exp(-np.clip(bias + own.sum(), -35, 35))) - labels[i]
            slope *= setting.rare_weight if labels[i] else 1.0
            step = (np.sqrt(n[at] + slope * slope) - np.sqrt(n[at])) / setting.alpha
            z[at] += slope - step * own
            n[at] += slope * slope
            move = (np.sqrt(n_bias + slope * slope) - np.sqrt(n_bias)) / setting.alpha
            z_bias += slope - move * (bias - start)
            n_bias += slope * slope
            bias = start - z_bias / ((setting.beta + np.sqrt(n_bias)) / setting.alpha + setting.l2)
    everywhere = np.flatnonzero(np.abs(z) > setting.l1)
    return Model(setting.bits, everywhere, weights(everywhere), bias)


def fit(docs: DataFrame, labels: DataFrame, setting: Settings = Settings(), modulus: int = 3,
        rest: int = 1, label: str = "toxic") -> Model:
    """Learn from labelled rows of ``docs`` whose key's remainder is not ``rest``."""
    bits = setting.bits

    @F.arrow_udf("array<int>")
    def listed(text: pa.Array) -> pa.Array:
        return feature_lists(text, bits)

    own = store.labelled(docs.select("doc_id", "text"), labels, label, modulus, rest, setting.sample_rows)
    table = (own.select("doc_id", "_label", listed("text").alias("_f"))
             .where(F.size("_f") <= setting.sample_features).toArrow())
    order = np.lexsort((table["_label"].to_numpy(), table["doc_id"].to_numpy()))
    lists = table["_f"].combine_chunks()
    rows = [lists[int(i)].values.to_numpy() for i in order]
    return train(rows, table["_label"].to_numpy()[order].astype(float), setting)


def score_texts(texts: pa.Array, model: Model) -> np.ndarray:
    out = np.zeros(len(texts))
    table = np.zeros(1 << model.bits)
    table[model.index] = model.weight
    for first, piece in words.slices(texts):
        row, index = features(words.split(piece), model.bits)
        used = table[index] != 0
        row, index = _distinct(row[used], index[used], model.bits)
        total = model.bias + words.group_sums(table[index], row, len(piece))
        with np.errstate(over="ignore"):
            out[first:first + len(piece)] = 1 / (1 + np.exp(-total))
    return out


def scorer(docs: DataFrame, model: Model):
    """A column function: text column -> probability of label 1."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        return pa.array(score_texts(text, sent.value))

    return score


def toxicity(docs: DataFrame, labels: DataFrame, setting: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    score = scorer(docs, fit(docs, labels, setting))
    return (docs.select("doc_id", store.held_out("doc_id", 3, 1).alias("held_out"), score("text").alias("score"))
            .withColumn("predicted", (F.col("score") >= setting.threshold).cast("int")))


def drop_toxic(docs: DataFrame, labels: DataFrame, setting: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` whose score is below the threshold, all columns as they are."""
    score: Column = scorer(docs, fit(docs, labels, setting))("text")
    return docs.where(score < setting.threshold)
