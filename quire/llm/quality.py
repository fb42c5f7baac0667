"""Text quality by a factorisation machine.

A text is a set of active features: its distinct words hashed into ``2**bits`` columns, each
worth ``1 / sqrt(number of them)``; one bin for each structure statistic (shares of letter
cases, digits, symbols, lines, repeated and distinct words, and so on); one bin for the
metadata column ``n_chars``. The machine adds a weight per feature and a ``rank``-wide inner
product per pair of features; all pairs together cost linear time because

    sum over pairs <v_i, v_j> x_i x_j = (|sum v_i x_i|^2 - sum |v_i x_i|^2) / 2.

It is fitted by AdaGrad on a bounded sample of labelled rows (``sample_rows`` rows of at most
``sample_features`` features); what is broadcast has ``2**bits`` rows. Scoring reads every
whole text. Language, source and doc_id are never read.

Defined results: a null, empty or blank text has no words and is scored by its structure
bins; a null ``n_chars`` has a bin of its own; without labelled rows of both classes every
score is the share of label 1 (0.0 without labels). Repeated rows get equal scores.
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
    bits: int = 16
    rank: int = 8
    bins: int = 12
    sample_rows: int = 8000
    sample_features: int = 8192
    passes: int = 6
    batch: int = 64
    rate: float = 0.08
    decay: float = 1e-5
    threshold: float = 0.7


STATISTICS = ("letters", "upper", "digits", "symbols", "other", "lines", "count", "length",
              "distinct", "top", "ends", "n_chars")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_PLAIN_END = np.zeros(256, bool)
_PLAIN_END[[ord(c) for c in ".,;:?\"')"]] = True


@dataclass(frozen=True)
class Features:
    """Distinct words (row, column, how many in the row) and one statistics row per text."""

    row: np.ndarray
    column: np.ndarray
    size: np.ndarray
    statistics: np.ndarray


@dataclass(frozen=True)
class Model:
    edges: np.ndarray
    bias: float
    weight: np.ndarray
    factor: np.ndarray
    setting: Settings


def features(texts: pa.Array, n_chars: np.ndarray, bits: int) -> Features:
    """Words and statistics of one slice of texts."""
    text = words.split(texts)
    rows = text.rows
    bytes_of = np.diff(text.offsets)
    per_byte = np.maximum(bytes_of, 1)
    at = np.repeat(np.arange(rows), bytes_of)
    raw = text.raw
    letter = ((raw | 32) >= 97) & ((raw | 32) <= 122)

    def share(mask: np.ndarray) -> np.ndarray:
        return np.bincount(at[mask], minlength=rows) / per_byte

    count = text.counts()
    per_word = np.maximum(count, 1)
    code = (text.row.astype(np.int64) << bits) | (text.hash >> np.uint64(64 - bits)).astype(np.int64)
    code, times = np.unique(code, return_counts=True)
    row, column = code >> bits, code & ((1 << bits) - 1)
    size = np.bincount(row, minlength=rows)
    top = np.zeros(rows)
    np.maximum.at(top, row, times)
    last = raw[text.end - 1] if len(text.end) else np.zeros(0, np.uint8)
    ends = np.bincount(text.row[_SYMBOL[last] & ~_PLAIN_END[last]], minlength=rows)
    statistics = np.column_stack([
        share(letter), share(letter & (raw < 97)), share((raw >= 48) & (raw <= 57)), share(_SYMBOL[raw]),
        share(raw >= 128), share(raw == 10), np.log1p(count), bytes_of / per_word,
        size / per_word, top / per_word, ends / per_word, np.log1p(np.maximum(n_chars, 0))])
    return Features(row, column, size, statistics)


def _bins(statistics: np.ndarray, edges: np.ndarray, setting: Settings) -> np.ndarray:
    """The column of each statistic's bin; a missing statistic has the last bin."""
    out = np.empty(statistics.shape, np.int64)
    for k in range(statistics.shape[1]):
        found = np.searchsorted(edges[k], statistics[:, k], side="right")
        found[np.isnan(statistics[:, k])] = setting.bins
        out[:, k] = (1 << setting.bits) + k * (setting.bins + 1) + found
    return out


def _columns(setting: Settings) -> int:
    return (1 << setting.bits) + len(STATISTICS) * (setting.bins + 1)


def _sums(values: np.ndarray, row: np.ndarray, bins: np.ndarray, table: np.ndarray) -> np.ndarray:
    return words.group_sums(values, row, len(bins)) + table[bins].sum(axis=1)


def train(row: np.ndarray, column: np.ndarray, statistics: np.ndarray, labels: np.ndarray,
          setting: Settings) -> Model:
    """AdaGrad on the logistic loss; ``row`` ascending, one statistics row and label per text."""
    share = float(labels.mean()) if len(labels) else 0.0
    width = _columns(setting)
    inner = np.linspace(0, 1, setting.bins + 1)[1:-1]
    edges = (np.nanquantile(np.nan_to_num(statistics), inner, axis=0).T if len(labels)
             else np.zeros((len(STATISTICS), setting.bins - 1)))
    weight, rng = np.zeros(width, np.float32), np.random.default_rng(11)
    if not 0 < share < 1:
        return Model(edges, np.inf if share else -np.inf, weight, np.zeros((width, setting.rank), np.float32), setting)
    factor = rng.normal(0, 0.05, (width, setting.rank)).astype(np.float32)
    bins = _bins(statistics, edges, setting)
    first = np.searchsorted(row, np.arange(len(labels) + 1))
    value = 1 / np.sqrt(np.maximum(np.diff(first), 1))
    g_weight, g_factor = np.full(width, 1e-6), np.full((width, setting.rank), 1e-6)
    bias = float(np.log(share / (1 - share)))
    for _ in range(setting.passes):
        order = rng.permutation(len(labels))
        for start in range(0, len(order), setting.batch):
            own = order[start:start + setting.batch]
            index = np.concatenate([np.r_[column[first[i]:first[i + 1]], bins[i]] for i in own])
            x = np.concatenate([np.r_[np.full(first[i + 1] - first[i], value[i]), np.ones(bins.shape[1])] for i in own])
            sizes = first[own + 1] - first[own] + bins.shape[1]
            at = np.repeat(np.arange(len(own)), sizes)
            vx = factor[index] * x[:, None]
            total = words.group_sums(vx, at, len(own))
            z = bias + words.group_sums(weight[index] * x, at, len(own)) + 0.5 * (
                (total ** 2).sum(1) - words.group_sums((vx ** 2).sum(1), at, len(own)))
            slope = 1 / (1 + np.exp(-np.clip(z, -35, 35))) - labels[own]
            bias -= setting.rate * float(slope.mean())
            by = np.argsort(index, kind="stable")
            used, begin = np.unique(index[by], return_index=True)
            gx = (slope[at] * x)[by]
            g1 = np.add.reduceat(gx, begin) + setting.decay * weight[used]
            g2 = np.add.reduceat(gx[:, None] * (total[at[by]] - vx[by]), begin, axis=0) + setting.decay * factor[used]
            g_weight[used] += g1 ** 2
            g_factor[used] += g2 ** 2
            weight[used] -= setting.rate * g1 / np.sqrt(g_weight[used])
            factor[used] -= setting.rate * g2 / np.sqrt(g_factor[used])
    return Model(edges, bias, weight, factor, setting)


def machine(found: Features, model: Model) -> np.ndarray:
    """Score of every text of a slice, in time linear in its active features."""
    bins = _bins(found.statistics, model.edges, model.setting)
    x = (1 / np.sqrt(np.maximum(found.size, 1)))[found.row].astype(np.float32)
    vx = model.factor[found.column] * x[:, None]
    square = (model.factor ** 2).sum(axis=1)
    total = _sums(vx, found.row, bins, model.factor)
    own = _sums(square[found.column] * x * x, found.row, bins, square)
    z = model.bias + _sums(model.weight[found.column] * x, found.row, bins, model.weight)
    z = z + 0.5 * ((total ** 2).sum(axis=1) - own)
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-z))


def _numbers(values: pa.Array) -> np.ndarray:
    return values.cast(pa.float64()).to_numpy(zero_copy_only=False)


def feature_rows(texts: pa.Array, n_chars: pa.Array, bits: int) -> pa.Array:
    """A struct column (columns of the distinct words, statistics) for the training sample."""
    lists, rows, numbers = [], [], _numbers(n_chars)
    for first, piece in words.slices(texts):
        found = features(piece, numbers[first:first + len(piece)], bits)
        at = np.r_[0, np.cumsum(found.size)].astype(np.int32)
        lists.append(pa.ListArray.from_arrays(at, found.column.astype(np.int32)))
        rows.append(pa.ListArray.from_arrays(
            (np.arange(len(piece) + 1) * len(STATISTICS)).astype(np.int32), found.statistics.ravel()))
    if not lists:
        lists, rows = [pa.array([], pa.list_(pa.int32()))], [pa.array([], pa.list_(pa.float64()))]
    return pa.StructArray.from_arrays([pa.concat_arrays(lists), pa.concat_arrays(rows)], ["columns", "statistics"])


def _input(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_chars; a missing ``n_chars`` column reads as null."""
    number = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    return docs.select("doc_id", "text", number.alias("n_chars"))


def fit(docs: DataFrame, labels: DataFrame, setting: Settings = Settings(), modulus: int = 4,
        rest: int = 2, label: str = "quality") -> Model:
    """Learn from labelled rows of ``docs`` whose key's remainder is not ``rest``."""
    bits = setting.bits
    shape = T.StructType([T.StructField("columns", T.ArrayType(T.IntegerType())),
                          T.StructField("statistics", T.ArrayType(T.DoubleType()))])

    @F.arrow_udf(shape)
    def found(text: pa.Array, n_chars: pa.Array) -> pa.Array:
        return feature_rows(text, n_chars, bits)

    own = store.labelled(_input(docs), labels, label, modulus, rest, setting.sample_rows)
    table = (own.select("doc_id", "_label", found("text", "n_chars").alias("_f"))
             .where(F.size("_f.columns") <= setting.sample_features)
             .select("doc_id", "_label", "_f.columns", "_f.statistics").toArrow())
    table = table.take(pa.array(np.lexsort((table["_label"].to_numpy(), table["doc_id"].to_numpy()))))
    lists = table["columns"].combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    row = np.repeat(np.arange(len(sizes)), sizes)
    statistics = table["statistics"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))
    return train(row, lists.flatten().to_numpy(), statistics, table["_label"].to_numpy().astype(float), setting)


def score_texts(texts: pa.Array, n_chars: pa.Array, model: Model) -> np.ndarray:
    out, numbers = np.zeros(len(texts)), _numbers(n_chars)
    for first, piece in words.slices(texts):
        stop = first + len(piece)
        out[first:stop] = machine(features(piece, numbers[first:stop], model.setting.bits), model)
    return out


def scorer(docs: DataFrame, model: Model):
    """A column function of (text, n_chars as double) -> probability of label 1."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(text: pa.Array, n_chars: pa.Array) -> pa.Array:
        return pa.array(score_texts(text, n_chars, sent.value))

    return score


def quality(docs: DataFrame, labels: DataFrame, setting: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    score = scorer(docs, fit(docs, labels, setting))
    return (_input(docs).select("doc_id", store.held_out("doc_id", 4, 2).alias("held_out"),
                                score("text", "n_chars").alias("score"))
            .withColumn("predicted", (F.col("score") >= setting.threshold).cast("int")))


def keep_good(docs: DataFrame, labels: DataFrame, setting: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, all columns as they are."""
    number = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    return docs.where(scorer(docs, fit(docs, labels, setting))(F.col("text"), number) >= setting.threshold)
