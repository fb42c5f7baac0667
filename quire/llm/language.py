"""Language by string kernels: presence of letter n-grams of blended lengths, and ridge regression.

Two texts are compared by the n-grams of bytes of 2 to 4 that both contain (A-Z lower-cased),
hashed into ``2**bits`` columns: ``K(x, y) = |x and y| / sqrt(|x| |y|)``. The Nyström method
replaces the kernel of all texts by their kernel rows against ``landmarks`` sample texts;
one-versus-rest kernel ridge regression on those rows gives one score per language. A batch
of texts is a 0/1 matrix, so scoring is two matrix products: against the landmarks, then
against the weights. Only a bounded sample (``sample_rows`` texts) is learned from, and what is
broadcast is ``landmarks * 2**bits / 8`` bytes of bits.

Defined results: ``und`` with score 0.0 for a text that is null or has no letter, and for
every text when no language is known. Equal scores go to the language first in order.
Repeated rows get equal results.
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
    bits: int = 13
    landmarks: int = 192
    sample_rows: int = 3000
    languages: int = 256
    ridge: float = 0.05
    sharpness: float = 6.0
    batch_rows: int = 512


@dataclass(frozen=True)
class Model:
    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray
    setting: Settings


_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32


def presence(texts: pa.Array, bits: int) -> np.ndarray:
    """0/1 matrix (texts x 2**bits): which hashed n-grams of 2, 3 and 4 bytes each text holds."""
    raw, offsets = words.raw_bytes(texts)
    out = np.zeros(len(texts) << bits, np.uint8)
    base = np.repeat(np.arange(len(texts), dtype=np.int64) << bits, np.diff(offsets))
    own = _FOLD[raw]
    last = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(raw))
    code = own * np.uint32(0x01000193)
    for n in (2, 3, 4):
        if len(raw) < n:
            break
        code = (code[:-1] ^ own[n - 1:]) * np.uint32(0x9E3779B1)
        inside = last[:len(code)] >= n
        place = (code ^ (code >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(32 - bits)
        out[base[:len(code)][inside] + place[inside]] = 1
    return out.reshape(len(texts), 1 << bits)


def kernel(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Normalised presence kernel of two 0/1 matrices; 0 for a text without n-grams."""
    a, b = left.astype(np.float32), right.astype(np.float32)
    norms = np.sqrt(np.outer(a.sum(1), b.sum(1)))
    return (a @ b.T) / np.maximum(norms, 1)


def train(rows: np.ndarray, labels: list[str], setting: Settings) -> Model:
    """Landmarks spread evenly over the languages, then ridge regression on the Nyström features."""
    names, y = np.unique(np.array(labels, dtype=object).astype(str), return_inverse=True)
    if not len(names):
        return Model([], rows[:0], np.zeros((0, 0), np.float32), setting)
    rank = np.empty(len(y), np.int64)
    for k in range(len(names)):
        rank[y == k] = np.arange((y == k).sum())
    chosen = np.argsort(rank * len(names) + y, kind="stable")[:setting.landmarks]
    landmarks = rows[chosen]
    size, side = np.linalg.eigh(kernel(landmarks, landmarks).astype(np.float64))
    keep = size > 1e-4 * size.max()
    root = side[:, keep] / np.sqrt(size[keep])
    z = kernel(rows, landmarks) @ root
    z1 = np.c_[z, np.ones(len(z))]
    target = 2.0 * (y[:, None] == np.arange(len(names))) - 1
    balance = (len(y) / (len(names) * np.bincount(y)))[y][:, None]
    cost = setting.ridge * np.eye(z1.shape[1])
    beta = np.linalg.solve(z1.T @ (z1 * balance) + cost, z1.T @ (target * balance))
    return Model([str(n) for n in names], np.packbits(landmarks, axis=1),
                 np.vstack([root @ beta[:-1], beta[-1:]]).astype(np.float32), setting)


def fit(docs: DataFrame, setting: Settings = Settings(), modulus: int = 4, rest: int = 2,
        label: str = "lang") -> Model:
    """Learn from a sample of the rows with a language whose key's remainder is not ``rest``."""
    bits = setting.bits
    own = docs.select("doc_id", "text", F.col(label).alias("_lang"))
    own = own.where(F.col("_lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~store.held_out("doc_id", modulus, rest))
    # Rare languages keep their rows: each has the same share of the sample.
    counts = own.groupBy("_lang").count().orderBy(F.desc("count"), "_lang").limit(setting.languages).collect()
    if not counts:
        return train(np.zeros((0, 1 << bits), np.uint8), [], setting)
    each = setting.sample_rows // len(counts)
    chance = F.create_map(*[F.lit(v) for r in counts for v in (r["_lang"], store.cut(each, r["count"]))])
    drawn = own.where(store.draw("doc_id", 23) < chance[F.col("_lang")])

    @F.arrow_udf("binary")
    def packed(text: pa.Array) -> pa.Array:
        return pa.array([r.tobytes() for _, piece in words.slices(text)
                         for r in np.packbits(presence(piece, bits), axis=1)], pa.binary())

    table = drawn.select("doc_id", "_lang", packed("text").alias("_f")).toArrow()
    order = np.lexsort((table["_lang"].to_numpy(), table["doc_id"].to_numpy()))
    blobs = table["_f"].to_pylist()
    bits_of = np.frombuffer(b"".join(blobs[i] for i in order), np.uint8).reshape(len(order), -1)
    names = table["_lang"].to_pylist()
    return train(np.unpackbits(bits_of, axis=1), [names[i] for i in order], setting)


def scores(texts: pa.Array, landmarks: np.ndarray, model: Model) -> np.ndarray:
    """One score per text and language: kernel rows of the batch times the weights."""
    out = np.zeros((len(texts), len(model.languages)), np.float32)
    for first, piece in words.slices(texts):
        for start in range(0, len(piece), model.setting.batch_rows):
            part = piece.slice(start, model.setting.batch_rows)
            rows = presence(part, model.setting.bits).astype(np.float32)
            products = (rows @ landmarks.T) / np.sqrt(np.maximum(np.outer(rows.sum(1), landmarks.sum(1)), 1))
            out[first + start:first + start + len(part)] = products @ model.weights[:-1] + model.weights[-1]
    return out


def languages(docs: DataFrame, setting: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    model = fit(docs, setting)
    base = docs.select("doc_id", store.held_out("doc_id", 4, 2).alias("held_out"), "text")
    lettered = F.col("text").rlike(r"\p{L}")
    if not model.languages:
        return base.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    shape = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    @F.arrow_udf(shape)
    def predict(text: pa.Array, has_letter: pa.Array) -> pa.Array:
        own: Model = sent.value
        landmarks = np.unpackbits(own.landmarks, axis=1).astype(np.float32)
        found = scores(text, landmarks, own).astype(np.float64)
        best = found.argmax(axis=1)
        odds = np.exp(own.setting.sharpness * (found - found.max(axis=1, keepdims=True)))
        known = has_letter.fill_null(False).to_numpy(zero_copy_only=False)
        names = np.array(own.languages, dtype=object)[best]
        names[~known] = "und"
        return pa.StructArray.from_arrays(
            [pa.array(names, pa.string()), pa.array(np.where(known, 1 / odds.sum(axis=1), 0.0))], ["lang_pred", "score"])

    return (base.withColumn("_p", predict(F.col("text"), lettered))
            .select("doc_id", "held_out", "_p.lang_pred", "_p.score"))
