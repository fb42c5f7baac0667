"""Token ids in binary files whose document borders are Elias-Fano encoded.

``write`` deals the documents out by ranges of doc_id, sorts each range, encodes it and writes
it through Spark's own writer, so that a lost task leaves nothing behind and any file system
Spark knows will do. A *part* is one range; its file is a run of *blocks*; a block is

    header    magic, version, bytes per id, part, block number, ids of the part before the block,
              documents, ids, documents with a doc_id, kind of keys, byte lengths of the sections
    ids       the ids of its documents end to end, 2 bytes each where the vocabulary allows it, else 4
    borders   the ends of its documents in ``ids``, as an Elias-Fano sequence
    keys      the doc_ids: whole numbers as an Elias-Fano sequence above the first, others as Arrow
    line end  one byte, 0x0A, which the writer adds

An Elias-Fano sequence of n rising numbers below u takes n * (2 + log2(u / n)) bits: the low
bits of each number side by side, the high bits in unary. ``select`` finds the k-th number from
a sample of every 64th one and a scan of the few bytes after it, so a reader that wants one
document needs no table of 64-bit offsets. ``listed`` reads the files back.

Documents stand in ascending order of doc_id, null ones last; rows of one doc_id in the order of
a hash of their text, so a doc_id of very many rows is dealt over several parts. Null and empty
texts are the end id alone; an empty table gives no rows. Columns of any other name pass by.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, store
from quire.plans.session import checkpoint_folder


@dataclass(frozen=True)
class Settings:
    end_id: int = 0
    #: A block is closed at so many ids; one document is never cut.
    block_ids: int = 1 << 21
    blocks_per_file: int = 16
    #: Bytes of text in a part, about, and how many parts there are at most.
    part_bytes: int = 32 << 20
    max_parts: int = 1 << 16
    cache_bytes: int = 64 << 20


_HEADER = struct.Struct("<4sHHIIQQQQBQQQ")
_MAGIC, _VERSION, _SAMPLED = b"QTOK", 1, 64
_SEQUENCE = struct.Struct("<QQBQQ")
_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)


class EliasFano:
    """A sequence of n never falling numbers from 0 to u."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, sample: np.ndarray) -> None:
        self.n, self.low_bits, self.low, self.high, self.sample = n, low_bits, low, high, sample

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values).astype(np.uint64)
        n, top = len(v), int(v[-1]) if len(v) else 0
        width = max(0, (top // n).bit_length() - 1) if n else 0
        bits = (v[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        ones = (v >> np.uint64(width)).astype(np.int64) + np.arange(n)
        unary = np.zeros((int(ones[-1]) + 1 if n else 0) + 7 & ~7, np.uint8)
        unary[ones] = 1
        return cls(n, width, low, np.packbits(unary, bitorder="little"), ones[::_SAMPLED].astype("<u4"))

    def to_bytes(self) -> bytes:
        return _SEQUENCE.pack(self.n, len(self.sample), self.low_bits, len(self.low), len(self.high)) + b"".join(
            a.tobytes() for a in (self.sample, self.low, self.high))

    @classmethod
    def parse(cls, raw: memoryview) -> EliasFano:
        n, samples, width, low, high = _SEQUENCE.unpack_from(raw)
        at = _SEQUENCE.size
        sample = np.frombuffer(raw, "<u4", samples, at)
        at += 4 * samples
        return cls(n, width, np.frombuffer(raw, np.uint8, low, at), np.frombuffer(raw, np.uint8, high, at + low), sample)

    def _low(self, k: int) -> int:
        start = k * self.low_bits
        first, last = start >> 3, start + self.low_bits + 7 >> 3
        word = int.from_bytes(self.low[first:last].tobytes(), "little")
        return word >> (start & 7) & (1 << self.low_bits) - 1

    def select(self, k: int) -> int:
        """The k-th number, from 0."""
        if not 0 <= k < self.n:
            raise IndexError(k)
        place, left = int(self.sample[k // _SAMPLED]), k % _SAMPLED
        if left:
            at, step = place + 1 >> 3, 16
            skip = int(self.high[at]) & (1 << (place + 1 & 7)) - 1 if at < len(self.high) else 0
            left += bin(skip).count("1")
            while True:
                seen = np.cumsum(_ONES[self.high[at:at + step]])
                if seen[-1] >= left:
                    break
                left, at, step = left - int(seen[-1]), at + step, 2 * step
            byte = int(np.searchsorted(seen, left))
            left -= int(seen[byte - 1]) if byte else 0
            bits = np.flatnonzero(np.unpackbits(self.high[at + byte:at + byte + 1], bitorder="little"))
            place = 8 * (at + byte) + int(bits[left - 1])
        return (place - k << self.low_bits) | self._low(k)

    def all(self) -> np.ndarray:
        """All numbers as unsigned 64-bit ones."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[:self.n]
        out = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            bits = np.unpackbits(self.low, bitorder="little")[:self.n * self.low_bits].reshape(self.n, self.low_bits)
            for k in range(self.low_bits):
                out |= bits[:, k].astype(np.uint64) << np.uint64(k)
        return out


def _keys(ids: pa.Array) -> tuple[int, int, bytes]:
    """(how many are not null, kind, bytes) of the doc_ids of a block; nulls stand at the end."""
    ids = ids.drop_null()
    if len(ids) and pa.types.is_integer(ids.type):
        first, values = ids[0].as_py(), ids.cast(pa.int64()).to_numpy()
        return len(ids), 1, struct.pack("<q", first) + EliasFano.of(values.view(np.uint64) - np.uint64(first % 2**64)).to_bytes()
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, pa.schema([("key", ids.type)])) as file:
        file.write_batch(pa.RecordBatch.from_arrays([ids], ["key"]))
    return len(ids), 0, out.getvalue().to_pybytes()


def pack_block(part: int, number: int, base: int, width: int, keys: pa.Array, ids: list[bytes]) -> bytes:
    """A block of documents, given as ids of 4 bytes each."""
    borders = EliasFano.of(np.cumsum([len(i) // 4 for i in ids], dtype=np.int64)).to_bytes()
    known, kind, key_bytes = _keys(keys)
    flat = np.frombuffer(b"".join(ids), "<u4").astype(f"<u{width}").tobytes()
    return _HEADER.pack(_MAGIC, _VERSION, width, part, number, base, len(ids), len(flat) // width, known, kind,
                        len(flat), len(borders), len(key_bytes)) + flat + borders + key_bytes


class Block:
    """A block at ``at`` of a file's bytes; sections are looked at only when asked for."""

    def __init__(self, raw: memoryview, at: int = 0) -> None:
        (magic, version, self.width, self.part, self.number, self.base, self.documents, self.size, self._known, self._kind,
         *lengths) = _HEADER.unpack_from(raw, at)
        if magic != _MAGIC or version != _VERSION:
            raise ValueError("not a block of token ids")
        at += _HEADER.size
        self._sections = []
        for length in lengths:
            self._sections.append(raw[at:at + length])
            at += length
        self.end = at + 1
        if len(raw) < self.end or raw[at] != 10:
            raise ValueError("a block of token ids is cut short")

    @property
    def borders(self) -> EliasFano:
        return EliasFano.parse(self._sections[1])

    def ids(self, start: int, end: int) -> np.ndarray:
        return np.frombuffer(self._sections[0], f"<u{self.width}", end - start, start * self.width).astype("<u4")

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document, by two selects."""
        borders = self.borders
        return self.ids(borders.select(k - 1) if k else 0, borders.select(k))

    def keys(self, kind: pa.DataType) -> pa.Array:
        """The doc_ids of all documents."""
        raw = self._sections[2]
        if self._kind:
            first = np.uint64(struct.unpack_from("<q", raw)[0] % 2**64)
            known = pa.array((EliasFano.parse(raw[8:]).all() + first).view(np.int64)).cast(kind)
        else:
            known = pa.ipc.open_stream(pa.py_buffer(raw)).read_all()["key"].combine_chunks().cast(kind)
        return pa.concat_arrays([known, pa.nulls(self.documents - self._known, kind)])


def blocks(content: bytes) -> Iterator[Block]:
    """The blocks of a file, in order."""
    raw, at = memoryview(content), 0
    while at < len(raw):
        block = Block(raw, at)
        yield block
        at = block.end


def write(docs: DataFrame, tokenizer: str, setting: Settings = Settings(), folder: str | None = None) -> str:
    """Writes the ids of all documents; returns the folder, by default a new one among the checkpoints."""
    spark = docs.sparkSession
    folder = folder or f"{checkpoint_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = min(setting.max_parts, max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // setting.part_bytes + 1))
    row = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text").alias("_hash"), F.col("_row")]
    ordered = (docs.select("doc_id", "text").withColumn("_row", F.monotonically_increasing_id())
               .repartitionByRange(parts, *row).sortWithinPartitions(*row))

    def pack(batches):
        encode = bpe.encoder(tokenizer, setting.cache_bytes)
        width, end = 2 if max(encode.widest, setting.end_id) < 1 << 16 else 4, np.array([setting.end_id], "<u4").tobytes()
        part, number, base, held, keys, ids = TaskContext.get().partitionId(), 0, 0, 0, [], []

        def close() -> pa.RecordBatch:
            made = pack_block(part, number, base, width, pa.concat_arrays(keys), ids)
            return pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], ["block"])

        for batch in batches:
            taken = 0
            for i, one in bpe.encoded(batch["text"], encode):
                ids.append(one + end)
                held += len(one) // 4 + 1
                if held >= setting.block_ids:
                    keys.append(batch["doc_id"].slice(taken, i + 1 - taken))
                    yield close()
                    taken, number, base, held, keys, ids = i + 1, number + 1, base + held, 0, [], []
            if taken < batch.num_rows:
                keys.append(batch["doc_id"].slice(taken))
        if ids:
            yield close()

    # The text writer copies the bytes of a string as they are.
    (ordered.mapInArrow(pack, "block binary").select(F.col("block").cast("string").alias("value")).write
     .option("maxRecordsPerFile", setting.blocks_per_file).option("compression", "none").text(folder))
    return folder


def listed(spark: SparkSession, folder: str, kind: str = "bigint") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, and its part and block, from the files
    of ``write``; ``kind`` is the type of doc_id."""
    arrow = pa.schema(spark.createDataFrame([], f"k {kind}").toArrow().schema).field(0).type

    def read(batches):
        for batch in batches:
            for content in batch["content"]:
                for block in blocks(content.as_buffer()):
                    ends = block.borders.all().astype(np.int64)
                    starts, ids = np.r_[0, ends[:-1]], block.ids(0, block.size)
                    crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [block.keys(arrow), pa.array(block.base + starts), pa.array(ends - starts), pa.array(crc, pa.int64()),
                         pa.array(np.full(len(ends), block.part, np.int32)), pa.array(np.full(len(ends), block.number, np.int32))],
                        ["doc_id", "_at", "n_tokens", "ids_crc32", "part", "block"])

    found = store.keep(spark.read.format("binaryFile").load(folder).select("content").mapInArrow(
        read, f"doc_id {kind}, _at long, n_tokens long, ids_crc32 long, part int, block int"))
    before, total = [], 0
    for part, size in sorted(found.groupBy("part").agg(F.sum("n_tokens")).collect()):  # at most max_parts rows
        before.append((part, total))
        total += size
    firsts = spark.createDataFrame(before, "part int, _before long")
    return (found.join(F.broadcast(firsts), "part")
            .select("doc_id", (F.col("_before") + F.col("_at")).alias("start"), "n_tokens", "ids_crc32", "part", "block"))
