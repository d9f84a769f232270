"""Token id files: concatenated ids with Elias-Fano coded document boundaries, read back by select.

A file is a row of blocks. A block holds whole documents in ascending order of doc_id::

    "EFIDS1" | header | doc ids | boundaries | ids | line feed

``doc ids`` and ``boundaries`` (where each document ends among the block's ids) are Elias-Fano sequences: the low bits of every
value packed side by side, the high parts as unary gaps in a bit vector, and 32-bit samples of every 256th set bit that let
``select`` start near its answer. That is about two bits a document more than the low bits, and no 64-bit table of offsets.
Ids take two bytes where the vocabulary fits in them, otherwise four.

Spark's writer commits the files, so that lost or repeated tasks leave no trace, and any file system that Spark reads serves.
The block headers tell how many ids stand before the block in its file; the manifest tells how many stand before the file.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from marketlake.llm.best_fit_packing import chunk_ids
from marketlake.llm.common import list_column, small_batches, texts_of

MAGIC = b"EFIDS1"
#: Bytes of ids in a block (a longer document makes a block of its own), and of text in a file, about.
BLOCK_BYTES = 2 << 20
FILE_BYTES = 24 << 20
SAMPLE = 256
_HEADER = np.dtype([
    ("shard", "<u4"), ("width", "<u4"), ("before", "<u8"), ("docs", "<u8"), ("unnamed", "<u8"), ("least", "<i8"), ("ids", "<u8"), ("size", "<u8")])


@dataclass
class EliasFano:
    """A rising sequence of numbers from 0 on: ``low_bits`` of each packed, the rest as gaps in ``high``."""

    count: int
    low_bits: int
    low: np.ndarray
    high: np.ndarray
    samples: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        """``values`` rise or stay equal, and are below 2**63."""
        values = np.asarray(values).astype(np.uint64)
        count = len(values)
        top = int(values[-1]) if count else 0
        low_bits = max(0, (top // count).bit_length() - 1) if count else 0
        bits = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(count)
        high = np.zeros((int(ones[-1]) + 1 if count else 0) + 63 & ~63, np.uint8)
        high[ones] = 1
        return cls(
            count, low_bits, np.packbits(bits.astype(np.uint8).ravel(), bitorder="little"),
            np.packbits(high, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def _lows(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.uint64)
        for bit in range(self.low_bits):
            place = at * self.low_bits + bit
            out |= ((self.low[place >> 3] >> (place & 7).astype(np.uint8)) & np.uint8(1)).astype(np.uint64) << np.uint64(bit)
        return out

    def select(self, at: np.ndarray) -> np.ndarray:
        """The values at the places ``at``: from the sample before each, words of the bit vector are counted until the bit is met."""
        at = np.asarray(at, np.int64)
        words = self.high.view("<u8")
        start = self.samples[at // SAMPLE].astype(np.int64)
        word = start >> 6
        masked = words[word] & (np.uint64(2**64 - 1) << (start & 63).astype(np.uint64))
        rest = at % SAMPLE  # set bits to pass from the sampled one on
        here = np.bitwise_count(masked).astype(np.int64)
        moving = np.flatnonzero(rest >= here)
        while len(moving):
            rest[moving] -= here[moving]
            word[moving] += 1
            masked[moving] = words[word[moving]]
            here[moving] = np.bitwise_count(masked[moving])
            moving = moving[rest[moving] >= here[moving]]
        place = (word << 6) + _nth_bit(masked, rest)
        return ((place - at).astype(np.uint64) << np.uint64(self.low_bits) | self._lows(at)).astype(np.int64)

    def tobytes(self) -> bytes:
        head = np.array([self.count, self.low_bits, len(self.low), len(self.high)], "<u8").tobytes()
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def read(cls, data: memoryview, at: int) -> tuple[EliasFano, int]:
        """The sequence that begins at a byte, and the byte after it."""
        count, low_bits, low, high = (int(x) for x in np.frombuffer(data, "<u8", 4, at))
        at += 32
        samples = -(-count // SAMPLE)
        out = cls(
            count, low_bits, np.frombuffer(data, np.uint8, low, at), np.frombuffer(data, np.uint8, high, at + low),
            np.frombuffer(data, "<u4", samples, at + low + high))
        return out, at + low + high + 4 * samples


def _nth_bit(words: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """Place of the set bit of each word with ``nth`` set bits below it, by halving."""
    place, rest = np.zeros(len(words), np.int64), nth.copy()
    for width in (32, 16, 8, 4, 2, 1):
        part = (words >> place.astype(np.uint64)) & np.uint64(2**width - 1)
        below = np.bitwise_count(part).astype(np.int64)
        up = rest >= below
        rest = np.where(up, rest - below, rest)
        place += width * up
    return place


def write_block(shard: int, before: int, doc_ids: list[int | None], parts: list[bytes], width: int) -> bytes:
    """One block of documents in order (null ids first), their ids as bytes of ``width``."""
    named = np.array([d for d in doc_ids if d is not None], np.int64)
    least = int(named[0]) if len(named) else 0
    # Ids over the whole 64-bit range do not fit a rising sequence of 63 bits; such a block keeps them plain.
    far = len(named) > 0 and int(named[-1]) - least >= 2**62
    coded = named.tobytes() if far else EliasFano.of(named - least).tobytes()
    ends = np.cumsum([len(p) // width for p in parts])
    body = np.array([far], "<u8").tobytes() + coded + EliasFano.of(ends).tobytes() + b"".join(parts)
    head = np.array((shard, width, before, len(parts), len(parts) - len(named), least, int(ends[-1]), len(body)), _HEADER)
    return MAGIC + head.tobytes() + body


@dataclass
class Block:
    shard: int
    before: int
    doc_ids: list[int | None]
    starts: np.ndarray
    ends: np.ndarray
    ids: np.ndarray


def read_blocks(content: bytes) -> list[Block]:
    """The blocks of a file in order of their ids; offsets come from ``select``."""
    out, at, data = [], 0, memoryview(content)
    while at < len(data):
        if data[at : at + len(MAGIC)] != MAGIC:
            raise ValueError("not a token id file")
        at += len(MAGIC)
        head = np.frombuffer(data, _HEADER, 1, at)[0]
        at += _HEADER.itemsize
        after = at + int(head["size"])
        count = int(head["docs"]) - int(head["unnamed"])
        far = int(np.frombuffer(data, "<u8", 1, at)[0])
        at += 8
        if far:
            named, at = np.frombuffer(data, "<i8", count, at), at + 8 * count
        else:
            coded, at = EliasFano.read(data, at)
            named = coded.select(np.arange(count)) + int(head["least"])
        boundaries, at = EliasFano.read(data, at)
        ends = boundaries.select(np.arange(boundaries.count))
        ids = np.frombuffer(data, f"<u{int(head['width'])}", int(head["ids"]), at)
        out.append(Block(
            int(head["shard"]), int(head["before"]), [None] * int(head["unnamed"]) + named.tolist(), np.concatenate([[0], ends[:-1]]), ends, ids))
        at = after + 1  # the line feed that ends a row of the writer
    return sorted(out, key=lambda b: b.before)


def _vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


def write_ids(docs: DataFrame, path: str, target: str, end_id: int = 2, file_bytes: int = FILE_BYTES) -> None:
    """Write the ids of every text of ``docs`` and ``end_id`` after each, in ascending order of doc_id, as files below ``target``.

    ``path`` names a ``tokenizers`` file that lower-cases and splits on white space. Null and empty texts are the end id alone;
    null ids come first; rows of one id stand in order of the lengths and hashes of their texts, repeated rows as often as they
    are given. The rows are dealt by ranges of all these, so one id that holds many rows spreads over files. Other columns are
    ignored; an empty table gives a manifest without rows. The driver sees three numbers a file of about ``file_bytes`` of text.
    """
    spark = docs.sparkSession
    small_batches(spark)
    width = 2 if max(_vocabulary_size(path), end_id + 1) <= 1 << 16 else 4
    end = np.array([end_id], f"<u{width}").tobytes()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 8)).first()[0] or 0
    # Rows that are alike are parted by their place in the scan; whichever stands first, the files are the same.
    order = ["doc_id", "n", "hash", "row"]
    dealt = rows.withColumns({"n": F.octet_length("text"), "hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    dealt = dealt.repartitionByRange(max(1, -(-size // file_bytes)), *order).sortWithinPartitions(*order)
    dealt = dealt.select(F.spark_partition_id().alias("shard"), "doc_id", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, before, doc_ids, parts, held, count = 0, 0, [], [], 0, 0

        def block() -> pa.RecordBatch:
            return pa.record_batch({"kind": ["ids"], "block": pa.array([write_block(shard, before, doc_ids, parts, width)], pa.binary())})

        for batch in batches:
            if batch.num_rows:
                shard = batch.column("shard")[0].as_py()
            for d, p in zip(batch.column("doc_id").to_pylist(), chunk_ids(path)(texts_of(batch.column("text"))), strict=True):
                p = (p if width == 4 else np.frombuffer(p, "<u4").astype("<u2").tobytes()) + end
                if parts and held + len(p) > BLOCK_BYTES:
                    yield block()
                    before, doc_ids, parts, held = before + held // width, [], [], 0
                doc_ids.append(d)
                parts.append(p)
                held += len(p)
                count += 1
        if parts:
            yield block()
            head = json.dumps({"shard": shard, "docs": count, "ids": before + held // width})
            yield pa.record_batch({"kind": ["shards"], "block": pa.array([head.encode()], pa.binary())})

    blocks = dealt.mapInArrow(work, "kind string, block binary")
    blocks.select("kind", F.col("block").cast("string").alias("value")).write.partitionBy("kind").text(f"{target}/data")
    # An empty table leaves no folder of a kind to read.
    shards = []
    if size:
        found = spark.read.schema("shard long, docs long, ids long").json(f"{target}/data/kind=shards")
        shards = sorted(tuple(r) for r in found.select("shard", "docs", "ids").collect())
    starts = np.concatenate([[0], np.cumsum([s[2] for s in shards])]).astype(int).tolist()
    rows = [(shard, docs, ids, start) for (shard, docs, ids), start in zip(shards, starts, strict=False)]
    spark.createDataFrame(rows, StructType([StructField(c, LongType()) for c in ("shard", "docs", "ids", "start")])).coalesce(1).write.parquet(
        f"{target}/manifest")


def read_ids(spark: SparkSession, target: str, with_ids: bool = False) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32[, ids])`` of every document of the files below ``target``.

    ``start`` counts the ids of all documents before it, ``ids_crc32`` is over its ids as little-endian unsigned 32-bit numbers.
    """
    small_batches(spark)
    manifest = spark.read.parquet(f"{target}/manifest").select("shard", F.col("start").alias("first"))
    schema = "shard long, doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    if not manifest.take(1):
        return spark.createDataFrame([], schema).drop("shard")
    files = spark.read.format("binaryFile").load(f"{target}/data/kind=ids").select("content")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                for b in read_blocks(content.as_buffer()):
                    crc = [zlib.crc32(b.ids[s:e].astype("<u4")) for s, e in zip(b.starts.tolist(), b.ends.tolist(), strict=True)]
                    out = {
                        "shard": pa.array(np.full(len(crc), b.shard, np.int64)), "doc_id": pa.array(b.doc_ids, pa.int64()),
                        "start": pa.array(b.before + b.starts), "n_tokens": pa.array(b.ends - b.starts), "ids_crc32": pa.array(crc, pa.int64())}
                    if with_ids:
                        out["ids"] = list_column(b.ids.astype(np.int32), b.ends - b.starts, pa.int32())
                    yield pa.record_batch(out)

    found = files.mapInArrow(work, schema).join(manifest, "shard")
    return found.select("doc_id", (F.col("start") + F.col("first")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
