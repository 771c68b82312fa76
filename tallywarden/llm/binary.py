"""Token-id files: ids of many documents in one array, document ends and ids as Elias-Fano sequences.

A file is a shard: some consecutive documents in ascending doc_id order, those without one last. Little-endian throughout:

====== ==========================================================================
bytes  what
====== ==========================================================================
8      ``TWEFv002``
4 x 3  bytes per id (2 or 4), low bits per end, low bits per doc_id
8 x 8  documents n, ids u, partition, shard within it, bytes of the ends' high bits, documents with a doc_id k,
       the first doc_id, bytes of the doc_ids' high bits
(nl)/8 low l bits of each end, packed
(high) bit (end >> l) + i is set for the i-th end
4 x s  select samples: place of every 128th set bit
...    the same three for the k doc_ids, each less the first
w u    the ids
1      line feed, written by Spark's text writer
====== ==========================================================================

An end takes about 2 + log2(u / n) bits, and a doc_id as many as their distances need. Spark's own writer makes the files, one row
a file, and its ``binaryFile`` source reads them, so they can lie in any store that Spark reaches. Beside each shard lies a file with
its first bytes alone, which is told apart by its length: shards are placed behind each other without opening them.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywarden.llm.encode import encoded, encoder
from tallywarden.llm.shared import parts, stored

MAGIC = b"TWEFv002"
HEAD = "<8sIIIQQQQQQqQ"
HEAD_BYTES = struct.calcsize(HEAD)
STRIDE = 128
#: A shard ends at the document with which it reaches so many ids.
SHARD_IDS = 2_000_000
#: Up to so many shards (a few MB) their places are sent to the readers, beyond that they are joined by a shuffle.
FEW_SHARDS = 100_000
#: Documents of a shard that are read at once.
READ_DOCUMENTS = 2048


class EliasFano:
    """A non-decreasing sequence of numbers from 0 to ``universe``, in near-minimal space."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray) -> None:
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def build(cls, ends: np.ndarray, universe: int) -> EliasFano:
        n, ends = len(ends), ends.astype(np.uint64)
        bits = max(0, (universe // n).bit_length() - 1) if n else 0
        low = np.packbits(((ends[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (ends >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros((universe >> bits) + n + 1, np.uint8)
        flags[ones] = 1
        return cls(n, bits, low, np.packbits(flags, bitorder="little"), ones[::STRIDE].astype(np.uint32))

    @classmethod
    def take(cls, take, n: int, bits: int, high: int) -> EliasFano:
        """Read the three parts with ``take`` (kind, count)."""
        low, high = take("u1", (n * bits + 7) // 8), take("u1", high)
        return cls(n, bits, low, high, take("<u4", -(-n // STRIDE)))

    def parts(self) -> list[bytes]:
        return [self.low.tobytes(), self.high.tobytes(), self.samples.astype("<u4").tobytes()]

    def _low(self, i: int) -> int:
        first, bits = i * self.low_bits, self.low_bits
        word = int.from_bytes(self.low[first // 8 : (first + bits + 7) // 8].tobytes(), "little")
        return word >> first % 8 & (1 << bits) - 1

    def select(self, i: int) -> int:
        """Place of the i-th set bit, from the nearest sample on."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // STRIDE]), i % STRIDE
        byte, width = at // 8, 64
        skip = at % 8
        while True:
            ones = np.flatnonzero(np.unpackbits(self.high[byte : byte + width], bitorder="little")[skip:])
            if len(ones) > left:
                return byte * 8 + skip + int(ones[left])
            left, byte, skip = left - len(ones), byte + width, 0

    def end(self, i: int) -> int:
        """The i-th end without decoding the others."""
        return (self.select(i) - i << self.low_bits) | self._low(i)

    def start(self, i: int) -> int:
        return self.end(i - 1) if i else 0

    def range(self, first: int, last: int) -> np.ndarray:
        """The numbers ``first`` to ``last`` (not included), from the nearest samples before and behind them."""
        if last <= first:
            return np.zeros(0, np.int64)
        block, behind = first // STRIDE, -(-last // STRIDE)
        begin = int(self.samples[block])
        end = int(self.samples[behind]) if behind < len(self.samples) else len(self.high) * 8
        bits = np.unpackbits(self.high[begin // 8 : -(-end // 8)], bitorder="little")[begin % 8 :]
        ones = begin + np.flatnonzero(bits)[first - block * STRIDE : last - block * STRIDE]
        at = first * self.low_bits
        bits = np.unpackbits(self.low[at // 8 : -(-last * self.low_bits // 8)], bitorder="little")[at % 8 :][: (last - first) * self.low_bits]
        low = (bits.reshape(last - first, self.low_bits).astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)
        return (ones - np.arange(first, last) << self.low_bits) | low


def write_shard(doc_ids: list[int | None], ids: np.ndarray, ends: np.ndarray, width: int, part: int, shard: int) -> bytes:
    """The bytes of a shard; doc_ids ascend, null ones are last."""
    lines = EliasFano.build(ends, len(ids))
    known = np.array([d for d in doc_ids if d is not None], np.int64).astype(np.uint64)
    first = known[:1].astype(np.int64)
    away = known - known[:1]  # modulo 2^64: ids from end to end of a long fit
    keys = EliasFano.build(away, int(away[-1]) if len(away) else 0)
    numbers = (len(doc_ids), len(ids), part, shard, len(lines.high), len(known), int(first[0]) if len(first) else 0, len(keys.high))
    head = struct.pack(HEAD, MAGIC, width, lines.low_bits, keys.low_bits, *numbers)
    return b"".join([head, *lines.parts(), *keys.parts(), ids.astype(f"<u{width}").tobytes()])


class Shard:
    """A shard's bytes: documents by position, offsets by select, ids as a view."""

    def __init__(self, data: bytes) -> None:
        magic, self.width, bits, key_bits, self.n, self.n_ids, self.part, self.shard, high, self.known, self.first, key_high = struct.unpack_from(HEAD, data)
        if magic != MAGIC:
            raise ValueError("not a token-id file")
        at = HEAD_BYTES

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(data, kind, count, at)
            at += found.nbytes
            return found

        self.lines = EliasFano.take(take, self.n, bits, high)
        self.keys = EliasFano.take(take, self.known, key_bits, key_high)
        self.ids = take(f"<u{self.width}", self.n_ids)

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.lines.start(i) : self.lines.end(i)]

    def doc_id(self, i: int) -> int | None:
        return self.doc_ids(i, i + 1).to_pylist()[0]

    def doc_ids(self, first: int, last: int) -> pa.Array:
        """The doc_ids of the documents ``first`` to ``last`` (not included)."""
        real = max(first, min(last, self.known))
        found = (self.keys.range(first, real).astype(np.uint64) + np.uint64(self.first & (1 << 64) - 1)).astype(np.int64)
        return pa.array(np.concatenate([found, np.zeros(last - real, np.int64)]), mask=np.arange(first, last) >= self.known)


def write_ids(docs: DataFrame, folder: str, vocabulary: str, end: int = 2, text: str = "text", shard_ids: int = SHARD_IDS) -> None:
    """Encode every whole text and write the ids in ascending doc_id order, null doc_ids last.

    A null text is empty and yields the end id alone. Rows of one doc_id are ordered by a hash
    of their texts, rows that agree in both are alike. A document is never cut, so a shard holds up
    to ``shard_ids`` ids plus one document. No documents: no files. Other columns are not read.
    """

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        width = 2 if max(encoder(vocabulary).size, end + 1) <= 1 << 16 else 4
        part, count, size = TaskContext.get().partitionId(), 0, 0
        keys: list[int | None] = []
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            data = write_shard(keys, np.concatenate(held), np.cumsum([len(x) for x in held]), width, part, count)
            return pa.RecordBatch.from_arrays([pa.array([data, data[:HEAD_BYTES]], pa.binary())], ["data"])

        for batch in batches:
            for step, ids, starts in encoded(batch, vocabulary, "text", end):
                ids = ids.astype(f"<u{width}")
                for key, a, b in zip(step.column("doc_id").to_pylist(), starts.tolist(), starts[1:].tolist()):
                    keys.append(key)
                    held.append(ids[a:b])
                    size += b - a
                    if size >= shard_ids:
                        yield flush()
                        keys, held, size, count = [], [], 0, count + 1
        if keys:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    order = [F.col("doc_id").isNull(), F.col("doc_id"), F.xxhash64("text")]
    # Texts are dealt before they are encoded: the range's sample then reads ids, not encodings.
    ordered = rows.repartitionByRange(parts(docs.sparkSession), *order).sortWithinPartitions(*order)
    packed = ordered.mapInArrow(shards, "data binary")
    packed.select(F.expr("cast(data as string)").alias("value")).write.option("maxRecordsPerFile", 1).text(folder)


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of a folder of shards: doc_id, start (over all shards), n_tokens, ids (binary, uint32).

    Each shard is read once; their places come from the files of first bytes beside them, one row per shard: sums per partition
    first, then within a partition.
    """
    files = spark.read.format("binaryFile").load(folder).select("length", "content")

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [struct.unpack_from(HEAD, x) for x in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (6, 7, 5)], ["part", "shard", "n"])

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                x = Shard(data.as_buffer().to_pybytes())
                for first in range(0, x.n, READ_DOCUMENTS):
                    last = min(first + READ_DOCUMENTS, x.n)
                    ends = x.lines.range(first, last)
                    starts = np.concatenate([[x.lines.start(first)], ends[:-1]])
                    whole = x.ids[starts[0] : ends[-1]].astype("<u4")
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(ends), x.part)), pa.array(np.full(len(ends), x.shard)), x.doc_ids(first, last), pa.array(starts), pa.array(ends - starts),
                            pa.array([whole[a:b].tobytes() for a, b in zip((starts - starts[0]).tolist(), (ends - starts[0]).tolist())], pa.binary()),
                        ],
                        ["part", "shard", "doc_id", "at", "n_tokens", "ids"],
                    )

    small = F.col("length") == HEAD_BYTES + 1  # with the writer's line feed; a filter on the length is applied before a file is opened
    heads_df = stored(files.where(small).select("content").mapInArrow(heads, "part long, shard long, n long"), "shards")
    by_part = heads_df.groupBy("part").agg(F.sum("n").alias("n"))
    before = by_part.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    within = F.sum("n").over(Window.partitionBy("part").orderBy("shard")) - F.col("n")
    base = heads_df.withColumn("within", within).join(before, "part").select("part", "shard", (F.col("before") + F.col("within")).alias("base"))
    rows = files.where(~small).select("content").mapInArrow(documents, "part long, shard long, doc_id long, at long, n_tokens long, ids binary")
    if heads_df.count() <= FEW_SHARDS:
        base = F.broadcast(base)
    return rows.join(base, ["part", "shard"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids")
