"""Token ids as files: static range asymmetric numeral systems (rANS) over interleaved lanes.

One frequency table is shared by all blocks. A block holds whole documents, is coded by itself in lanes
that take turns, and carries checkpoints from which a reader can start inside it, and a checksum. Blocks
are rows of Parquet files (shard, block, n_docs, n_ids, data), so any store that Spark writes can hold
them; `data` is the binary block described at `encode_block`.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.llm.tokens import encoder, slices
from spanforge.llm.words import frugal
from spanforge.runtime import attach, drop_staged, stage, stage_path

END = 1
TOKENIZER = "word_bpe_49k.json"
#: Ids of a block, about (whole documents); lanes at most; steps between checkpoints; bits of probabilities at least.
BLOCK = 1 << 20
LANES = 2048
CHECKPOINT = 256
BITS = 18
#: Ids that make a shard, about.
SHARD_IDS = 24 << 20

_LOW = 1 << 31
_HEAD = struct.Struct("<4sBBHIIIQQII")
_MAGIC = b"RNS1"


@dataclass(frozen=True)
class Table:
    """Frequencies of ids 0..n-1 that add up to 2**bits; ids that never occur have none."""

    freq: np.ndarray
    bits: int

    @cached_property
    def start(self) -> np.ndarray:
        return (np.cumsum(self.freq) - self.freq).astype(np.uint64)

    @cached_property
    def both(self) -> np.ndarray:
        """Start and frequency of each id in one number, so that one look-up gets both."""
        return self.start << np.uint64(32) | self.freq

    @cached_property
    def symbol(self) -> np.ndarray:
        """The id of each of the 2**bits slots."""
        return np.repeat(np.arange(len(self.freq), dtype=np.uint16 if len(self.freq) <= 1 << 16 else np.uint32), self.freq.astype(np.int64))

    @cached_property
    def crc(self) -> int:
        return zlib.crc32(self.freq.astype("<u4").tobytes())


def table(counts: dict[int, int], bits: int = BITS) -> Table:
    """Scale counts to 2**bits, every id that occurs at least 1. Ties and remainders go to the smallest ids of the largest."""
    ids = np.array(sorted(counts), np.int64)
    if not len(ids):
        return Table(np.zeros(1, np.uint64), bits)
    bits = max(bits, int(len(ids)).bit_length() + 2)
    c = np.array([counts[i] for i in ids.tolist()], np.float64)
    f = np.maximum(1, np.floor(c / c.sum() * (1 << bits))).astype(np.int64)
    over = int(f.sum()) - (1 << bits)
    order = np.argsort(-f, kind="stable")
    if over < 0:
        f[order[0]] -= over
    k = 0
    while over > 0:
        i = order[k % len(order)]
        cut = min(over, int(f[i]) // 2)
        f[i] -= cut
        over -= cut
        k += 1
    freq = np.zeros(int(ids[-1]) + 1, np.uint64)
    freq[ids] = f
    return Table(freq, bits)


def encode_block(ids: np.ndarray, doc_ids: list[int | None] | list[str | None], sizes: list[int], t: Table, lanes: int = LANES, every: int = CHECKPOINT) -> bytes:
    """One block: head, documents (null flags, ids, sizes), states, checkpoints, words, CRC-32 of all that.

    Id i is in lane i % lanes, at step i // lanes. States are 64 bits and pass 32-bit words to one shared
    stream, in the order in which a reader takes them: by step, then lane. A checkpoint holds the states
    before a step and the words taken until then.
    """
    n = len(ids)
    lanes = max(1, min(lanes, 1 << max(0, (n // 64).bit_length() - 1)))
    f, c = t.freq[ids], t.start[ids]
    limit, bits = np.uint64(63 - t.bits), np.uint64(t.bits)
    x = np.full(lanes, _LOW, np.uint64)
    steps = -(-n // lanes)
    out: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []
    taken = 0
    for step in range(steps - 1, -1, -1):
        a, b = step * lanes, min(n, step * lanes + lanes)
        fs, y = f[a:b], x[: b - a]
        full = y >= fs << limit
        if full.any():
            out.append(y[full].astype(np.uint32))
            taken += len(out[-1])
            y[full] >>= np.uint64(32)
        q = y // fs
        y[:] = (q << bits) + (y - q * fs) + c[a:b]
        if step and step % every == 0:
            marks.append((taken, x.copy()))
    words = np.concatenate(out[::-1]) if out else np.empty(0, np.uint32)
    text = int(any(isinstance(d, str) for d in doc_ids))
    names = [(d or "").encode() for d in doc_ids] if text else []
    parts = [
        _HEAD.pack(_MAGIC, 1, t.bits, text, lanes, every, len(sizes), n, len(words), len(marks), t.crc),
        np.array([d is None for d in doc_ids], np.uint8).tobytes(),
        np.array([len(d) for d in names] if text else [d or 0 for d in doc_ids], "<i8").tobytes(),
        b"".join(names),
        np.array(sizes, "<i8").tobytes(),
        x.astype("<u8").tobytes(),
        *[struct.pack("<Q", taken - k) + s.astype("<u8").tobytes() for k, s in marks[::-1]],
        words.astype("<u4").tobytes(),
    ]
    data = b"".join(parts)
    return data + struct.pack("<I", zlib.crc32(data))


class Block:
    """A block's parts. Wrong checksums, tables and ends of the stream raise ValueError."""

    def __init__(self, data: bytes, t: Table):
        if len(data) < _HEAD.size + 4 or zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("block: checksum")
        magic, version, bits, text, self.lanes, self.every, docs, self.n, words, marks, crc = _HEAD.unpack_from(data)
        if (magic, version, bits, crc) != (_MAGIC, 1, t.bits, t.crc):
            raise ValueError("block: other format or table")
        self.table, at = t, _HEAD.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(data, kind, count, at)
            at += got.nbytes
            return got

        nulls = take("u1", docs)
        ids: list = take("<i8", docs).tolist()
        if text:
            ends = np.cumsum([0, *ids]).tolist()
            blob = take("u1", ends[-1]).tobytes()
            ids = [blob[a:b].decode() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        self.doc_ids = [None if x else i for x, i in zip(nulls.tolist(), ids, strict=True)]
        self.sizes = take("<i8", docs)
        self.marks = [(0, take("<u8", self.lanes))]
        for _ in range(marks):
            self.marks.append((int(take("<u8", 1)[0]), take("<u8", self.lanes)))
        self.words = take("<u4", words)

    def decode(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids first..last-1, from the nearest checkpoint before them."""
        last = self.n if last is None else last
        t, lanes = self.table, self.lanes
        mark = min(first // lanes // self.every, len(self.marks) - 1)
        at, x = self.marks[mark][0], self.marks[mark][1].astype(np.uint64)
        begin = mark * self.every
        bits, mask, low, word = np.uint64(t.bits), np.uint64((1 << t.bits) - 1), np.uint64(_LOW), np.uint64(32)
        word_mask = np.uint64(0xFFFFFFFF)
        steps = -(-last // lanes)
        out = np.empty(max(0, min(self.n, steps * lanes) - begin * lanes), np.uint32)
        for step in range(begin, steps):
            a, b = step * lanes, min(self.n, step * lanes + lanes)
            y = x[: b - a]
            slot = y & mask
            s = t.symbol[slot]
            out[a - begin * lanes : b - begin * lanes] = s
            both = t.both[s]
            y >>= bits
            y *= both & word_mask
            y += slot
            y -= both >> word
            more = np.flatnonzero(y < low)
            if len(more):
                y[more] = (y[more] << word) | self.words[at : at + len(more)]
                at += len(more)
        if last == self.n and ((x != low).any() or at != len(self.words)):
            raise ValueError("block: the stream does not end where it should")
        return out[first - begin * lanes : last - begin * lanes]


def tokenize(docs: DataFrame, text: str = "text", tokenizer: str = TOKENIZER, end: int = END) -> DataFrame:
    """doc_id, n and ids (binary, little-endian, 16 bits where the vocabulary allows) with the end id; and in some rows
    counts: pairs of (id, occurrences) as 64-bit integers, which over all rows add up to those of all ids. mark is a hash of
    the ids, by which rows of one doc_id are told apart and dealt without reading their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, False)
        for batch in (part for whole in frugal(batches) for part in slices(whole, 1)):
            ids, sizes = enc.encode(batch.column(1))
            ids = np.insert(ids, np.cumsum(sizes), end).astype(width(enc.size, end))
            n = np.bincount(ids)
            some = np.flatnonzero(n)
            counts = [np.stack([some, n[some]]).astype("<i8").tobytes()] + [None] * (len(sizes) - 1)
            at = np.concatenate([[0], np.cumsum(sizes + 1)]) * ids.itemsize
            data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(ids.tobytes())]).cast(pa.binary())
            whole, ends = memoryview(ids).cast("B"), at.tolist()
            mark = np.fromiter((xxhash.xxh64_intdigest(whole[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)), np.uint64, len(sizes)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes + 1), data, pa.array(counts, pa.binary()), pa.array(mark)], names=["doc_id", "n", "ids", "counts", "mark"])

    kind = id_kind(docs)
    return docs.select(F.col("doc_id").cast(kind).alias("doc_id"), F.col(f"`{text}`")).mapInArrow(run, f"doc_id {kind}, n long, ids binary, counts binary, mark long")


def id_kind(docs: DataFrame) -> str:
    """Files hold ids as long, or as string where they are text."""
    return "string" if docs.schema["doc_id"].dataType.simpleString() == "string" else "long"


def width(size: int, end: int) -> str:
    return "<u2" if max(size, end + 1) <= 1 << 16 else "<u4"


def count_ids(tokens: DataFrame) -> dict[int, int]:
    """How often each id occurs in all documents, from the counts column alone; as many rows as the vocabulary has ids reach
    the driver at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frugal(batches):
            for value in batch.column(0).to_pylist():
                ids, n = np.frombuffer(value, "<i8").reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n)], names=["id", "n"])

    rows = tokens.select("counts").where("counts is not null").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return {r["id"]: r["n"] for r in rows}


def write(docs: DataFrame, path: str, text: str = "text", tokenizer: str = TOKENIZER, end: int = END, vocabulary: int | None = None, shard_ids: int = SHARD_IDS) -> None:
    """Encode all documents into files under path, in ascending doc_id order (nulls first, then by content).

    Texts are tokenized once; the ids are staged, counted, and dealt by ranges of doc_id into shards, whose
    number follows the input. path/table has the frequencies, path/blocks the blocks.
    """
    spark = docs.sparkSession
    tokens = stage(tokenize(docs, text, tokenizer, end), "ids")
    size = tokens.agg(F.sum("n")).first()[0] or 0
    kind = width(vocabulary or encoder(tokenizer, False).size, end)
    t = table(count_ids(tokens))
    some = np.flatnonzero(t.freq).tolist()
    spark.createDataFrame([(i, int(t.freq[i]), t.bits, id_kind(docs)) for i in some] or [(0, 0, t.bits, id_kind(docs))], "id long, freq long, bits int, doc_ids string").coalesce(1).write.parquet(f"{path}/table")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block = TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        names: list = []
        count = 0

        def flush() -> pa.RecordBatch:
            nonlocal block, count
            data = encode_block(np.concatenate(held), names, [len(x) for x in held], t)
            row = [[shard], [block], [len(names)], [count], [data]]
            block, count = block + 1, 0
            held.clear(), names.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["shard", "block", "n_docs", "n_ids", "data"])

        for batch in frugal(batches):
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                names.append(name)
                held.append(np.frombuffer(value.as_buffer(), kind).astype(np.uint32))
                count += len(held[-1])
                if count >= BLOCK:
                    yield flush()
        if held:
            yield flush()

    shards = max(1, -(-size // shard_ids))
    order = [F.col("doc_id").asc_nulls_first(), F.col("mark")]
    dealt = tokens.select("doc_id", "mark", "ids").repartitionByRange(shards, *order).sortWithinPartitions(*order).select("doc_id", "ids")
    dealt.mapInArrow(run, "shard int, block int, n_docs long, n_ids long, data binary").write.option("compression", "none").parquet(f"{path}/blocks")
    drop_staged(tokens)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (little-endian, 32 bits), from the files.

    Each block is checked and decoded by itself. Starts come from the files' own counts: the sums of the
    shards before (one row a shard) and of the blocks before in the shard.
    """
    rows = spark.read.parquet(f"{path}/table").collect()
    freq = np.zeros(max(r["id"] for r in rows) + 1, np.uint64)
    for r in rows:
        freq[r["id"]] = r["freq"]
    t = Table(freq, rows[0]["bits"])
    ids_are = rows[0]["doc_ids"]
    blocks = spark.read.schema("shard int, block int, n_docs long, n_ids long, data binary").parquet(f"{path}/blocks")
    light = blocks.select("shard", "block", "n_ids")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = light.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = light.select("shard", "block", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("inner")).join(shards, "shard")
    starts = stage(starts.select("shard", "block", (F.col("inner") + F.col("shard_start")).alias("block_start")), "block-starts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frugal(batches):
            for shard, number, value in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                b = Block(value.as_py(), t)
                ids = b.decode()
                at = np.concatenate([[0], np.cumsum(b.sizes)])
                data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(b.sizes), [None, pa.py_buffer(at * 4), pa.py_buffer(ids.astype("<u4").tobytes())])
                n = len(b.sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard.as_py()] * n, pa.int32()), pa.array([number.as_py()] * n, pa.int32()), pa.array(b.doc_ids, pa.int64() if ids_are == "long" else pa.string()), pa.array(at[:-1]), pa.array(b.sizes), data.cast(pa.binary())],
                    names=["shard", "block", "doc_id", "inner", "n_tokens", "ids"],
                )

    decoded = blocks.select("shard", "block", "data").mapInArrow(run, f"shard int, block int, doc_id {ids_are}, inner long, n_tokens long, ids binary")
    out = attach(decoded, starts, ["shard", "block"])
    return out.select("doc_id", (F.col("block_start") + F.col("inner")).alias("start"), "n_tokens", "ids")


def round_trip(docs: DataFrame, text: str = "text", tokenizer: str = TOKENIZER, end: int = END) -> DataFrame:
    """Write all documents to files in the shared folder and read them back.

    A null or empty text is the end id alone; null ids come first; repeated rows are written each; an empty
    table gives files without blocks and an empty result.
    """
    path = stage_path(docs.sparkSession, "rans")
    write(docs, path, text, tokenizer, end)
    return read(docs.sparkSession, path)
