"""Pack tokenized documents into sequences of a fixed length by the sum-of-squares rule."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.tokens import encoder, slices
from spanforge.llm.words import frugal

#: Ids a sequence, the id that ends a document, and the public tokenizer.
LENGTH = 2048
END = 0
TOKENIZER = "byte_bpe_50k.json"
#: Bytes of text whose pieces are packed together, about; and sequence numbers set apart for each such bucket.
BUCKET_BYTES = 64 << 20
NUMBERS = 1 << 32
#: Shuffle partitions for each bucket whose ids travel, and at most for all.
SPREAD, PARTITIONS = 4, 100_000


def sum_of_squares(lengths: np.ndarray, room: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, placed one by one.

    N(h) counts the open bins filled to h. A length goes where the sum of N(h)^2 over 0 < h < room becomes
    smallest: onto an open bin, or into a new one; a bin that is full leaves the sum. Ties go to the fullest
    bin. Longest first, as the last, short ones then fill what is open. Each step compares at most `room`
    levels, whatever the number of bins.
    """
    count = np.zeros(room + 1, np.int64)
    open_at: list[list[int]] = [[] for _ in range(room + 1)]
    bins, offsets = np.empty(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    used = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        s = int(lengths[i])
        level = 0
        if s < room:
            have = count[1 : room - s + 1]
            # onto level h: 2 (N(h + s) - N(h)) + 2, or 1 - 2 N(h) where that fills the bin
            change = 2 * (count[1 + s : room + 1] - have) + 2
            change[-1] = 1 - 2 * have[-1]
            change[have == 0] = np.iinfo(np.int64).max
            best = len(change) - 1 - int(np.argmin(change[::-1]))
            if change[best] <= 2 * count[s] + 1:
                level = best + 1
        if level:
            count[level] -= 1
            bins[i], offsets[i] = open_at[level].pop(), level
        else:
            bins[i] = used
            used += 1
        if level + s < room:
            count[level + s] += 1
            open_at[level + s].append(int(bins[i]))
    return bins, offsets


def cut(n: int, room: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: one if it fits, else whole sequences behind a first, shorter one."""
    first = n - room * (-(-n // room) - 1)
    return [(0, first), *((s, room) for s in range(first, n, room))]


def pieces(docs: DataFrame, text: str = "text", tokenizer: str = TOKENIZER, end: int = END, room: int = LENGTH, ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids (little-endian, 16 bits where the vocabulary allows, else 32)."""

    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, True)
        narrow = "<u2" if max(enc.size, end) < 1 << 16 else "<u4"
        for batch in (part for whole in frugal(batches) for part in slices(whole, 1)):
            found, sizes = enc.encode(batch.column(1))
            row, piece, start, length, crc, data, at = [], [], [], [], [], [], 0
            for i, n in enumerate(sizes.tolist()):
                doc = np.append(found[at : at + n], np.uint32(end)).astype("<u4")
                at += n
                for k, (s, m) in enumerate(cut(n + 1, room)):
                    row.append(i), piece.append(k), start.append(s), length.append(m)
                    crc.append(zlib.crc32(doc[s : s + m]))
                    if ids:
                        data.append(doc[s : s + m].astype(narrow).tobytes())
            columns = [batch.column(0).take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(data, pa.binary())] if ids else [])], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col(f"`{text}`")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids binary" if ids else ""))


def pack(docs: DataFrame, text: str = "text", tokenizer: str = TOKENIZER, end: int = END, room: int = LENGTH, bucket_bytes: int = BUCKET_BYTES, ids: bool = True) -> DataFrame:
    """Every piece with its place, sequence_id and offset, and unless ids is false its ids.

    Pieces are dealt by a hash of their id, number and content into buckets of about bucket_bytes of text,
    so that no bucket grows with the input, and each bucket is packed by `sum_of_squares`. Its few open bins
    are all that is lost against packing the whole. Without ids only lengths and checksums are shuffled; with
    them the shuffle has SPREAD partitions a bucket, so that few buckets meet in a task. A null or empty text
    is the end id alone; null ids are kept; repeated rows are packed each; texts of any length are cut, never
    shortened; an empty table gives an empty one. Reruns agree.
    """
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0
    buckets = max(1, -(-size // bucket_bytes))

    def place(key: tuple, group: pa.Table) -> pa.Table:
        # the ids stay where they are: only lengths are put in order
        order = pc.sort_indices(group.select(["doc_id", "piece", "ids_crc32"]), [("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")]).to_numpy()
        bins, offsets = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        bins[order], offsets[order] = sum_of_squares(group["length"].to_numpy()[order], room)
        out = group.drop_columns(["bucket"])
        return out.append_column("sequence_id", pa.array(bins + key[0].as_py() * NUMBERS)).append_column("offset", pa.array(offsets))

    dealt = pieces(docs, text, tokenizer, end, room, ids).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    if ids:
        dealt = dealt.repartition(min(PARTITIONS, SPREAD * buckets), "bucket")
    kind = docs.schema["doc_id"].dataType.simpleString()
    with_ids = "ids binary, " if ids else ""
    return dealt.groupBy("bucket").applyInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, {with_ids}sequence_id long, offset long")
