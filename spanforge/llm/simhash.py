"""SimHash near-duplicates by deletion-variant signatures.

64 bits are cut into two segments of 32. Two fingerprints that differ by at most two bits have a segment
that differs by at most one, so they share a variant of that segment with one bit as a wildcard. Every
distinct fingerprint is indexed under its 2 * 32 variants, equal variants meet, and each pair is verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm import words
from spanforge.llm.components import components, forest
from spanforge.runtime import attach, attach_copies, stage

SHINGLE = 3
SEED = 42
BITS = 2
#: A segment value with more distinct fingerprints than this is indexed by finer variants.
HOT = 4096
#: Shingles whose bits are counted at a time.
CHUNK = 1 << 17


def shingle_hashes(found: list[bytes], size: int = SHINGLE) -> list[int]:
    """XXH64 of every window of so many words, joined by a space; of the whole sequence if it is shorter."""
    if not found:
        return []
    whole = b" ".join(found)
    if len(found) <= size:
        return [xxhash.xxh64_intdigest(whole, SEED)]
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate([[0], ends[: -size] + 1])
    digest = xxhash.xxh64_intdigest
    return [digest(whole[s:e], SEED) for s, e in zip(starts.tolist(), ends[size - 1 :].tolist(), strict=True)]


def majority(hashes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A fingerprint for each run of hashes: the bits set in over half of the run; zero for an empty run."""
    out = np.zeros(len(starts), np.uint64)
    some = lengths > 0
    if some.any():
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums = np.add.reduceat(bits, starts[some], axis=0, dtype=np.int64)
        on = (2 * sums > lengths[some][:, None]).astype(np.uint8)
        out[some] = np.packbits(on, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(texts: list[str]) -> np.ndarray:
    """SimHash of every text (uint64). A very long text is counted by itself, in chunks."""
    out = np.zeros(len(texts), np.uint64)
    held: list[int] = []
    rows: list[int] = []
    lengths: list[int] = []

    def flush():
        if rows:
            n = np.array(lengths)
            out[rows] = majority(np.array(held, np.uint64), np.cumsum(n) - n, n)
            held.clear(), rows.clear(), lengths.clear()

    for i, text in enumerate(texts):
        h = shingle_hashes(words.lower_words(text))
        if len(h) > CHUNK:
            sums = np.zeros(64, np.int64)
            for k in range(0, len(h), CHUNK):
                sums += np.unpackbits(np.array(h[k : k + CHUNK], np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0)
            out[i] = np.packbits((2 * sums > len(h)).astype(np.uint8), bitorder="little").view(np.uint64)[0]
            continue
        held += h
        rows.append(i)
        lengths.append(len(h))
        if len(held) > CHUNK:
            flush()
    flush()
    return out


def with_fingerprint(docs: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with __sf_fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.frugal(batches):
            fp = pa.array(fingerprints(words.strings(batch.column(text))).view(np.int64))
            rest = batch if keep_text else batch.drop_columns([text])
            yield pa.RecordBatch.from_arrays([*rest.columns, fp], names=[*rest.schema.names, "__sf_fp"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if keep_text or f.name != text]
    return docs.mapInArrow(run, ", ".join([*fields, "__sf_fp long"]))


def close_pairs(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs at BITS or fewer differing bits, compared in blocks."""
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for i in range(0, len(fp), 1024):
        for j in range(i, len(fp), 1024):
            near = np.bitwise_count(fp[i : i + 1024, None] ^ fp[None, j : j + 1024]) <= BITS
            a, b = np.nonzero(np.triu(near, 1) if i == j else near)
            found.append((a + i, b + j))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _links_of_runs(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star forests of the links within each run of equal keys (sorted by key)."""
    if not len(key):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.append(starts, len(key)))
    two = starts[sizes == 2]
    near = two[np.bitwise_count((fp[two] ^ fp[two + 1]).view(np.uint64)) <= BITS]
    a, b = [fp[near]], [fp[near + 1]]
    for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        part = fp[s : s + n]
        i, j = close_pairs(part.view(np.uint64))
        if len(i):
            u, v = forest(part[i], part[j])
            a.append(u), b.append(v)
    return np.concatenate(a), np.concatenate(b)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links from a partition sorted by key. A run that goes on in the next batch is held until it ends."""
    key, fp = np.empty(0, np.int64), np.empty(0, np.int64)

    def out(k, f):
        u, v = _links_of_runs(k, f)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    for batch in words.frugal(batches):
        key, fp = np.concatenate([key, batch.column(0).to_numpy()]), np.concatenate([fp, batch.column(1).to_numpy()])
        if len(key):
            cut = int(np.searchsorted(key, key[-1]))
            yield out(key[:cut], fp[:cut])
            key, fp = key[cut:], fp[cut:]
    yield out(key, fp)


def _variants(nodes: DataFrame) -> DataFrame:
    """(key, fp): both segments, each with one of its bits as a wildcard."""
    keys = []
    for s in range(2):
        segment = F.shiftrightunsigned(F.col("fp"), 32 * s).bitwiseAND(F.lit(0xFFFFFFFF))
        keys += [segment.bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << j))).bitwiseOR(F.lit((s << 5 | j) << 32)) for j in range(32)]
    skip = F.array(*[F.lit(None).cast("long")])
    mine = [F.when(F.col(f"hot{s}"), skip).otherwise(F.array(*keys[32 * s : 32 * s + 32])) for s in range(2)]
    return nodes.select(F.explode(F.concat(*mine)).alias("key"), "fp").where("key is not null")


def _fine_variants(nodes: DataFrame) -> DataFrame:
    """(key, fp) for fingerprints near a hot segment value: the segment whole or with one wildcard, and half of the other.

    With the hot segment equal, the other differs by up to two bits, so one of its halves differs by at most
    one: 2 * 16 variants. With one bit of the hot segment apart, the other differs by at most one bit, so one
    of its halves is equal: 32 * 2 variants. A key leaves at most 17 bits free: 131,072 fingerprints at most.
    """
    out = None
    for s in range(2):
        hot = F.shiftrightunsigned(F.col("fp"), 32 * s).bitwiseAND(F.lit(0xFFFFFFFF))
        keys = []
        for h in range(2):
            half = F.shiftrightunsigned(F.col("fp"), 32 * (1 - s) + 16 * h).bitwiseAND(F.lit(0xFFFF))
            keys += [F.xxhash64(F.lit(s), F.lit(h), F.lit(100 + j), hot, half.bitwiseAND(F.lit(0xFFFF ^ (1 << j)))) for j in range(16)]
            keys += [F.xxhash64(F.lit(s), F.lit(h), F.lit(j), hot.bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << j))), half) for j in range(32)]
        part = nodes.where(f"fine{s}").select(F.explode(F.array(*keys)).alias("key"), "fp")
        out = part if out is None else out.unionByName(part)
    return out


def links(prints: DataFrame, hot: int = HOT) -> DataFrame:
    """(u, v): links that connect all distinct fingerprints (column fp) that chains of BITS-bit steps connect.

    Only a forest of each list's links is given, never all pairs. Segment values with over `hot` distinct
    fingerprints go by finer keys, so no list grows with the input.
    """
    segments = prints.select(F.posexplode(F.array(*[F.shiftrightunsigned(F.col("fp"), 32 * s).bitwiseAND(F.lit(0xFFFFFFFF)) for s in range(2)])).alias("s", "segment"))
    busy = stage(segments.groupBy("s", "segment").count().where(F.col("count") > hot).select("s", "segment"), "hot-segments")
    if busy.isEmpty():
        keyed = _variants(prints.select("fp", F.lit(False).alias("hot0"), F.lit(False).alias("hot1")))
    else:
        flips = F.array(F.col("segment"), *[F.col("segment").bitwiseXOR(F.lit(1 << j)) for j in range(32)])
        near = stage(busy.select("s", F.explode(flips).alias("segment")).distinct().join(busy.withColumn("is", F.lit(True)), ["s", "segment"], "left"), "near-hot")
        nodes = prints
        for s in range(2):
            mine = near.where(F.col("s") == s).select(F.col("segment").alias(f"g{s}"), F.lit(True).alias(f"near{s}"), F.col("is").alias(f"is{s}"))
            nodes = attach(nodes.withColumn(f"g{s}", F.shiftrightunsigned(F.col("fp"), 32 * s).bitwiseAND(F.lit(0xFFFFFFFF))), mine, [f"g{s}"])
            nodes = nodes.withColumn(f"hot{s}", F.coalesce(f"is{s}", F.lit(False))).withColumn(f"fine{s}", F.coalesce(f"near{s}", F.lit(False)))
        nodes = stage(nodes.select("fp", "hot0", "hot1", "fine0", "fine1"), "hot-prints")
        keyed = _variants(nodes).unionByName(_fine_variants(nodes))
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_links, "u long, v long")


def classes(printed: DataFrame, hot: int = HOT) -> DataFrame:
    """(fp, root, component_id, copies) for every distinct fingerprint of (doc_id, fp).

    root is a fingerprint that names the component, component_id the smallest doc_id in reach, copies the rows.
    """
    nodes = stage(printed.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "prints")
    found = components(links(nodes.select("fp"), hot)).withColumnRenamed("node", "fp")
    linked = stage(nodes.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "linked")
    lowest = stage(linked.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("prints")).where("prints > 1").drop("prints"), "lowest")
    out = attach(linked, lowest, ["root"])
    return out.select("fp", "root", F.coalesce("component_id", "rep").alias("component_id"), "copies")


def near_duplicates(docs: DataFrame, text: str = "text", hot: int = HOT) -> DataFrame:
    """doc_id, fp and component_id, one row per row of docs.

    A null or empty text has fingerprint zero and links like any other. Null ids are no smallest id; a
    component of null ids alone has a null component_id. Repeated rows are copies of one another. Copies
    share one fingerprint, are folded into it before any comparison, and are joined back at the end, those
    of a fingerprint with very many without a shuffle. Texts of any length are taken whole. An empty table
    gives an empty one.
    """
    printed = stage(with_fingerprint(docs.select("doc_id", F.col(f"`{text}`").alias("text")), keep_text=False).withColumnRenamed("__sf_fp", "fp"), "fingerprints")
    return attach_copies(printed, stage(classes(printed, hot), "classes"), "fp", "copies").select("doc_id", "fp", "component_id")
