"""SimHash near-duplicates at a Jaccard similarity: deletion-variant signatures over as many segments as that takes.

The operator of `simhash` cuts 64 bits into two segments, which finds pairs two bits apart. Texts whose sets of
five-word shingles have a similarity of 0.8 differ in about 15 % of their bits, whatever the fingerprint's width.
So the fingerprint here is wider and cut into more segments; a pair is a candidate where one segment differs by at
most one bit, which is an equal one-wildcard variant of it. A segment that differs in one bit has an equal half:
rows are dealt by halves, and the wildcard variants of the other half are formed and joined within the task, so
two rows a segment travel in place of one for each variant. Rows that meet so form
clusters, in which the sets are compared exactly. Texts with equal sets share one key and are folded before any comparison.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm import words
from spanforge.llm.components import components, forest
from spanforge.llm.simhash import shingle_hashes
from spanforge.runtime import among, attach, drop_staged, stage

SHINGLE = 5
#: A pair is similar at NEAR / OF and above.
NEAR, OF = 4, 5
#: Share of pairs at exactly the least similarity that may go unseen; more similar ones are missed less often.
MISS = 0.01
#: Bits of a segment at least and at most; it takes two more than the number of documents has, so that chance lists stay short.
LEAST_BITS, MOST_BITS = 20, 32
#: Bits compared before a pair is verified, and the most that may differ: 3.4 deviations above the mean at the least similarity.
SKETCH, APART = 128, 33
#: Lists up to this length are compared many at a time, longer ones row by row.
SHORT = 32
#: Rows of one half's value that are joined within a task; more are dealt by its wildcard variants first.
HOT = 200_000
#: Sets and shingles of a cluster's block, about: two blocks are compared in one task.
BLOCK = 256
BLOCK_SHINGLES = 1 << 20

_GOLD, _A, _B = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def segments(documents: int, miss: float = MISS) -> tuple[int, int]:
    """(bits of a segment, segments) for so many documents.

    At a Jaccard similarity s of sets of one size, a bit differs with a chance of acos(2 s / (1 + s)) / pi.
    A segment meets if at most one of its bits does, and all fail to with a chance of `miss`.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, 2 * -(-(max(1, documents).bit_length() + 2) // 2)))
    q = math.acos(2 * NEAR / (NEAR + OF)) / math.pi
    meets = (1 - q) ** bits + bits * q * (1 - q) ** (bits - 1)
    return bits, math.ceil(math.log(miss) / math.log(1 - meets))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The set of a text's shingles, as sorted hashes (uint64)."""
    return np.unique(np.array(shingle_hashes(words.lower_words(text), size), np.uint64))


def fingerprint(held: np.ndarray, bits: int) -> np.ndarray:
    """SimHash of a set of hashes in so many bits (uint8, 0 or 1); a tie takes the bit of the smallest hash."""
    words_ = -(-bits // 64)
    salt = np.array([((k + 1) * _GOLD) & (1 << 64) - 1 for k in range(words_)], np.uint64)
    sums = np.zeros(64 * words_, np.int64)
    for at in range(0, len(held), 255):  # what a byte can count
        x = held[at : at + 255, None] + salt
        x ^= x >> np.uint64(30)
        x *= _A
        x ^= x >> np.uint64(27)
        x *= _B
        x ^= x >> np.uint64(31)
        on = np.unpackbits(x.view(np.uint8), axis=1)
        sums += np.add.reduce(on, axis=0, dtype=np.uint8)
        if not at:
            least = on[0]
    return np.where(2 * sums == len(held), least, 2 * sums > len(held)).astype(np.uint8)[:bits]


def with_signature(docs: DataFrame, text: str, bits: int, count: int, size: int = SHINGLE) -> DataFrame:
    """docs with __sf_fp, a key of the set of shingles, __sf_n, its size, __sf_segments and __sf_sketch.

    Sets of fewer than NEAR shingles are similar to equal ones only and get no segments.
    """
    weights = 1 << np.arange(bits, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.frugal(batches):
            n = batch.num_rows
            fp, sizes, cuts, sketch = np.empty(n, np.uint64), np.empty(n, np.int64), [], np.zeros((n, 2), np.int64)
            for i, t in enumerate(words.strings(batch.column(text))):
                s = shingles(t, size)
                fp[i], sizes[i] = xxhash.xxh64_intdigest(s.tobytes()), len(s)
                if len(s) >= NEAR:
                    print_ = fingerprint(s, bits * count + SKETCH)
                    cuts.append(print_[: bits * count].reshape(count, bits) @ weights)
                    sketch[i] = np.packbits(print_[-SKETCH:]).view(np.int64)
            ends = np.concatenate([[0], np.cumsum(np.where(sizes >= NEAR, count, 0))]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(cuts) if cuts else np.empty(0, np.int64)))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * 2), pa.array(sketch.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fp.view(np.int64)), pa.array(sizes), listed, flat], names=[*batch.schema.names, "__sf_fp", "__sf_n", "__sf_segments", "__sf_sketch"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    return docs.mapInArrow(run, ", ".join([*fields, "__sf_fp long, __sf_n long, __sf_segments array<long>, __sf_sketch array<long>"]))


def keyed(nodes: DataFrame, bits: int, hot: int = HOT) -> DataFrame:
    """nodes (fp, n, segments, a, b) as (key, other, ...): a row for each half of each segment.

    key holds the segment, the half and its value; other is the segment's other half. Values with more than
    `hot` rows get a row for each wildcard of the other half, with that variant in the key, so that what meets
    in a task is bounded by the lists themselves.
    """
    half = bits // 2
    low = (1 << half) - 1
    rest = [c for c in nodes.columns if c != "segments"]
    cut = nodes.select(*rest, F.posexplode("segments").alias("s", "segment"))
    right, left = F.col("segment").bitwiseAND(F.lit(low)), F.shiftrightunsigned("segment", half)
    two = F.explode(F.array(*[F.struct((F.col("s") * 2 + k).alias("side"), v.alias("value"), o.alias("other")) for k, v, o in ((0, left, right), (1, right, left))])).alias("x")
    dealt = cut.select(*rest, two).select(*rest, F.shiftleft(F.shiftleft(F.col("x.side").cast("long"), half).bitwiseOR(F.col("x.value")), half + 6).alias("key"), F.col("x.other").alias("other"))
    busy = stage(dealt.groupBy("key").count().where(F.col("count") > hot).select(F.col("key").alias("busy")), "hot-halves")
    if busy.isEmpty():
        return dealt.select("key", "other", *rest)
    marked = dealt.join(F.broadcast(busy), F.col("key") == F.col("busy"), "left")  # at most rows / hot of them
    variants = F.array(*[F.shiftleft(F.lit(w + 1).cast("long"), half).bitwiseOR(F.col("other").bitwiseAND(F.lit(low ^ (1 << w)))) for w in range(half)])
    low_part = F.explode(F.when(F.col("busy").isNull(), F.array(F.lit(0).cast("long"))).otherwise(variants)).alias("variant")
    return marked.select("*", low_part).select(F.col("key").bitwiseOR(F.col("variant")).alias("key"), "other", *rest)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of a partition sorted by its first, cut only where that changes."""
    held: list[list[np.ndarray]] = []
    for batch in words.frugal(batches):
        new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(new[0]):
            continue
        cut = int(np.searchsorted(new[0], new[0][-1]))
        if cut or (held and held[-1][0][-1] != new[0][0]):
            yield [np.concatenate(x) for x in zip(*held, [x[:cut] for x in new], strict=True)]
            held = []
        held.append([x[cut:] for x in new])
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _lists(key: np.ndarray, other: np.ndarray, half: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in order, starts, sizes), for each wildcard: lists of two or more rows with an equal variant."""
    low = (1 << half) - 1
    variant = (key >> half) & 63  # 0: all variants are formed here; else the key's own
    change = np.concatenate([[True], key[1:] != key[:-1]])
    dense = np.cumsum(change) - 1
    for w in range(half):
        mine = np.flatnonzero((variant == 0) | (variant == w + 1))
        if not len(mine):
            continue
        code = dense[mine] << half | other[mine] & (low ^ (1 << w))
        order = np.argsort(code, kind="stable")
        code = code[order]
        starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        sizes = np.diff(np.append(starts, len(code)))
        many = sizes > 1
        if many.any():
            yield mine[order], starts[many], sizes[many]


def _near(rows: tuple[np.ndarray, ...], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs of places are of like size and sketch."""
    n, a, b = rows
    ok = OF * np.minimum(n[i], n[j]) >= NEAR * np.maximum(n[i], n[j])
    ok[ok] = np.bitwise_count(a[i[ok]] ^ a[j[ok]]) + np.bitwise_count(b[i[ok]] ^ b[j[ok]]) <= APART
    return ok


def _long(rows: tuple[np.ndarray, ...], mine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that connect what the near ones of a long list connect; each row is held against those not yet with it."""
    group = np.arange(len(mine))
    u, v = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for k in range(len(mine) - 1):
        apart = np.flatnonzero(group[k + 1 :] != group[k]) + k + 1
        met = apart[_near(rows, np.full(len(apart), mine[k]), mine[apart])]
        if len(met):
            met = met[np.unique(group[met], return_index=True)[1]]  # one of each group is enough
            group[np.isin(group, group[met])] = group[k]
            u.append(np.full(len(met), mine[k])), v.append(mine[met])
    return np.concatenate(u), np.concatenate(v)


def _meetings(half: int, short: int):
    """Rows (u, v): a forest of the near pairs of all lists of a run. No list gives more rows than it has members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, other, fp, n, a, b in _runs(batches):
            rows = n, a.view(np.uint64), b.view(np.uint64)
            u, v = np.empty(0, np.int64), np.empty(0, np.int64)
            for order, starts, sizes in _lists(key, other, half):
                found = [(u, v)]
                for m in np.unique(sizes).tolist():
                    at = starts[sizes == m]
                    if m <= short:
                        x, y = np.triu_indices(m, 1)
                        i, j = order[(at[:, None] + x).ravel()], order[(at[:, None] + y).ravel()]
                        ok = _near(rows, i, j)
                        found.append((fp[i[ok]], fp[j[ok]]))
                    else:
                        for s in at.tolist():
                            i, j = _long(rows, order[s : s + m])
                            found.append((fp[i], fp[j]))
                u, v = forest(*(np.concatenate(x) for x in zip(*found, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.frugal(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t, size).tobytes() for t in words.strings(batch.column(1))], pa.binary())], names=["row", "s"])

    return run


def similar_pairs(sets: list[np.ndarray], left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) that connect what the similar pairs of a left and a right set connect; of all, where all are left.

    Shared hashes are counted for one set against all others at once, so a group costs its hashes times its sets.
    """
    sizes = np.array([len(x) for x in sets], np.int64)
    right = np.flatnonzero(~left) if not left.all() else np.arange(len(sets))
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    at = np.cumsum(sizes) - sizes
    held = np.concatenate([flat[at[k] : at[k] + sizes[k]] for k in right])
    starts = np.cumsum(sizes[right]) - sizes[right]
    mark = np.zeros(int(flat.max(initial=0)) + 1, np.int32)
    group = np.arange(len(sets))
    u, v = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for k in np.flatnonzero(left).tolist():
        if (group[right] == group[k]).all():
            continue
        mine = flat[at[k] : at[k] + sizes[k]]
        mark[mine] = 1
        both = np.add.reduceat(mark[held], starts)
        mark[mine] = 0
        met = right[(OF * both >= NEAR * (sizes[k] + sizes[right] - both)) & (group[right] != group[k])]
        if len(met):
            met = met[np.unique(group[met], return_index=True)[1]]
            group[np.isin(group, group[met])] = group[k]
            u.append(np.full(len(met), k)), v.append(met)
    return np.concatenate(u), np.concatenate(v)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) of the groups (key) of a sorted partition."""
    for key, fp, second, data in _runs(batches):
        cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        out_u, out_v = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for s, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(key)], strict=True):
            left = ~second[s:e].astype(bool)
            if e - s > 1 and left.any():
                i, j = similar_pairs([np.frombuffer(x, np.uint64) for x in data[s:e]], left)
                out_u.append(fp[s:e][i]), out_v.append(fp[s:e][j])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_u)), pa.array(np.concatenate(out_v))], names=["u", "v"])


def links(nodes: DataFrame, texts: DataFrame, bits: int, size: int = SHINGLE, hot: int = HOT, short: int = SHORT, block: int = BLOCK) -> DataFrame:
    """(u, v): links that connect what chains of similar candidates connect, of nodes (fp, row, n, segments, a, b) and texts (row, text).

    Rows that share a variant and have near sketches meet; a forest of these meetings gives clusters. A cluster is
    cut into blocks of about `block` sets or BLOCK_SHINGLES shingles, and every two blocks (most clusters have one) go to one task, which
    compares their sets exactly and returns a forest of the similar pairs. So neither meetings nor similar pairs
    are ever emitted by the square of a group, and no task gets a whole cluster that is large.
    """
    half = bits // 2
    near = keyed(nodes, bits, hot).select("key", "other", "fp", "n", "a", "b").repartition("key").sortWithinPartitions("key")
    met = stage(near.mapInArrow(_meetings(half, short), "u long, v long").distinct(), "meetings")
    clusters = stage(components(met).select(F.col("node").alias("fp"), F.col("root").alias("cluster")), "clusters")
    drop_staged(met)
    members = stage(nodes.select("fp", "row", "n").join(clusters, "fp"), "members")
    blocks = members.groupBy("cluster").agg(F.ceil(F.greatest(F.sum("n") / F.lit(BLOCK_SHINGLES), F.count("*") / F.lit(block))).cast("int").alias("blocks"))
    many = stage(blocks.where("blocks > 1"), "large-clusters")
    placed = attach(clusters, many, ["cluster"]).withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    pair = F.xxhash64("cluster", F.least("mine", "with"), F.greatest("mine", "with")).alias("key")
    placed = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(pair, "fp", (F.col("mine") > F.col("with")).alias("second"))
    one = among(texts, members.select("row"))
    sets = stage(one.mapInArrow(_sets(size), "row long, s binary").join(members.select("fp", "row"), "row"), "shingle-sets")
    held = placed.join(sets, "fp").select("key", "fp", "second", "s").repartition("key").sortWithinPartitions("key")
    found = stage(held.mapInArrow(_verify, "u long, v long").distinct(), "similar")
    for used in (clusters, members, many, sets):
        drop_staged(used)
    return found


def keep_one(docs: DataFrame, text: str = "text", size: int = SHINGLE, miss: float = MISS, hot: int = HOT, short: int = SHORT, block: int = BLOCK) -> DataFrame:
    """One document of each component, that of the smallest doc_id, with the columns of docs.

    Documents are linked where their sets of `size`-word shingles (A-Z lower-cased; the whole sequence of a
    shorter text) have a Jaccard similarity of 0.8 or more and share a variant, which pairs at exactly 0.8 do
    but for a share of `miss`. A null or empty text, like one of blanks, has the empty set, as any other such
    text: one of them stays. Null ids are no smallest id. Of repeated rows one stays. Texts of any length are
    taken whole. An empty table gives an empty one. Extra columns are kept, whatever their names.
    """
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    doc_id, text = f"c{names.index('doc_id')}", f"c{names.index(text)}"
    bits, count = segments(docs.count(), miss)
    printed = stage(with_signature(plain.withColumn("__sf_row", F.monotonically_increasing_id()), text, bits, count, size), "signed-docs")
    first = [F.first(c).alias(c.removeprefix("__sf_")) for c in ("__sf_n", "__sf_segments", "__sf_sketch")]
    low = F.min(F.struct(F.col(doc_id).isNull().alias("null"), F.col(doc_id).alias("doc_id"), F.col("__sf_row").alias("row"))).alias("best")
    sets = stage(printed.groupBy(F.col("__sf_fp").alias("fp")).agg(*first, low), "sets")
    nodes = sets.where(F.size("segments") > 0).select("fp", F.col("best.row").alias("row"), "n", "segments", F.col("sketch")[0].alias("a"), F.col("sketch")[1].alias("b"))
    similar = links(nodes, printed.select(F.col("__sf_row").alias("row"), F.col(text).alias("text")), bits, size, hot, short, block)
    found = stage(components(similar).withColumnRenamed("node", "fp"), "components")
    best = sets.select("fp", "best").join(found, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("best").alias("best"))
    losers = stage(printed.select("__sf_row").join(best.select(F.col("best.row").alias("__sf_row")), "__sf_row", "left_anti"), "losers")
    for used in (sets, similar, found):
        drop_staged(used)
    return among(printed, losers, "left_anti").select(*[f"c{i}" for i in range(len(names))]).toDF(*names)
