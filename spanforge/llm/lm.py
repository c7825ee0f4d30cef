"""Score documents with a gated recurrent language model that is trained on the corpus itself."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.llm import gru
from spanforge.llm.words import frugal, units
from spanforge.runtime import drop_staged, stage

#: Documents whose CRC-32 leaves this remainder are held out.
FOLDS, HELD_OUT = 5, 1
#: Words at most whose counts go to every task; the others' counts are joined. The end of a document is the empty word.
HEAD = 300_000
#: Rounds of training at least; weights are averaged after each. Bytes of text a trainer gets in a round, about.
ROUNDS = 2
TRAINER_BYTES = 8 << 20
#: Sets of weights that meet in one place at most.
TOGETHER = 64


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c) over the rows of (text): all words and, as the empty word, ends. Each task counts its batches first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frugal(batches):
            names, index, _ = units(batch.column(0))
            n = np.bincount(index, minlength=len(names))
            some = n > 0
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([names.filter(pa.array(some)), pa.array([""])]), pa.array(np.append(n[some], batch.num_rows))], names=["word", "n"])

    return docs.mapInArrow(run, "word string, n long").where("n > 0").groupBy("word").agg(F.sum("n").alias("c"))


def rare_class(names: pa.Array) -> np.ndarray:
    """Rare class of each word, by a CRC-32 of its last two characters."""
    tails = pc.utf8_slice_codeunits(names, -2).dictionary_encode()
    crc = np.array([zlib.crc32(t.encode()) % gru.RARE for t in tails.dictionary.to_pylist()] or [0], np.int64)
    return crc[tails.indices.to_numpy()] if len(names) else np.empty(0, np.int64)


class Vocabulary:
    """Corpus figures that every task gets: N, V, the head's words and counts, and each rare class's weight."""

    def __init__(self, words: list[str], counts: list[int], n: int, v: int, rare: dict[int, float]):
        order = sorted(range(len(words)), key=lambda i: (words[i] != "", -counts[i], words[i]))
        self.words = [words[i] for i in order]
        if not self.words or self.words[0] != "":
            self.words.insert(0, "")
        known = {words[i]: counts[i] for i in range(len(words))}
        self.counts = np.array([known.get(w, 0) for w in self.words], np.int64)
        self.n, self.v = n, v
        # one unseen word a class, at half a count
        self.rare = np.array([rare.get(r, 0.0) + 0.5 for r in range(gru.RARE)])
        short = self.counts[: gru.SHORT] + 0.5
        by_class = np.zeros(gru.CLASSES)
        np.add.at(by_class, np.arange(len(short)) // gru.CLASS_WORDS, short)
        self.word_weight, self.class_weight = short, np.concatenate([by_class, self.rare])

    def symbols(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Place in the head (-1 outside) and model symbol of each distinct word."""
        place = pc.index_in(names, value_set=pa.array(self.words, pa.string())).fill_null(-1).to_numpy().astype(np.int32)
        return place, np.where((place >= 0) & (place < gru.SHORT), place, gru.SHORT + rare_class(names)).astype(np.int32)


def vocabulary(counts: DataFrame, head: int = HEAD) -> Vocabulary:
    """From (word, c). Head words are those from the lowest eighth of a power of two upward that leaves at most `head` of them."""
    step = F.floor(F.log2("c") * 8)
    bins = counts.groupBy(step.alias("b")).agg(F.count("*").alias("k"), F.sum("c").alias("c")).orderBy(F.desc("b")).collect()
    n, v = sum(r["c"] for r in bins), sum(r["k"] for r in bins)
    total, lowest = 0, None
    for r in bins:
        total += r["k"]
        if total > head:
            break
        lowest = r["b"]
    rows = counts.where((step >= F.lit(lowest if lowest is not None else 1 << 30)) | (F.col("word") == "")).collect()
    vocab = Vocabulary([r["word"] for r in rows], [r["c"] for r in rows], n, v, {})
    short = vocab.words[: gru.SHORT]
    spark = counts.sparkSession
    listed = spark.createDataFrame([(w,) for w in short], "word string")
    tail_class = (F.crc32(F.right("word", F.lit(2)).cast("binary")) % gru.RARE).alias("r")
    rare = counts.join(F.broadcast(listed), "word", "left_anti").groupBy(tail_class).agg(F.sum(F.col("c") + 0.5).alias("z")).collect()
    return Vocabulary([r["word"] for r in rows], [r["c"] for r in rows], n, v, {r["r"]: r["z"] for r in rare})


def _teacher(weights: np.ndarray):
    def teach(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by([("key", "ascending")])
        ids = [np.frombuffer(x, "<u2") for x in group["ids"].to_pylist()]
        symbols = np.concatenate(ids).astype(np.int64)
        got = gru.train(gru.unflat(weights), symbols, np.array([len(x) for x in ids], np.int64), 0)
        return pa.table({"n": pa.array([len(symbols)], pa.int64()), "w": pa.array([gru.flat(got)], pa.list_(pa.float32()))})

    return teach


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row (n, w) for a task's rows: tokens, and the mean of their weights by tokens."""
    n, total = 0, 0.0
    for batch in frugal(batches):
        for k, w in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            n, total = n + k, total + k * w.values.to_numpy().astype(np.float64)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([(total / n).astype(np.float32)], pa.list_(pa.float32()))], names=["n", "w"])


def average(taught: DataFrame, before: np.ndarray, together: int = TOGETHER) -> np.ndarray:
    """The mean weights of (n, w): summed within each task first, then in ever fewer tasks; those of before if there are none."""
    parts = stage(taught.mapInArrow(_summed, "n long, w array<float>"), "weights")
    while (rows := parts.count()) > together:
        fewer = stage(parts.repartition(max(1, rows // max(2, together))).mapInArrow(_summed, "n long, w array<float>"), "weights")
        drop_staged(parts)
        parts = fewer
    got = parts.collect()
    drop_staged(parts)
    n = sum(r["n"] for r in got)
    return (sum(r["n"] * np.array(r["w"], np.float64) for r in got) / n).astype(np.float32) if n else before


def train(docs: DataFrame, vocab: Vocabulary, rounds: int | None = None, trainer_bytes: int = TRAINER_BYTES) -> np.ndarray:
    """Weights after rounds of parallel training over all (doc_id, text) rows of training documents.

    Every document is in one of the rounds, by a hash. In a round each trainer goes once over its documents,
    from the weights that the round before left, and the weights are averaged by tokens. Both the trainers
    and the rounds follow the input: about trainer_bytes of text each, and a round more each time that the
    input grows fourfold, ROUNDS at least. At most TOGETHER sets of weights reach the driver.
    """
    weights = gru.flat(gru.initial(vocab.word_weight, vocab.class_weight))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frugal(batches):
            names, index, sizes = units(batch.column(1))
            _, symbol = vocab.symbols(names)
            ids = np.insert(symbol[index], np.cumsum(sizes), 0).astype("<u2")
            at = np.concatenate([[0], np.cumsum(sizes + 1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([ids[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["key", "ids"])

    coded = stage(docs.select(F.xxhash64("doc_id", "text").alias("key"), "text").mapInArrow(code, "key long, ids binary"), "train-ids")
    size = (coded.agg(F.sum(F.length("ids"))).first()[0] or 0) * 3  # bytes of text are about three times the ids'
    loads = max(1, -(-size // trainer_bytes))
    if rounds is None:
        rounds = max(ROUNDS, (loads.bit_length() + 1) // 2)
    trainers = max(1, -(-loads // rounds))
    for k in range(rounds):
        part = coded.where(F.pmod(F.shiftrightunsigned("key", 8), F.lit(rounds)) == k).withColumn("trainer", F.pmod(F.shiftrightunsigned("key", 20), F.lit(trainers)))
        weights = average(part.groupBy("trainer").applyInArrow(_teacher(weights), "n long, w array<float>"), weights)
    drop_staged(coded)
    return weights


def score(docs: DataFrame, text: str = "text", head: int = HEAD, rounds: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Counts are over all training documents. Words outside the head are joined with their counts by word, so
    nothing that grows with the corpus is broadcast. A null or empty text is the end token alone; a null id
    counts as the empty text in the split; repeated rows are scored each; without training documents every
    token has probability one under the base and the untrained model scores. An empty table is empty.
    """
    rows = docs.select("doc_id", F.col(f"`{text}`").alias("text"), (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"))
    training = rows.where(~F.col("held_out"))
    counts = stage(count_words(training.select("text")), "word-counts")
    vocab = vocabulary(counts, head)
    weights = train(training.select("doc_id", "text"), vocab, rounds)
    log_short = np.log10(vocab.counts + 0.5)
    log_rare = np.log10(vocab.rare)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = gru.unflat(weights)
        number = TaskContext.get().partitionId() << 40
        for batch in frugal(batches):
            names, index, sizes = units(batch.column(1))
            place, symbol = vocab.symbols(names)
            ends = np.cumsum(sizes)
            where = np.insert(place[index], ends, 0)
            ids = np.insert(symbol[index], ends, 0)
            full = sizes + 1
            doc = np.repeat(np.arange(len(full), dtype=np.int32), full)
            model = gru.score(p, ids, full, 0) / np.log(10)
            inside = where >= 0
            base = np.where(inside, log_short[where], 0.0)
            # within a rare class: the word's weight over the class's; words outside the head add theirs after the join
            rare = ids >= gru.SHORT
            model += np.where(rare, base - log_rare[np.maximum(ids - gru.SHORT, 0)], 0.0)
            n, rid = len(full), number + np.arange(len(full))
            number += n
            out = [np.bincount(doc, x, n) for x in (inside & (vocab.counts[where] > 0), base, model)]
            tail = np.flatnonzero(~inside)
            word = names.take(pa.array(index[np.flatnonzero(place[index] < 0)] if len(index) else [], pa.int32()))
            none = len(tail)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rid), batch.column(0), batch.column(2), pa.array(full), pa.array(out[0].astype(np.int64)), pa.array(out[1]), pa.array(out[2]), pa.nulls(n, pa.string())],
                names=_NAMES,
            )
            if none:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rid[doc[tail]]), pa.nulls(none, batch.schema.field(0).type), *[pa.nulls(none, t) for t in (pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())], word], names=_NAMES
                )

    parts = stage(rows.select("doc_id", "text", "held_out").mapInArrow(run, f"rid long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, model double, word string"), "scored")
    tail = parts.where("word is not null").select("rid", "word").join(counts, "word", "left")
    tail = tail.groupBy("rid").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("tail"), F.count("c").alias("tail_known"))
    whole = float(np.log10(vocab.n + 0.5 * (vocab.v + 1)))
    scored = parts.where("word is null").drop("word").join(tail, "rid", "left")
    rest = F.coalesce("tail", F.lit(0.0))
    return scored.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(vocab.n).cast("long").alias("train_tokens"),
        (F.col("base") + rest - F.col("n_tokens") * F.lit(whole)).alias("base_score"),
        (F.col("model") + rest).alias("score"),
    )


_NAMES = ["rid", "doc_id", "held_out", "n_tokens", "n_known", "base", "model", "word"]
