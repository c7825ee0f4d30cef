"""Toxicity categories by a classifier chain: linear models in a row, each reading the ones before.

A category's model sees which of its telling words a document holds, and the log-odds that the earlier
categories got. In training these come from models that have not seen the document (out of fold).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.words import frugal, units
from spanforge.runtime import drop_staged, stage

#: Labelled rows that fit the models, those of the lowest hashes; the only bound, and only on training.
SAMPLE = 20_000
FOLDS = 3
#: A word is a feature from this chi-squared statistic on, in this many training documents; features at most.
TELLING, SEEN, FEATURES = 30.0, 5, 512
#: Characters of a word's beginning, which is a feature too.
BEGINNING = 4
RIDGE = 0.1
#: Characters that don't count at the ends of words.
EDGES = ".,;:!?\"'()[]{}<>#*$%&|+=~^`/\\_-"
#: From this probability on a category holds.
CUT = 0.5


def word_sets(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words (lower case, edges trimmed) and beginnings of words (marked by *), and the pairs (document, feature) that occur."""
    names, index, sizes = units(texts)
    names = pc.utf8_trim(names, EDGES)
    begins = pc.binary_join_element_wise(pc.utf8_slice_codeunits(names, 0, BEGINNING), "*", "")
    coded = pa.concat_arrays([names, begins]).dictionary_encode()
    feature = coded.indices.to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
    wide = max(1, len(coded.dictionary))
    pairs = np.unique(np.concatenate([doc * wide + feature[index], doc * wide + feature[len(names) + index]])) if len(index) else np.empty(0, np.int64)
    return coded.dictionary, pairs // wide, pairs % wide


@dataclass
class Linear:
    """Weights of words, of earlier categories' log-odds, and the bias."""

    words: list[str]
    weights: list[float]
    chain: list[float]
    bias: float


def ridge_logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps; the last column is the bias and carries no penalty."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], RIDGE)
    penalty[-1] = 1e-6
    for _ in range(50):
        gradient, curve = penalty * w, np.diag(penalty)
        for a in range(0, len(x), 2048):
            part = x[a : a + 2048].astype(np.float64)
            p = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30)))
            gradient += part.T @ (p - y[a : a + 2048])
            curve += (part * (p * (1 - p))[:, None]).T @ part
        step = np.linalg.solve(curve, gradient)
        step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-9))
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_one(doc: np.ndarray, word: np.ndarray, names: list[str], chosen: np.ndarray, y: np.ndarray, earlier: np.ndarray) -> Linear:
    """One category's model over the chosen words. Without both labels it is the bias alone, at the label's rate of (k + 0.5) / (n + 1)."""
    n, k = len(y), float(y.sum())
    if not 0 < k < n:
        return Linear([], [], [0.0] * earlier.shape[1], float(np.log((k + 0.5) / (n - k + 0.5))))
    place = np.full(len(names), -1)
    place[chosen] = np.arange(len(chosen))
    x = np.zeros((n, len(chosen) + earlier.shape[1] + 1), np.float32)
    there = place[word] >= 0
    x[doc[there], place[word[there]]] = 1
    x[:, len(chosen) : -1] = earlier
    x[:, -1] = 1
    w = ridge_logistic(x, y)
    return Linear([names[i] for i in chosen], w[: len(chosen)].tolist(), w[len(chosen) : -1].tolist(), float(w[-1]))


def log_odds(m: Linear, names: pa.Array, doc: np.ndarray, word: np.ndarray, n: int, earlier: np.ndarray) -> np.ndarray:
    place = pc.index_in(names, value_set=pa.array(m.words, pa.string())).fill_null(-1).to_numpy()[word] if len(names) and m.words else np.full(len(word), -1)
    there = place >= 0
    out = np.bincount(doc[there], np.array(m.weights)[place[there]], n) if there.any() else np.zeros(n)
    return np.clip(out + m.bias + earlier @ np.array(m.chain, np.float64), -30, 30)


def fit(names: list[str], doc: np.ndarray, word: np.ndarray, labels: np.ndarray, folds: np.ndarray, chosen: list[list[np.ndarray]]) -> list[Linear]:
    """A chain for the columns of labels, from the pairs (doc, word) that occur. chosen holds, for each category, the words
    of its model and of those without one fold. Each earlier category's log-odds are predicted by models of the other folds."""
    n, chain = len(labels), []
    earlier = np.zeros((n, 0))
    known = pa.array(names, pa.string())
    for k in range(labels.shape[1]):
        y = labels[:, k].astype(np.float64)
        chain.append(fit_one(doc, word, names, chosen[k][0], y, earlier))
        unseen = np.zeros(n)
        for f in range(FOLDS):
            rest = np.flatnonzero(folds != f)
            number = np.full(n, -1)
            number[rest] = np.arange(len(rest))
            seen = number[doc] >= 0
            m = fit_one(number[doc[seen]], word[seen], names, chosen[k][f + 1], y[rest], earlier[rest])
            unseen = np.where(folds == f, log_odds(m, known, doc, word, n, earlier), unseen)
        earlier = np.column_stack([earlier, unseen])
    return chain


def examples(docs: DataFrame, labels: DataFrame, categories: list[str], text: str, sample: int) -> DataFrame:
    """(doc_id, text, key, fold, y0, y1, ...): the labelled documents that fit the models, one row each, staged."""
    usable = labels.select("doc_id", *[F.col(f"`{c}`").cast("double").alias(f"y{i}") for i, c in enumerate(categories)]).dropna()
    order = F.xxhash64(F.lit("toxicity"), "doc_id")
    ys = [f"y{i}" for i in range(len(categories))]
    usable = usable.groupBy("doc_id").agg(*[F.max(y).alias(y) for y in ys]).orderBy(order, "doc_id").limit(sample)
    rows = docs.select("doc_id", F.col(f"`{text}`").alias("text")).where("text is not null").join(F.broadcast(usable), "doc_id")
    once = rows.groupBy("doc_id").agg(F.min("text").alias("text"), *[(F.max(y) > 0).cast("long").alias(y) for y in ys])
    key = F.shiftrightunsigned(order, 8)
    return stage(once.select("doc_id", "text", key.alias("key"), F.pmod(key, F.lit(FOLDS)).alias("fold"), *ys), "examples")


def word_counts(rows: DataFrame, n: int) -> DataFrame:
    """(word, c<fold>_0, c<fold>_1, ...): examples of each fold with a word, of all labels and with each category's; staged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frugal(batches):
            names, doc, word = word_sets(batch["text"])
            fold, ys = batch["fold"].to_numpy(), [batch[f"y{i}"].to_numpy() for i in range(n)]
            cols = []
            for f in range(FOLDS):
                mine = fold[doc] == f
                at = doc[mine]
                cols += [np.bincount(word[mine], w, len(names)).astype(np.int64) for w in (None, *[y[at] for y in ys])]
            yield pa.RecordBatch.from_arrays([names, *[pa.array(c) for c in cols]], names=["word", *counted])

    counted = [f"c{f}_{i}" for f in range(FOLDS) for i in range(n + 1)]
    parts = rows.select("text", "fold", *[f"y{i}" for i in range(n)]).mapInArrow(run, "word string, " + ", ".join(f"{c} long" for c in counted))
    return stage(parts.groupBy("word").agg(*[F.sum(c).alias(c) for c in counted]), "word-counts")


def telling(counts: DataFrame, category: int, folds: list[int], n: int, positive: int) -> list[str]:
    """Words whose presence and a category depend on each other in some folds, most so first (ties by word), FEATURES at most."""
    if not 0 < positive < n:
        return []
    df, a = (sum((F.col(f"c{f}_{i}") for f in folds), F.lit(0)) for i in (0, category + 1))
    b, c = df - a, positive - a
    odds = (a * (n - positive - b) - b * c).cast("double")
    scale = df.cast("double") * (n - df) * positive * (n - positive)
    scored = counts.select("word", df.alias("df"), F.when(scale > 0, n * odds * odds / scale).alias("chi"))
    best = scored.where((F.col("chi") >= TELLING) & (F.col("df") >= SEEN)).orderBy(F.desc("chi"), "word").limit(FEATURES)
    return [r["word"] for r in best.select("word").collect()]


def train(docs: DataFrame, labels: DataFrame, categories: list[str], text: str = "text", sample: int = SAMPLE) -> list[Linear]:
    """The chain from at most `sample` labelled documents; only telling words and the models reach the driver.

    Words are counted where the texts lie, and the telling ones chosen from the counts. The one task that fits the models
    gets, for each example, the numbers of the telling words that it holds, never a text, so that its memory is bounded by
    the sample and by FEATURES, however long texts are. Rows with a null label or text are no examples; of several labels
    of one document the highest counts, of several texts the lowest. Without examples every category has probability one half.
    """
    n = len(categories)
    rows = examples(docs, labels, categories, text, sample)
    sizes = {r["fold"]: r[1:] for r in rows.groupBy("fold").agg(F.count("*"), *[F.sum(f"y{i}") for i in range(n)]).collect()}
    if not sizes:
        return [Linear([], [], [0.0] * i, 0.0) for i in range(n)]
    counts = word_counts(rows, n)
    sets = [list(range(FOLDS)), *[[g for g in range(FOLDS) if g != f] for f in range(FOLDS)]]
    total = [[sum(sizes[f][i] for f in s if f in sizes) for i in range(n + 1)] for s in sets]
    told = [[telling(counts, k, s, t[0], t[k + 1]) for s, t in zip(sets, total, strict=True)] for k in range(n)]
    names = sorted({w for per in told for words in per for w in words})
    number = {w: i for i, w in enumerate(names)}
    chosen = [[np.array([number[w] for w in words], np.int64) for words in per] for per in told]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(names, pa.string())
        for batch in frugal(batches):
            found, doc, word = word_sets(batch["text"])
            place = pc.index_in(found, value_set=known).fill_null(-1).to_numpy()[word]
            there = place >= 0
            sizes = np.bincount(doc[there], minlength=batch.num_rows)
            held = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(place[there], pa.int32()))
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in light], held], names=[*light, "held"])

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by([("key", "ascending"), ("y0", "ascending")])
        held = group["held"].combine_chunks()
        doc = np.repeat(np.arange(len(held)), pc.list_value_length(held).to_numpy())
        y = np.column_stack([group[f"y{i}"].to_numpy() > 0 for i in range(n)])
        chain = fit(names, doc, held.flatten().to_numpy(), y, group["fold"].to_numpy(), chosen)
        return pa.table({"model": pa.array([json.dumps([vars(m) for m in chain])])})

    light = ["key", "fold", *[f"y{i}" for i in range(n)]]
    marked = rows.select("text", *light).mapInArrow(mark, ", ".join(f"{c} long" for c in light) + ", held array<int>")
    got = marked.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(run, "model string").collect()
    drop_staged(counts)
    drop_staged(rows)
    return [Linear(**m) for m in json.loads(got[0]["model"])]


def predict(docs: DataFrame, chain: list[Linear], categories: list[str], text: str = "text") -> DataFrame:
    """doc_id, p_<category> for each category in the chain's order, one row per row of docs.

    Whole texts; a null or empty one has no words and gets the biases. Repeated rows are each predicted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frugal(batches):
            names, doc, word = word_sets(batch.column(1))
            earlier = np.zeros((batch.num_rows, 0))
            for m in chain:
                earlier = np.column_stack([earlier, log_odds(m, names, doc, word, batch.num_rows, earlier)])
            p = 1 / (1 + np.exp(-earlier))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(p[:, i]) for i in range(len(chain))]], names=["doc_id", *[f"p_{c}" for c in categories]])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col(f"`{text}`")).mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"`p_{c}` double" for c in categories))


def classify(docs: DataFrame, labels: DataFrame, categories: list[str], text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """predict() by a chain trained on labels, with is_<category> from probability CUT on."""
    found = predict(docs, train(docs, labels, categories, text, sample), categories, text)
    return found.select("*", *[(F.col(f"`p_{c}`") >= CUT).alias(f"is_{c}") for c in categories])
