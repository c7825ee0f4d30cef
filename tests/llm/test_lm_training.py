"""The recurrent model: learns from every training document, scores as a plain scorer does, and gains on held-out text."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from spanforge.llm import gru, lm, words


def test_both_halves_by_hash_train(spark):
    for half in (0, 1):
        docs = spark.range(40).withColumnRenamed("id", "doc_id").where(F.pmod(F.xxhash64(F.lit("train"), "doc_id"), F.lit(2)) == half).withColumn("text", F.repeat(F.lit("red green blue "), 30))
        assert docs.count()
        vocab = lm.vocabulary(lm.count_words(docs.select("text")))
        got = lm.train(docs, vocab)
        assert not np.array_equal(got, gru.flat(gru.initial(vocab.word_weight, vocab.class_weight)))


def corpus(n, seed=3):
    """Sentences whose next word hangs on the one before."""
    rng = random.Random(seed)
    chain = {f"w{i}": [f"w{(3 * i + k) % 40}" for k in range(3)] for i in range(40)}
    rows = []
    for i in range(n):
        w, text = f"w{rng.randrange(40)}", []
        for _ in range(rng.randrange(20, 60)):
            text.append(w)
            w = rng.choice(chain[w])
        rows.append((i, " ".join(text)))
    return rows


def plain_score(p, vocab, text):
    """log10 of a text's chance, word by word, by the definitions."""
    h, total, prev = np.zeros(gru.WIDTH), 0.0, 0
    place = {w: i for i, w in enumerate(vocab.words)}
    tokens = [w.decode() for w in words.lower_words(text)] + [""]
    w = gru.WIDTH
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    for token in tokens:
        x = p["emb"][prev].astype(float) @ p["wx"] + p["b"]
        g = h @ p["wh"]
        r, z = sigmoid(x[:w] + g[:w]), sigmoid(x[w : 2 * w] + g[w : 2 * w])
        new = np.tanh(x[2 * w :] + r * g[2 * w :])
        h = (1 - z) * new + z * h
        logits = h @ p["wc"] + p["bc"]
        chances = np.exp(logits - logits.max())
        chances /= chances.sum()
        at = place[token]
        if at < gru.SHORT:
            c = at // gru.CLASS_WORDS
            inside = p["ww"][c * gru.CLASS_WORDS : (c + 1) * gru.CLASS_WORDS] @ h + p["bw"][c * gru.CLASS_WORDS : (c + 1) * gru.CLASS_WORDS]
            inside = np.exp(inside - inside.max())
            total += math.log10(chances[c] * inside[at % gru.CLASS_WORDS] / inside.sum())
            prev = at
        else:
            raise AssertionError("the small corpus has no rare words")
    return total


def test_scores_are_a_plain_scorers_and_gain_on_held_out_text(spark):
    rows = corpus(1500)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    training = docs.where(lm.fold(F.col("doc_id")) != lm.HELD_OUT)
    vocab = lm.vocabulary(lm.count_words(training.select("text")))
    weights = gru.unflat(lm.train(training, vocab))
    got = {r["doc_id"]: r for r in lm.score(docs).collect()}
    assert len(got) == len(rows)
    for i, text in rows[:40]:
        assert abs(got[i]["score"] - plain_score(weights, vocab, text)) < 1e-3 * got[i]["n_tokens"]
    held = [i for i, _ in rows if got[i]["held_out"]]
    untrained = gru.initial(vocab.word_weight, vocab.class_weight)
    trained, base = sum(got[i]["score"] for i in held), sum(got[i]["base_score"] for i in held)
    before = sum(plain_score(untrained, vocab, rows[i][1]) for i in held)
    assert len(held) > 200
    assert trained > base + 100 and trained > before + 100


def test_weights_are_averaged_by_tokens_over_any_number_of_rows(spark):
    taught = spark.range(150).repartition(7).select(F.col("id").alias("n"), F.array((F.col("id") * 2).cast("float"), F.lit(1.0).cast("float")).alias("w"))
    want = 2 * sum(i * i for i in range(150)) / sum(range(150))
    for together in (1, 3, 64):
        assert np.allclose(lm.average(taught, np.zeros(2), together), [want, 1.0], rtol=1e-5)
    assert lm.average(taught.limit(0), np.ones(2)).tolist() == [1.0, 1.0]
