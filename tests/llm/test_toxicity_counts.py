"""The words chosen from counts against a plain count over all examples."""

import numpy as np
from pyspark.sql import functions as F

from spanforge.llm import toxicity


def test_telling_words_are_those_of_a_plain_count(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i:02d}x{i}" for i in range(40)]
    texts = [" ".join(w for j, w in enumerate(words) if rng.random() < (0.7 if i % 2 and j < 6 else 0.3)) for i in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(7, None), (8, texts[8])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(3, 0), (400, 1)], "doc_id long, toxic int")
    rows = toxicity.examples(docs, labels, ["toxic"], "text", 1000)
    assert rows.count() == 300 and rows.agg(F.sum("y0")).first()[0] == 150
    counts = toxicity.word_counts(rows, 1)
    sets = [set(t.split()) | {w[: toxicity.BEGINNING] + "*" for w in t.split()} for t in texts]
    folds = {r["doc_id"]: r["fold"] for r in rows.select("doc_id", "fold").collect()}
    for some in ([0, 1, 2], [1, 2]):
        mine = [i for i in range(300) if folds[i] in some]
        y = np.array([i % 2 for i in mine])
        n, pos = len(mine), int(y.sum())
        chi = {}
        for w in set().union(*sets):
            has = np.array([w in sets[i] for i in mine])
            df, a = int(has.sum()), int((has & (y == 1)).sum())
            b, c = df - a, pos - a
            scale = df * (n - df) * pos * (n - pos)
            if scale and df >= toxicity.SEEN and n * (a * (n - pos - b) - b * c) ** 2 / scale >= toxicity.TELLING:
                chi[w] = n * (a * (n - pos - b) - b * c) ** 2 / scale
        want = sorted(chi, key=lambda w: (-chi[w], w))
        got = toxicity.telling(counts, 0, some, n, pos)
        assert len(want) >= 4 and set(got) == set(want) and np.allclose([chi[w] for w in got], [chi[w] for w in want])


def test_one_example_a_document_however_often_it_repeats(spark):
    docs = spark.createDataFrame([(i % 40, "bad awful word" if i % 2 else "good kind word") for i in range(4000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    assert toxicity.examples(docs, labels, ["toxic"], "text", 25).count() == 25
    chain = toxicity.train(docs, labels, ["toxic"])
    assert {"bad", "good"} <= set(chain[0].words)
    assert all((r["p_toxic"] >= 0.5) == bool(r["doc_id"] % 2) for r in toxicity.predict(docs, chain, ["toxic"]).collect())
