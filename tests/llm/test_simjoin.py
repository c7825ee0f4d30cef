"""SimHash near-duplicates at a Jaccard similarity, against brute force."""

import random
from pathlib import Path

import numpy as np
import pytest

from spanforge.llm import simjoin, words

NAMES = "doc_id long, text string, n_chars long"


def shingle_set(text):
    w = words.lower_words(text)
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar(a, b):
    return not a and not b or 5 * len(a & b) >= 4 * len(a | b)


def kept(texts, ids):
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(sets)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if similar(sets[i], sets[j]):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    low = {}
    for i in range(len(sets)):
        low[top(i)] = min(low.get(top(i), (True, 0)), (ids[i] is None, ids[i] or 0))
    return sorted(low.values())


@pytest.mark.parametrize(("hot", "short", "block"), [(simjoin.HOT, simjoin.SHORT, simjoin.BLOCK), (3, 2, 500)])
def test_near_copies_are_found(spark, hot, short, block):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = [None, "", " \n", "one", "One two", "a b c d e f g h", "a b c d e f g h i"]
    for size in (40, 120, 400):
        for _ in range(6):
            base = [word() for _ in range(size)]
            texts.append(" ".join(base))
            for edits in range(1, 12):
                copy = list(base)
                for i in rng.sample(range(size), max(1, edits * size // 300)):
                    copy[i] = word()
                texts.append(" ".join(copy))
    line = " ".join(word() for _ in range(20))
    texts += [f"{line} {' '.join(word() for _ in range(12))}" for _ in range(60)]  # a common line is no near copy
    base = [word() for _ in range(60)]
    for _ in range(80):  # a group whose members are like their neighbours, not like all
        base[rng.randrange(60)] = word()
        texts.append(" ".join(base))
    ids = [None if i % 50 == 9 else 1000 - i for i in range(len(texts))]
    df = spark.createDataFrame([(i, t, 1) for i, t in zip(ids, texts, strict=True)], NAMES)
    got = simjoin.keep_one(df, hot=hot, short=short, block=block)
    assert got.columns == df.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got.collect()) == kept(texts, ids)


def test_the_stage_drops_near_copies(spark):
    import corpus_pipeline

    rng = random.Random(6)
    base = [f"w{rng.randrange(10**6)}" for _ in range(100)]
    copy = [*base[:50], "changed", *base[51:]]
    df = spark.createDataFrame([(2, " ".join(base), 1), (1, " ".join(copy), 1), (3, "something else", 1)], NAMES)
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, "").collect()) == [1, 3]


def test_odd_rows(spark):
    rows = [(None, None, 1), (None, "", 2), ("b", " \t", 3), ("a", "x " * 30000, 4), ("a", "x " * 30000, 4), ("c", "X " * 30000, 5), ("d", "one two", 6)]
    df = spark.createDataFrame(rows, "doc_id string, text string, `__sf_fp` int").toDF("doc_id", "text", "__sf_fp").selectExpr("*", "1 AS segments", "2 AS `n`")
    got = simjoin.keep_one(df)
    assert got.columns == df.columns
    assert sorted((r["doc_id"], r["__sf_fp"]) for r in got.collect()) == [("a", 4), ("b", 3), ("d", 6)]
    assert simjoin.keep_one(df.limit(0)).count() == 0


def test_segments_follow_the_number_of_documents():
    assert simjoin.segments(0) == simjoin.segments(200_000) == (20, 25)
    assert simjoin.segments(12_000_000)[0] == 26
    assert simjoin.segments(1 << 40)[0] == simjoin.MOST_BITS


def test_pairs_at_the_least_similarity_share_a_variant():
    """Measured on random sets at a similarity of exactly 0.8: at least 0.98 of the pairs are candidates, and so of the sketch."""
    rng = np.random.default_rng(1)
    bits, count = simjoin.segments(1000)
    met = close = 0
    for k in range(300):
        n = (9, 45, 180)[k % 3]
        common, a, b = (rng.integers(0, 1 << 63, m, np.uint64) for m in (8 * n // 9, n // 9, n // 9))
        one, two = (simjoin.fingerprint(np.unique(np.concatenate([common, x])), bits * count + simjoin.SKETCH) for x in (a, b))
        apart = one != two
        met += bool((apart[: bits * count].reshape(count, bits).sum(1) <= 1).any())
        close += int(apart[-simjoin.SKETCH :].sum()) <= simjoin.APART
    assert met >= 0.98 * 300 and close >= 0.99 * 300


def test_the_drivers_documents_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    if not Path(sf).is_dir():
        pytest.skip("the driver's tables are not here")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = kept([r["text"] for r in rows], [r["doc_id"] for r in rows])
    assert sorted((False, r["doc_id"]) for r in simjoin.keep_one(docs).collect()) == want
