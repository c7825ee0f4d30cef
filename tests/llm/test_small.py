"""Each operator against brute force: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_simjoin import kept as one_of_each

from spanforge.llm import attribution, components, gru, lm, mixing, packing, pii, pivots, quality, rans, simhash, tokens, toxicity, words

NAMES = "doc_id long, text string, lang string, source string, n_chars long, n_words long, bucket string, fp string, kept string, u int"


@pytest.fixture(scope="module")
def odd_rows():
    """Nulls in any column, empty and very long texts, copies, near copies, repeated rows."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdeßé") for _ in range(rng.randint(1, 6)))
    base = " ".join(word() for _ in range(80))
    texts = [None, "", " \n\t ", "one", "One two", base, base, base + " tail", base.upper(), "x" * 5000, " ".join(["same"] * 400), "a\nb\na\n\na\n", "end  of  runs   here ", "tab\tand\x0bvt", "é́ ΣΑΣ <|endoftext|> don't", "\n".join(word() + " " + word() for _ in range(3000))]
    rows = [(i, t, "en", ["h1", "h2", None][i % 3], None, 1, "b", "f", "k", 1) for i, t in enumerate(texts)]
    rows.append((None, base, None, None, None, None, None, None, None, None))
    rows.append(rows[5])
    return rows


@pytest.fixture(scope="module")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, NAMES)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], NAMES)


# 1 ------------------------------------------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(t):
    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(t)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(t):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in PHONE.finditer(t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[1], ["email", "ip", "card", "phone"].index(s[0])))


def test_plain_identifiers_match_the_patterns():
    rng = random.Random(2)
    for _ in range(20000):
        t = "".join(rng.choice("a@.1+- 4(é") for _ in range(rng.randint(0, 40)))
        assert pii.plain(t) == plain(t)


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("mail john.doe at example dot com now", "email", "john.doe at example dot com"),
        ("john [at] example [dot] org", "email", "john [at] example [dot] org"),
        ("é jоhn@exаmple.com é", "email", "jоhn@exаmple.com"),
        ("x john@​example.com", "email", "john@​example.com"),
        ("call plus one seven four three five five five three eight two four.", "phone", "plus one seven four three five five five three eight two four"),
        ("４１１１ 1111 1111 1111", "card", "４１１１ 1111 1111 1111"),
        ("ip 192 dot 168 dot 1 dot 1", "ip", "192 dot 168 dot 1 dot 1"),
        ("ip 192[.]168[.]1[.]1!", "ip", "192[.]168[.]1[.]1"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, found):
    assert [(k, text[a:b], x) for k, a, b, x in pii.find(text) if x] == [(kind, found, True)]


def test_clean_text_stays():
    for t in ("meet me at noon. the dot is at the end", "he is at home dot", "un deux trois, soleil", "one two three four five six seven eight nine ten eleven", "5 @ 3.50 each"):
        assert pii.find(t) == [] and pii.mask(t) == t


def test_long_runs_take_linear_time():
    for unit in (" ", "a", "1", "1.", "+1 ", "@", "a@", "( ", "one ", "o1", "a dot "):
        pii.find(unit * (100_000 // len(unit)))


def test_pii_query_and_redaction(spark, odd, none):
    df = spark.createDataFrame([(1, "a b@c.de, 1.2.3.4 x", 19), (2, None, None)], "doc_id long, text string, n_chars long")
    r = pii.spans(df).orderBy("doc_id").select(pii.joined(F.col("spans")).alias("s"), F.sha2(pii.joined(F.filter("spans", lambda s: ~s["added"])), 256).alias("h")).collect()
    assert r[0]["s"] == "email:2:8,ip:10:17" and r[0]["h"] == hashlib.sha256(b"email:2:8,ip:10:17").hexdigest() and r[1]["s"] == ""
    assert [tuple(x) for x in pii.redact(df).orderBy("doc_id").collect()] == [(1, "a <EMAIL>, <IP> x", 17), (2, None, None)]
    assert pii.redact(odd).columns == odd.columns and pii.redact(odd).count() == odd.count() == pii.spans(odd).count()
    assert pii.redact(none).count() == 0


# 2, 3, 5 ------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("name", "blanks"), [(packing.TOKENIZER, True), (rans.TOKENIZER, False)])
def test_cached_ids_are_the_librarys(odd_rows, name, blanks, monkeypatch):
    monkeypatch.setattr(tokens, "CACHED", 50)
    enc = tokens.Encoder(tokens.public(name), blanks)
    texts = [r[1] for r in odd_rows]
    for _ in range(2):
        for group in (texts, texts[::-1]):
            ids, sizes = enc.encode(group)
            want = [enc.tokenizer.encode(t or "", add_special_tokens=False).ids for t in group]
            assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_packing(odd, none, odd_rows):
    got = packing.pack(odd).collect()
    enc = tokens.Encoder(tokens.public(packing.TOKENIZER), True)
    want = Counter()
    for r in odd_rows:
        ids = enc.tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [0]
        first = len(ids) - 2048 * (-(-len(ids) // 2048) - 1)
        for k, (s, n) in enumerate([(0, first)] + [(s, 2048) for s in range(first, len(ids), 2048)]):
            want[(r[0], k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    seqs = {}
    for r in got:
        assert len(r["ids"]) == 2 * r["length"]
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    assert packing.pack(none).count() == 0
    light = packing.pack(odd, ids=False)
    assert "ids" not in light.columns
    assert sorted(map(str, light.collect())) == sorted(str(r) for r in packing.pack(odd).drop("ids").collect())


def test_sum_of_squares_places_by_its_rule():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 40, 300)
    bins, offsets = packing.sum_of_squares(lengths, 40)
    level, count = {}, Counter()
    for i in np.argsort(-lengths, kind="stable"):
        s = int(lengths[i])

        def cost(h, s=s):
            c = count.copy()
            c[h] -= h > 0
            c[h + s] += h + s < 40
            return sum(v * v for k, v in c.items() if 0 < k < 40)

        options = [0] + [h for h, v in count.items() if v > 0 and 0 < h and h + s <= 40]
        assert cost(int(offsets[i])) == min(map(cost, options))
        assert level.get(int(bins[i]), 0) == offsets[i]
        count[int(offsets[i])] -= offsets[i] > 0
        level[int(bins[i])] = int(offsets[i]) + s
        count[int(offsets[i]) + s] += 1
    assert len(level) <= lengths.sum() / 40 * 1.1


def test_rans_blocks_round_trip_and_notice_damage():
    rng = np.random.default_rng(1)
    for n in (0, 1, 63, 5000, 300_000):
        ids = (rng.zipf(1.3, n) % 5000).astype(np.uint32)
        t = rans.table(dict(Counter(ids.tolist())) or {3: 1})
        assert t.freq.sum() == 1 << t.bits
        data = rans.encode_block(ids, [None, 5], [n, 0], t, 256, 64)
        block = rans.Block(data, t)
        assert block.doc_ids == [None, 5] and np.array_equal(block.decode(), ids)
        if n > 1000:
            for a, b in ((0, 10), (n // 2, n // 2 + 777), (n - 5, n)):
                assert np.array_equal(block.decode(a, b), ids[a:b])
            assert len(block.marks) > 1
        for k in (0, len(data) // 2, len(data) - 1):
            with pytest.raises(ValueError, match="block"):
                rans.Block(data[:k] + bytes([data[k] ^ 1]) + data[k + 1 :], t)


def test_rans_files(odd, none, odd_rows):
    got = rans.round_trip(odd).collect()
    enc = tokens.Encoder(tokens.public(rans.TOKENIZER), False)
    ids = [(r[0], enc.tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [1]) for r in odd_rows]
    assert Counter((r["doc_id"], r["ids"] and bytes(r["ids"])) for r in got) == Counter((i, np.array(x, "<u4").tobytes()) for i, x in ids)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    in_order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert in_order == sorted(in_order, key=lambda i: -1 if i is None else i)
    assert rans.round_trip(none).count() == 0
    named = rans.round_trip(odd.withColumn("doc_id", F.concat(F.lit("é"), "doc_id"))).collect()
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in named) == Counter((None if i is None else f"é{i}", np.array(x, "<u4").tobytes()) for i, x in ids)


@pytest.mark.parametrize("rule", attribution.RULES)
def test_attribution(spark, odd, none, odd_rows, rule):
    enc = tokens.Encoder(tokens.public(attribution.TOKENIZER), True).tokenizer
    got = {}
    for r in attribution.attribute(odd.where("doc_id is not null").dropDuplicates(["doc_id"]), rule).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for r in {x[0]: x for x in odd_rows if x[0] is not None}.values():
        text = r[1] or ""
        lines, at, want = text.split("\n"), 0, []
        for line in lines:
            want.append((at, min(len(text), at + len(line) + 1)))
            at += len(line) + 1
        rows = sorted(got[r[0]], key=lambda x: x["section"])
        assert [(x["start"], x["end"]) for x in rows] == want
        n = len(enc.encode(text, add_special_tokens=False).ids)
        assert sum(x["n_tokens"] for x in rows) == n and {x["doc_tokens"] for x in rows} == {n}
    spans = spark.createDataFrame([(1, "Hello wonderful world", [("a", 0, 8), ("b", 8, 99), ("c", 3, 3)])], "doc_id long, text string, sections array<struct<name:string,start:long,end:long>>")
    e = enc.encode("Hello wonderful world", add_special_tokens=False)
    where = {"first": lambda a, b: a, "middle": lambda a, b: (a + b - 1) // 2, "last": lambda a, b: b - 1}[rule]
    parts = {r["name"]: r for r in attribution.attribute(spans, rule, "sections").collect()}
    for name, a, b in (("a", 0, 8), ("b", 8, 21), ("c", 3, 3)):
        mine = [o for o in e.offsets if a <= where(*o) < b]
        assert parts[name]["n_tokens"] == len(mine) and parts[name]["n_crossing"] == sum(o[0] < a or o[1] > b for o in mine)
    assert attribution.attribute(none).count() == 0


# 4 ------------------------------------------------------------------------------------------------


def test_quality_counts(odd, none, odd_rows):
    got = quality.verdicts(odd).collect()
    assert len(got) == len(odd_rows) and quality.verdicts(none).count() == 0 and quality.keep(none).count() == 0
    want = Counter()
    for r in odd_rows:
        t = r[1] or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        held = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search("[^\x20\x09-\x0d]", line):
                dup += line in seen
                seen.add(line)
        failed = len(w) < 50 or 100 * len(held) > 50 * len(w)
        want[(r[0], len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(held), failed)] += 1
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got) == want
    assert quality.keep(odd).columns == odd.columns


def test_bad_hosts_go_and_small_ones_are_shrunk(spark):
    good, bad = " ".join(f"w{i}" for i in range(60)), "too short"
    rows = [(i, good if i % 10 else bad, f"good{i % 9}") for i in range(900)]
    rows += [(1000 + i, bad if i % 20 else good, "bad") for i in range(200)]
    rows += [(2000, bad, "tiny"), (2001, good, "tiny")]
    got = {r["doc_id"]: r for r in quality.verdicts(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i]["host_rejected"] for i in range(1000, 1200)) and not got[1000]["kept"]
    assert not any(got[i]["host_rejected"] for i in range(900)) and got[1]["kept"] and got[2001]["kept"]


# 6 ------------------------------------------------------------------------------------------------


def test_gradients_and_lanes():
    rng = np.random.default_rng(0)
    p = gru.initial(rng.random(1500) * 100 + 1, rng.random(gru.CLASSES + gru.RARE) + 0.1)
    p = {k: v.astype(np.float64) + rng.normal(0, 0.1, v.shape) for k, v in p.items()}
    prev, want = rng.integers(0, 2080, (5, 3)), rng.integers(0, 2080, (5, 3))
    want[want < gru.SHORT] %= 1500
    fresh, there, h = rng.random((5, 3)) < 0.3, rng.random((5, 3)) < 0.9, rng.normal(0, 0.3, (3, gru.WIDTH))
    _, g, _ = gru.gradients(p, prev, fresh, want, there, h)
    for k, i in (("emb", (prev[1, 1], 3)), ("wx", (2, 20)), ("wh", (3, 40)), ("b", (5,)), ("wc", (1, 7)), ("bc", (9,))):
        old, ends = p[k][i], []
        for e in (1e-3, -1e-3):
            p[k][i] = old + e
            ends.append(gru.gradients(p, prev, fresh, want, there, h)[0])
        p[k][i] = old
        assert g[k][i] == pytest.approx((ends[0] - ends[1]) / 2e-3, rel=0.02, abs=1e-5)
    sizes = np.array([3, 40, 1, 7, 100])
    symbols = rng.integers(0, 2080, sizes.sum())
    symbols[symbols < gru.SHORT] %= 1500
    q = {k: v.astype(np.float32) for k, v in p.items()}
    together = gru.score(q, symbols, sizes, 0)
    at = np.cumsum(sizes) - sizes
    alone = np.concatenate([gru.score(q, symbols[a : a + n], np.array([n]), 0) for a, n in zip(at, sizes, strict=True)])
    assert np.allclose(together, alone, atol=1e-4)


def test_word_probabilities_sum_to_one():
    rng = np.random.default_rng(3)
    p = gru.initial(rng.random(gru.SHORT) + 0.1, rng.random(gru.CLASSES + gru.RARE) + 0.1)
    h = np.repeat(rng.normal(0, 1, (1, gru.WIDTH)).astype(np.float32), gru.SHORT + gru.RARE, 0)
    assert np.exp(gru.token_log(p, h, np.arange(gru.SHORT + gru.RARE))).sum() == pytest.approx(1, abs=1e-4)


@pytest.mark.parametrize("head", [5, 100_000])
def test_language_model(odd, none, odd_rows, head):
    got = lm.score(odd, head=head).collect()
    lower = lambda t: [w.lower() if w.isascii() else w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in re.findall("[^\x20\x09-\x0d]+", t or "")] + [None]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    c = Counter(w for r in odd_rows if not held(r[0]) for w in lower(r[1]))
    n, d = sum(c.values()), sum(c.values()) + 0.5 * (len(c) + 1)
    want = sorted((str(r[0]), held(r[0]), len(lower(r[1])), sum(c[w] > 0 for w in lower(r[1])), n, round(sum(math.log10((c[w] + 0.5) / d) for w in lower(r[1])), 6)) for r in odd_rows)
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert lm.score(none).count() == 0


# 7, 8 ---------------------------------------------------------------------------------------------


def closure(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("few", [components.FEW, 5])
def test_components(spark, few):
    rng = random.Random(6)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(500, x) for x in range(501, 700)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long").repartition(5), few).collect()}
    want = closure(700, links)
    assert got == {x: want[x] for pair in links for x in pair if any(a != b and x in (a, b) for a, b in links)}
    assert components.components(spark.createDataFrame([], "a long, b long"), few).count() == 0


@pytest.mark.parametrize("block", [1024, 7])
def test_pivots(spark, block):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    rows = []
    for i in range(260):
        v = centres[i % 12] + rng.normal(0, 0.05 if i % 2 else 0.4, 16)
        rows.append((i, v.astype(np.float32).tolist(), i % 2))
    rows += [(300 + i, rows[0][1], 0) for i in range(20)]
    rows += [(400, None, 1), (401, [0.0] * 16, 1), (402, [1.0, None] * 8, 1), (403, [math.nan] * 16, 1), (404, rows[0][1], None), (405, [], 0), (406, [1.0, 2.0], 0), (None, rows[1][1], 1), rows[3], (407, [1e200] * 16, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = pivots.near_duplicates(df, block=block).collect()
    ok = [r[1] is not None and len(r[1]) > 0 and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1]) and r[2] is not None for r in rows]
    unit = [np.array(r[1]) / np.abs(r[1]).max() if o else None for r, o in zip(rows, ok, strict=True)]
    unit = [None if x is None else x / np.sqrt((x * x).sum()) for x in unit]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98]
    degree = Counter(x for p in links for x in p)
    root = closure(len(rows), links)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[root[i]] = min(low.get(root[i], 1 << 60), r[0])
    want = Counter((r[0], degree[i], low[root[i]], r[0] == low[root[i]]) for i, r in enumerate(rows))
    assert Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == want
    assert pivots.near_duplicates(df.limit(0)).count() == 0


def fingerprint(text):
    import xxhash

    w = words.lower_words(text)
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("hot", [4096, 1])
def test_simhash(spark, odd, none, odd_rows, hot):
    got = simhash.near_duplicates(odd, hot=hot).collect()
    prints = [fingerprint(r[1]) for r in odd_rows]
    links = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    root = closure(len(prints), links)
    low = {}
    for i, r in enumerate(odd_rows):
        if r[0] is not None:
            low[root[i]] = min(low.get(root[i], 1 << 60), r[0])
    want = Counter((r[0], prints[i], low[root[i]]) for i, r in enumerate(odd_rows))
    assert Counter((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in got) == want
    assert simhash.near_duplicates(none).count() == 0


def test_variants_miss_no_pair(spark):
    rng = random.Random(9)
    prints = [rng.getrandbits(64) for _ in range(40)]
    for p in list(prints):
        for _ in range(6):
            q = p
            for b in rng.sample(range(64), rng.randint(1, 3)):
                q ^= 1 << b
            prints.append(q)
    signed = sorted({p - (1 << 64) if p >> 63 else p for p in prints})
    want = closure(len(signed), [(i, j) for i in range(len(signed)) for j in range(i) if ((signed[i] ^ signed[j]) & (1 << 64) - 1).bit_count() <= 2])
    df = spark.createDataFrame([(i, p) for i, p in enumerate(signed)], "doc_id long, fp long")
    for hot in (4096, 1):
        got = {r["fp"]: r["component_id"] for r in simhash.classes(df, hot).collect()}
        assert [got[p] for p in signed] == want


# 9 ------------------------------------------------------------------------------------------------


def test_chain_learns_and_uses_earlier_categories(spark, none):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(900):
        rude, threat = rng.random() < 0.3, rng.random() < 0.15
        w = [f"word{rng.randrange(300)}" for _ in range(40)] + (["scum!"] if rude else []) + (["perish"] if threat else [])
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
        if i % 2:
            labels.append((i, int(rude), int(rude or threat)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(1, None, 1), (5000, 1, 1)], "doc_id long, rude int, toxic int")
    chain = toxicity.train(docs, known, ["rude", "toxic"])
    assert chain[1].chain[0] > 0
    for r in toxicity.predict(docs, chain, ["rude", "toxic"]).collect():
        w = rows[r["doc_id"]][1]
        assert (r["p_rude"] >= 0.5) == ("scum" in w) and (r["p_toxic"] >= 0.5) == ("scum" in w or "perish" in w)
    odd = spark.createDataFrame([(None, None), (1, ""), (1, "")], "doc_id long, text string")
    assert toxicity.classify(odd, known, ["rude"]).count() == 3 and toxicity.classify(none, known, ["rude"]).count() == 0
    assert toxicity.classify(odd, known.limit(0), ["rude"]).count() == 3


# 10 -----------------------------------------------------------------------------------------------


def test_mix(spark, odd, none):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), ["a", "b", "c", "d", None, "tiny"][min(5, i % 6 if i % 40 else 5)]) for i in range(3000)]
    rows += [(9000 + i, "w " * 400, "whale") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    planned = mixing.plan(df).collect()
    size = Counter()
    for _, t, s in rows:
        size[s] += len(t.split())
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, budget = {}, 1.5 * sum(size.values())
    left = set(names)
    while left:
        level = (budget - sum(target.values())) / sum(weight[s] for s in left)
        full = {s for s in left if level * weight[s] > 2 * size[s]}
        target |= {s: 2.0 * size[s] for s in full} if full else {s: level * weight[s] for s in left}
        left = left - full if full else set()
    taken = Counter()
    for r in planned:
        assert r["__sf_target"] == pytest.approx(target[r["source"]]) and r["__sf_source_size"] == size[r["source"]] and 0 <= r["__sf_copies"] <= 2
        taken[r["source"]] += r["__sf_size"] * r["__sf_copies"]
    for s in names:
        assert taken[s] == pytest.approx(target[s], rel=0.25, abs=800)
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and Counter(r["doc_id"] for r in mixed.collect()) == Counter({r["doc_id"]: r["__sf_copies"] for r in planned if r["__sf_copies"]})
    assert mixing.mix(odd).columns == odd.columns and mixing.plan(odd).count() == odd.count() and mixing.mix(none).count() == 0


def test_pipeline(spark):
    from pathlib import Path

    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    if not Path(sf).is_dir():
        pytest.skip("the driver's tables are not here")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.STAGES[0][1](spark, docs, sf)
    want = {r["doc_id"] for r in quality.verdicts(docs).where("kept").collect()}
    assert {r["doc_id"] for r in kept.collect()} == want and kept.columns == docs.columns
    one = corpus_pipeline.STAGES[1][1](spark, kept, sf)
    rows = kept.collect()
    assert sorted((False, r["doc_id"]) for r in one.collect()) == one_of_each([r["text"] for r in rows], [r["doc_id"] for r in rows])
    clean = corpus_pipeline.STAGES[2][1](spark, one, sf)
    assert all(not pii.plain(r["text"]) or "<" in r["text"] for r in clean.collect())
    packed = corpus_pipeline.run(spark, sf).collect()
    mixed = corpus_pipeline.STAGES[3][1](spark, clean, sf)
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == Counter(r["doc_id"] for r in mixed.collect())
