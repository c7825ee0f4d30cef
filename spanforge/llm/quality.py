"""Quality rules of documents, and of the hosts (domains) that they come from.

Each document gets counts and a set of rule failures. Failures are summed by host, each rule's rate is
shrunk towards the corpus with an empirical beta prior, and a host whose shrunk rate is too high for any
rule is rejected with all of its documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.llm import words
from spanforge.runtime import attach, stage

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: A document needs so many words, and at most so many hundredths of them in repeated windows.
LEAST_WORDS = 50
REPEATED_PERCENT = 50
#: Further rules, for hosts alone: symbols a word, and share of lines that repeat an earlier one.
SYMBOLS_A_WORD = 0.3
REPEATED_LINES = 0.3
#: A host goes when the shrunk failure rate of any rule is above this.
HOST_RATE = 0.5
RULES = ("few_words", "repeats", "symbols", "lines")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def repeated_words(found: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more, the first included."""
    if len(found) < 4:
        return 0
    windows = list(zip(found, found[1:], found[2:], strict=False))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    total, until = 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            total += i + 3 - max(i, until)
            until = i + 3
    return total


def repeated_lines(text: str) -> tuple[int, int]:
    """Lines (cut at \\n) with a word that equal an earlier line, and all lines with a word."""
    lines = [x for x in text.split("\n") if x.strip(words.SEPARATORS)]
    return len(lines) - len(set(lines)), len(lines)


def counts(text: str) -> tuple[int, ...]:
    """COUNTS of one whole text."""
    found = words.split(text)
    dup, lines = repeated_lines(text)
    return (
        len(found),
        len(text) - sum(map(text.count, words.SEPARATORS)),
        sum(map(text.count, SYMBOLS)),
        dup,
        repeated_words(found),
        lines,
    )


def _count(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    for batch in words.frugal(batches):
        rows = [counts(x) for x in words.strings(batch.column(text))]
        columns = list(zip(*rows, strict=True)) or [()] * len(COUNTS)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, *[pa.array(c, pa.int64()) for c in columns]], names=[*batch.schema.names, *[f"__sf_{c}" for c in COUNTS]]
        )


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a column __sf_<count> for each of COUNTS. Null texts count as empty."""
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"__sf_{c} long" for c in COUNTS])
    return docs.mapInArrow(lambda it: _count(it, text), schema)


def base_failed(n_words: Column, n_repeat: Column) -> Column:
    return (n_words < LEAST_WORDS) | (100 * n_repeat > REPEATED_PERCENT * n_words)


def failures() -> dict[str, Column]:
    """Each rule as a condition on the counts; a document without words or lines fails few_words alone."""
    c = {k: F.col(f"__sf_{k}") for k in COUNTS}
    return {
        "few_words": c["n_words"] < LEAST_WORDS,
        "repeats": 100 * c["n_repeat_words"] > REPEATED_PERCENT * c["n_words"],
        "symbols": c["n_symbols"] > SYMBOLS_A_WORD * c["n_words"],
        "lines": c["n_dup_lines"] > REPEATED_LINES * c["n_lines"],
    }


def host_rates(counted: DataFrame, host: str = "source") -> DataFrame:
    """A row for each host: documents, and for each rule failures and the shrunk rate; rejected where any is too high.

    The prior of a rule is Beta(m s, (1 - m) s): m is the corpus's rate, and s comes from the variance of
    the hosts' rates less what chance alone would give them (weighted by documents, method of moments).
    Where hosts differ no more than by chance, s is large and every host gets the corpus's rate. Null is
    no host. Sums are taken in each task first, so a hot host costs one row a task.
    """
    per = counted.where(F.col(f"`{host}`").isNotNull()).groupBy(F.col(f"`{host}`").alias("host"))
    per = stage(per.agg(F.count("*").alias("n_docs"), *[F.sum(bad.cast("long")).alias(f"n_{r}") for r, bad in failures().items()]), "hosts")
    first = per.agg(F.sum("n_docs"), F.count("*"), F.sum(F.col("n_docs") * F.col("n_docs")), *[F.sum(f"n_{r}") for r in RULES]).first()
    n, hosts, square = first[0] or 0, first[1], first[2] or 0
    means = {r: (first[3 + i] or 0) / n if n else 0.0 for i, r in enumerate(RULES)}
    spread = per.agg(*[F.sum(F.col("n_docs") * F.pow(F.col(f"n_{r}") / F.col("n_docs") - m, 2)) for r, m in means.items()]).first()
    out, bad = per, F.lit(False)
    for i, (r, m) in enumerate(means.items()):
        s = 1e6
        if hosts > 1 and 0 < m < 1:
            # E[sum n_i (p_i - m)^2] = (hosts - 1) m (1 - m) by chance, and (n - sum n_i^2 / n) of the variance between hosts on top
            between = (spread[i] - (hosts - 1) * m * (1 - m)) / max(n - square / n, 1e-9)
            s = min(1e6, max(1.0, m * (1 - m) / between - 1)) if between > 0 else 1e6
        rate = (F.col(f"n_{r}") + F.lit(m * s)) / (F.col("n_docs") + F.lit(float(s)))
        out = out.withColumn(f"rate_{r}", rate)
        bad = bad | (F.col(f"rate_{r}") > HOST_RATE)
    return out.withColumn("rejected", bad)


def verdicts(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """doc_id, the counts, base_failed, host_rejected and kept, one row per row of docs.

    A null or empty text has no words and fails; a null host is judged by its document alone; repeated
    rows are each judged; an empty table gives an empty result. The counts are staged without the texts, so
    the texts are read once.
    """
    light = docs.select("doc_id", F.col(f"`{host}`").alias("host"), F.col(f"`{text}`").alias("text"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, host {docs.schema[host].dataType.simpleString()}, " + ", ".join(f"__sf_{c} long" for c in COUNTS)
    counted = stage(light.mapInArrow(lambda it: (b.drop_columns(["text"]) for b in _count(it, "text")), schema), "counts")
    bad_hosts = stage(host_rates(counted, "host").where("rejected").select("host", F.lit(True).alias("host_rejected")), "bad-hosts")
    out = attach(counted, bad_hosts, ["host"]).withColumn("host_rejected", F.coalesce("host_rejected", F.lit(False)) & F.col("host").isNotNull())
    failed = base_failed(F.col("__sf_n_words"), F.col("__sf_n_repeat_words"))
    return out.select(
        "doc_id", *[F.col(f"__sf_{c}").alias(c) for c in COUNTS], failed.alias("base_failed"), "host_rejected", (~failed & ~F.col("host_rejected")).alias("kept")
    )


def keep(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """The documents that the rules keep, with their columns, whatever these are called.

    What holds for nulls, empty texts and repeated rows is as in `verdicts`; texts of any length are taken
    whole; an empty table gives an empty one. Counted documents are staged, as both the hosts and the filter
    need them.
    """
    counted = stage(with_counts(docs, text), "counted-docs")
    bad_hosts = stage(host_rates(counted, host).where("rejected").select("host", F.lit(True).alias("__sf_bad")), "bad-hosts")
    out = counted.where(~base_failed(F.col("__sf_n_words"), F.col("__sf_n_repeat_words"))).withColumn("__sf_on", F.col(f"`{host}`"))
    out = attach(out, bad_hosts.withColumnRenamed("host", "__sf_on"), ["__sf_on"])
    return out.where(F.col("__sf_bad").isNull()).select(*[F.col(f"`{c}`") for c in docs.columns])
