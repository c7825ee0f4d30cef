"""The queries opN_<name>: thin digests of the operators over whole tables, and SQL for those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm import attribution, lm, mixing, packing, pii, pivots, quality, rans, simhash, toxicity
from spanforge.runtime import prepare


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and base_sha256 are of the plain spans, spans of all; n_added counts those that the method adds."""
    found = pii.spans(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: ~s["added"])

    def count(kind: str):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(k) for k in pii.KINDS],
        F.sha2(pii.joined(base), 256).alias("base_sha256"),
        pii.joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["added"])).cast("long").alias("n_added"),
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), ids=False)


def op3_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rans.round_trip(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_rejected"
    )


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document: its span in code points, its tokens, and those that cross its ends."""
    return attribution.attribute(_table(spark, sf_dir, "documents")).drop("name")


def op6_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents"))


def op7_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Labels that make the chain, in order.
CATEGORIES = ["quality", "toxic"]


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels table knows one toxicity category; quality precedes it in the chain."""
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), CATEGORIES)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    prepare(spark)
    return corpus_pipeline.run(spark, sf_dir)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan(_table(spark, sf_dir, "documents"))
    size = F.col("__sf_size")
    return planned.select(
        "doc_id", size.alias("size"), F.col("__sf_source_size").alias("source_size"), F.col("__sf_target").alias("target"), (size * F.col("__sf_copies")).alias("taken")
    )


#: The mix in SQL: the same level of filling up, found with the same sums in the same order.
OP10_SQL = r"""
WITH sized AS (
    SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), per AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
        CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight
    FROM sized GROUP BY source
), caps AS (
    SELECT *, CAST(source_size AS DOUBLE) * 2.0::DOUBLE AS cap, CAST(source_size AS DOUBLE) * 2.0::DOUBLE / weight AS fills_at FROM per
), levels AS (
    SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE
            - coalesce(sum(cap) OVER (ORDER BY fills_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
        / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY fills_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS level
    FROM caps
), filled AS (
    SELECT *, coalesce(max(CASE WHEN level <= fills_at THEN level END) OVER (), 0.0::DOUBLE) AS at_level FROM levels
), rates AS (
    SELECT source, source_size, CASE WHEN fills_at <= at_level THEN cap ELSE at_level * weight END AS target FROM filled
), rated AS (
    SELECT *, CASE WHEN source_size > 0 THEN least(target / CAST(source_size AS DOUBLE), 2.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate FROM rates
)
SELECT d.doc_id, d.size, r.source_size, r.target,
    CAST(d.size * (floor(r.rate) + CASE WHEN CAST(CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0::DOUBLE
        < r.rate - floor(r.rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized d JOIN rated r ON d.source IS NOT DISTINCT FROM r.source
"""


def _op4_sql() -> str:
    rules = {"few_words": "n_words < 50", "repeats": "100 * n_repeat_words > 50 * n_words", "symbols": "n_symbols > 0.3::DOUBLE * n_words", "lines": "n_dup_lines > 0.3::DOUBLE * n_lines"}
    sums = ", ".join(f"count(*) FILTER ({c}) AS n_{r}" for r, c in rules.items())
    means = ", ".join(f"sum(n_{r}) / sum(n_docs)::DOUBLE AS m_{r}" for r in rules)
    spread = ", ".join(f"sum(n_docs * pow(n_{r} / n_docs::DOUBLE - m_{r}, 2)) AS q_{r}" for r in rules)
    between = ", ".join(f"(q_{r} - (hosts - 1) * m_{r} * (1 - m_{r})) / greatest(n - sq / n::DOUBLE, 1e-9::DOUBLE) AS v_{r}" for r in rules)
    strength = ", ".join(f"CASE WHEN hosts > 1 AND m_{r} > 0 AND m_{r} < 1 AND v_{r} > 0 THEN least(1e6::DOUBLE, greatest(1.0::DOUBLE, m_{r} * (1 - m_{r}) / v_{r} - 1)) ELSE 1e6::DOUBLE END AS s_{r}" for r in rules)
    bad = " OR ".join(f"(n_{r} + m_{r} * s_{r}) / (n_docs + s_{r}) > 0.5::DOUBLE" for r in rules)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
ws AS (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
w AS (SELECT rid, unnest(ws) AS a, generate_subscripts(ws, 1) AS i FROM ws),
g AS (SELECT rid, i, a, lead(a) OVER (PARTITION BY rid ORDER BY i) AS b, lead(a, 2) OVER (PARTITION BY rid ORDER BY i) AS c FROM w),
twice AS (SELECT rid, a, b, c FROM g WHERE c IS NOT NULL GROUP BY rid, a, b, c HAVING count(*) > 1),
covered AS (SELECT DISTINCT g.rid, g.i + k AS i FROM g JOIN twice USING (rid, a, b, c), (VALUES (0), (1), (2)) AS v(k)),
r AS (SELECT rid, count(*) AS n FROM covered GROUP BY rid),
l AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d),
ls AS (SELECT rid, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
c AS (SELECT d.rid, d.doc_id, d.source, CAST(len(ws.ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(ls.dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, coalesce(ls.n, 0) AS n_lines
    FROM d JOIN ws USING (rid) LEFT JOIN r USING (rid) LEFT JOIN ls USING (rid)),
h AS (SELECT source, count(*) AS n_docs, {sums} FROM c WHERE source IS NOT NULL GROUP BY source),
m AS (SELECT sum(n_docs) AS n, count(*) AS hosts, sum(n_docs * n_docs) AS sq, {means} FROM h),
q AS (SELECT any_value(m) AS m, {spread} FROM h, m),
v AS (SELECT m.*, {", ".join(f"q_{r}" for r in rules)}, {between.replace("hosts", "m.hosts").replace("greatest(n - sq / n", "greatest(m.n - m.sq / m.n").replace(" m_", " m.m_").replace("(1 - m_", "(1 - m.m_")} FROM q),
s AS (SELECT *, {strength} FROM v),
gone AS (SELECT source, {bad} AS gone FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT coalesce(gone, false) AS kept, coalesce(gone, false) AS host_rejected
FROM c LEFT JOIN gone USING (source)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii, op2_packing, op3_rans, op4_quality, op5_token_counts, op6_gru_lm, op7_pivots, op8_simhash, op9_toxicity, op10_mixing, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op4_quality": _op4_sql(), "op10_mixing": OP10_SQL}
