"""What a run did, as text: a row a stage with its time and what flowed through it."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from spanforge.functions.maps import compact, flow, share

#: Share of a stage's time from which what no phase covers is a row of its own.
REST = 0.02


def phase_rows(cpu: float, wall: float, phases: Iterable[tuple[str, float]]) -> list[tuple[str, float]]:
    """Phases timed by the clock as processor seconds of their stage, longest first, with what none of them covers."""
    rate = min(1.0, cpu / wall) if wall > 0 else 1.0
    rows = [(name, seconds * rate) for name, seconds in phases]
    rest = cpu - sum(s for _, s in rows)
    if rows and rest > cpu * REST:
        rows.append(("other", rest))
    return sorted(rows, key=lambda r: -r[1])


def render(spark: SparkSession, stages: list[tuple[str, float, int | None, int | None]]) -> str:
    """A table of stages (name, seconds, rows in, rows out) in their order, with shares of the time and of the rows."""
    total = sum(s[1] for s in stages)
    rows = spark.createDataFrame([(k, *s) for k, s in enumerate(stages)], "k int, stage string, seconds double, came long, left long").orderBy("k")
    texts = [F.col("stage"), F.format_string("%.1fs", "seconds"), share(F.col("seconds"), F.lit(total)), compact(F.col("came")), compact(F.col("left")), flow(F.col("left"), F.col("came"))]
    lines = [("stage", "time", "share", "in", "out", "kept"), *[tuple(r) for r in rows.select(*[F.coalesce(t, F.lit("")).alias(str(i)) for i, t in enumerate(texts)]).collect()], ("total", f"{total:.1f}s", "", "", "", "")]
    wide = [max(len(r[i]) for r in lines) for i in range(len(texts))]
    return "\n".join("  ".join(c.ljust(w) if i == 0 else c.rjust(w) for i, (c, w) in enumerate(zip(r, wide, strict=True))).rstrip() for r in lines)
