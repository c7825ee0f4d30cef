"""Pairs of end points within a band of distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions.scalars import TAU, bearing, choose_heights, is_open, opposite, sector
from spanforge.params import DEFAULTS, Params


#: Points in a square of the greatest distance from which it is divided by so many each way.
DIVIDED = ((64, 4), (16, 2), (0, 1))


def _offsets(parts: int, low: float, high: float) -> list[tuple[int, int]]:
    """Of cells of side high / parts, those from the centre on (in one half plane) that hold any point within the band of one in the centre."""
    reach = [(i, j) for i in range(parts + 1) for j in range(-parts, parts + 1) if (i, j) >= (0, 0)]
    side = high / parts
    far = [(max(abs(i) - 1, 0) ** 2 + max(abs(j) - 1, 0) ** 2) ** 0.5 * side for i, j in reach]
    wide = [((abs(i) + 1) ** 2 + (abs(j) + 1) ** 2) ** 0.5 * side for i, j in reach]
    # a hair more than the bounds, for rounding in the division
    return [c for c, f, w in zip(reach, far, wide, strict=True) if f <= high * (1 + 1e-9) and w >= low * (1 - 1e-9)]


def band_join(points: DataFrame, low: float, high: float, extra: list[str] | None = None, gates: bool = False, sectors: int = DEFAULTS.sectors) -> DataFrame:
    """Pairs i < j of points (id, e, n) with low <= distance <= high: i, j, d2 and the extra columns as a_*, b_*.

    Each point sits in one cell; the probing copy goes to the cells of one half plane that the band reaches, so the join
    is an equi-join on cells, which meets each two points once, and the distance a residual. Cells have the side `high`,
    or a half or a quarter of it where points are dense (counted): fewer that are out of the band meet. With gates, each
    end must be open (bits of column `open`) toward the other, inside the join, before any pair leaves it.
    """
    extra = [*(extra or []), *(["open"] if gates and "open" not in (extra or []) else [])]
    squares = [F.floor(F.col(c) / F.lit(float(high))) for c in ("e", "n")]
    n, held = points.agg(F.count("*"), F.approx_count_distinct(F.struct(*squares))).first()
    parts = next(k for least, k in DIVIDED if n >= least * max(1, held))
    side = F.lit(float(high) / parts)
    steps = _offsets(parts, low, high)
    cell = [F.floor(F.col(c) / side).cast("long") for c in ("e", "n")]
    names = ["id", "e", "n", *[c for c in extra if c not in ("id", "e", "n")]]
    y = points.select(cell[0].alias("ce"), cell[1].alias("cn"), *[F.col(c).alias(f"y_{c}") for c in names])
    step = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps]))
    x = points.select(*[F.col(c).alias(f"x_{c}") for c in names], cell[0].alias("he"), cell[1].alias("hn"), step.alias("s"))
    x = x.select((F.col("he") + F.col("s.i")).alias("ce"), (F.col("hn") + F.col("s.j")).alias("cn"), ((F.col("s.i") != 0) | (F.col("s.j") != 0)).alias("x_off"), *[f"x_{c}" for c in names])
    de, dn = F.col("y_e") - F.col("x_e"), F.col("y_n") - F.col("x_n")
    d2 = de * de + dn * dn
    near = (x["ce"] == y["ce"]) & (x["cn"] == y["cn"]) & (d2 >= F.lit(float(low) ** 2)) & (d2 <= F.lit(float(high) ** 2))
    # both orders of two points meet in the centre only
    straight = F.col("x_id") < F.col("y_id")
    near = near & (straight | (F.col("x_off") & (F.col("x_id") > F.col("y_id"))))

    def end(which: str, c: str) -> Column:
        first, second = (F.col(f"{q}_{c}") for q in ("xy" if which == "a" else "yx"))
        return F.when(straight, first).otherwise(second)

    if gates:
        # nought added makes no difference of eastings a negative nought, so its sign tells that of the angle, which is taken once
        ahead, up = end("b", "e") - end("a", "e") + F.lit(0.0), end("b", "n") - end("a", "n")
        to_b = F.when(ahead < 0, F.atan2(ahead, up) + F.lit(TAU)).otherwise(F.atan2(ahead, up))
        near = near & is_open(end("a", "open"), sector(to_b, sectors)) & is_open(end("b", "open"), sector(opposite(to_b), sectors))
    joined = x.join(y.hint("merge"), near)
    return joined.select(F.least("x_id", "y_id").alias("i"), F.greatest("x_id", "y_id").alias("j"), d2.alias("d2"), *[end(q, c).alias(f"{q}_{c}") for q in "ab" for c in ("e", "n", *extra)])


def owned(pairs: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Pairs whose first end (lower n, then lower e) lies in the half-open box (min_e, min_n, max_e, max_n)."""
    first = (F.col("a_n") < F.col("b_n")) | ((F.col("a_n") == F.col("b_n")) & (F.col("a_e") <= F.col("b_e")))
    e, n = (F.when(first, F.col(f"a_{c}")).otherwise(F.col(f"b_{c}")) for c in ("e", "n"))
    return pairs.where((e >= box[0]) & (n >= box[1]) & (e < box[2]) & (n < box[3]))


def within_reach(points: DataFrame, box: tuple[float, float, float, float], high: float) -> DataFrame:
    """Points that may be an end of a pair that a box owns: in it, or at most `high` (and a hair) beside or above it."""
    wide = high * (1 + 1e-9)
    return points.where((F.col("e") >= box[0] - wide) & (F.col("e") <= box[2] + wide) & (F.col("n") >= box[1]) & (F.col("n") <= box[3] + wide))


def levelled(pairs: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Pairs with heights that both ends allow (a_lo, a_hi, b_lo, b_hi) within the off-level budget of their length."""
    length = F.sqrt("d2")
    h = choose_heights(F.col("a_lo"), F.col("a_hi"), F.col("b_lo"), F.col("b_hi"), length * p.off_level_ratio)
    return pairs.withColumn("length", length).withColumn("h", h).where("h is not null").select("*", "h.*").drop("h")


def funnel(pairs: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """How many pairs are in range, open toward each other, level enough. pairs carry open masks and height ranges."""
    to_b = bearing(F.col("b_e") - F.col("a_e"), F.col("b_n") - F.col("a_n"))
    faces = is_open(F.col("a_open"), sector(to_b, p.sectors)) & is_open(F.col("b_open"), sector(opposite(to_b), p.sectors))
    h = choose_heights(F.col("a_lo"), F.col("a_hi"), F.col("b_lo"), F.col("b_hi"), F.sqrt("d2") * p.off_level_ratio)
    return pairs.agg(F.count("*").alias("in_range"), F.count_if(faces).alias("facing"), F.count_if(faces & h.isNotNull()).alias("level"))
