"""Measuring pairs as lines: evaluation in stages, the search, refinement, and plans for lines that somebody draws."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions.scalars import bearing, choose_heights, clearance_needed, ground_distance, half_up, line_height, line_kind, rig_cost, rig_max
from spanforge.operators import pairs, profile, raster, select, ways
from spanforge.params import DEFAULTS, Params
from spanforge.runtime import stage

CROSSINGS = profile.NO_CROSSINGS


@dataclass(frozen=True)
class Scene:
    """Layers as tables. A layer that is absent is read strictly: no roofs, no water, no traffic, canopy as the ground."""

    ground: DataFrame
    surface: DataFrame | None = None
    roofs: DataFrame | None = None
    water: DataFrame | None = None
    ways: DataFrame | None = None


def _flag(rows: DataFrame, cells: DataFrame | None, e: str, n: str, name: str) -> DataFrame:
    if cells is None:
        return rows.withColumn(name, F.lit(False))
    mask = cells.select("cx", "cy", F.lit(True).alias(name)).distinct()
    keyed = rows.withColumn("cx", F.floor(e)).withColumn("cy", F.floor(n))
    return keyed.join(mask, ["cx", "cy"], "left").withColumn(name, F.coalesce(name, F.lit(False))).drop("cx", "cy")


def ends(spans: DataFrame, scene: Scene) -> DataFrame:
    """spans with ground and roof at both ends, by the cell that each lies in."""
    out = spans
    for k in "ab":
        cells = scene.ground.select("cx", "cy", F.col("z").alias(f"g{k}"))
        out = _flag(raster.nearest(out, cells, f"{k}e", f"{k}n"), scene.roofs, f"{k}e", f"{k}n", f"roof_{k}")
    return out


def _walk(lines: DataFrame, scene: Scene, p: Params) -> DataFrame:
    """Ids of lines whose centre clears the ground every p.profile_step metres: no gap in the data, clear beyond the
    anchor zones (by less over water), and deep enough somewhere."""
    d = F.explode(F.transform(F.sequence(F.lit(0), F.floor(F.col("span") / p.profile_step).cast("int")), lambda i: i * F.lit(p.profile_step)))
    at = lines.select("id", "ae", "an", "be", "bn", "span", "ha", "hb", d.alias("d")).withColumn("t", F.col("d") / F.col("span"))
    at = at.withColumn("e", F.col("ae") + (F.col("be") - F.col("ae")) * F.col("t")).withColumn("n", F.col("an") + (F.col("bn") - F.col("an")) * F.col("t"))
    at = _flag(raster.bilinear(at, scene.ground, ["id", "d"], name="g"), scene.water, "e", "n", "wet")
    clear = line_height(F.col("ha"), F.col("hb"), F.col("span") * p.sag_ratio, F.col("t")) - F.col("g")
    inner = F.col("d").between(F.lit(p.anchor_zone), F.col("span") - p.anchor_zone)
    ok = F.col("g").isNotNull() & (~inner | (clear >= clearance_needed(F.col("wet"), p)))
    return at.groupBy("id").agg(F.every(ok).alias("ok"), F.max(clear).alias("exposure")).where(F.col("ok") & (F.col("exposure") >= p.min_exposure)).select("id")


def _ground_series(lines: DataFrame, scene: Scene, p: Params) -> DataFrame:
    """(id, ground, ground_max, needed): bilinear on the line, the highest cell across the band, what each station owes."""
    stations = profile.stations(lines.select("id", "ae", "an", "be", "bn"), p)
    centre = raster.bilinear(stations.select("id", "i", "e", "n"), scene.ground, ["id", "i"], name="g").select("id", "i", "g")
    across = _flag(raster.nearest(profile.band_points(stations, p), scene.ground, "pe", "pn"), scene.water, "pe", "pn", "wet")
    band = across.groupBy("id", "i").agg(F.max(F.when(F.col("k") != 0, F.col("z"))).alias("side"), F.every("wet").alias("wet"))
    rows = centre.join(band, ["id", "i"]).select(
        "id", "i", half_up(F.col("g"), 2).alias("g"), half_up(F.when(F.col("g").isNotNull(), F.greatest("g", "side")), 2).alias("m"), clearance_needed(F.col("wet"), p).alias("need")
    )
    series = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("i", "g", "m", "need"))).alias("s"))
    return series.select("id", F.col("s.g").alias("ground"), F.col("s.m").alias("ground_max"), F.col("s.need").alias("needed"))


def _surface_series(lines: DataFrame, scene: Scene, p: Params) -> DataFrame:
    """(id, surface): canopy on the line, never below the ground; unknown or nought falls back to the ground."""
    if scene.surface is None:
        return lines.select("id", F.col("ground").alias("surface"))
    stations = profile.stations(lines.select("id", "ae", "an", "be", "bn"), p)
    tops = raster.bilinear(stations.select("id", "i", "e", "n"), scene.surface, ["id", "i"], name="s")
    rows = tops.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("i", "s"))).alias("tops"))
    both = lines.select("id", "ground").join(rows, "id")
    return both.select("id", F.zip_with("ground", "tops", lambda g, s: half_up(F.greatest(g, F.when(s["s"] != 0, s["s"])), 2)).alias("surface"))


def evaluate(spans: DataFrame, scene: Scene, p: Params = DEFAULTS) -> DataFrame:
    """Each span (id, ae, an, be, bn) measured: reject (the first stage that refuses it, null for a candidate), and the
    candidate's figures. Dear layers are only read for what cheaper stages leave: heights, then the ground along the
    line, the band, ways, canopy. Stages are staged, so a lost executor repeats one of them."""
    e, n = F.col("be") - F.col("ae"), F.col("bn") - F.col("an")
    known = ends(spans, scene).withColumn("span", F.hypot(e, n))
    ranges = [F.col("ga"), F.col("ga") + rig_max(F.col("roof_a"), p), F.col("gb"), F.col("gb") + rig_max(F.col("roof_b"), p)]
    h = choose_heights(*ranges, F.col("span") * p.off_level_ratio)
    known = known.withColumn("h", h).withColumns({"ha": F.col("h.h_a"), "hb": F.col("h.h_b")})
    why = F.when(F.col("ga").isNull() | F.col("gb").isNull(), "geometry").when((F.col("span") < p.min_length) | (F.col("span") > p.max_length), "length").when(F.col("h").isNull(), "offlevel")
    known = stage(known.withColumn("reject", why), "ends")
    alive = known.where("reject is null")
    alive = stage(alive.join(_walk(alive, scene, p), "id", "left_semi"), "walked")
    lines = alive.select(
        "id", "ae", "an", "be", "bn", "roof_a", "roof_b", half_up(F.col("span"), 1).alias("length"), half_up(F.col("ha"), 2).alias("h_a"), half_up(F.col("hb"), 2).alias("h_b"), half_up(F.col("h.off_level"), 2).alias("off_level"), "ga", "gb"
    )
    lines = stage(lines.join(_ground_series(lines, scene, p), "id"), "bands")
    early = profile.metrics(lines.withColumn("surface", F.col("ground")), None, p).select("id", profile.rejection(p).alias("early"))
    passed = stage(lines.join(early.where("early is null"), "id", "left_semi"), "banded")
    if scene.ways is not None:
        found = ways.crossings(passed.select("id", "ae", "an", "be", "bn"), scene.ways, p, scene.ground, scene.surface)
        listed = found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("d", "from", "to", "offset", "kind", "tier", "carrier", "onBridge"))).alias("crossings"))
        passed = passed.join(listed, "id", "left").withColumn("crossings", F.coalesce("crossings", F.array().cast(CROSSINGS)))
    else:
        passed = passed.withColumn("crossings", F.array().cast(CROSSINGS))
    passed = stage(passed.join(_surface_series(passed, scene, p), "id"), "crossed")
    measured = profile.metrics(passed, None, p).join(passed, "id").withColumn("late", profile.rejection(p))
    figures = {
        "kind": line_kind(F.col("roof_a"), F.col("roof_b")), "bearing": half_up(F.degrees(bearing(e, n)), 1), "sag": half_up(F.col("length") * p.sag_ratio, 2), "off_level_ratio": half_up(F.col("off_level") / F.col("length"), 4),
        "clearance_min": half_up(F.col("clearance_min"), 2), "canopy_min": half_up(F.col("canopy_min"), 2), "score": half_up(profile.score(p), 1),
    }
    final = measured.select("id", "late", "length", "h_a", "h_b", "off_level", half_up(F.col("exposure"), 2).alias("exposure"), half_up(F.col("blocked"), 3).alias("blocked"), *[c.alias(k) for k, c in figures.items()])
    out = known.select("id", "ae", "an", "be", "bn", "reject").join(alive.select("id", F.lit(True).alias("walked")), "id", "left").join(early, "id", "left").join(final, "id", "left")
    whole = F.coalesce("reject", F.when(F.col("walked").isNull(), "terrain"), "early", "late")
    return out.withColumn("reject", whole).drop("walked", "early", "late")


def candidate_id() -> Column:
    return F.format_string("%.1f_%.1f__%.1f_%.1f", "ae", "an", "be", "bn")


def find_lines(anchors: DataFrame, scene: Scene, p: Params = DEFAULTS) -> DataFrame:
    """Candidates from anchors (e, n, lo, hi, open): pairs in reach that face each other, measured, near-duplicates out."""
    numbered = stage(anchors.withColumn("id", F.xxhash64("n", "e")), "anchors")
    facing = pairs.band_join(numbered, p.min_length, p.max_length, ["lo", "hi", "open"], gates=True, sectors=p.sectors)
    level = pairs.levelled(facing, p)
    spans = level.select(F.xxhash64("i", "j").alias("id"), F.col("a_e").alias("ae"), F.col("a_n").alias("an"), F.col("b_e").alias("be"), F.col("b_n").alias("bn"))
    found = stage(evaluate(stage(spans, "pairs"), scene, p).where("reject is null"), "found")
    return select.dedupe(found, p.dedup_radius)


def steps_around(radius: float, step: float) -> list[tuple[float, float]]:
    """Offsets within radius on a square lattice, nearest first."""
    k = int(radius // step)
    all_of_them = [(i * step, j * step) for i in range(-k, k + 1) for j in range(-k, k + 1)]
    return sorted((o for o in all_of_them if 0 < o[0] ** 2 + o[1] ** 2 <= radius**2), key=lambda o: o[0] ** 2 + o[1] ** 2)


def refine(candidates: DataFrame, scene: Scene, p: Params = DEFAULTS) -> DataFrame:
    """Candidates with each end moved, by turns, to the best of the places around where it began, until nothing gains.

    All candidates go through a pass together: every move of one end is a span of its own for `evaluate`, and the best
    (the nearest of equals, and only if strictly better) is an arg-max. At most p.refine_passes passes of two ends.
    """
    around = steps_around(p.refine_radius, p.refine_step)
    if not around:
        return candidates
    moves = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(e).alias("de"), F.lit(n).alias("dn")) for k, (e, n) in enumerate(around)])
    columns = candidates.columns
    best = stage(candidates.withColumns({"oae": F.col("ae"), "oan": F.col("an"), "obe": F.col("be"), "obn": F.col("bn")}), "refined")
    for _ in range(p.refine_passes):
        before = best
        for end, other in ("ab", "ba"):
            tries = best.select("id", F.explode(moves).alias("m"), "ae", "an", "be", "bn", f"o{end}e", f"o{end}n")
            tries = tries.select(F.col("id").alias("of"), F.col("m.k").alias("k"), (F.col(f"o{end}e") + F.col("m.de")).alias(f"{end}e"), (F.col(f"o{end}n") + F.col("m.dn")).alias(f"{end}n"), f"{other}e", f"{other}n")
            tries = stage(tries.withColumn("id", F.xxhash64("of", "k", F.lit(end))), "moves")
            got = evaluate(tries.select("id", "ae", "an", "be", "bn"), scene, p).where("reject is null").join(tries.select("id", "of", "k"), "id")
            figures = [c for c in columns if c != "id" and c in got.columns]
            top = got.groupBy("of").agg(F.max_by(F.struct(*figures), F.struct("score", -F.col("k"))).alias("new")).withColumnRenamed("of", "id")
            joined = best.join(top, "id", "left")
            gains = F.coalesce(F.col("new.score") > F.col("score"), F.lit(False))
            best = stage(joined.select("id", *[F.when(gains, F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in figures], *[c for c in best.columns if c not in figures and c != "id"]), "refined")
        if best.select("id", F.col("score").alias("now")).join(before.select("id", "score"), "id").where("now > score").isEmpty():
            break
    return best.select(*columns)


def plan(lines: DataFrame, scene: Scene, sag_ratio: float = DEFAULTS.sag_ratio, p: Params = DEFAULTS) -> DataFrame:
    """Lines that somebody has drawn (id, ae, an, be, bn), never refused for a rule: figures, the rules broken in words, and
    a score less what rigging costs. Lengths are metres on the ground; heights at the ends are bilinear. Lines without
    ground at an end or along them are left out."""
    long = replace(p, profile_step=1.0, profile_points=4000)
    at = lines
    for k in "ab":
        at = raster.bilinear(at, scene.ground, "id", f"{k}e", f"{k}n", name=f"g{k}")
        at = _flag(at, scene.roofs, f"{k}e", f"{k}n", f"roof_{k}")
        at = at.withColumn(f"top_{k}", F.col(f"g{k}")) if scene.surface is None else raster.bilinear(at, scene.surface, "id", f"{k}e", f"{k}n", name=f"top_{k}")
    at = at.where("ga is not null and gb is not null").withColumn("length", ground_distance(F.col("ae"), F.col("an"), F.col("be"), F.col("bn"))).where("length >= 1")
    h = choose_heights(F.col("ga"), F.col("ga") + rig_max(F.col("roof_a"), p), F.col("gb"), F.col("gb") + rig_max(F.col("roof_b"), p), F.lit(float("inf")))
    at = at.withColumn("h", h).withColumns({"h_a": F.col("h.h_a"), "h_b": F.col("h.h_b"), "off_level": F.col("h.off_level")}).drop("h")
    at = stage(at.join(_ground_series(at, scene, long), "id").where(~F.exists("ground", lambda g: g.isNull())), "planned")
    at = at.join(_surface_series(at, scene, long), "id")
    if scene.ways is not None:
        found = ways.crossings(at.select("id", "ae", "an", "be", "bn"), scene.ways, p, scene.ground, scene.surface)
        listed = found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("d", "from", "to", "offset", "kind", "tier", "carrier", "onBridge"))).alias("crossings"))
        at = at.join(listed, "id", "left").withColumn("crossings", F.coalesce("crossings", F.array().cast(CROSSINGS)))
    else:
        at = at.withColumn("crossings", F.array().cast(CROSSINGS))
    at = stage(at, "planned")
    measured = profile.metrics(at, F.lit(sag_ratio), p).join(at, "id")
    rig = rig_cost(F.col("h_a") - F.col("ga"), F.col("roof_a"), F.greatest(F.lit(0.0), F.col("top_a") - F.col("ga")), p) + rig_cost(F.col("h_b") - F.col("gb"), F.col("roof_b"), F.greatest(F.lit(0.0), F.col("top_b") - F.col("gb")), p)
    return measured.select("id", "ae", "an", "be", "bn", half_up(F.col("length"), 1).alias("length"), "h_a", "h_b", "off_level", "exposure", "clearance_min", "margin", "blocked", (profile.score(p) - rig).alias("score"), profile.violations(p, F.col("crossings")).alias("violations"))


def hexagon(rings: int = 3) -> list[tuple[float, float]]:
    """Places of a hexagonal patch around the origin, in units of its spacing, nearest first."""
    rows = [(q + t / 2, t * 3**0.5 / 2) for q in range(-rings, rings + 1) for t in range(max(-rings, -q - rings), min(rings, rings - q) + 1)]
    return sorted((r for r in rows if r != (0, 0)), key=lambda r: r[0] ** 2 + r[1] ** 2)


def optimise(lines: DataFrame, scene: Scene, reach: float = 10.0, spacing: float = 1.0, finest: float = 0.01, p: Params = DEFAULTS) -> DataFrame:
    """Planned lines moved, end by end, toward fewer broken rules and then higher scores, never over `reach` from where
    they began; the patch of places looked at is halved where nothing gains, and the search ends where the patch of `finest`
    gains nothing. All lines move together, and one that has settled stays where it is: moves must be strictly better."""
    origin = [F.col(c).alias(f"o{c}") for c in ("ae", "an", "be", "bn")]
    at = stage(lines.select("id", "ae", "an", "be", "bn", *origin), "optimised")
    while True:
        gained = False
        for end, other in ("ab", "ba"):
            moves = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(e * spacing).alias("de"), F.lit(n * spacing).alias("dn")) for k, (e, n) in enumerate([(0.0, 0.0), *hexagon()])])
            tries = at.withColumn("m", F.explode(moves)).withColumn(f"{end}e", F.col(f"{end}e") + F.col("m.de")).withColumn(f"{end}n", F.col(f"{end}n") + F.col("m.dn"))
            near = F.hypot(F.col(f"{end}e") - F.col(f"o{end}e"), F.col(f"{end}n") - F.col(f"o{end}n")) <= reach + 1e-9
            tries = tries.where(near | (F.col("m.k") == 0)).select(F.col("id").alias("of"), F.col("m.k").alias("k"), "ae", "an", "be", "bn").withColumn("id", F.xxhash64("of", "k"))
            tries = stage(tries, "places")
            ranked = plan(tries.select("id", "ae", "an", "be", "bn"), scene, p.sag_ratio, p).select("id", F.size("violations").alias("broken"), "score").join(tries, "id")
            best = ranked.groupBy("of").agg(F.min_by(F.struct("k", "ae", "an", "be", "bn"), F.struct("broken", -F.col("score"), F.col("k"))).alias("to")).withColumnRenamed("of", "id")
            there = [F.coalesce(F.col(f"to.{c}"), F.col(c)).alias(c) for c in ("ae", "an", "be", "bn")]
            moved = stage(at.join(best, "id", "left").select("id", "oae", "oan", "obe", "obn", *there, F.coalesce(F.col("to.k") > 0, F.lit(False)).alias("moved")), "optimised")
            gained = gained or not moved.where("moved").isEmpty()
            at = moved.drop("moved")
        if not gained:
            if spacing <= finest:
                break
            spacing = max(finest, spacing / 2)
    return at.select("id", "ae", "an", "be", "bn")
