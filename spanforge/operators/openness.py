"""End points: places on a lattice that stand high enough over what is near, and the directions that are open from them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.params import DEFAULTS, Params

_SCHEMA = "e double, n double, ground double, lo double, hi double, open long, open_count int, drop_depth double"


def _grid(pdf: pd.DataFrame, halo: int, tx: int, ty: int, tile: int) -> tuple[np.ndarray, int, int]:
    x0, y0, side = tx * tile - halo, ty * tile - halo, tile + 2 * halo
    z = np.full((side, side), np.nan)
    z[pdf["cy"].to_numpy() - y0, pdf["cx"].to_numpy() - x0] = pdf["z"].to_numpy()
    return z, x0, y0


def _nearest(z: np.ndarray, e: np.ndarray, n: np.ndarray) -> np.ndarray:
    c, r = np.floor(e).astype(int), np.floor(n).astype(int)
    inside = (c >= 0) & (r >= 0) & (c < z.shape[1]) & (r < z.shape[0])
    out = np.full(e.shape, np.nan)
    out[inside] = z[r[inside], c[inside]]
    return out


def _between(z: np.ndarray, e: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Bilinear; the cell's own value where one of the four is missing."""
    x, y = np.floor(e - 0.5), np.floor(n - 0.5)
    fx, fy = e - 0.5 - x, n - 0.5 - y
    four = [_nearest(z, x + dx, y + dy) for dy in (0, 1) for dx in (0, 1)]
    mixed = (four[0] * (1 - fx) + four[1] * fx) * (1 - fy) + (four[2] * (1 - fx) + four[3] * fx) * fy
    return np.where(np.isnan(mixed), _nearest(z, e, n), mixed)


def _scan(pdf: pd.DataFrame, tile: int, halo: int, p: Params) -> pd.DataFrame:
    tx, ty = int(pdf["tx"].iloc[0]), int(pdf["ty"].iloc[0])
    z, x0, y0 = _grid(pdf, halo, tx, ty, tile)
    roof = np.zeros(z.shape, bool)
    roof[pdf["cy"].to_numpy() - y0, pdf["cx"].to_numpy() - x0] = pdf["roof"].to_numpy(bool)

    def lattice(edge: int) -> np.ndarray:
        first = math.ceil((edge - p.anchor_step / 2) / p.anchor_step) * p.anchor_step + p.anchor_step / 2
        return np.arange(first, edge + tile, p.anchor_step)

    e, n = (v.ravel() - o for v, o in zip(np.meshgrid(lattice(tx * tile), lattice(ty * tile)), (x0, y0), strict=True))
    g = _nearest(z, e, n)
    there = ~np.isnan(g)
    e, n, g = e[there], n[there], g[there]
    on_roof = roof[np.floor(n).astype(int), np.floor(e).astype(int)]
    top = g + np.where(on_roof, 0.0, p.frame_max)
    low = np.full(len(e), np.inf)
    for dn in np.arange(-p.drop_radius, p.drop_radius + 1):
        across = math.sqrt(max(0.0, p.drop_radius**2 - dn**2))
        for de in np.arange(-across, across + 1e-9):
            low = np.fmin(low, _nearest(z, e + de, n + dn))
    deep = low <= top - p.min_drop
    e, n, g, on_roof, top, low = (v[deep] for v in (e, n, g, on_roof, top, low))
    bits, count = np.zeros(len(e), np.uint64), np.zeros(len(e), np.int32)
    reach = np.arange(p.anchor_zone, p.probe_length + 1e-9)
    for s in range(p.sectors):
        w = (s + 0.5) / p.sectors * 2 * math.pi
        seen = _between(z, e[:, None] + math.sin(w) * reach, n[:, None] + math.cos(w) * reach)
        ok = (seen <= top[:, None] - p.fall_slope * reach - p.min_clearance).all(1)
        bits |= np.where(ok, np.uint64(1) << np.uint64(s), np.uint64(0))
        count += ok
    some = count > 0
    out = {"e": e + x0, "n": n + y0, "ground": g, "lo": g + np.where(on_roof, 0.0, p.frame_min), "hi": top, "open": bits.view(np.int64), "open_count": count, "drop_depth": top - low}
    return pd.DataFrame({k: v[some] for k, v in out.items()})


def scan(cells: DataFrame, roofs: DataFrame | None = None, p: Params = DEFAULTS, tile: int = 256) -> DataFrame:
    """Anchors (e, n, ground, lo, hi, open, open_count, drop_depth) on the lattice of p.anchor_step over 1 m cells.

    Kept are those with ground at least p.min_drop below within p.drop_radius, and at least one of p.sectors
    directions in which the ground falls away. Cells are sent to their tile and, as a margin, to the tiles
    within reach of them, so tasks hold one tile each, and each lattice point is one tile's.
    """
    halo = int(max(p.probe_length, p.drop_radius)) + 2
    masked = cells.select("cx", "cy", "z", F.lit(False).alias("roof")) if roofs is None else cells.join(roofs.select("cx", "cy", F.lit(True).alias("roof")), ["cx", "cy"], "left").withColumn("roof", F.coalesce("roof", F.lit(False)))
    near = [F.explode(F.sequence(F.floor((F.col(c) - halo) / tile), F.floor((F.col(c) + halo) / tile))).alias(t) for c, t in (("cx", "tx"), ("cy", "ty"))]
    spread = masked.select("*", near[0]).select("*", near[1])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return _scan(pdf, tile, halo, p)

    return spread.groupBy("tx", "ty").applyInPandas(run, _SCHEMA)


def in_urban_or_open(anchors: DataFrame, roofs: DataFrame, boxes: list[tuple[float, float, float, float]]) -> tuple[DataFrame, DataFrame]:
    """Anchors without those on roofs outside all urban boxes, and how many went."""
    on = anchors.withColumn("cx", F.floor("e")).withColumn("cy", F.floor("n")).join(roofs.select("cx", "cy", F.lit(True).alias("roof")), ["cx", "cy"], "left")
    inside = F.lit(False)
    for w, s, e, n in boxes:
        inside = inside | (F.col("e").between(w, e) & F.col("n").between(s, n))
    gone = F.coalesce("roof", F.lit(False)) & ~inside
    return on.where(~gone).drop("cx", "cy", "roof"), on.agg(F.count_if(gone).alias("skipped"))


