"""Block files of features: gzip over a magic number, a table of names, and features with zigzag differences as varints."""

from __future__ import annotations

import gzip
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the format: magic number, metres of a block's side, units a metre, kinds by number, the bridge flag.
MAGIC = 0x314F4C48
SIDE = 8000
UNITS = 10
KINDS = ["path", "cycle", "street", "road", "highway", "water", "waterway", "island"]
BRIDGE = 8

FEATURE = "id long, kind string, name string, half double, bridge boolean, pts array<struct<e:double,n:double>>"


def _units(x: float) -> int:
    return math.floor(x * UNITS + 0.5)


def pack_numbers(numbers: list[int]) -> bytes:
    """Base-128 varints, the low seven bits first."""
    out = bytearray()
    for v in numbers:
        while v > 127:
            out.append(v & 127 | 128)
            v >>= 7
        out.append(v)
    return bytes(out)


def zigzag(v: int) -> int:
    return -2 * v - 1 if v < 0 else 2 * v


class Numbers:
    """Reads varints in a row; past the end is an error."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def next(self) -> int:
        value = shift = 0
        while True:
            if self.at == len(self.data):
                raise ValueError("the block ends inside a number")
            byte = self.data[self.at]
            self.at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    def signed(self) -> int:
        v = self.next()
        return -(v + 1 >> 1) if v & 1 else v >> 1

    def text(self) -> str:
        n = self.next()
        self.at += n
        return self.data[self.at - n : self.at].decode()


def origin(key: str) -> tuple[int, int]:
    e, n = key.split("-")
    return int(e) * SIDE * UNITS, int(n) * SIDE * UNITS


def encode(key: str, features: list[dict]) -> bytes:
    """features: dicts of FEATURE's fields, pts as (e, n) pairs. Ascending ids; names numbered as they come."""
    names = list(dict.fromkeys(f["name"] for f in features))
    number = {n: k for k, n in enumerate(names)}
    out = [pack_numbers([MAGIC, len(names)])]
    out += [pack_numbers([len(n.encode())]) + n.encode() for n in names]
    rest, last = [len(features)], 0
    for f in sorted(features, key=lambda f: f["id"]):
        rest += [zigzag(f["id"] - last), KINDS.index(f["kind"]) | (BRIDGE if f["bridge"] else 0), number[f["name"]], _units(f["half"]), len(f["pts"])]
        last, here = f["id"], origin(key)
        for p in f["pts"]:
            there = (_units(p[0]), _units(p[1]))
            rest += [zigzag(there[0] - here[0]), zigzag(there[1] - here[1])]
            here = there
    return gzip.compress(b"".join([*out, pack_numbers(rest)]), mtime=0)


def decode(key: str, data: bytes) -> list[dict]:
    r = Numbers(gzip.decompress(data))
    if r.next() != MAGIC:
        raise ValueError(f"no block file: {key}")
    names = [r.text() for _ in range(r.next())]
    out, last = [], 0
    for _ in range(r.next()):
        last += r.signed()
        head, name, half, count = r.next(), r.next(), r.next(), r.next()
        e, n = origin(key)
        pts = []
        for _ in range(count):
            e, n = e + r.signed(), n + r.signed()
            pts.append((e / UNITS, n / UNITS))
        out.append({"id": last, "kind": KINDS[head & 7], "name": names[name], "half": half / UNITS, "bridge": bool(head & BRIDGE), "pts": pts})
    return out


def read(content: DataFrame) -> DataFrame:
    """Features with their block of files (path, content) named <block>.bin."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = [{"block": b, **f, "pts": [{"e": e, "n": n} for e, n in f["pts"]]} for b, c in zip(pdf["block"], pdf["content"], strict=True) for f in decode(b, bytes(c))]
            yield pd.DataFrame(rows, columns=["block", "id", "kind", "name", "half", "bridge", "pts"])

    named = content.select(F.regexp_extract("path", r"([^/]+)\.bin$", 1).alias("block"), "content")
    return named.mapInPandas(run, "block string, " + FEATURE)


def write(features: DataFrame) -> DataFrame:
    """(block, content) of features that carry their block. A block is 8 km of map, so a group is bounded by the ground."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [{**r, "pts": [(p["e"], p["n"]) for p in r["pts"]]} for r in pdf.to_dict("records")]
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "content": [encode(pdf["block"].iloc[0], rows)]})

    return features.groupBy("block").applyInPandas(run, "block string, content binary")


def simplify(points: list[tuple[float, float]], tolerance: float) -> list[tuple[float, float]]:
    """A line without the points that lie within tolerance of the chords of those that stay (Douglas-Peucker)."""
    keep = {0, len(points) - 1}
    todo = [(0, len(points) - 1)] if len(points) > 2 else []
    while todo:
        a, b = todo.pop()
        (x0, y0), (x1, y1) = points[a], points[b]
        length = math.hypot(x1 - x0, y1 - y0)
        off = [(math.dist(points[a], points[i]) if length == 0 else abs((x1 - x0) * (points[i][1] - y0) - (y1 - y0) * (points[i][0] - x0)) / length, -i) for i in range(a + 1, b)]
        far, minus = max(off, default=(0.0, 0))
        if far > tolerance:
            keep.add(-minus)
            todo += [(a, -minus), (-minus, b)]
    return [points[i] for i in sorted(keep)]
