"""OpenStreetMap PBF files: blocks of a file decoded side by side into nodes, ways and relations."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

WAYS = "id long, refs array<long>, tags map<string,string>"
RELATIONS = "id long, members array<struct<type:int,ref:long,role:string>>, tags map<string,string>"


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message: integers as they are, other fields as bytes."""
    at, end = 0, len(data)

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < end:
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(kind)
        size = number() if size is None else size
        yield key >> 3, data[at : at + size]
        at += size


def packed(data: bytes) -> np.ndarray:
    """All varints of a packed field at once (uint64)."""
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.empty(0, np.uint64)
    last = np.flatnonzero(b < 128)
    starts = np.concatenate([[0], last[:-1] + 1])
    place = np.arange(len(b)) - np.repeat(starts, last - starts + 1)
    return np.add.reduceat((b & 127).astype(np.uint64) << (7 * place).astype(np.uint64), starts)


def unzigzag(v: np.ndarray) -> np.ndarray:
    return (v >> np.uint64(1)).astype(np.int64) ^ -(v & np.uint64(1)).astype(np.int64)


def running(data: bytes) -> np.ndarray:
    return np.cumsum(unzigzag(packed(data)))


def blobs(data: bytes) -> Iterator[bytes]:
    """The data blocks of a file, unpacked."""
    at = 0
    while at < len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        head = dict(fields(data[at + 4 : at + 4 + size]))
        at += 4 + size + head[3]
        if head[1] == b"OSMData":
            body = dict(fields(data[at - head[3] : at]))
            yield body[1] if 1 in body else zlib.decompress(body[3])


def _tags(strings: list[str], keys: bytes, values: bytes) -> dict[str, str]:
    return {strings[k]: strings[v] for k, v in zip(packed(keys).tolist(), packed(values).tolist(), strict=True)}


def block(data: bytes) -> tuple[pd.DataFrame, list[dict], list[dict]]:
    """(nodes as id, lat, lon; ways; relations) of one data block."""
    top = list(fields(data))
    single = {k: v for k, v in top if k not in (1, 2)}
    strings = [s.decode() for k, v in top if k == 1 for _, s in fields(v)]
    scale, lat0, lon0 = single.get(17, 100), single.get(19, 0), single.get(20, 0)
    parts: list[pd.DataFrame] = []
    ways: list[dict] = []
    relations: list[dict] = []
    for group in (v for k, v in top if k == 2):
        for kind, body in fields(group):
            f = dict(fields(body))
            if kind == 2:
                ids, lat, lon = (running(f.get(k, b"")) for k in (1, 8, 9))
                parts.append(pd.DataFrame({"id": ids, "lat": (lat0 + scale * lat) * 1e-9, "lon": (lon0 + scale * lon) * 1e-9}))
            elif kind == 1:
                one = [int(unzigzag(np.array([f.get(k, 0)], np.uint64))[0]) for k in (1, 8, 9)]
                parts.append(pd.DataFrame({"id": [one[0]], "lat": [(lat0 + scale * one[1]) * 1e-9], "lon": [(lon0 + scale * one[2]) * 1e-9]}))
            elif kind == 3:
                ways.append({"id": f[1], "refs": running(f.get(8, b"")).tolist(), "tags": _tags(strings, f.get(2, b""), f.get(3, b""))})
            elif kind == 4:
                who = zip(packed(f.get(10, b"")).tolist(), running(f.get(9, b"")).tolist(), packed(f.get(8, b"")).tolist(), strict=True)
                relations.append({"id": f[1], "members": [{"type": t, "ref": r, "role": strings[s]} for t, r, s in who], "tags": _tags(strings, f.get(2, b""), f.get(3, b""))})
    nodes = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"id": [], "lat": [], "lon": []})
    return nodes, ways, relations


def split(content: DataFrame, tasks: int | None = None) -> DataFrame:
    """(data) of all blocks of binary files (path, content), dealt out evenly: one file is many tasks' work."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for c in pdf["content"]:
                for data in blobs(bytes(c)):
                    yield pd.DataFrame({"data": [data]})

    out = content.select("content").mapInPandas(run, "data binary")
    return out.repartition(tasks) if tasks else out


def _pick(data: DataFrame, which: Callable[[tuple], pd.DataFrame], schema: str) -> DataFrame:
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for d in pdf["data"]:
                yield which(block(bytes(d)))

    return data.mapInPandas(run, schema)


def nodes(data: DataFrame) -> DataFrame:
    """(id, lat, lon) of all nodes; those that ways use are checked where their shapes are made (etl.features)."""
    return _pick(data, lambda b: b[0].astype({"id": "int64"}), "id long, lat double, lon double")


def ways(data: DataFrame) -> DataFrame:
    return _pick(data, lambda b: pd.DataFrame(b[1], columns=["id", "refs", "tags"]), WAYS)


def relations(data: DataFrame) -> DataFrame:
    return _pick(data, lambda b: pd.DataFrame(b[2], columns=["id", "members", "tags"]), RELATIONS)
