"""What a run is asked for, from its arguments."""

from __future__ import annotations

import argparse
from dataclasses import dataclass, field
from datetime import datetime

from spanforge.operators.regions import parse_chunk_name


@dataclass(frozen=True)
class Asked:
    everything: bool = False
    rectangles: list[tuple[float, float, float, float]] = field(default_factory=list)
    chunks: list[tuple[int, int]] = field(default_factory=list)
    before: datetime | None = None
    hotspots_only: bool = False


def asked(args: list[str]) -> Asked:
    """Rectangles are four numbers each; a date, chunk or rectangle that is none is an error, and so is a contradiction."""
    p = argparse.ArgumentParser(prog="spanforge", exit_on_error=False)
    p.add_argument("--all", action="store_true")
    p.add_argument("--hotspots", action="store_true")
    p.add_argument("--before", type=datetime.fromisoformat)
    p.add_argument("--chunk", action="append", type=parse_chunk_name, default=[])
    try:
        got, rest = p.parse_known_args(args)
        numbers = [float(x) for x in rest]
    except (argparse.ArgumentError, ValueError) as e:
        raise ValueError(f"arguments: {e}") from e
    if len(numbers) % 4:
        raise ValueError(f"not four numbers a rectangle: {' '.join(rest)}")
    boxes = [tuple(numbers[i : i + 4]) for i in range(0, len(numbers), 4)]
    if got.hotspots and (got.all or got.chunk or boxes or got.before):
        raise ValueError("--hotspots searches nothing, so it can't be given ground to search")
    return Asked(got.all, boxes, got.chunk, got.before, got.hotspots)
