"""Spacecraft clock strings and time scales as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TICKS = 65536
#: The periodic difference of dynamical time from terrestrial time, K sin(E) with E = M + EB sin(M), M = M0 + M1 t.
K, EB, M0, M1 = 1.657e-3, 1.671e-2, 6.239996, 1.99096871e-7


def clock_ticks(text: Column) -> Column:
    """Ticks of a clock string such as 3/1307904494:30287; null for anything else."""
    main = F.regexp_extract(text, r"^(?:\d+/)?(\d+)(?::\d+)?$", 1)
    sub = F.regexp_extract(text, r"^(?:\d+/)?\d+:(\d+)$", 1)
    return F.when(main != "", main.cast("double") * TICKS + F.when(sub != "", sub.cast("double")).otherwise(0.0))


def continuous_ticks(ticks: Column, partitions: list[tuple[float, float]]) -> Column:
    """Ticks since the first partition's start, without the gaps between partitions (start, stop), of which a mission has some
    dozens. In the first partition ticks stay as they are; of partitions that share a place the last counts; outside all it is null."""
    spans, total = [], 0.0
    for i, (start, stop) in enumerate(partitions):
        first, last = float(int(start + 0.5)), float(int(stop + 0.5))
        spans.append((first, last, 0.0 if i == 0 else total - first))
        total += last - first
    out = F.lit(None).cast("double")
    for first, last, shift in spans:  # later ones are asked first
        out = F.when((ticks >= first) & (ticks <= last), ticks + shift).otherwise(out)
    return out


def terrestrial_seconds(ticks: Column, origin: float, seconds: float, rate: float) -> Column:
    return F.lit(seconds) + rate / TICKS * (ticks - origin)


def periodic_seconds(terrestrial: Column) -> Column:
    """What dynamical time is ahead of terrestrial time."""
    m = M0 + M1 * terrestrial
    return K * F.sin(m + EB * F.sin(m))


def dynamical_seconds(terrestrial: Column) -> Column:
    return terrestrial + periodic_seconds(terrestrial)
