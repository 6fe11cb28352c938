"""The step graph: nine steps in order, each behind its switch and its preconditions, each logged."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..sources.config import Config

STEPS = ["preprocess", "mosaic", "trajectory", "downsample", "feature_match", "grid_match", "inter_tile_match", "adjustment", "export"]
LOG = "step string, status string, seconds double, message string"


@dataclass
class Step:
    run: Callable[[dict], dict | None]
    needs: list[str] = field(default_factory=list)


def run(spark: SparkSession, config: Config, steps: dict[str, Step], tables: dict | None = None, dry: bool = False) -> tuple[dict, DataFrame]:
    """Runs the steps that are switched on and there. A step whose needed tables are missing fails; a failed
    step does not stop later ones, which fail by their own preconditions. Returns tables and the log."""
    tables, log = dict(tables or {}), []
    for name in STEPS:
        began = time.time()
        if name not in steps or not getattr(config.steps, name):
            log.append((name, "skipped", 0.0, ""))
            continue
        missing = [n for n in steps[name].needs if n not in tables]
        if missing:
            log.append((name, "failed", 0.0, "missing " + ", ".join(missing)))
        elif dry:
            log.append((name, "planned", 0.0, ""))
        else:
            try:
                tables |= steps[name].run(tables) or {}
                log.append((name, "done", time.time() - began, ""))
            except Exception as e:  # noqa: BLE001  the log says what failed, later steps see what is missing
                log.append((name, "failed", time.time() - began, f"{type(e).__name__}: {e}"[:500]))
    return tables, spark.createDataFrame(log, LOG)


def batch(spark: SparkSession, pairs: list[Config], steps: Callable[[Config], dict[str, Step]], keep_going: bool = True, dry: bool = False) -> DataFrame:
    """Runs a list of stereo pairs one after the other; without ``keep_going`` the first failed pair ends it."""
    out = None
    for c in pairs:
        _, log = run(spark, c, steps(c), dry=dry)
        out = log if out is None else out.unionByName(log)
        if not keep_going and log.filter("status = 'failed'").count():
            break
    return out


def register_views(spark: SparkSession, tables: dict[str, DataFrame]) -> None:
    """Names tables for SQL."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
