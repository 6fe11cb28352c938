"""All queries of the library and the SQL that states the same results."""

from __future__ import annotations

from . import fits, images, patches, planes, points, raster, search, spatial, texts  # noqa: F401  they register what they hold
from .registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
