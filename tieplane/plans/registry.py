"""Where query modules put their queries and the SQL that states the same results."""

from __future__ import annotations

from collections.abc import Callable

from .proxies import SQL

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers (spark, sf_dir) -> DataFrame; the SQL may read the proxy tables of ``proxies.SQL``."""

    def put(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            head, body = ("WITH RECURSIVE " if "RECURSIVE" in sql else "WITH "), sql.replace("RECURSIVE", "").strip()
            ORACLES[name] = head + SQL + (", " + body[4:].strip() if body.startswith("WITH") else body)
        return f

    return put
