"""All queries by name (QUERIES) and the DuckDB SQL for each (ORACLES)."""

from __future__ import annotations

from evirank.plans import further, more, star

QUERIES: dict = {**star.QUERIES, **more.QUERIES, **further.QUERIES}
ORACLES: dict[str, str] = {**star.ORACLES, **more.ORACLES, **further.ORACLES}
