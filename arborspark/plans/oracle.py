"""DuckDB SQL of the registered queries."""

from __future__ import annotations

from arborspark.plans import queries  # noqa: F401 - registers
from arborspark.plans.registry import SQL


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
