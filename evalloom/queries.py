"""All queries of the library, by name, and the SQL that must give the same rows."""

from __future__ import annotations

from .catalog import base, benchmarks, decoding, linear, more, plumbing, retention, retention_more, scoring, streams  # noqa: F401 - importing a module registers its queries


def queries() -> dict[str, base.Query]:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)
