"""Every query of the library by name, with the SQL that DuckDB runs beside it."""

from __future__ import annotations

from fenwright import registry
from fenwright.plans import bi_queries, clean_queries, document_queries, field_queries, name_queries, rule_queries, source_queries, spatial_queries, state_queries, text_queries  # noqa: F401  they register their queries


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
