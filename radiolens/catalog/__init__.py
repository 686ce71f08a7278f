"""Registered queries and the SQL each of them must agree with."""

from radiolens.catalog.base import CHECKS, Check, Tables
from radiolens.catalog import (  # noqa: F401  (importing registers)
    ingest,
    cleaning,
    joins,
    windows,
    aggregates,
    scalars,
    metrics,
    retrieval,
    diagnosis,
    models,
    streams,
)

__all__ = ["CHECKS", "Check", "Tables"]
