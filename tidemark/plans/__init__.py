"""Queries by name: what runs on Spark, and the same in DuckDB SQL."""

from . import domain, primitives, remaining, research, structures, studies, texts
from .fixtures import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "domain", "primitives", "remaining", "research", "structures", "studies", "texts"]
