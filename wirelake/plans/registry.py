"""The table of queries: key -> (DataFrame builder, SQL for comparison or None)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from wirelake.plans.tables import Tables, with_views


@dataclass(frozen=True)
class Entry:
    build: Callable[[Tables], DataFrame]
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def query(key: str, sql: str | None = None, views: tuple[str, ...] | str = ()):
    """Register a builder under ``key``; ``views`` are the domain views that ``sql`` names."""
    names = (views,) if isinstance(views, str) else tuple(views)

    def register(build: Callable[[Tables], DataFrame]):
        if key in REGISTRY:
            raise ValueError(f"query key used twice: {key}")
        REGISTRY[key] = Entry(build, with_views(names, sql) if sql else None)
        return build

    return register
