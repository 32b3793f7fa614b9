"""Queries of this subpackage: key -> (builder taking ``(spark, sf_dir)``, SQL for comparison or None)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Item:
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


ITEMS: dict[str, Item] = {}


def query(key: str, sql: str | None = None):
    def register(build):
        if key in ITEMS:
            raise ValueError(f"query key used twice: {key}")
        ITEMS[key] = Item(build, sql)
        return build

    return register
