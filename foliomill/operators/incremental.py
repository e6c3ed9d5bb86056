"""Recomputation keyed by content, and state tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def cache_key(backend: Column, model: Column, title: Column, text: Column) -> Column:
    return F.sha1(F.concat_ws("|", backend, F.coalesce(model, F.lit("")), title, text))


def pending(rows: DataFrame, cache: DataFrame, key: str = "cache_key") -> DataFrame:
    """Rows whose key the cache lacks, one per key."""
    return rows.join(cache.select(key), key, "left_anti").dropDuplicates([key])


def refresh(rows: DataFrame, cache: DataFrame, compute: Callable[[DataFrame], DataFrame], key: str = "cache_key") -> tuple[DataFrame, DataFrame]:
    """Results for ``rows`` and the rows to append to the cache; only what is new is computed."""
    fresh = compute(pending(rows, cache, key))
    known = cache.unionByName(fresh)
    return rows.join(known, key, "left"), fresh


def missing_files(wanted: DataFrame, listing: DataFrame) -> DataFrame:
    """Files that are not there yet, or are empty: ``wanted`` has path, ``listing`` path and length."""
    return wanted.join(listing.filter("length > 0").select("path"), "path", "left_anti")


def upsert(state: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """State with the changed rows in place of the old ones."""
    return state.join(changes.select(*keys), keys, "left_anti").unionByName(changes)
