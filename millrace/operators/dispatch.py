"""Functions on shards of a DataFrame, and registries of named tools."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Shard = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def on_shards(df: DataFrame, f: Shard, schema: str, shards: int, *keys: str) -> DataFrame:
    """f over each shard's batches, results stacked; with keys, rows of a key are on one shard."""
    return df.repartition(shards, *keys).mapInPandas(f, schema)


def to_all(df: DataFrame, small: DataFrame, most: int = 100_000) -> DataFrame:
    """Every row of df beside the rows of a small table, which is counted before it is sent to all."""
    if small.count() > most:
        raise ValueError(f"more than {most} rows are not sent to all")
    return df.crossJoin(F.broadcast(small))


def on_driver(df: DataFrame, f: Callable[[DataFrame], object]) -> object:
    """f of an aggregate on the driver."""
    return f(df)


class Registry:
    """Tools by name; a name is taken once unless it may be overwritten."""

    def __init__(self):
        self.tools: dict[str, Callable] = {}

    def register(self, name: str, overwrite: bool = False) -> Callable:
        def add(tool: Callable) -> Callable:
            if name in self.tools and not overwrite:
                raise ValueError(f"{name} is taken")
            self.tools[name] = tool
            return tool

        return add

    def __getitem__(self, name: str) -> Callable:
        return self.tools[name]
