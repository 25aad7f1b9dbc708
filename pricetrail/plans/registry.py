"""Query registry and the reading of the tables a query names."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pricetrail.session import bound_tasks, configure

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "pages", "documents")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Source:
    """The tables of one data folder, and frames made from shared binding SQL."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = bound_tasks(configure(spark)), folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        text = text.replace("{", "{{").replace("}", "}}")
        used = [t for t in TABLES if re.search(rf"\b{t}\b", text)]
        for t in used:
            text = re.sub(rf"\b(FROM|JOIN)\s+{t}\b", rf"\1 {{{t}}}", text)
        return self.spark.sql(text, **{t: self.table(t) for t in used})


def query(name: str, oracle: str | None = None):
    """Register a function of a Source under a name, with the SQL that must give the same rows."""

    def register(function):
        QUERIES[name] = lambda spark, folder: function(Source(spark, folder))
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return register


def with_views(*views: tuple[str, str]) -> str:
    """A WITH list naming binding SQL for an oracle."""
    return "WITH RECURSIVE " + ", ".join(f"{name} AS ({text})" for name, text in views) + " "
