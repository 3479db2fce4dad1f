"""The queries a driver can run, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from wardline.session import LOCAL_TASKS

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

# Local sessions for tests and the bench ask for so many tasks over the texts, which lie in one file that cannot be split.
TEXTS = ("documents", "pages", "conversations")


class Tables:
    """The given tables of one folder, read lazily: ``t.documents`` is a DataFrame."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        tasks = self.spark.conf.get(LOCAL_TASKS, None)
        return table.repartition(int(tasks)) if tasks and name in TEXTS else table


@dataclass(frozen=True)
class Query:
    name: str
    covers: str
    run: Callable[[Tables], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None):
    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = Query(name, covers, fn, sql)
        return fn

    return register


def load_all() -> dict[str, Query]:
    from wardline.plans import load_modules

    load_modules()
    return QUERIES
