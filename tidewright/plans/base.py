"""Registry of the bound queries and the output rules both engines share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import bound_shuffles, bound_tasks, prepare, stored_bytes


class Tables:
    """Lazy access to the given Parquet tables. Shuffles are dealt by the size of those that a query has asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.sizes = spark, folder, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        path = f"{self.folder}/{name}.parquet"
        df = self.spark.read.parquet(path)
        if name not in self.sizes:
            self.sizes[name] = stored_bytes(self.spark, path)
            bound_shuffles(self.spark, sum(self.sizes.values()))
        return df


def stage(df: DataFrame) -> DataFrame:
    """Keep a small stage table (one row per day, step, cell-year or bin) that a query reads several times.

    Without it every use would repeat the scan behind the table. Lost blocks are recomputed from lineage.
    """
    return df.persist(StorageLevel.MEMORY_AND_DISK)


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    spec: str
    covers: tuple[str, ...]
    ctes: str | None

    @cached_property
    def columns(self) -> list[tuple[str, str]]:
        return [tuple(item.rsplit(":", 1)) for item in self.spec.split()]

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        df = self.build(Tables(bound_tasks(prepare(spark)), folder))
        return df.select(*[_out(F.col(f"`{c}`"), kind).alias(c) for c, kind in self.columns])

    @property
    def sql(self) -> str | None:
        if self.ctes is None:
            return None
        cols = ", ".join(f'{_out_sql(c, kind)} AS "{c}"' for c, kind in self.columns)
        return f"WITH {self.ctes.strip()} SELECT {cols} FROM final"


def _eps(digits: int) -> float:
    return 3.0 * 10.0 ** -(digits + 3)


def _out(c: Column, kind: str) -> Column:
    """Output form: s text, i whole number, b flag as 0/1, d day, t second, fN number with N digits.

    Numbers are nudged by a small fraction of the last digit before rounding, so that values lying exactly
    on a rounding tie round alike in both engines whatever the order of summation.
    """
    if kind == "s":
        return c
    if kind in ("i", "b"):
        return c.cast("long")
    if kind == "d":
        return F.date_format(c, "yyyy-MM-dd")
    if kind == "t":
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    digits = int(kind[1:])
    return F.round(c.cast("double") + F.lit(_eps(digits)), digits)


def _out_sql(name: str, kind: str) -> str:
    q = f'"{name}"'
    if kind == "s":
        return q
    if kind in ("i", "b"):
        return f"CAST({q} AS BIGINT)"
    if kind == "d":
        return f"strftime({q}, '%Y-%m-%d')"
    if kind == "t":
        return f"strftime({q}, '%Y-%m-%d %H:%M:%S')"
    digits = int(kind[1:])
    return f"round(CAST({q} AS DOUBLE) + {_eps(digits):.12f}, {digits})"


REGISTRY: dict[str, Query] = {}


def query(name: str, spec: str, ctes: str | None = None, covers: str = ""):
    """Register a query: output columns, covered operators, and the same result in SQL.

    ``ctes`` is the WITH list of the SQL; its last member is called ``final``.
    """

    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, " ".join(spec.split()), tuple(covers.split()), ctes)
        return fn

    return wrap
