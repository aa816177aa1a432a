"""Named queries over the driver tables, each with its SQL twin where SQL can say it.

``columns`` is a compact result contract, ``"name:type …"``, applied to both engines so that a
comparison sees the same types: ``s`` string, ``i`` bigint, ``b`` boolean, ``t`` date as
``yyyy-MM-dd``, ``ts`` timestamp to the second, ``dN`` double rounded half up to N decimals. The
rounding adds a guard far above float noise and far below the last digit kept, because prices are
ratios of cents and exact ties do occur.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from risklake.plans.base_sql import with_ctes
from risklake.session import tune
from risklake.sources.testdata import Tables


ROUND_GUARD = 0.500001
EXACT_LIMIT = 9e15  # beyond this a double has no digits left to round


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    columns: str
    sql: str | None
    store: tuple[str, ...] = ()
    ready: tuple[str, ...] = ()

    def fields(self) -> list[tuple[str, str]]:
        return [tuple(part.split(":")) for part in self.columns.split()]

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        tables = Tables(tune(spark), sf_dir)
        for name in self.store:
            tables.store(name)
        df = self.build(tables)
        return df.select(*[F.col(name) if name in self.ready else _spark_cell(name, kind) for name, kind in self.fields()])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        cells = ", ".join(_sql_cell(name, kind) for name, kind in self.fields())
        return with_ctes(f"SELECT {cells} FROM ({self.sql}) AS q")


TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"


def _spark_cell(name: str, kind: str) -> Column:
    col = F.col(name)
    if kind == "s":
        col = col.cast("string")
    elif kind == "i":
        col = col.cast("bigint")
    elif kind == "b":
        col = col.cast("boolean")
    elif kind == "t":
        col = F.date_format(col, "yyyy-MM-dd")
    elif kind == "ts":
        col = F.date_format(col, TIME_FORMAT)
    else:
        scale = float(10 ** int(kind[1:]))
        x = col.cast("double")
        col = F.when(F.abs(x * scale) < EXACT_LIMIT, F.floor(x * scale + ROUND_GUARD).cast("double") / scale).otherwise(x)
    return col.alias(name)


def _sql_cell(name: str, kind: str) -> str:
    col = f'"{name}"'
    if kind == "s":
        expr = f"CAST({col} AS VARCHAR)"
    elif kind == "i":
        expr = f"CAST({col} AS BIGINT)"
    elif kind == "b":
        expr = f"CAST({col} AS BOOLEAN)"
    elif kind == "t":
        expr = f"strftime(CAST({col} AS DATE), '%Y-%m-%d')"
    elif kind == "ts":
        expr = f"strftime(CAST({col} AS TIMESTAMP), '%Y-%m-%d %H:%M:%S')"
    else:
        scale = f"{10 ** int(kind[1:])}e0"
        x = f"CAST({col} AS DOUBLE)"
        expr = f"CASE WHEN abs({x} * {scale}) < {EXACT_LIMIT} THEN floor({x} * {scale} + {ROUND_GUARD}e0) / {scale} ELSE {x} END"
    return f"{expr} AS {col}"


REGISTRY: dict[str, Query] = {}


def register(name: str, columns: str, sql: str | None = None, store: str = "", ready: str = ""):
    """Decorator: file a ``Tables -> DataFrame`` builder under ``name``.

    ``store`` lists the derived tables the query reads several times; each is written once per run.
    ``ready`` lists the columns that the builder gives as the contract wants them.
    """
    if not re.fullmatch(r"[a-z]+_[a-z0-9_]+", name):
        raise ValueError(f"bad query name {name!r}")

    def add(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, build, columns, sql, tuple(store.split()), tuple(ready.split()))
        return build

    return add
