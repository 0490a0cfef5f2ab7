"""Registration of named queries: a Spark plan, an output signature, oracle SQL.

The signature (``"group:long rmse:double"``) is applied to both engines, so column
types and float rounding agree; it never drops or orders rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Plan = Callable[[SparkSession, str], DataFrame]

_SPARK = {"long": "bigint", "str": "string", "bool": "boolean"}
_DUCK = {"long": "BIGINT", "str": "VARCHAR", "bool": "BOOLEAN"}


@dataclass(frozen=True)
class Query:
    name: str
    ids: str
    signature: tuple[tuple[str, str], ...]
    plan: Plan
    sql: str | None

    def run(self, spark: SparkSession, sf: str) -> DataFrame:
        df = self.plan(spark, sf)
        out = []
        for name, kind in self.signature:
            c = F.col(f"`{name}`")
            if kind.startswith("d"):
                c = F.round(c.cast("double"), int(kind[1:] or 6)) + F.lit(0.0)
            else:
                c = c.cast(_SPARK[kind])
            out.append(c.alias(name))
        return df.select(*out)

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        out = []
        for name, kind in self.signature:
            if kind.startswith("d"):
                out.append(f'round(CAST("{name}" AS DOUBLE), {int(kind[1:] or 6)}) + CAST(0 AS DOUBLE) AS "{name}"')
            else:
                out.append(f'CAST("{name}" AS {_DUCK[kind]}) AS "{name}"')
        return f"SELECT {', '.join(out)} FROM ({self.sql}) AS result"


REGISTRY: dict[str, Query] = {}


def query(name: str, ids: str, signature: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register ``plan(spark, sf_dir)`` under ``name``; ``ids`` lists survey rows."""

    def wrap(plan: Plan) -> Plan:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        columns = tuple(tuple(part.split(":")) for part in signature.split())
        REGISTRY[name] = Query(name, ids, columns, plan, sql)  # type: ignore[arg-type]
        return plan

    return wrap
