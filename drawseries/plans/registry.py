"""Named queries: a Spark plan, its DuckDB oracle SQL, and one output spec.

The output spec fixes every column's canonical type for comparison:
``int`` → BIGINT, ``nint`` (integer that can be null) → DOUBLE, ``dbl`` →
DOUBLE rounded to 6 places, ``str`` → STRING, ``date`` → ISO text, ``bool`` →
BOOLEAN.  ``nint`` exists because the two engines hand nullable integers to
pandas differently (float64 vs Int64); as DOUBLE both agree.  Both sides are projected through the
same spec, so names and types agree by construction.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import BASE_CONF

HUGE_METHOD = "spark.sql.codegen.hugeMethodLimit"
WINDOW_ROWS = "spark.sql.windowExec.buffer.in.memory.threshold"


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    spec: tuple[tuple[str, str], ...]
    sql: str | None = None
    note: str = ""


REGISTRY: dict[str, Query] = {}


def spec_of(text: str) -> tuple[tuple[str, str], ...]:
    """``"a int, b dbl"`` → (("a","int"), ("b","dbl"))."""
    out = []
    for part in text.split(","):
        part = part.strip()
        if part:
            name, kind = part.split()
            out.append((name, kind))
    return tuple(out)


def canon_spark(df: DataFrame, spec) -> DataFrame:
    cols = []
    for name, kind in spec:
        c = F.col(name)
        if kind == "int":
            c = c.cast("bigint")
        elif kind == "nint":
            c = c.cast("bigint").cast("double")
        elif kind == "dbl":
            c = F.round(c.cast("double"), 6)
        elif kind == "str":
            c = c.cast("string")
        elif kind == "date":
            c = F.date_format(c, "yyyy-MM-dd")
        elif kind == "bool":
            c = c.cast("boolean")
        else:
            raise ValueError(kind)
        cols.append(c.alias(name))
    return df.select(*cols)


def canon_sql(body: str, spec) -> str:
    cols = []
    for name, kind in spec:
        q = f'q."{name}"'
        if kind == "int":
            e = f"CAST({q} AS BIGINT)"
        elif kind == "nint":
            e = f"CAST(CAST({q} AS BIGINT) AS DOUBLE)"
        elif kind == "dbl":
            e = f"round(CAST({q} AS DOUBLE), 6)"
        elif kind == "str":
            e = f"CAST({q} AS VARCHAR)"
        elif kind == "date":
            e = f"strftime(CAST({q} AS DATE), '%Y-%m-%d')"
        elif kind == "bool":
            e = f"CAST({q} AS BOOLEAN)"
        else:
            raise ValueError(kind)
        cols.append(f'{e} AS "{name}"')
    return "SELECT " + ", ".join(cols) + f" FROM (\n{body}\n) q"


def register(name: str, spec: str, sql: str | None = None, note: str = ""):
    def deco(fn):
        if name in REGISTRY:
            raise KeyError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, spec_of(spec), sql, note)
        return fn
    return deco


def spark_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    q = REGISTRY[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        # the library's date/time semantics are defined in UTC
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        for name in (HUGE_METHOD, WINDOW_ROWS):
            spark.conf.set(name, BASE_CONF[name])
        return canon_spark(q.build(spark, sf_dir), q.spec)
    return run


def oracle(name: str) -> str | None:
    q = REGISTRY[name]
    return canon_sql(q.sql, q.spec) if q.sql else None
