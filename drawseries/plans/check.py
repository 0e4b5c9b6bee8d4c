"""Compare every registered query with its DuckDB oracle on one scale factor.

    python -m drawseries.plans.check /root/testdata/sf0.01 [name ...]

Prints one line per query: rows on each side and whether the sorted,
canonicalised rows are identical.
"""

from __future__ import annotations

import math
import sys
import time

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    return v


def rows_of(records) -> list[tuple]:
    return sorted((tuple(_norm(x) for x in r) for r in records),
                  key=lambda t: tuple((x is None, str(x)) for x in t))


def compare(spark, con, sf_dir: str, name: str) -> dict:
    from .. import plans  # noqa: F401  (registers queries)
    from .registry import REGISTRY, oracle, spark_query
    q = REGISTRY[name]
    t0 = time.time()
    sdf = spark_query(name)(spark, sf_dir)
    s_rows = [tuple(r) for r in sdf.collect()]
    t_spark = time.time() - t0
    out = {"name": name, "spark_rows": len(s_rows), "spark_sec": round(t_spark, 2)}
    sql = oracle(name)
    if sql is None:
        out["oracle"] = None
        return out
    d_rows = con.execute(sql).fetchall()
    out["oracle_rows"] = len(d_rows)
    a, b = rows_of(s_rows), rows_of(d_rows)
    out["match"] = a == b
    if not out["match"]:
        sa, sb = set(a), set(b)
        out["only_spark"] = sorted(sa - sb, key=str)[:3]
        out["only_oracle"] = sorted(sb - sa, key=str)[:3]
        out["columns"] = [c for c, _ in q.spec]
    return out


def main(argv):
    from ..session import get_spark
    from .. import plans  # noqa: F401
    from .registry import REGISTRY
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(REGISTRY)
    spark = get_spark("local[8]", 8)
    con = duck(sf_dir)
    bad = 0
    for n in names:
        try:
            r = compare(spark, con, sf_dir, n)
        except Exception as e:  # report and continue with the next query
            r = {"name": n, "error": repr(e)[:400]}
        ok = r.get("match", r.get("oracle", "x") is None and "error" not in r)
        bad += 0 if ok else 1
        print(r, flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
