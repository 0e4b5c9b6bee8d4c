"""Star schema and keyed writes: view join, key lookup, insert-if-absent,
upsert, dedupe, bulk load and its report.

Joins to dimension tables (lotteries, signs) are left to Spark's byte threshold.
Keyed merges are ``groupBy(key)`` aggregations with ``max_by``/``min_by`` — partial
aggregation on the map side collapses a hot key before the shuffle.  Merges into a
stored table that should not shuffle it go through ``sources.cow``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.clean import ESSENTIAL
from ..session import store

# -- A12 --------------------------------------------------------------------

def dedupe_last(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key, the one with the greatest ``order`` (last arrival)."""
    rest = [c for c in df.columns if c not in key]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*key).agg(best).select(*key, "_row.*")


def dedupe_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key, the one with the smallest ``order`` (first arrival)."""
    rest = [c for c in df.columns if c not in key]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*key).agg(best).select(*key, "_row.*")


# -- J1 ---------------------------------------------------------------------

def v_resultados(fact: DataFrame, loterias: DataFrame, signos: DataFrame) -> DataFrame:
    """Fact + both dimensions, inner equi-joins (no ORDER BY: output order is free)."""
    lot = loterias.select(F.col("id").alias("loteria_id"),
                                            F.col("nombre").alias("lottery"))
    sig = signos.select(F.col("id").alias("signo_id"),
                                          F.col("codigo").alias("series"),
                                          F.col("nombre").alias("sign_name"))
    return fact.join(lot, "loteria_id").join(sig, "signo_id") \
        .select("fecha", "lottery", "result", "series", "sign_name")


# -- J2 / J3 ----------------------------------------------------------------

def lookup_keys(draws: DataFrame, loterias: DataFrame, signos: DataFrame,
                case_insensitive: bool = True) -> tuple[DataFrame, DataFrame]:
    """Resolve dimension ids; returns (resolved fact rows, rejected draws)."""
    norm = (lambda c: F.upper(F.trim(c))) if case_insensitive else (lambda c: c)
    lot = loterias.select(F.col("id").alias("loteria_id"),
                                            norm(F.col("nombre")).alias("_lk"))
    sig = signos.select(F.col("id").alias("signo_id"),
                                          norm(F.col("codigo")).alias("_sk"))
    j = draws.withColumn("_lk", norm(F.col("lottery"))).withColumn("_sk", norm(F.col("series"))) \
        .join(lot, "_lk", "left").join(sig, "_sk", "left").drop("_lk", "_sk")
    ok = F.col("loteria_id").isNotNull() & F.col("signo_id").isNotNull()
    return j.filter(ok), j.filter(~ok)


def unknown_codes(draws: DataFrame, signos: DataFrame) -> DataFrame:
    """Distinct sign codes absent from the dimension."""
    codes = signos.select(F.col("codigo").alias("series"))
    return draws.select("series").dropna().join(codes, "series", "left_anti").distinct()


# -- J4 / J5 ----------------------------------------------------------------

def insert_if_absent(target: DataFrame, new: DataFrame, key: list[str],
                     order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Stored rows win; within the new rows the first arrival wins.

    Returns (merged table, inserted rows).
    """
    first = dedupe_first(new, key, order)
    inserted = first.join(target.select(*key), key, "left_anti")
    cols = target.columns
    return target.unionByName(inserted.select(*cols)), inserted.select(*cols)


def upsert(target: DataFrame, new: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """New rows replace stored rows with the same key; the later new row wins.

    One aggregation keyed on ``key``: the stored row has priority 0, new rows
    priority 1 then their arrival order.
    """
    cols = target.columns
    prio = [F.lit(0).alias("_p")] + [F.lit(None).cast(new.schema[o].dataType).alias(f"_o{i}")
                                       for i, o in enumerate(order)]
    t = target.select(*cols, *prio)
    n = new.select(*cols, F.lit(1).alias("_p"), *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)])
    both = t.unionByName(n)
    return dedupe_last(both, key, ["_p"] + [f"_o{i}" for i in range(len(order))]) \
        .select(*cols)


def upsert_observed(target: DataFrame, new: DataFrame, key: list[str], order: list[str]) -> tuple[DataFrame, Observation]:
    """J5 with its counts: (merged table, observation that the action which writes it fills).

    ``affected`` is the number of new rows, as a keyed write reports it; ``inserted`` and
    ``replaced`` count keys.  No second job: the counts are taken on the way to the write.
    """
    cols = target.columns
    rest = [c for c in cols if c not in key]
    t = target.select(*cols, F.lit(0).alias("_p"), *[F.lit(None).cast(new.schema[o].dataType).alias(f"_o{i}") for i, o in enumerate(order)])
    n = new.select(*cols, F.lit(1).alias("_p"), *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)])
    best = F.max_by(F.struct(*rest), F.struct("_p", *[f"_o{i}" for i in range(len(order))])).alias("_row")
    merged = t.unionByName(n).groupBy(*key).agg(best, F.sum("_p").alias("_new"), F.min("_p").alias("_least"))
    seen = Observation(f"upsert-{uuid.uuid4().hex}")
    merged = merged.observe(seen, F.sum("_new").alias("affected"), F.count(F.when(F.col("_least") == 1, 1)).alias("inserted"),
                            F.count(F.when((F.col("_least") == 0) & (F.col("_new") > 0), 1)).alias("replaced"))
    return merged.select(*key, "_row.*").select(*cols), seen


def extend_dimension(dim: DataFrame, names: DataFrame, name_col: str = "nombre") -> DataFrame:
    """J4 on a dimension: names not present yet are appended with the next ids
    (in name order); existing ids never change."""
    from pyspark.sql.window import Window
    new = names.select(F.col(name_col)).dropna().distinct().join(dim.select(name_col), name_col, "left_anti")
    top = dim.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]      # one scalar
    # the new names are distinct dimension members (a handful), ranked once
    added = new.select((F.lit(top) + F.row_number().over(Window.orderBy(name_col))).cast("int").alias("id"),
                       name_col)
    return dim.select("id", name_col).unionByName(added)


# -- J6 ---------------------------------------------------------------------

def pair_predictions(pred: DataFrame, actual: DataFrame, key=("lottery", "fecha")) -> DataFrame:
    """Prediction next to the real draw (inner equi-join on the draw key)."""
    a = actual.select(*key, F.col("result").alias("real_result"),
                      F.col("series").alias("real_series"))
    return pred.join(a, list(key))


# -- S7 / A3 ----------------------------------------------------------------

def bulk_load(target_fact: DataFrame, draws: DataFrame, loterias: DataFrame, signos: DataFrame,
              order: str = "k", failed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Staged bulk insert that ignores key conflicts.

    P5 → J2 → J4 on ``(fecha, loteria_id)``.  Returns (new fact table, report
    rows per lottery: read, rejected, inserted, skipped; ``failed`` lotteries
    report −1).
    """
    lot = loterias.select(F.col("id").alias("loteria_id"), F.col("nombre").alias("_lk"))
    sig = signos.select(F.col("id").alias("signo_id"), F.col("codigo").alias("_sk"))
    j = draws.join(lot, draws["lottery"] == F.col("_lk"), "left").join(sig, draws["series"] == F.col("_sk"), "left")
    whole = F.lit(True)
    for c in ESSENTIAL:
        whole = whole & F.col(c).isNotNull()
    what = (F.when(~whole, "incomplete").when(F.col("loteria_id").isNull() | F.col("signo_id").isNull(), "rejected")
            .otherwise("candidate"))
    fact_cols = ["fecha", "loteria_id", "result", "signo_id"]
    # each row is looked up and tagged once; the load and the report read the tags
    tagged = store(j.select(*fact_cols, "lottery", order, what.alias("what")), "tagged")
    first = dedupe_first(tagged.where("what = 'candidate'").drop("what"), ["fecha", "loteria_id"], [order])
    inserted = first.join(target_fact.select("fecha", "loteria_id"), ["fecha", "loteria_id"], "left_anti")
    merged = target_fact.select(*fact_cols).unionByName(inserted.select(*fact_cols))
    events = tagged.select("lottery", F.explode(F.array_compact(F.array(
        F.lit("read"), F.when(F.col("what") == "rejected", F.col("what"))))).alias("what")) \
        .unionByName(inserted.select("lottery", F.lit("inserted").alias("what")))
    return merged, load_report(events, failed)


def load_report(events: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """A3: per lottery counts of read / rejected / inserted rows, skipped = read −
    rejected − inserted; a failed lottery reports −1 and is left out of the total."""
    per = events.groupBy("lottery").agg(
        F.sum((F.col("what") == "read").cast("bigint")).alias("read"),
        F.sum((F.col("what") == "rejected").cast("bigint")).alias("rejected"),
        F.sum((F.col("what") == "inserted").cast("bigint")).alias("inserted"))
    per = per.withColumn("skipped", F.col("read") - F.col("rejected") - F.col("inserted"))
    if failed is not None:
        f = failed.select("lottery", F.lit(True).alias("_failed"))
        per = per.join(f, "lottery", "left")
        for c in ("read", "rejected", "inserted", "skipped"):
            per = per.withColumn(c, F.when(F.col("_failed"), F.lit(-1)).otherwise(F.col(c)))
        per = per.drop("_failed")
    total = per.filter(F.col("inserted") >= 0).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("read", "rejected", "inserted", "skipped")]) \
        .select(F.lit("TOTAL").alias("lottery"), "read", "rejected", "inserted", "skipped")
    return per.unionByName(total)
