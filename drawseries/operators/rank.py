"""Ordering, latest rows, top-k and set operations.

Top-k per group is ``row_number() <= k`` over a window: Spark plans it with
a partial group limit *before* the shuffle (``WindowGroupLimit``), so only
``k`` rows per group and map partition cross the network even when one group
holds most of the data.  The digit-combination ranking of T4 works inside one
row per series with array functions (2 candidates × 4 positions = 16 combos).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def order_by_date(df: DataFrame, descending: bool = False) -> DataFrame:
    """Output ordering only."""
    return df.orderBy(F.col("fecha").desc() if descending else F.col("fecha").asc())


def latest_row(df: DataFrame, key: str = "lottery", order: str = "seq") -> DataFrame:
    """The last row of every series (the row to score)."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(key, "_r.*")


def last_n(df: DataFrame, n: int, key: str | None = "lottery", order: str = "seq") -> DataFrame:
    """Last ``n`` rows per key (or overall when ``key`` is None)."""
    if key is None:
        return df.orderBy(F.col(order).desc()).limit(n)
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def first_n(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """First ``n`` rows overall (TakeOrdered)."""
    return df.orderBy(*order).limit(n)


def top3_numbers(scores: DataFrame, key: str | list[str] = "lottery", per_position: int = 2,
                 k: int = 3) -> DataFrame:
    """T4: from per-(position, digit) scores, the ``k`` best 4-digit numbers.

    Per position the two best digits (score desc, smaller digit on ties); the
    16 combinations score the product of their four probabilities; the best
    three are kept (ties → smaller number).
    """
    keys = [key] if isinstance(key, str) else list(key)
    w = Window.partitionBy(*keys, "position").orderBy(F.col("score").desc(), F.col("digit").asc())
    best = scores.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= per_position)
    per_key = best.groupBy(*keys).agg(*[
        F.array_sort(F.collect_list(F.when(F.col("position") == p,
                                           F.struct(F.col("digit").alias("d"), F.col("score").alias("s")))))
        .alias(f"_p{p}") for p in range(4)])

    # nested transforms build all combinations as (−prob, number) structs
    def units(a, b, c):
        return F.transform(F.col("_p3"), lambda d: F.struct(
            (-(a["s"] * b["s"] * c["s"] * d["s"])).alias("neg_prob"),
            (a["d"] * 1000 + b["d"] * 100 + c["d"] * 10 + d["d"]).alias("number")))

    def tens(a, b):
        return F.flatten(F.transform(F.col("_p2"), lambda c: units(a, b, c)))

    def hundreds(a):
        return F.flatten(F.transform(F.col("_p1"), lambda b: tens(a, b)))

    def combos():
        return F.flatten(F.transform(F.col("_p0"), hundreds))

    ranked = per_key.select(*keys, F.slice(F.array_sort(combos()), 1, k).alias("_top"))
    return ranked.select(*keys, F.posexplode("_top").alias("_i", "_c")).select(
        *keys, (F.col("_i") + 1).alias("rank"), F.col("_c.number").alias("number"),
        (-F.col("_c.neg_prob")).alias("prob"))


def top3_classes(df: DataFrame, proba: str = "proba", k: int = 3, keys=("lottery",)) -> DataFrame:
    """T5: the ``k`` most probable classes of a probability array (class = index)."""
    pairs = F.transform(F.col(proba), lambda p, i: F.struct((-p).alias("neg_p"), i.alias("cls")))
    top = F.slice(F.array_sort(pairs), 1, k)
    return df.select(*keys, F.posexplode(top).alias("_i", "_c")).select(
        *keys, (F.col("_i") + 1).alias("rank"), F.col("_c.cls").alias("cls"),
        (-F.col("_c.neg_p")).alias("prob"))


def concat_lotteries(frames: list[DataFrame]) -> DataFrame:
    """UNION ALL by column name."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def distinct_values(df: DataFrame, cols: list[str]) -> DataFrame:
    """U2."""
    return df.select(*cols).distinct()
