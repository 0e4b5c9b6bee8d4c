"""Aggregations over draws and prediction pairs.

Look-back statistics pair a draw with the draws before it through block
windows with a halo (:func:`blocked_lags`), one shuffle however long a series.  Every aggregate is
a partial+final hash aggregation keyed on the lottery.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.clean import DIGIT_COLUMNS, digits
from ..session import store

POSITIONS = DIGIT_COLUMNS


# -- A1 / A2 ----------------------------------------------------------------

def profile(draws: DataFrame) -> DataFrame:
    """A1: rows, first and last date, distinct lotteries, sorted distinct signs.

    The sign list is a ``collect_set`` over a domain of a dozen codes, so the
    buffer is bounded by the domain, not by the data.
    """
    return draws.agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("fecha").alias("min_fecha"),
        F.max("fecha").alias("max_fecha"), F.countDistinct("lottery").alias("n_lotteries"),
        F.array_join(F.sort_array(F.collect_set("series")), ",").alias("signs"))


def count_by_lottery(draws: DataFrame) -> DataFrame:
    """A2."""
    return draws.groupBy("lottery").agg(F.count(F.lit(1)).alias("n"))


# -- shifted pairs ----------------------------------------------------------

LAG_BLOCK = 4096


def persistence_predictions(draws: DataFrame) -> DataFrame:
    """"Repeat the previous draw" as a prediction for every draw but the first."""
    row = F.struct("result", "series")
    return blocked_lags(draws.select("lottery", "fecha", "seq", "result", "series", row.alias("_row")), "_row", 1, LAG_BLOCK) \
        .where("seq > 1").select(
        "lottery", "fecha", "seq", F.col("result").alias("real"),
        F.col("series").alias("real_series"), F.col("lag_1.result").alias("pred"),
        F.col("lag_1.series").alias("pred_series"))


def digit_hits(pred: str, real: str) -> list:
    return [(F.floor(F.col(pred) / p) % 10 == F.floor(F.col(real) / p) % 10).cast("double")
            for p in (1000, 100, 10, 1)]


# -- A4 ---------------------------------------------------------------------

def accuracy(pairs: DataFrame, key: str = "lottery") -> DataFrame:
    """A4: per-digit accuracy, result score (mean of the 4 digit accuracies),
    exact-number accuracy and sign accuracy."""
    hits = digit_hits("pred", "real")
    aggs = [F.avg(h).alias(f"{n}_acc") for h, n in zip(hits, POSITIONS)]
    out = pairs.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), *aggs,
        F.avg((F.col("pred") == F.col("real")).cast("double")).alias("exact_acc"),
        F.avg((F.col("pred_series") == F.col("real_series")).cast("double")).alias("series_acc"))
    return out.withColumn("result_acc", sum(F.col(f"{n}_acc") for n in POSITIONS) / 4)


# -- A5 ---------------------------------------------------------------------

def classification_report(pairs: DataFrame, y: str, p: str, key: str = "lottery") -> DataFrame:
    """A5: per class precision, recall, F1, support, plus macro F1 per key.

    Classes are those seen in truth or prediction; 0/0 gives 0.  Built from
    the confusion counts (one aggregation), marginals derived from them.
    """
    conf = pairs.groupBy(key, F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    per_class = conf.select(key, F.explode(F.array(
        F.struct(F.col("y").alias("cls"), F.col("n").alias("sup"), F.lit(0).cast("bigint").alias("prd"),
                 F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("tp")),
        F.struct(F.col("p").alias("cls"), F.lit(0).cast("bigint").alias("sup"), F.col("n").alias("prd"),
                 F.lit(0).cast("bigint").alias("tp")))).alias("e")) \
        .groupBy(key, F.col("e.cls").alias("cls")).agg(
            F.sum("e.sup").alias("support"), F.sum("e.prd").alias("predicted"), F.sum("e.tp").alias("tp"))
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    out = per_class.withColumn("precision", prec).withColumn("recall", rec)
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    out = out.withColumn("f1", f1)
    macro = out.groupBy(key).agg(F.avg("f1").alias("macro_f1"))
    return out.join(macro, key)


# -- A6 ---------------------------------------------------------------------

def balanced_weights(df: DataFrame, label: str, key: str = "lottery") -> DataFrame:
    """Class weight n / (k · n_c) per key and class (scikit-learn's "balanced")."""
    counts = df.groupBy(key, label).agg(F.count(F.lit(1)).alias("n_c"))
    totals = counts.groupBy(key).agg(F.sum("n_c").alias("n"), F.count(F.lit(1)).alias("k"))
    return counts.join(totals, key).withColumn(
        "weight", F.col("n") / (F.col("k") * F.col("n_c")))


def with_balanced_weights(df: DataFrame, labels: list[str], key: str = "lottery",
                          prefix: str = "w_") -> DataFrame:
    """A6 for several label columns at once: ``<prefix><label>`` weight columns.

    One aggregation over a long (key, label name, class) table, folded into a
    per-key map bounded by (labels × classes), joined back once.
    """
    # written, so that the planner knows the (small) size and need not shuffle the rows
    out = df.join(store(balanced_maps(df, labels, [key]), "class-weights"), key, "left")
    for c in labels:
        out = out.withColumn(prefix + c, weight_of(F.col("_wm"), c))
    return out.drop("_wm")


def balanced_maps(df: DataFrame, labels: list[str], keys: list[str]) -> DataFrame:
    """(keys, ``_wm``), a map from label name and class to the weight; :func:`weight_of` reads it."""
    long = df.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(c).alias("_t"), F.col(c).cast("string").alias("_v")) for c in labels])).alias("_e")) \
        .select(*keys, "_e._t", "_e._v").where(F.col("_v").isNotNull())
    counts = long.groupBy(*keys, "_t", "_v").agg(F.count(F.lit(1)).alias("_nc"))
    tot = counts.groupBy(*keys, "_t").agg(F.sum("_nc").alias("_n"), F.count(F.lit(1)).alias("_k"))
    w = counts.join(tot, [*keys, "_t"]).select(
        *keys, F.concat_ws("\u0001", "_t", "_v").alias("_kv"), (F.col("_n") / (F.col("_k") * F.col("_nc"))).alias("_w"))
    return w.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_kv", "_w"))).alias("_wm"))


def weight_of(weights, label: str):
    """The weight of a row's class of ``label`` in a map of :func:`balanced_maps`; null without a class."""
    return F.try_element_at(weights, F.concat_ws("\u0001", F.lit(label), F.col(label).cast("string")))


# -- A9 / A11 ---------------------------------------------------------------

def safe_corr(df: DataFrame, key: str, pairs: list[tuple[str, str, str]]) -> DataFrame:
    """Pearson correlation per key for each (x, y, alias); null where x or y is
    constant within the key (Spark's ``corr`` would divide by zero under ANSI).

    One aggregation: covariance over the root of both variances, all over the
    rows that have both values.
    """
    out = []
    for x, y, alias in pairs:
        both = F.col(x).isNotNull() & F.col(y).isNotNull()
        vx, vy = [F.var_pop(F.when(both, F.col(c).cast("double"))) for c in (x, y)]
        spread = F.sqrt(vx) * F.sqrt(vy)
        out.append((F.covar_pop(F.col(x).cast("double"), F.col(y).cast("double"))
                    / F.nullif(spread, F.lit(0.0))).alias(alias))
    return df.groupBy(key).agg(*out)


def lag_corr(draws: DataFrame, k: int = 1, block_rows: int = LAG_BLOCK) -> DataFrame:
    """Pearson correlation of a series with its lag-k: result, first
    difference, units digit, digit sum; one blocked pass serves all four."""
    d = blocked_lags(draws.select("lottery", "seq", "result"), "result", k + 1, block_rows).where(F.col("seq") > k)

    def four(now, before, prefix=""):
        return [now.alias(f"{prefix}result"), (now - before).alias(f"{prefix}diff"), (now % 10).alias(f"{prefix}units"),
                sum(F.floor(now / p) % 10 for p in (1000, 100, 10, 1)).alias(f"{prefix}dsum")]
    x = d.select("lottery", *four(F.col("result"), F.col("lag_1")),
                 *four(F.col(f"lag_{k}"), F.col(f"lag_{k + 1}"), "prev_"))
    return safe_corr(x, "lottery", [(c, f"prev_{c}", f"corr_{c}") for c in ("result", "diff", "units", "dsum")])


def digit_corr(draws: DataFrame) -> DataFrame:
    """The six pairwise correlations of the four digits, per lottery."""
    d = draws.select("lottery", *digits("result"))
    pairs = [(a, b) for i, a in enumerate(POSITIONS) for b in POSITIONS[i + 1:]]
    return safe_corr(d, "lottery", [(a, b, f"corr_{a}_{b}") for a, b in pairs])


# -- A10 --------------------------------------------------------------------

def blocked_lags(df: DataFrame, value: str, max_lag: int, block_rows: int,
                 key: str = "lottery") -> DataFrame:
    """``lag_1 .. lag_<max_lag>`` of ``value`` per series, computed in blocks.

    Rows are cut in blocks of ``block_rows`` consecutive positions; each block
    also receives the previous block's last ``max_lag`` rows (halo), so the
    lags come from a bounded ``(key, block)`` window however long the series.
    """
    if block_rows <= max_lag:
        raise ValueError("block_rows must exceed max_lag")
    own = F.floor((F.col("seq") - 1) / F.lit(block_rows)).cast("bigint")
    pos = (F.col("seq") - 1) % block_rows
    blocks = F.when(pos >= block_rows - max_lag, F.array(own, own + 1)).otherwise(F.array(own))
    exp = df.withColumn("_own", own).select("*", F.explode(blocks).alias("_block"))
    w = Window.partitionBy(key, "_block").orderBy("seq")
    lagged = exp.select("*", *[F.lag(value, k).over(w).alias(f"lag_{k}") for k in range(1, max_lag + 1)])
    return lagged.filter(F.col("_block") == F.col("_own")).drop("_block", "_own")


def acf(draws: DataFrame, nlags: int = 60, threshold: float = 0.15, value: str = "result",
        block_rows: int = 4096) -> DataFrame:
    """A10: biased autocorrelation (overall mean, divided by c0) for lags 0..nlags;
    ``is_peak`` marks lags ≥ 1 whose absolute value exceeds ``threshold``."""
    # centred algebraically, so that no mean has to be joined back to the rows:
    # sum (x - m)(x_k - m) = sum x x_k - m (sum x + sum x_k) + n_k m^2, over rows that have a lag k
    lagged = blocked_lags(draws.select("lottery", "seq", F.col(value).cast("double").alias("x")), "x", nlags, block_rows)
    sums = [F.avg("x").alias("m"), F.sum("x").alias("s_0"), F.sum(F.col("x") * F.col("x")).alias("p_0"), F.count("x").alias("n_0")]
    for k in range(1, nlags + 1):
        lag = F.col(f"lag_{k}")
        sums += [F.sum(F.col("x") * lag).alias(f"p_{k}"), F.count(lag).alias(f"n_{k}"),
                 F.sum(F.when(lag.isNotNull(), F.col("x") + lag)).alias(f"s_{k}")]
    m = F.col("m")
    stacked = lagged.groupBy("lottery").agg(*sums).select(
        "lottery", (F.col("p_0") - m * m * F.col("n_0")).alias("c0"), F.explode(F.array(*[
            F.struct(F.lit(k).alias("lag"), F.coalesce(
                F.col(f"p_{k}") - m * F.col(f"s_{k}") * (2 if k == 0 else 1) + m * m * F.col(f"n_{k}"),
                F.lit(0.0)).alias("ck")) for k in range(0, nlags + 1)])).alias("e"))
    # a constant series has c0 = 0: its autocorrelation is undefined (null)
    out = stacked.select("lottery", F.col("e.lag").alias("lag"),
                         F.when(F.col("c0") != 0, F.col("e.ck") / F.col("c0")).alias("acf"))
    return out.withColumn("is_peak", F.coalesce((F.col("lag") >= 1) & (F.abs("acf") > threshold),
                                                F.lit(False)))


# -- A13 --------------------------------------------------------------------

def baselines(draws: DataFrame) -> DataFrame:
    """Chance levels and the "repeat the previous draw" hit rates, with lift."""
    seen = draws.groupBy("lottery").agg(
        F.countDistinct("result").alias("classes_seen"),
        F.countDistinct("series").alias("signs_seen"))
    pairs = persistence_predictions(draws)
    acc = accuracy(pairs).select(
        "lottery", F.col("n").alias("n_pairs"), F.col("exact_acc").alias("repeat_exact"),
        F.col("result_acc").alias("repeat_digit"), F.col("series_acc").alias("repeat_sign"))
    out = seen.join(acc, "lottery")
    return out.select(
        "*", (1.0 / F.col("classes_seen")).alias("chance_exact"), F.lit(0.1).alias("chance_digit"),
        (1.0 / F.col("signs_seen")).alias("chance_sign"),
        (F.col("repeat_exact") * F.col("classes_seen")).alias("lift_exact"),
        (F.col("repeat_digit") / 0.1).alias("lift_digit"))
