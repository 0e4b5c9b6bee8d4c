"""History features per series: lags, digits, differences, streak, rolling
statistics, trend, digit sums, recent frequency and recency (41 columns).

Input: a draw table with ``lottery`` (series key), ``seq`` (1-based position,
see :mod:`sequence`), ``fecha`` (DATE) and ``result`` (0..9999).

Two physical forms give identical values:

* **plain** (``block_rows=None``): windows by ``lottery`` and by
  ``(lottery, result)``.  Parallelism is the number of series.
* **block + halo** (``block_rows=B``): rows are cut into blocks of ``B``
  consecutive draws; each block also receives the last ``halo`` rows of the
  previous block and the first row of the next one, so every bounded frame
  (lags ≤ 7, rolling ≤ 31 rows, frequency ≤ 90 rows, lead 1) is answered
  inside one ``(lottery, block)`` partition.  Task size is bounded by
  ``B + halo + 1`` however long (or skewed) a series is.  The two features
  with unbounded look-back get a carry from earlier blocks through small
  per-block tables: the start of the current up/down run (``racha``, from a
  narrow 2-row-halo pass), and the last date each number came
  (``dias_desde_ultimo``, injected as one virtual row per block and number).

``mode='recorded'`` returns the feature row of every draw (column parity with
the reference: many of these columns contain the draw's own result).
``mode='as_of'`` adds the next draw as the label (``target``,
``target_series``, ``target_fecha``); the last row of a series has a null
label and is the row to score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..session import shuffle_partitions

# The 41 feature names, in the reference's column order.
FEATURE_COLUMNS = [
    "result_lag_1", "result_lag_2", "result_lag_3", "result_lag_5", "result_lag_7",
    "lag1_miles", "lag1_centenas", "lag1_decenas", "lag1_unidades",
    "lag2_miles", "lag2_centenas", "lag2_decenas", "lag2_unidades",
    "lag3_miles", "lag3_centenas", "lag3_decenas", "lag3_unidades",
    "diff_1", "diff_2", "diff_abs_1", "signo_diff_1",
    "racha",
    "rolling_mean_7", "rolling_std_7", "rolling_mean_30", "rolling_std_30",
    "rolling_max_7", "rolling_min_7", "rolling_range_7",
    "lag1_sobre_media_7", "lag1_sobre_media_30", "lag1_z_score_30",
    "tendencia_7", "tendencia_30",
    "lag1_suma_digitos", "lag1_suma_digitos_par",
    "lag1_unidades_par",
    "freq_10", "freq_30", "freq_90",
    "dias_desde_ultimo",
]

DOUBLE_FEATURES = {"rolling_mean_7", "rolling_std_7", "rolling_mean_30", "rolling_std_30",
                   "lag1_z_score_30"}

DIGIT_NAMES = ["miles", "centenas", "decenas", "unidades"]
DIGIT_PLACES = [1000, 100, 10, 1]

LAGS = (1, 2, 3, 5, 7)
MAX_LOOKBACK = 90           # longest bounded frame (freq_90)
DEFAULT_BLOCK_ROWS = 1 << 16


def digit(c: Column, place: int) -> Column:
    """Digit of a non-negative integer at a decimal place (1000, 100, 10, 1)."""
    return (F.floor(c / F.lit(place)) % 10).cast("int")


def _prefix_columns(w: WindowSpec) -> list[Column]:
    """Running sums, row index and first value inside the window partition.

    Rolling means and deviations are differences of these (O(1) per row);
    sliding aggregate frames would re-aggregate every frame row for every row.
    Sums are exact 64-bit integers (values < 10^4, frames ≤ 31 rows).
    """
    r = F.col("result").cast("bigint")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    return [F.sum(r).over(upto).alias("_s1"), F.sum(r * r).over(upto).alias("_s2"),
            F.row_number().over(w).alias("_c"), F.first("result").over(upto).alias("_first")]


def _frame_stats(w: WindowSpec, lo: int, hi: int) -> tuple[Column, Column]:
    """Mean and sample standard deviation of ``result`` over rows i+lo .. i+hi
    (hi = 0 or -1), from the running sums; null where the frame has too few rows."""
    def frame_sum(c):
        upper = F.col(c) if hi == 0 else F.lag(c, -hi).over(w)
        lower = F.lag(c, -lo + 1).over(w)
        return F.coalesce(upper, F.lit(0)) - F.coalesce(lower, F.lit(0))
    n = F.least(F.lit(hi - lo + 1), F.col("_c") + hi).cast("bigint")
    s1, s2 = frame_sum("_s1"), frame_sum("_s2")
    mean = F.when(n > 0, s1 / n)
    var = (n * s2 - s1 * s1).cast("double") / (n * (n - 1)).cast("double")
    std = F.when(n >= 2, F.sqrt(var))
    return mean, std


def _bounded_columns(w: WindowSpec, wr: WindowSpec) -> dict[str, Column]:
    """Every feature whose frame reaches at most ``MAX_LOOKBACK`` rows back.

    Expects the ``_prefix_columns`` of ``w`` on the input."""
    r = F.col("result")
    lag = {k: F.lag(r, k).over(w) for k in LAGS}
    c: dict[str, Column] = {}
    for k in LAGS:
        c[f"result_lag_{k}"] = lag[k]
    for k in (1, 2, 3):
        v = F.coalesce(lag[k], F.lit(0))
        for name, place in zip(DIGIT_NAMES, DIGIT_PLACES):
            c[f"lag{k}_{name}"] = digit(v, place)
    d1 = r - lag[1]
    c["diff_1"] = d1
    c["diff_2"] = lag[1] - lag[2]
    c["diff_abs_1"] = F.abs(d1)
    c["signo_diff_1"] = F.signum(d1).cast("int")

    c["rolling_mean_7"], c["rolling_std_7"] = _frame_stats(w, -6, 0)
    c["rolling_mean_30"], c["rolling_std_30"] = _frame_stats(w, -29, 0)
    mx7 = F.max(r).over(w.rowsBetween(-6, 0))
    mn7 = F.min(r).over(w.rowsBetween(-6, 0))
    c["rolling_max_7"] = mx7
    c["rolling_min_7"] = mn7
    c["rolling_range_7"] = mx7 - mn7

    lag1 = F.coalesce(lag[1], F.lit(0))
    prev_mean7, _ = _frame_stats(w, -7, -1)
    prev_mean30, prev_std30 = _frame_stats(w, -30, -1)
    prev_mean7 = F.coalesce(prev_mean7, F.lit(0.0))
    prev_mean30 = F.coalesce(prev_mean30, F.lit(0.0))
    c["lag1_sobre_media_7"] = (lag1 > prev_mean7).cast("int")
    c["lag1_sobre_media_30"] = (lag1 > prev_mean30).cast("int")
    c["lag1_z_score_30"] = (lag1 - prev_mean30) / F.when(
        prev_std30.isNull() | (prev_std30 == 0), F.lit(1.0)).otherwise(prev_std30)

    has_two = lag[1].isNotNull()
    for n in (7, 30):
        # first row of the n-row frame: n-1 rows back, or the partition's first row
        first = F.coalesce(F.lag(r, n - 1).over(w), F.col("_first"))
        c[f"tendencia_{n}"] = F.when(has_two & (r > first), 1).otherwise(0)

    suma = sum(digit(lag1, p) for p in DIGIT_PLACES)
    c["lag1_suma_digitos"] = suma
    c["lag1_suma_digitos_par"] = (suma % 2 == 0).cast("int")
    c["lag1_unidades_par"] = (lag1 % 10 % 2 == 0).cast("int")

    for n in (10, 30, 90):
        c[f"freq_{n}"] = F.count(F.lit(1)).over(wr.rangeBetween(-n, -1))
    return c


def _finish(df: DataFrame, passthrough: list[str], mode: str) -> DataFrame:
    """0-fill, fixed types, and the optional next-draw label."""
    out = []
    for name in FEATURE_COLUMNS:
        typ = "double" if name in DOUBLE_FEATURES else "int"
        out.append(F.coalesce(F.col(name).cast(typ), F.lit(0).cast(typ)).alias(name))
    labels = ["target", "target_series", "target_fecha"] if mode == "as_of" else []
    return df.select(*passthrough, *out, *labels)


def features(draws: DataFrame, mode: str = "recorded", block_rows: int | None = DEFAULT_BLOCK_ROWS,
             halo: int = MAX_LOOKBACK, keep: tuple[str, ...] = (),
             materialize_input: bool = True) -> DataFrame:
    """The 41 features per draw (see module doc).

    ``block_rows=None`` selects the plain window form (one task per series).
    ``keep``: extra input columns carried to the output (e.g. ``series``).
    ``materialize_input`` (block form): the narrow input is read by the main
    pass and by both carry passes; it is checkpointed once so the source scan
    and the ``seq`` derivation run once.  Pass ``False`` when the input is
    already a stored table.
    """
    if mode not in ("recorded", "as_of"):
        raise ValueError(f"mode must be 'recorded' or 'as_of', not {mode!r}")
    if block_rows is not None and block_rows <= halo:
        raise ValueError("block_rows must exceed the halo")
    need_series = mode == "as_of" or "series" in keep
    cols = ["lottery", "seq", "fecha", "result"] + (["series"] if need_series else []) + \
        [k for k in keep if k not in ("series",)]
    base = draws.select(*dict.fromkeys(cols))
    passthrough = list(dict.fromkeys(["lottery", "seq", "fecha", "result", *keep]))
    if block_rows is None:
        return _finish(_plain(base, mode), passthrough, mode)
    if materialize_input:
        from ..session import checkpoint
        base = checkpoint(base)
    return _finish(_blocked(base, mode, block_rows, halo), passthrough, mode)


def _labels(w: WindowSpec) -> list[Column]:
    return [F.lead("result").over(w).alias("target"),
            F.lead("series").over(w).alias("target_series"),
            F.lead("fecha").over(w).alias("target_fecha")]


def _plain(base: DataFrame, mode: str) -> DataFrame:
    w = Window.partitionBy("lottery").orderBy("seq")
    wr = Window.partitionBy("lottery", "result").orderBy("seq")
    bounded = _bounded_columns(w, wr)
    s = F.coalesce(F.signum(F.col("result") - F.lag("result").over(w)), F.lit(0.0)).cast("int")
    step1 = base.select("*", *_prefix_columns(w)) \
        .select("*", *[v.alias(k) for k, v in bounded.items()], s.alias("_s"),
                        F.datediff("fecha", F.lag("fecha").over(wr)).alias("dias_desde_ultimo"),
                        *(_labels(w) if mode == "as_of" else []))
    prev_s = F.lag("_s").over(w)
    cp = F.when(prev_s.isNull() | (F.col("_s") != prev_s), F.col("seq"))
    step2 = step1.withColumn("_cp", cp)
    start = F.max("_cp").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return step2.withColumn("racha", (F.col("_s") * (F.col("seq") - start + 1)).cast("int"))


VIRTUAL_SEQ = -(10 ** 15)       # sorts before every real row, outside every range frame


def _blocked(base: DataFrame, mode: str, B: int, H: int) -> DataFrame:
    seq = F.col("seq")
    own = F.floor((seq - 1) / F.lit(B)).cast("bigint")
    pos = (seq - 1) % B
    targets = F.concat(
        F.array(own),
        F.when(pos >= B - H, F.array(own + 1)).otherwise(F.array().cast("array<bigint>")),
        F.when((pos == 0) & (own > 0), F.array(own - 1)).otherwise(F.array().cast("array<bigint>")))
    real = base.withColumn("_own", own).withColumn("_virtual", F.lit(False)) \
        .select("*", F.explode(targets).alias("_block"))

    # last-seen carry as data: for every (block, number) that occurs in the
    # block, one virtual row holding the number's last date in earlier blocks.
    # It sorts first among that number's rows, so lag picks it up when the
    # block and halo hold no earlier occurrence; it is dropped before the
    # row-frame windows, which therefore never see it.
    last_in_block = base.groupBy("lottery", own.alias("_block"), "result") \
        .agg(F.max_by("fecha", "seq").alias("_last"))
    by_number = Window.partitionBy("lottery", "result").orderBy("_block")
    virtual = last_in_block.select("lottery", "_block", "result",
                                   F.lag("_last").over(by_number).alias("fecha")) \
        .filter(F.col("fecha").isNotNull()) \
        .select("lottery", F.lit(VIRTUAL_SEQ).cast("bigint").alias("seq"), "fecha", "result",
                *[F.lit(None).cast(base.schema[c].dataType).alias(c)
                  for c in base.columns if c not in ("lottery", "seq", "fecha", "result")],
                F.lit(-1).cast("bigint").alias("_own"), F.lit(True).alias("_virtual"), "_block")
    # one shuffle by (lottery, block) serves both window families: it clusters
    # (lottery, block, number) too.  The partition count is the session's own
    # setting: the stage is CPU-bound (about 40 window functions per row), and a
    # byte-based coalesce would pack many blocks into few tasks.
    n_parts = shuffle_partitions(base.sparkSession)
    exp = real.unionByName(virtual).repartition(n_parts, "lottery", "_block")

    w = Window.partitionBy("lottery", "_block").orderBy("seq")
    wr = Window.partitionBy("lottery", "_block", "result").orderBy("seq")
    bounded = _bounded_columns(w, wr)
    per_number = {k: bounded.pop(k) for k in ("freq_10", "freq_30", "freq_90")}
    # 1) per-number windows, virtual rows included (they sit outside every range frame)
    step_a = exp.select("*", *[v.alias(k) for k, v in per_number.items()],
                        F.lag("fecha").over(wr).alias("_prev_fecha")) \
        .filter(~F.col("_virtual"))
    # 2) row-frame windows over real rows only (same partitioning, no shuffle)
    s = F.coalesce(F.signum(F.col("result") - F.lag("result").over(w)), F.lit(0.0)).cast("int")
    step1 = step_a.select("*", *_prefix_columns(w)) \
        .select("*", *[v.alias(k) for k, v in bounded.items()], s.alias("_s"),
                *(_labels(w) if mode == "as_of" else []))
    prev_s = F.lag("_s").over(w)
    is_own = F.col("_block") == F.col("_own")
    # change points only on the block's own rows: the first halo row has no lag
    cp = F.when(is_own & (prev_s.isNull() | (F.col("_s") != prev_s)), F.col("seq"))
    step2 = step1.withColumn("_cp", cp) \
        .withColumn("_start", F.max("_cp").over(w.rowsBetween(Window.unboundedPreceding, 0))) \
        .filter(is_own)
    joined = step2.join(_run_carry(base, B), ["lottery", "_block"], "left")
    start = F.coalesce(F.col("_start"), F.col("_carry_start"))
    return joined.withColumn("racha", (F.col("_s") * (seq - start + 1)).cast("int")) \
        .withColumn("dias_desde_ultimo", F.datediff("fecha", F.col("_prev_fecha")))


def _run_carry(base: DataFrame, B: int) -> DataFrame:
    """Per block, the start of the up/down run in progress when the block
    begins: the last change point of any earlier block.  A narrow pass over
    (lottery, seq, result) with a 2-row halo finds each block's last change
    point; a prefix max over the (small) per-block table carries it forward."""
    seq = F.col("seq")
    own = F.floor((seq - 1) / F.lit(B)).cast("bigint")
    pos = (seq - 1) % B
    blocks = F.when(pos >= B - 2, F.array(own, own + 1)).otherwise(F.array(own))
    nb = base.select("lottery", "seq", "result", own.alias("_own")).select("*", F.explode(blocks).alias("_block"))
    w = Window.partitionBy("lottery", "_block").orderBy("seq")
    sgn = F.coalesce(F.signum(F.col("result") - F.lag("result").over(w)), F.lit(0.0))
    steps = nb.select("lottery", "seq", "_own", "_block", sgn.alias("_s"))
    prev = F.lag("_s").over(w)
    cps = steps.select("lottery", "_block", F.when(
        (F.col("_block") == F.col("_own")) & (prev.isNull() | (F.col("_s") != prev)), F.col("seq")).alias("_cp"))
    per_block = cps.groupBy("lottery", "_block").agg(F.max("_cp").alias("_bcp"))
    earlier = Window.partitionBy("lottery").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return per_block.select("lottery", "_block", F.max("_bcp").over(earlier).alias("_carry_start"))
