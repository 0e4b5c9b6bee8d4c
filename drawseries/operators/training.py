"""Training-history analytics and model registry ranking
(A7, A8, W43, W44, T6–T9).

History rows: ``(run_id, lottery, attempt, result_acc, series_acc,
result_f1, series_f1, ts)``; the attempts of a run are numbered 1, 2, ...

A run may hold any share of the rows, so no window runs over a whole run.  Running
values are two-level segmented scans: attempts are cut into blocks of ``BLOCK``;
each block's totals are aggregated, prefixed over the blocks of a run (a table
``BLOCK`` times smaller), and carried into the windows inside the blocks.  The
frames of W43 are bounded, so blocks get the last rows of the block before as a
halo.  T9 ranks by range partitions.  Registry ranking is ``row_number`` per
group, which Spark plans with a partial group limit before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import store
from .sequence import add_seq

# Default thresholds of the reference's production profile.
MIN_ACCURACY = 0.05
CONVERGENCE_WINDOW = 50
CONVERGENCE_RANGE = 0.002
MIN_ATTEMPT = 5
PATIENCE = 5
ELITE = 2
#: Attempts in a block of the segmented scans.
BLOCK = 4096


def _blocked(history: DataFrame, rows: int) -> DataFrame:
    return history.withColumn("_b", F.floor((F.col("attempt") - 1) / rows).cast("long"))


def _carried(rows: DataFrame, run: str, totals: dict) -> DataFrame:
    """``rows`` with, for each name of ``totals``, what the earlier blocks of the run amount to.

    ``totals``: name -> (aggregate of a block's rows, aggregate of the blocks' values).
    """
    blocks = rows.groupBy(run, "_b").agg(*[agg.alias(n) for n, (agg, _) in totals.items()])
    before = Window.partitionBy(run).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = store(blocks.select(F.col(run).alias("_run"), F.col("_b").alias("_block"),
                                *[over(n).over(before).alias(n) for n, (_, over) in totals.items()]), "carry")
    return rows.join(carry, rows[run].eqNullSafe(carry["_run"]) & (rows["_b"] == carry["_block"])).drop("_run", "_block")


def _inside(run: str) -> Window:
    return Window.partitionBy(run, "_b").orderBy("attempt")


def _first_stop(flagged: DataFrame, flag: str, run: str) -> DataFrame:
    """``flagged`` with stop_attempt: the first attempt of the run where ``flag`` holds, or null."""
    flagged = store(flagged, "flagged")
    first = store(flagged.where(flag).groupBy(F.col(run).alias("_run")).agg(F.min("attempt").alias("stop_attempt")), "stops")
    return flagged.join(first, flagged[run].eqNullSafe(first["_run"]), "left").drop("_run")


# -- A7 ---------------------------------------------------------------------

def training_summary(history: DataFrame, run: str = "run_id") -> DataFrame:
    """Per run iterations, best / mean / first / last accuracy per target,
    improvement (best − first), best F1, duration and attempts per second."""
    aggs = [F.count(F.lit(1)).alias("iterations")]
    for t in ("result", "series"):
        acc = f"{t}_acc"
        aggs += [F.max(acc).alias(f"best_{t}_acc"), F.avg(acc).alias(f"mean_{t}_acc"),
                 F.min_by(acc, "attempt").alias(f"first_{t}_acc"),
                 F.max_by(acc, "attempt").alias(f"last_{t}_acc"),
                 F.coalesce(F.max(f"{t}_f1"), F.lit(0.0)).alias(f"best_{t}_f1")]
    aggs += [F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts")]
    out = history.groupBy(run, "lottery").agg(*aggs)
    for t in ("result", "series"):
        out = out.withColumn(f"improvement_{t}", F.col(f"best_{t}_acc") - F.col(f"first_{t}_acc"))
    secs = F.unix_timestamp(F.col("end_ts").cast("timestamp")) - F.unix_timestamp(F.col("start_ts").cast("timestamp"))
    return out.withColumn("duration_sec", secs) \
        .withColumn("attempts_per_sec", F.when(secs > 0, F.col("iterations") / secs))


# -- A8 ---------------------------------------------------------------------

def _improvements(history: DataFrame, run: str, rows: int) -> DataFrame:
    """The columns of A8 and ``_last``, the attempt of the latest improvement so far (0: none)."""
    best = {f"_c_{t}": (F.max(f"{t}_acc"), F.max) for t in ("result", "series")}
    j = _carried(_blocked(history, rows), run, best)
    before = _inside(run).rowsBetween(Window.unboundedPreceding, -1)
    upto = _inside(run).rowsBetween(Window.unboundedPreceding, 0)
    prev = {t: F.coalesce(F.greatest(f"_c_{t}", F.max(f"{t}_acc").over(before), F.lit(0.0)), F.lit(0.0)) for t in ("result", "series")}
    step = store(j.select(*history.columns, "_b", *[(F.col(f"{t}_acc") > prev[t]).alias(f"improved_{t}") for t in prev],
                          *[F.greatest(prev[t], f"{t}_acc").alias(f"best_{t}") for t in prev]), "improved")
    either = F.col("improved_result") | F.col("improved_series")
    at = F.when(either, F.col("attempt"))
    got = _carried(step, run, {"_c_n": (F.sum(either.cast("int")), F.sum), "_c_at": (F.max(at), F.max)})
    return got.withColumn("improvements", F.coalesce("_c_n", F.lit(0)) + F.coalesce(F.sum(either.cast("int")).over(upto), F.lit(0))) \
        .withColumn("_last", F.coalesce(F.greatest("_c_at", F.max(at).over(upto)), F.lit(0))).drop("_c_n", "_c_at", "_b")


def running_best(history: DataFrame, run: str = "run_id", block_rows: int = BLOCK) -> DataFrame:
    """Best so far per target (starting at 0), strict-improvement flags and
    the running count of attempts where either target improved."""
    return _improvements(history, run, block_rows).drop("_last")


# -- W43 --------------------------------------------------------------------

def converged(history: DataFrame, min_acc: float = MIN_ACCURACY, window: int = CONVERGENCE_WINDOW,
              tol: float = CONVERGENCE_RANGE, run: str = "run_id", block_rows: int = BLOCK) -> DataFrame:
    """Flag attempts where training would stop for convergence, and the
    first such attempt per run (``stop_attempt``)."""
    size = max(block_rows, window)
    rows = _blocked(history, size)
    # a block's last rows are also the halo of the next
    late = F.col("attempt") - F.col("_b") * size > size - (window - 1)
    rows = rows.withColumn("_t", F.explode(F.when(late, F.array("_b", F.col("_b") + 1)).otherwise(F.array("_b"))))
    last = Window.partitionBy(run, "_t").orderBy("attempt").rowsBetween(1 - window, 0)
    flags = rows.select(
        "*", F.count(F.lit(1)).over(last).alias("_n"),
        (F.max("result_acc").over(last) - F.min("result_acc").over(last)).alias("range_result"),
        (F.max("series_acc").over(last) - F.min("series_acc").over(last)).alias("range_series")).where("_t = _b")
    cond = ((F.col("attempt") >= MIN_ATTEMPT) & (F.col("result_acc") >= min_acc)
            & (F.col("series_acc") >= min_acc) & (F.col("_n") == window)
            & (F.col("range_result") < tol) & (F.col("range_series") < tol))
    return _first_stop(flags.withColumn("converged", cond).drop("_n", "_b", "_t"), "converged", run)


# -- W44 --------------------------------------------------------------------

def plateau(history: DataFrame, patience: int = PATIENCE, run: str = "run_id", block_rows: int = BLOCK) -> DataFrame:
    """Generations since either global best last rose; ``stop`` when that
    count reaches ``patience``; ``stop_attempt`` = first stop per run."""
    out = _improvements(history, run, block_rows).withColumn("since_improvement", F.col("attempt") - F.col("_last")).drop("_last")
    return _first_stop(out.withColumn("stop", F.col("since_improvement") >= patience), "stop", run)


# -- registry views ---------------------------------------------------------

def registry_long(history: DataFrame) -> DataFrame:
    """One registry row per (model, target): ``target``, ``accuracy``, ``f1``."""
    return history.select("*", F.explode(F.array(
        F.struct(F.lit("result").alias("target"), F.col("result_acc").alias("accuracy"),
                 F.col("result_f1").alias("f1")),
        F.struct(F.lit("series").alias("target"), F.col("series_acc").alias("accuracy"),
                 F.col("series_f1").alias("f1")))).alias("_t")) \
        .select("run_id", "lottery", "attempt", "k", "ts", "_t.*")


def best_model(registry: DataFrame, order: str = "k") -> DataFrame:
    """Per (lottery, target) the highest accuracy (missing = 0); on ties the
    first registered wins."""
    acc = F.coalesce(F.col("accuracy"), F.lit(0.0))
    key = F.struct(acc.alias("a"), (-F.col(order)).alias("o"))
    cols = [c for c in registry.columns if c not in ("lottery", "target")]
    return registry.groupBy("lottery", "target").agg(
        F.max_by(F.struct(*cols), key).alias("_b")).select("lottery", "target", "_b.*")


def keep_two_slots(registry: DataFrame, slots: int = 2, order: str = "k") -> DataFrame:
    """Models kept after registering in ``order``: a free slot is taken,
    otherwise the worst is replaced only by a strictly better model — i.e. the
    top ``slots`` by accuracy, older first on ties."""
    w = Window.partitionBy("lottery", "target").orderBy(
        F.coalesce(F.col("accuracy"), F.lit(0.0)).desc(), F.col(order).asc())
    return registry.withColumn("slot", F.row_number().over(w)).filter(F.col("slot") <= slots)


def retain_top_runs(history: DataFrame, n: int = 3) -> DataFrame:
    """Runs ranked per lottery by the mean of their best result and best
    series accuracy (missing = 0); the top ``n`` are kept."""
    per_run = history.groupBy("lottery", "run_id").agg(
        F.coalesce(F.max("result_acc"), F.lit(0.0)).alias("best_result"),
        F.coalesce(F.max("series_acc"), F.lit(0.0)).alias("best_series"))
    scored = per_run.withColumn("score", (F.col("best_result") + F.col("best_series")) / 2)
    w = Window.partitionBy("lottery").orderBy(F.col("score").desc(), F.col("run_id").asc())
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def leaderboard(candidates: DataFrame, group: str = "run_id", fitness: str = "result_acc",
                elite: int = ELITE) -> DataFrame:
    """Rank candidates of a generation by fitness; the first ``elite`` pass
    unchanged, the top half (at least 2) forms the mating pool."""
    # ranks come from range partitions of (group, fitness): a group of any size is spread over tasks
    falling = candidates.withColumn("_less", F.coalesce(-F.col(fitness), F.lit(float("inf"))))
    ranked = add_seq(falling, group, ["_less", "attempt"], "rank").drop("_less")
    sizes = store(candidates.groupBy(F.col(group).alias("_group")).agg(F.count(F.lit(1)).alias("population")), "sizes")
    return ranked.join(sizes, ranked[group].eqNullSafe(sizes["_group"])).drop("_group") \
        .withColumn("is_elite", F.col("rank") <= elite) \
        .withColumn("in_pool", F.col("rank") <= F.greatest(F.lit(2), F.floor(F.col("population") / 2)))
