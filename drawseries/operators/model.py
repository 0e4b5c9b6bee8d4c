"""Per-series digit and sign classifiers on MLlib.

Training rows are the leak-free ``as_of`` feature rows (features of draw i,
label = draw i+1); the last row of every series has no label and is the row
to score.  Five classifiers per series: one per digit of the next number and
one for its sign, each with "balanced" class weights (A6).

The assembled rows are written once, as Parquet in folders by series (and by
split), in the pass that makes the features: a fit, a holdout and the newest
rows each read their own folders and columns.  MLlib makes several passes over
its input, so a series' training rows are decoded once and kept while its five
targets are fitted; each fit is itself a distributed job.
"""

from __future__ import annotations

import random
from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint, store, store_by
from . import boosted_fit as BF
from . import forest_fit as FF
from .features import FEATURE_COLUMNS, features
from .rank import top3_classes, top3_numbers
from .stats import classification_report, with_balanced_weights

DIGITS = ["miles", "centenas", "decenas", "unidades"]
PLACES = [1000, 100, 10, 1]
TARGETS = [f"y_{d}" for d in DIGITS] + ["y_series"]
MLLIB_MAX_DEPTH = 30


# -- H1 ---------------------------------------------------------------------

def random_split(df: DataFrame, test_size: float, seed: int, key=("lottery", "seq")) -> DataFrame:
    """H1: ``is_test`` from a hash of the row key and the seed — the same rows
    for every target, independent of partitioning and computed alike by any SQL
    engine (MD5); the share is approximate."""
    text = F.concat_ws(":", *[F.col(k).cast("string") for k in key], F.lit(str(seed)))
    h = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") % 1000
    return df.withColumn("is_test", h < int(round(1000 * test_size)))


# -- training frame ---------------------------------------------------------

def sign_labels_of(df: DataFrame, column: str) -> list[str]:
    """The signs of a column in alphabetical order, nulls left out."""
    return list(StringIndexer(inputCol=column, outputCol="_sign", stringOrderType="alphabetAsc", handleInvalid="keep").fit(
        df.filter(F.col(column).isNotNull())).labels)


def with_labels(as_of: DataFrame, sign_labels: list[str]) -> DataFrame:
    """Labels (4 digits + sign index; null without a next draw) and the feature vector of every row."""
    df = as_of
    for d, p in zip(DIGITS, PLACES):
        df = df.withColumn(f"y_{d}", F.when(F.col("target").isNotNull(),
                                            (F.floor(F.col("target") / p) % 10).cast("double")))
    code = F.array_position(F.array(*[F.lit(s) for s in sign_labels]), F.col("target_series"))
    df = df.withColumn("y_series", F.when(code > 0, (code - 1).cast("double")))
    return VectorAssembler(inputCols=FEATURE_COLUMNS, outputCol="features").transform(df)


def training_frame(as_of: DataFrame, sign_labels: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Labels (4 digits + sign index) and the feature vector.

    Class weights are left to the fit, which sees the training rows only.  The sign index is alphabetical over every sign present (P13); returned
    with the frame so predictions can be decoded.
    """
    if sign_labels is None:
        sign_labels = sign_labels_of(as_of, "target_series")
    return with_labels(as_of, sign_labels).filter(F.col("target").isNotNull()), sign_labels


#: Draws of a block of the models' features: with halo and carried rows a block stays in a window's memory
#: (``session.BASE_CONF``), and the carried rows, one a number, weigh less than in shorter blocks.
MODEL_BLOCK_ROWS = 8192

#: Columns of a stored frame, beside its folders (lottery, labelled and, if split, is_test).
STORED = ["seq", "fecha", "target", "features", *TARGETS]


def stored_frame(draws: DataFrame, test_size: float | None = None, split_seed: int = 42,
                 block_rows: int = MODEL_BLOCK_ROWS) -> tuple[DataFrame, DataFrame, list[str]]:
    """(labelled rows, newest rows, sign labels) of a stored draw table.

    The as-of features, labels and vectors are made and written in one pass, in folders by
    lottery and by whether the row has a label; with ``test_size`` the labelled rows also carry
    ``is_test`` (H1) and its two values have folders of their own.  The sign labels come from the
    draws that are some draw's next, so the features are not made twice for them.
    """
    labels = sign_labels_of(draws.filter(F.col("seq") > 1), "series")
    rows = with_labels(features(draws, mode="as_of", block_rows=block_rows, materialize_input=False), labels)
    by = ["lottery", "labelled"]
    rows = rows.withColumn("labelled", F.col("target").isNotNull())
    if test_size is not None:
        rows, by = random_split(rows, test_size, split_seed), [*by, "is_test"]
    stored = store_by(rows.select(*STORED, *by), by, "frame")
    train, latest = stored.filter("labelled"), stored.filter("not labelled")
    return train.drop("labelled"), latest.drop("labelled", "is_test"), labels


def split_frame(frame: DataFrame, test_size: float, seed: int) -> DataFrame:
    """H1 of a frame in folders by lottery and ``is_test``; a frame that was split when it was stored is that already."""
    if "is_test" in frame.columns:
        return frame
    rest = [c for c in frame.columns if c != "lottery"]
    return store_by(random_split(frame, test_size, seed).select(*rest, "lottery", "is_test"), ["lottery", "is_test"], "split")


@dataclass
class Candidate:
    """H4 hyper-parameters; ``max_depth=None`` means the MLlib maximum."""
    n_estimators: int = 20
    max_depth: int | None = 8
    min_samples_split: int = 2
    seed: int = 42
    algorithm: str = "rf"
    learning_rate: float = 0.1
    subsample: float = 1.0
    extra: dict = field(default_factory=dict)

    @property
    def mllib_depth(self) -> int:
        return MLLIB_MAX_DEPTH if self.max_depth is None else min(self.max_depth, MLLIB_MAX_DEPTH)

    @property
    def mllib_min_rows(self) -> int:
        """min_samples_split is approximated by minInstancesPerNode (children of a split)."""
        return max(1, self.min_samples_split // 2)

    def estimator(self, label: str, weight: str | None):
        depth, min_inst = self.mllib_depth, self.mllib_min_rows
        tag = label[2:]
        if self.algorithm == "rf":
            return RandomForestClassifier(
                labelCol=label, featuresCol="features", weightCol=weight, numTrees=self.n_estimators,
                maxDepth=depth, minInstancesPerNode=min_inst, seed=self.seed,
                predictionCol=f"pred_{tag}", probabilityCol=f"prob_{tag}", rawPredictionCol=f"raw_{tag}")
        if self.algorithm == "gbt":
            gbt = GBTClassifier(featuresCol="features", maxIter=self.n_estimators, maxDepth=min(depth, 30),
                                stepSize=self.learning_rate, subsamplingRate=self.subsample,
                                minInstancesPerNode=min_inst, seed=self.seed)
            return OneVsRest(classifier=gbt, labelCol=label, featuresCol="features",
                             predictionCol=f"pred_{tag}", parallelism=2)
        raise ValueError(self.algorithm)

    def forest_plan(self, label: str, weights, limit: int | None = None):
        """The forest of :meth:`estimator` to grow on binned rows, with a weight for each class."""
        return FF.Plan(TARGETS.index(label), weights, self.n_estimators, self.mllib_depth, self.mllib_min_rows, self.seed, limit)


# -- H2 / H13 ---------------------------------------------------------------

def weighted(train: DataFrame) -> DataFrame:
    """Balanced class weights of the rows that are trained on, unless present."""
    if f"w_{TARGETS[0]}" in train.columns:
        return train
    return checkpoint(with_balanced_weights(train, TARGETS, key="lottery"))


def fit_targets(train: DataFrame, cand: Candidate, targets=TARGETS) -> dict:
    """One classifier per target on ``train``, which has its class weights if the algorithm takes any."""
    return {t: cand.estimator(t, f"w_{t}" if cand.algorithm == "rf" else None).fit(train.filter(F.col(t).isNotNull()))
            for t in targets}


def fit_digit_models(train: DataFrame, cand: Candidate, targets=TARGETS) -> dict:
    """H2: one classifier per target on ``train`` (all rows given)."""
    return fit_targets(weighted(train) if cand.algorithm == "rf" else train, cand, targets)


def warm_start_fit(train: DataFrame, cand: Candidate, lotteries: list[str], extra_trees: int = 50, stored: bool = False) -> dict:
    """Every lottery's models refitted with ``extra_trees`` more trees (a fitted forest is not grown in place)."""
    bigger = Candidate(**{**cand.__dict__, "n_estimators": cand.n_estimators + extra_trees})
    return fit_per_lottery(train, bigger, lotteries, stored=stored)


def fit_per_lottery(train: DataFrame, cand: Candidate, lotteries: list[str], parallelism: int = 10, stored: bool = False) -> dict:
    """H2 per series: every lottery is trained on its own draws.

    A series reads its own folder only: ``stored`` says that ``train`` is in folders by lottery
    (:func:`stored_frame`, :func:`split_frame`); else its columns are written so first.  Each fit is a distributed MLlib job.  A series' rows and class
    weights are decoded once and kept for its five targets.  Two series are in work at a time, and
    ``parallelism`` fits: a fit is many short jobs, so fewer leave the cluster idle.  Each fit keeps a
    copy of the rows in bins (about 300 bytes a row, spilled by Spark if memory is short).
    Boosted models of all series, targets and classes grow in the same passes (:mod:`boosted_fit`).
    """
    from concurrent.futures import ThreadPoolExecutor
    if cand.algorithm == "gbt":
        return BF.fit_boosted(train, cand, lotteries, TARGETS, cand.mllib_depth, cand.mllib_min_rows)
    weights = [f"w_{t}" for t in TARGETS] if cand.algorithm == "rf" else []
    if not stored:
        given = [w for w in weights if w in train.columns]
        train = store_by(train.select("features", *TARGETS, *given, "lottery"), ["lottery"], "training")
    if weights and weights[0] not in train.columns:
        train = with_balanced_weights(train.select("features", *TARGETS, "lottery"), TARGETS, key="lottery")
    narrow = train.select("features", *TARGETS, *weights, "lottery")

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as fits, ThreadPoolExecutor(max_workers=2) as series:
        def fit(lot):
            rows = narrow.filter(F.col("lottery") == lot).drop("lottery").persist()
            try:
                return dict(fits.map(lambda t: (t, fit_targets(rows, cand, [t])[t]), TARGETS))
            finally:
                rows.unpersist()
        return dict(zip(lotteries, series.map(fit, lotteries)))


def fit_candidates(train: DataFrame, candidates: list[Candidate], lotteries: list[str]) -> list[dict]:
    """H4: the models of every candidate, series and target on the same rows, in folders by lottery.

    The forests of all candidates of a series grow in the same passes (:mod:`forest_fit`).
    """
    out: list[dict] = [None if c.algorithm == "rf" else fit_per_lottery(train, c, lotteries, stored=True) for c in candidates]
    forests = [i for i, c in enumerate(candidates) if c.algorithm == "rf"]
    if not forests:
        return out
    mine = train.filter(F.col("lottery").isin(lotteries))
    edges, counts = FF.split_candidates(mine), FF.label_counts(mine, TARGETS)
    binned = FF.binned_rows(mine, TARGETS, edges)
    plans = {lot: [candidates[i].forest_plan(t, FF.balanced(FF.classes_below(counts[lot], None, t))) for i in forests for t in TARGETS]
             for lot in lotteries}
    grown = FF.fit_series(binned, edges, plans)
    for n, i in enumerate(forests):
        out[i] = {lot: dict(zip(TARGETS, grown[lot][n * len(TARGETS):])) for lot in lotteries}
    return out


# -- H3 ---------------------------------------------------------------------

def apply_models(df: DataFrame, models: dict) -> DataFrame:
    """Append ``pred_*`` and ``prob_*`` (as arrays) for every target."""
    out = df
    for t, m in models.items():
        n_feat = getattr(m, "numFeatures", len(FEATURE_COLUMNS))
        if n_feat != len(FEATURE_COLUMNS):
            raise ValueError(f"model for {t} expects {n_feat} features, frame has {len(FEATURE_COLUMNS)}")
    if models and all(isinstance(m, (FF.Forest, BF.Boosted)) for m in models.values()):
        return FF.apply_forests(df, models)
    for t, m in models.items():
        tag = t[2:]
        if hasattr(m, "models"):
            out = apply_one_vs_rest(out, m, tag)
            continue
        out = m.transform(out)
        if f"prob_{tag}" in out.columns:
            out = out.withColumn(f"prob_{tag}", vector_to_array(f"prob_{tag}"))
        out = out.drop(f"raw_{tag}", "rawPrediction")
    return out


def apply_one_vs_rest(df: DataFrame, model, tag: str) -> DataFrame:
    """``prob_<tag>`` and ``pred_<tag>`` of one-vs-rest boosted trees.

    Each binary model's margin m gives its class's chance 1 / (1 + exp(-2 m)), as the model
    itself has it; the chances are divided by their sum.  Ties go to the smaller class.
    """
    out, margins = df, []
    for c, binary in enumerate(model.models):
        raw = f"_raw_{tag}_{c}"
        one = binary.copy().setFeaturesCol("features").setRawPredictionCol(raw).setProbabilityCol("").setPredictionCol("")
        out = one.transform(out)
        margins.append(F.element_at(vector_to_array(raw), 2))
    chances = F.array(*[1 / (1 + F.exp(-2 * m)) for m in margins])
    out = out.withColumn("_chances", chances).drop(*[f"_raw_{tag}_{c}" for c in range(len(model.models))])
    total = F.aggregate("_chances", F.lit(0.0), lambda a, x: a + x)
    prob = F.transform("_chances", lambda x: x / total)
    return out.withColumn(f"prob_{tag}", prob).drop("_chances") \
        .withColumn(f"pred_{tag}", (F.array_position(f"prob_{tag}", F.array_max(f"prob_{tag}")) - 1).cast("double"))


def top_numbers(scored: DataFrame, by: list[str]) -> DataFrame:
    """T4 over model probabilities: the three best numbers of each group ``by``."""
    long = scored.select(*by, F.posexplode(F.array(*[F.col(f"prob_{d}") for d in DIGITS])).alias("position", "_p")) \
        .select(*by, "position", F.posexplode("_p").alias("digit", "score"))
    return top3_numbers(long, by)


def predict_number(scored: DataFrame) -> DataFrame:
    """H3: argmax digit per position, recomposed into the 4-digit number."""
    num = sum(F.col(f"pred_{d}").cast("int") * p for d, p in zip(DIGITS, PLACES))
    return scored.withColumn("pred_number", num)


def score(df: DataFrame, per_lottery_models: dict) -> DataFrame:
    parts = [apply_models(df.filter(F.col("lottery") == lot), m) for lot, m in per_lottery_models.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return predict_number(out)


def accuracy_table(scored: DataFrame) -> DataFrame:
    """A4 over model predictions: per lottery, per-digit, result (mean of digits)
    and sign accuracy."""
    aggs = [F.avg((F.col(f"pred_{d}") == F.col(f"y_{d}")).cast("double")).alias(f"{d}_acc") for d in DIGITS]
    out = scored.groupBy("lottery").agg(
        F.count(F.lit(1)).alias("n"), *aggs,
        F.avg((F.col("pred_series") == F.col("y_series")).cast("double")).alias("series_acc"))
    return out.withColumn("result_acc", sum(F.col(f"{d}_acc") for d in DIGITS) / 4)


def macro_f1(scored: DataFrame) -> DataFrame:
    """A5 over model predictions: per lottery macro F1 of the sign, and the mean
    over the four digits' macro F1 as that of the result."""
    rows = scored.select("lottery", F.explode(F.array(*[
        F.struct(F.lit("series" if t == "series" else "result").alias("target"), F.lit(t).alias("part"),
                 F.col(f"y_{t}").cast("int").alias("y"), F.col(f"pred_{t}").cast("int").alias("p"))
        for t in [*DIGITS, "series"]])).alias("_e")).select("lottery", "_e.*")
    keyed = rows.withColumn("key", F.concat_ws("\u0001", "lottery", "target", "part"))
    per = classification_report(keyed, "y", "p", key="key").groupBy("key").agg(F.first("macro_f1").alias("f1"))
    names = F.split("key", "\u0001")
    return per.groupBy(names[0].alias("lottery"), names[1].alias("target")).agg(F.avg("f1").alias("f1"))


# -- H4 ---------------------------------------------------------------------

# Hyper-parameter grids (test profile, production profile).
GRID_TEST = {"n_estimators": [10, 20], "max_depth": [5, 8], "min_samples_split": [2], "seed": [42]}
GRID_PROD = {"n_estimators": [50, 100, 150, 200, 300], "max_depth": [5, 10, 15, 20, None],
             "min_samples_split": [2, 5, 10, 20], "seed": [42]}


def draw_candidates(grid: dict, n: int, rng_seed: int = 0) -> list[Candidate]:
    """Random draw of ``n`` candidates from the grid (driver-side parameters)."""
    rng = random.Random(rng_seed)
    out = []
    for _ in range(n):
        algorithm = rng.choice(grid["algorithm"]) if "algorithm" in grid else "rf"
        boosted = {k: rng.choice(grid[k]) for k in ("learning_rate", "subsample") if algorithm == "gbt" and k in grid}
        out.append(Candidate(n_estimators=rng.choice(grid["n_estimators"]), max_depth=rng.choice(grid["max_depth"]),
                             min_samples_split=rng.choice(grid["min_samples_split"]), seed=rng.randrange(10000),
                             algorithm=algorithm, **boosted))
    return out


def search(frame: DataFrame, candidates: list[Candidate], test_size: float = 0.2, split_seed: int = 42,
           lotteries: list[str] | None = None) -> DataFrame:
    """H4: evaluate every candidate on one shared holdout; returns a results
    table ``(candidate, lottery, params…, *_acc)``.  The best per target is
    chosen independently from this table (T6/T9)."""
    split = split_frame(frame, test_size, split_seed)
    train, test = split.filter(~F.col("is_test")), split.filter(F.col("is_test"))
    lotteries = lotteries or [r[0] for r in split.select("lottery").distinct().collect()]
    fitted = fit_candidates(train, candidates, lotteries)
    test = test.select("lottery", "features", *TARGETS)
    results = None
    for i, cand in enumerate(candidates):
        acc = accuracy_table(score(test, fitted[i])).select(
            F.lit(i).alias("candidate"), "*", F.lit(cand.n_estimators).alias("n_estimators"),
            F.lit(cand.max_depth).cast("int").alias("max_depth"),
            F.lit(cand.min_samples_split).alias("min_samples_split"), F.lit(cand.seed).alias("seed"))
        acc = store(acc, "search")           # a row a series: what reads the results does not score the holdout again
        results = acc if results is None else results.unionByName(acc)
    return results


HISTORY = ("run_id string, lottery string, attempt int, result_acc double, series_acc double, result_f1 double, "
           "series_f1 double, ts timestamp, algorithm string, n_estimators int, max_depth int, min_samples_split int, seed int")


def search_history(frame: DataFrame, candidates, log: str, run_id: str, patience: int, test_size: float = 0.2,
                   split_seed: int = 42, lotteries: list[str] | None = None) -> DataFrame:
    """H4 live: candidates are tried one after the other, each attempt is appended to ``log``, and a
    lottery is searched no further once W44 finds its plateau in the log.

    One lottery's attempts are one run (``run_id`` and the lottery's name).  Returns the log's rows of
    the run; A7, A8, W43, W44 and T8 take them as they are.  ``log`` is a folder of append-only files.
    """
    from .training import plateau
    spark = frame.sparkSession
    split = split_frame(frame, test_size, split_seed)
    train, test = split.filter(~F.col("is_test")), split.filter(F.col("is_test"))
    if any(c.algorithm == "rf" for c in candidates):     # weights are a series' own: those of the ended ones do not matter
        train = with_balanced_weights(train.select("features", *TARGETS, "lottery"), TARGETS, key="lottery")
    todo = lotteries or [r[0] for r in split.select("lottery").distinct().collect()]
    mine = F.col("run_id").startswith(f"{run_id}/")
    for i, cand in enumerate(candidates):
        if not todo:
            break
        scored = checkpoint(score(test, fit_per_lottery(train.filter(F.col("lottery").isin(todo)), cand, todo, stored=True)).select(
            "lottery", *[f"{p}_{t}" for t in [*DIGITS, "series"] for p in ("y", "pred")]))
        f1 = macro_f1(scored).groupBy("lottery").agg(*[
            F.max(F.when(F.col("target") == t, F.col("f1"))).alias(f"{t}_f1") for t in ("result", "series")])
        attempt = accuracy_table(scored).join(f1, "lottery").select(
            F.concat(F.lit(f"{run_id}/"), "lottery").alias("run_id"), "lottery", F.lit(i + 1).alias("attempt"), "result_acc",
            "series_acc", "result_f1", "series_f1", F.current_timestamp().alias("ts"), F.lit(cand.algorithm).alias("algorithm"),
            F.lit(cand.n_estimators).alias("n_estimators"), F.lit(cand.max_depth).cast("int").alias("max_depth"),
            F.lit(cand.min_samples_split).alias("min_samples_split"), F.lit(cand.seed).alias("seed"))
        attempt.write.mode("append").json(log)
        history = spark.read.schema(HISTORY).json(log).where(mine)
        stopped = {r.lottery for r in plateau(history, patience).where("stop_attempt is not null").select("lottery").distinct().collect()}
        todo = [lot for lot in todo if lot not in stopped]
    return spark.read.schema(HISTORY).json(log).where(mine)


# -- H6 / H7 ----------------------------------------------------------------

def predict_latest(frame_all: DataFrame, models: dict, sign_labels: list[str]) -> tuple[DataFrame, DataFrame]:
    """H6: score the last row of every series; returns (top-3 numbers, top-3 signs)."""
    latest = frame_all.filter(F.col("target").isNull())
    scored = score(latest, models)
    numbers = top_numbers(scored, ["lottery"])
    signs = top3_classes(scored, proba="prob_series").withColumn(
        "sign", F.element_at(F.array(*[F.lit(s) for s in sign_labels]), F.col("cls") + 1))
    return numbers, signs


def prediction_records(numbers: DataFrame, signs: DataFrame, model_name: str = "rf") -> DataFrame:
    """Nested prediction record per series: top-1 number (4 characters) and
    sign, the top-3 lists with probabilities, confidence (top-1 probability),
    model name and timestamp — the S4 log layout."""
    n = numbers.groupBy("lottery").agg(F.array_sort(F.collect_list(
        F.struct("rank", F.struct(F.col("number").alias("value"), F.col("prob").alias("prob")).alias("v")))).alias("_n"))
    s = signs.groupBy("lottery").agg(F.array_sort(F.collect_list(
        F.struct("rank", F.struct(F.col("sign").alias("value"), F.col("prob").alias("prob")).alias("v")))).alias("_s"))
    top_n = F.transform("_n", lambda x: x["v"])
    top_s = F.transform("_s", lambda x: x["v"])
    return n.join(s, "lottery").select(
        "lottery", F.lpad(top_n[0]["value"].cast("string"), 4, "0").alias("numero"),
        top_s[0]["value"].alias("serie"), top_n.alias("top3_numeros"), top_s.alias("top3_signos"),
        top_n[0]["prob"].alias("confianza"), F.lit(model_name).alias("modelo"),
        F.current_timestamp().alias("timestamp"))


def score_dates(frame_all: DataFrame, models: dict, start: str | None = None, end: str | None = None,
                next_n: int | None = None, dates: list[str] | None = None) -> DataFrame:
    """H7: one prediction row per (date, lottery) from each series' latest
    state (the features carry no calendar input).  Dates: the range
    ``[start, end]``, the ``next_n`` days after each series' last draw, or an
    explicit list."""
    latest = predict_number(score(frame_all.filter(F.col("target").isNull()), models))
    if dates is not None:
        days = F.array(*[F.lit(d).cast("date") for d in dates])
    elif next_n is not None:
        days = F.sequence(F.date_add("fecha", 1), F.date_add("fecha", next_n))
    else:
        days = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))
    spine = latest.select("lottery", "pred_number", F.explode(days).alias("_day"))
    return spine.select(F.col("_day").alias("fecha"), "lottery",
                        F.lpad(F.col("pred_number").cast("string"), 4, "0").alias("numero"))


def eligible_lotteries(frame: DataFrame, min_rows: int = 50) -> list[str]:
    """Series with at least ``min_rows`` training rows (P11 gate before H6)."""
    counts = frame.groupBy("lottery").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_rows)
    return [r[0] for r in counts.select("lottery").orderBy("lottery").collect()]


def select_best(results: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """H4: best candidate per (lottery, target), chosen independently for the
    result score and the sign score (strictly better wins, so the earlier
    candidate keeps ties).  With a registry, its best entry is the warm
    baseline a candidate has to beat."""
    long = results.select("lottery", "candidate", F.explode(F.array(
        F.struct(F.lit("result").alias("target"), F.col("result_acc").alias("accuracy")),
        F.struct(F.lit("series").alias("target"), F.col("series_acc").alias("accuracy")))).alias("_t")) \
        .select("lottery", F.col("candidate").cast("bigint").alias("candidate"), "_t.*")
    if registry is not None:
        from .training import best_model
        reg = best_model(registry)
        long = long.unionByName(reg.select("lottery", F.lit(-1).cast("bigint").alias("candidate"),
                                           "target", "accuracy"))
    key = F.struct(F.coalesce(F.col("accuracy"), F.lit(0.0)).alias("a"), (-F.col("candidate")).alias("c"))
    return long.groupBy("lottery", "target").agg(
        F.max_by(F.struct("candidate", "accuracy"), key).alias("_b")).select("lottery", "target", "_b.*")


# -- H11 --------------------------------------------------------------------

def feature_importance(model, top: int = 10, names=FEATURE_COLUMNS) -> list[tuple[str, float]]:
    """The ``top`` features by importance (driver-side model metadata)."""
    imp = model.featureImportances.toArray()
    return sorted(zip(names, map(float, imp)), key=lambda x: (-x[1], x[0]))[:top]
