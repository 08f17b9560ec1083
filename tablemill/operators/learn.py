"""The model behind the rule: fitted and asked only about tables the rule passed."""

from __future__ import annotations

import math
import random
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions.ranking import exact_rank, stratified_folds
from ..sources.tables import TABLE_KEY
from . import boosting
from .store import stored

SEED = 42
# ---------------------------------------------------------------- fixed values: model settings
FOREST = dict(numTrees=200, maxDepth=15, minInstancesPerNode=2, featureSubsetStrategy="sqrt")
MODELS = {
    "Random Forest": "forest", "XGBoost": "boosting", "LightGBM": "boosting",
    "CatBoost": "boosting", "SVM (RBF)": "rbf", "Logistic Regression": "logistic",
}
BALANCED = {"Random Forest", "CatBoost", "SVM (RBF)", "Logistic Regression"}
LOGISTIC_ITERATIONS = 1000
LANDMARKS = 64         # features of the RBF kernel
AT_ONCE = 4            # fits of a cross-validation
SAMPLE = 2000          # rows that landmarks are chosen from


def encoder(rows: DataFrame, label: str = "verification"):
    """Label <-> index, alphabetical: genuine 0, no genuine 1."""
    return StringIndexer(inputCol=label, outputCol="target", stringOrderType="alphabetAsc",
                         handleInvalid="error").fit(rows)


def class_weights(rows: DataFrame, label: str = "verification") -> DataFrame:
    """n / (k * n_class) per label: as many rows as there are labels."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n_class"))
    total = counts.agg(F.sum("n_class").alias("n"), F.count("*").alias("k"))
    return (counts.crossJoin(F.broadcast(total))        # one row
            .select(label, "n_class", (F.col("n") / (F.col("k") * F.col("n_class")))
                    .alias("weight")))


def _weight(rows: DataFrame, all_rows: DataFrame, name: str, labels: list[str]) -> Column:
    """Weight of a row as a ``when`` over the labels (two of them)."""
    if name in BALANCED:
        found = {r["verification"]: r["weight"] for r in class_weights(rows).collect()}
    else:                       # the second label counts as often as the labels are unequal
        counts = [r["n_class"] for r in class_weights(all_rows).collect()]
        found = {labels[-1]: max(counts) / min(counts)}
    out = F.lit(1.0)
    for label, weight in found.items():
        out = F.when(F.col("verification") == label, weight).otherwise(out)
    return out


def farthest_points(points: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` of the points, each the farthest from those before it; fewer if there are not so many places."""
    chosen = [0]
    away = ((points - points[0]) ** 2).sum(axis=1)
    while len(chosen) < n and away.max() > 1e-12:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return points[chosen]


def kernel_map(sample: np.ndarray, gamma: float, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(landmarks, root): k(x, landmarks) times ``root`` are features whose products are nearly the RBF kernel,
    and the kernel itself between landmarks."""
    marks = farthest_points(sample, n)
    kernel = np.exp(-gamma * ((marks[:, None] - marks[None]) ** 2).sum(axis=2))
    values, vectors = np.linalg.eigh(kernel)
    held = values > 1e-10 * values.max()
    return marks, (vectors[:, held] / np.sqrt(values[held])) @ vectors[:, held].T


def _kernel_stage(rows: DataFrame) -> SQLTransformer:
    """RBF kernel by landmarks, for gamma = 1 / (number of features * variance over all values).

    Landmarks come from a sample of at most ``SAMPLE`` rows, drawn by a digest of
    the key; only these rows reach the driver.
    """
    spread = rows.select(F.explode(F.array(*fixed.FEATURES)).alias("x")).agg(F.var_pop("x")).first()[0] or 1.0
    gamma = 1.0 / (len(fixed.FEATURES) * spread)
    drawn = rows.orderBy(F.xxhash64(*TABLE_KEY, F.lit(SEED))).limit(SAMPLE).select(*fixed.FEATURES).collect()
    marks, root = kernel_map(np.asarray(drawn, float).reshape(-1, len(fixed.FEATURES)) if drawn
                             else np.zeros((1, len(fixed.FEATURES))), gamma, LANDMARKS)

    def listed(values) -> str:
        return "array(" + ", ".join(f"{float(v)!r}D" for v in values) + ")"
    values = "array(" + ", ".join(f"CAST(`{f}` AS DOUBLE)" for f in fixed.FEATURES) + ")"
    near = (f"transform(array({', '.join(map(listed, marks))}), m -> exp({-gamma!r}D * aggregate("
            f"zip_with(m, {values}, (a, b) -> (a - b) * (a - b)), 0D, (s, x) -> s + x)))")
    terms = [f"aggregate(zip_with(_near, {listed(line)}, (a, b) -> a * b), 0D, (s, x) -> s + x) AS rbf_{i}"
             for i, line in enumerate(root)]
    terms += [f"0D AS rbf_{i}" for i in range(len(root), LANDMARKS)]
    return SQLTransformer(statement=f"SELECT *, {', '.join(terms)} FROM (SELECT *, {near} AS _near FROM __THIS__)")


def _stages(name: str, rows: DataFrame, settings: dict) -> list:
    kind = MODELS[name]
    common = dict(featuresCol="features", labelCol="target", weightCol="weight")
    plain = VectorAssembler(inputCols=fixed.FEATURES, outputCol="features")
    if kind == "forest":
        return [plain, RandomForestClassifier(**common, **{**FOREST, "seed": SEED, **settings})]
    if kind == "boosting":
        made = boosting.fit(stored(rows.select(*TABLE_KEY, *fixed.FEATURES, "target", "weight"), "taught"), fixed.FEATURES,
                            TABLE_KEY, boosting.PRESETS[name], SEED, settings.get("maxIter", boosting.ROUNDS))
        return [SQLTransformer(statement=f"SELECT *, IF({made.margin()} > 0, 1D, 0D) AS prediction FROM __THIS__")]
    penalty = 1.0 / max(rows.count(), 1)                # C = 1 over a mean loss
    if kind == "logistic":
        return [plain, LogisticRegression(**common, **{
            "maxIter": LOGISTIC_ITERATIONS, "regParam": penalty, "elasticNetParam": 0.0,
            "standardization": False, **settings})]
    mapped = VectorAssembler(inputCols=[f"rbf_{i}" for i in range(LANDMARKS)], outputCol="features")
    return [_kernel_stage(rows), mapped, LinearSVC(**common, **{
        "regParam": penalty, "standardization": False, "maxIter": 100, **settings})]


class GatedModel:
    """A fitted pipeline with its labels. Tables that failed the rule never reach it."""

    def __init__(self, pipeline: Model, labels: list[str]):
        self.pipeline, self.labels = pipeline, labels

    def predict(self, features: DataFrame) -> DataFrame:
        """``features`` with ``prediction``: the model's label, or no genuine at once."""
        kept = features.columns
        names = F.array(*[F.lit(label) for label in self.labels])
        asked = self.pipeline.transform(features.where("consistency = 1"))
        asked = asked.withColumn("prediction", names[F.col("prediction").cast("int")])
        gated = (features.where("consistency <> 1")
                 .withColumn("prediction", F.lit(fixed.NOT_GENUINE_LABEL)))
        return asked.select(*kept, "prediction").unionByName(gated)

    def predict_inline(self, features: DataFrame) -> DataFrame:
        """The same in one pass over ``features``, for streams and unstored input."""
        names = F.array(*[F.lit(label) for label in self.labels])
        answer = F.when(F.col("consistency") == 1, names[F.col("prediction").cast("int")]) \
            .otherwise(fixed.NOT_GENUINE_LABEL)
        return (self.pipeline.transform(features)
                .select(*features.columns, answer.alias("prediction")))

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        spark = SparkSession.active()
        (spark.range(len(self.labels)).select(F.col("id"), F.array(*map(F.lit, self.labels))[
            F.col("id").cast("int")].alias("label")).coalesce(1)
            .write.mode("overwrite").parquet(f"{path}/labels"))

    @staticmethod
    def load(path: str) -> "GatedModel":
        spark = SparkSession.active()
        labels = spark.read.parquet(f"{path}/labels").orderBy("id").collect()
        return GatedModel(PipelineModel.load(f"{path}/pipeline"), [r["label"] for r in labels])


def fit(name: str, rows: DataFrame, **settings) -> GatedModel:
    """Fit a model by name on labelled features (stored: they are read repeatedly).

    Only consistent rows teach; ``settings`` override the fixed ones.
    """
    if name not in MODELS:
        raise ValueError(f"Неизвестная модель: {name}")
    indexer = encoder(rows)
    labels = list(indexer.labels)
    taught = rows.where("consistency = 1")
    taught = (indexer.transform(taught)
              .withColumn("weight", _weight(taught, rows, name, labels)))
    return GatedModel(Pipeline(stages=_stages(name, taught, settings)).fit(taught), labels)


def fold_scores(predicted: DataFrame, by: list[str]) -> DataFrame:
    """Accuracy, weighted and macro F1 per group, from counts of (label, prediction)."""
    pairs = predicted.groupBy(*by, "verification", "prediction").agg(F.count("*").alias("n"))
    sides = pairs.select(*by, "n", F.explode(F.array(
        F.struct(F.col("verification").alias("label"), F.lit(1).alias("real"), F.lit(0).alias("said"),
                 (F.col("verification") == F.col("prediction")).cast("int").alias("hit")),
        F.struct(F.col("prediction").alias("label"), F.lit(0).alias("real"), F.lit(1).alias("said"),
                 F.lit(0).alias("hit")))).alias("s")).select(*by, "n", "s.*")
    per_label = (sides.groupBy(*by, "label")
                 .agg(F.sum(F.col("n") * F.col("real")).alias("support"),
                      F.sum(F.col("n") * F.col("said")).alias("said"),
                      F.sum(F.col("n") * F.col("hit")).alias("hit"))
                 .withColumn("f1", 2 * F.col("hit") / (F.col("support") + F.col("said"))))
    return per_label.groupBy(*by).agg(
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1_weighted"),
        F.avg("f1").alias("f1_macro"),
        (F.sum("hit") / F.sum("support")).alias("accuracy"))


def _fold_models(rows: DataFrame, names: list[str], folds: int, settings: dict) -> dict[tuple[str, int], GatedModel]:
    """(name, fold) -> model fitted on the other folds of stored rows; ``AT_ONCE`` are fitted at a time, each in
    a scheduler pool of its own, so that the short jobs of one fill the cores that another leaves idle."""
    context = rows.sparkSession.sparkContext

    def fitted(name: str, fold: int) -> GatedModel:
        context.setLocalProperty("spark.scheduler.pool", f"{name}, fold {fold}")
        try:
            return fit(name, rows.where(F.col("fold") != fold), **settings.get(name, {}))
        finally:
            context.setLocalProperty("spark.scheduler.pool", None)
    with ThreadPoolExecutor(AT_ONCE) as pool:
        # a task of the pool has its own copy of the caller's properties
        target = inheritable_thread_target(rows.sparkSession)(fitted)
        asked = {(name, fold): pool.submit(target, name, fold) for name in names for fold in range(folds)}
        return {key: one.result() for key, one in asked.items()}


def with_folds(rows: DataFrame, folds: int = 5, seed: int = SEED) -> DataFrame:
    """Labelled features with a stratified ``fold`` number, stored."""
    keyed = rows.withColumn("_key", F.concat_ws("/", *TABLE_KEY))
    return stored(stratified_folds(keyed, "verification", "_key", seed, folds).drop("_key"),
                  "folds")


def cross_validate(rows: DataFrame, names: list[str] | None = None, folds: int = 5,
                   settings: dict | None = None) -> DataFrame:
    """Scores per model and fold; rows the rule rejected count in every test fold."""
    rows = with_folds(rows, folds)
    predicted = None
    for (name, fold), model in _fold_models(rows, names or list(MODELS), folds, settings or {}).items():
        part = model.predict(rows.where(F.col("fold") == fold)).withColumn("model", F.lit(name))
        predicted = part if predicted is None else predicted.unionByName(part)
    return fold_scores(predicted, ["model", "fold"])


def summary(per_fold: DataFrame) -> DataFrame:
    """Mean and (population) deviation over the folds."""
    return per_fold.groupBy("model").agg(*[f(m).alias(m + suffix) for m in
                                           ("f1_weighted", "f1_macro", "accuracy")
                                           for f, suffix in ((F.avg, ""), (F.stddev_pop, "_std"))])


def ranked(summaries: DataFrame) -> DataFrame:
    """Models by weighted F1; there are as many rows as models."""
    return summaries.withColumn("place", F.rank().over(
        Window.orderBy(F.desc("f1_weighted"))))


def moves(sizes: dict[int, int], repeats: int, seed: int = SEED) -> list[tuple]:
    """(fold, feature, repeat, a, b, n): for each fold, feature and repeat a bijection x -> (a x + b) mod n of 0..n - 1."""
    out = []
    for fold, n in sorted(sizes.items()):
        for k in range(len(fixed.FEATURES)):
            for repeat in range(1, repeats + 1):
                rng = random.Random(f"{seed}/{fold}/{k}/{repeat}")
                a = next(x for x in iter(lambda: rng.randint(1, n), None) if math.gcd(x, n) == 1)
                out.append((fold, k, repeat, a, rng.randrange(n), n))
    return out


def permuted(rows: DataFrame, repeats: int, seed: int = SEED) -> DataFrame:
    """Each of the stored ``rows`` (with a ``fold``) once per feature and repeat, with that feature's value moved in
    from another row of its fold.

    Rows have ranks in the order of a digest of their key. A bijection of these ranks, drawn for each fold, feature and
    repeat, says which row a value moves to, so only values are shuffled, to the rank that takes them; whole rows
    are multiplied where they are scored. Up to three billion rows a fold.
    """
    key = F.concat_ws("/", *[F.col(c).cast("string") for c in TABLE_KEY])
    ranked_ = stored(exact_rank(rows, ["fold"], F.md5(key), "_rank"), "ranked")
    sizes = {r.fold: r["count"] for r in ranked_.groupBy("fold").count().collect()}           # a row per fold
    drawn = (rows.sparkSession.createDataFrame(moves(sizes, repeats, seed), "fold int, feature int, repeat int, a long, b long, n long")
             .groupBy("fold").agg(F.collect_list(F.struct("feature", "repeat", "a", "b", "n")).alias("m")))
    sent = (ranked_.join(F.broadcast(drawn), "fold")                # folds x features x repeats numbers
            .select("fold", "_rank", F.array(*fixed.FEATURES).alias("_x"), F.explode("m").alias("m"))
            .select("fold", ((F.col("m.a") * (F.col("_rank") - 1) + F.col("m.b")) % F.col("m.n") + 1).alias("_rank"),
                    F.struct("m.feature", "m.repeat", F.col("_x")[F.col("m.feature")].alias("value")).alias("v"))
            .groupBy("fold", "_rank").agg(F.collect_list("v").alias("v")))
    names = F.array(*map(F.lit, fixed.FEATURES))
    taken = ranked_.join(sent, ["fold", "_rank"]).withColumn("v", F.explode("v"))
    return taken.select(
        *[c for c in rows.columns if c not in fixed.FEATURES], names[F.col("v.feature")].alias("feature"), F.col("v.repeat").alias("repeat"),
        *[F.when(F.col("v.feature") == k, F.col("v.value")).otherwise(F.col(f)).alias(f) for k, f in enumerate(fixed.FEATURES)])


def permutation_importance(rows: DataFrame, name: str, folds: int = 5, repeats: int = 10,
                           settings: dict | None = None) -> DataFrame:
    """Loss of weighted F1 when a feature is shuffled, over consistent test rows: mean
    over repeats, then over folds. All folds are scored in one job."""
    rows = with_folds(rows, folds)
    models = _fold_models(rows, [name], folds, {name: settings or {}})
    tested = stored(rows.where("consistency = 1"), "tested")
    moved = permuted(tested, repeats)

    def scored(cases: DataFrame, by: list[str]) -> DataFrame:
        said = None
        for (_, fold), model in models.items():
            part = model.predict(cases.where(F.col("fold") == fold))
            said = part if said is None else said.unionByName(part)
        return fold_scores(said, by)
    base = scored(tested, ["fold"]).select("fold", F.col("f1_weighted").alias("base"))
    drops = (scored(moved, ["fold", "feature", "repeat"]).join(base, "fold")
             .groupBy("feature", "fold").agg(F.avg(F.col("base") - F.col("f1_weighted")).alias("drop")))
    return drops.groupBy("feature").agg(F.avg("drop").alias("importance"))
