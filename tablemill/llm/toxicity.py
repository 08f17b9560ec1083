"""Toxicity by a classifier chain: each category's linear model also sees the earlier categories' probabilities."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_of, stored

#: Label columns in the order of the chain; a document is rejected by the last.
CHAIN = ("quality", "toxic")
#: Labelled documents that the models are fitted to, chosen by digest.
SAMPLE = 12_000
#: Terms, the most frequent of the sample; exact terms, so that no clean word shares a weight.
TERMS = 1 << 15
FOLDS = 2
ROUNDS = 12
#: The bounded sample is read in so many tasks: a fit is a hundred short jobs.
TASKS = 4
PENALTY = 1e-4

TERM = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"


def terms(text: str = "text") -> Column:
    """Distinct lower-cased runs of letters and digits, and of other marks."""
    return F.array_distinct(F.regexp_extract_all(
        F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(TERM), 0))


@dataclass
class Chain:
    """A fitted chain; ``threshold`` is for the last category's probability."""

    bag: CountVectorizerModel
    models: list[LogisticRegressionModel]
    chain: tuple[str, ...]
    threshold: float

    def scored(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """``docs`` with __p0, __p1, ..: the categories' probabilities."""
        rows = self.bag.transform(docs.withColumn("__terms", terms(text)))
        for k, model in enumerate(self.models):
            rows = _probable(model, _with_earlier(rows, k), f"__p{k}")
        return rows.drop("__terms", "__bag")


def _unnamed(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` without the names of a vector's places: every plan would hold one for each term."""
    return rows.withColumn(column, F.col(column).alias(column, metadata={}))


def _with_earlier(rows: DataFrame, k: int) -> DataFrame:
    """``rows`` with __seen, the bag and the earlier categories' probabilities."""
    if not k:
        return rows.withColumn("__seen", F.col("__bag"))
    return _unnamed(VectorAssembler(inputCols=["__bag", *[f"__p{i}" for i in range(k)]], outputCol="__seen")
                    .transform(rows), "__seen")


def _probable(model: LogisticRegressionModel, rows: DataFrame, name: str) -> DataFrame:
    own = model.copy().setFeaturesCol("__seen").setProbabilityCol("__probability")
    own = own.setRawPredictionCol("").setPredictionCol("")
    return (own.transform(rows)
            .withColumn(name, vector_to_array("__probability")[1]).drop("__probability", "__seen"))


def _fit(rows: DataFrame, label: str) -> LogisticRegressionModel:
    return LogisticRegression(featuresCol="__seen", labelCol=label, maxIter=ROUNDS, regParam=PENALTY,
                              standardization=False, family="binomial").fit(rows)


def sample(docs: DataFrame, labels: DataFrame, chain: tuple[str, ...] = CHAIN, text: str = "text",
           most: int = SAMPLE) -> DataFrame:
    """(__terms, __fold, labels) of at most ``most`` labelled documents, stored."""
    known = labels.where(F.col("doc_id").isNotNull())
    for c in chain:
        known = known.where(F.col(c).isNotNull())
    known = known.groupBy("doc_id").agg(*[F.max(F.col(c).cast("double")).alias(f"__is_{c}") for c in chain])
    digest = F.xxhash64("doc_id")
    chosen = stored(known.orderBy(digest, "doc_id").limit(most)
                    .withColumnRenamed("doc_id", "__id")
                    .withColumn("__fold", F.pmod(F.shiftright(F.xxhash64("__id"), 11), F.lit(FOLDS))), "labelled")
    return stored(
        docs.select("doc_id", F.col(text).alias("text")).join(
            F.broadcast(chosen), F.col("doc_id") == F.col("__id"))
        .select(terms("text").alias("__terms"), "__fold", *[f"__is_{c}" for c in chain]), "sample")


def fit(docs: DataFrame, labels: DataFrame, chain: tuple[str, ...] = CHAIN, text: str = "text",
        most: int = SAMPLE) -> Chain | None:
    """A chain fitted to a bounded sample; None if no labelled document has a term.

    For its training, each category sees of the earlier ones the probabilities
    that models of the other folds gave: what it will see of unknown documents.
    The last category's probabilities of that kind also give the threshold.
    """
    rows = sample(docs, labels, chain, text, most)
    if not rows.where(F.size("__terms") > 0).limit(1).count():
        return None
    bag = CountVectorizer(inputCol="__terms", outputCol="__bag", vocabSize=TERMS, binary=True).fit(rows)
    rows = stored(bag.transform(rows).drop("__terms").coalesce(TASKS), "bags")
    folds = {r["__fold"] for r in rows.select("__fold").distinct().collect()}
    models = []
    for k, c in enumerate(chain):
        seen = stored(_with_earlier(rows, k), "seen") if k else _with_earlier(rows, k)
        models.append(_fit(seen, f"__is_{c}"))
        parts = None
        for fold in range(FOLDS):
            rest, held = seen.where(F.col("__fold") != fold), seen.where(F.col("__fold") == fold)
            model = _fit(rest, f"__is_{c}") if folds - {fold} else models[-1]
            part = _probable(model, held, f"__p{k}")
            parts = part if parts is None else parts.union(part)
        rows = stored(parts.coalesce(TASKS), "out_of_fold")
    got = rows.select(F.col(f"__p{len(chain) - 1}").alias("p"), F.col(f"__is_{chain[-1]}").alias("y")).toPandas()
    return Chain(bag, models, chain, threshold(got["p"].tolist(), got["y"].tolist()))


def threshold(scores: list[float], labels: list[float]) -> float:
    """Where precision and recall on held-out scores are best together: in the middle of the gap
    below the last score worth rejecting; above 1 if no label is positive."""
    order = sorted(zip(scores, labels), reverse=True)
    positive = sum(labels)
    if not positive:
        return 2.0
    best, at, hits = -1.0, 0, 0.0
    for n, (score, label) in enumerate(order, 1):
        hits += label
        if n < len(order) and order[n][0] == score:
            continue
        value = 2 * hits / (n + positive)
        if value > best:
            best, at = value, n
    below = order[at][0] if at < len(order) else 0.0
    return (order[at - 1][0] + below) / 2


def judged(docs: DataFrame, labels: DataFrame, chain: tuple[str, ...] = CHAIN, text: str = "text",
           most: int = SAMPLE) -> DataFrame:
    """``docs`` with p_<category> for each category of the chain, and rejected.

    Every document is judged on its whole text, those of the sample too. A null
    or empty text is judged by the models' intercepts alone, and never
    rejected. If nothing is labelled, probabilities are null and nothing is rejected. Rows without
    doc_id are judged but not learned from; repeated rows agree. Columns named like the new ones are replaced.
    """
    new = [f"p_{c}" for c in chain]
    base = docs.drop(*new, "rejected")
    model = fit(base, labels, chain, text, most)
    if model is None:
        return base.select("*", *[F.lit(None).cast("double").alias(c) for c in new],
                           F.lit(False).alias("rejected"))
    rows = model.scored(base, text)
    last = F.col(f"__p{len(chain) - 1}")
    filled = F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) > 0
    return rows.select(*columns_of(rows, {f"__p{k}" for k in range(len(chain))}),
                       *[F.col(f"__p{k}").alias(c) for k, c in enumerate(new)],
                       ((last >= F.lit(model.threshold)) & filled).alias("rejected"))


def accepted(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the rejected ones."""
    rows = judged(docs, labels, text=text).where("not rejected")
    return rows.select(*columns_of(rows, {*[f"p_{c}" for c in CHAIN], "rejected"}))
