"""Projections and linear classifiers on vectors and token counts, with ``pyspark.ml``."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, PCA, CountVectorizer, Normalizer, StandardScaler, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifmill.operators.splits import group_folds


def pca(df: DataFrame, k: int = 2, col: str = "embedding", out: str = "projection") -> tuple[DataFrame, list[float]]:
    """Centred projections on the first components, and the variance they explain."""
    rows = df.withColumn("_v", array_to_vector(F.col(col).cast("array<double>")))
    centre = rows.select(Summarizer.mean(F.col("_v")).alias("m")).first()["m"]
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(rows)
    shift = model.pc.toArray().T @ centre.toArray()
    moved = F.transform(F.arrays_zip(vector_to_array("_p").alias("x"), F.array(*[F.lit(float(s)) for s in shift]).alias("s")), lambda z: z["x"] - z["s"])
    return model.transform(rows).withColumn(out, moved).drop("_v", "_p"), model.explainedVariance.toArray().tolist()


def label_index(df: DataFrame, col: str = "label", out: str = "label_id") -> DataFrame:
    """Classes as 0, 1, ... in sorted order."""
    rows = df.withColumn("_l", F.col(col).cast("string"))
    return StringIndexer(inputCol="_l", outputCol=out, stringOrderType="alphabetAsc").fit(rows).transform(rows).drop("_l")


def tfidf(df: DataFrame, tokens: str = "tokens", out: str = "features", vocabulary: int = 1 << 14, min_df: int = 2) -> DataFrame:
    counted = CountVectorizer(inputCol=tokens, outputCol="_tf", vocabSize=vocabulary, minDF=min_df).fit(df).transform(df)
    weighted = IDF(inputCol="_tf", outputCol="_idf").fit(counted).transform(counted)
    return Normalizer(inputCol="_idf", outputCol=out).transform(weighted).drop("_tf", "_idf")


def random_features(df: DataFrame, dims: int, seed: int = 42, out: str = "embedding", key: str = "vec_id") -> DataFrame:
    """Vectors of normal values drawn by seed, key and dimension: a baseline that does not depend on partitions."""
    uniform = lambda k, part: (F.pmod(F.xxhash64(F.lit(seed), F.col(key), F.lit(k), F.lit(part)), F.lit(1 << 52)) + 1) / F.lit(float((1 << 52) + 1))
    normal = lambda k: F.sqrt(-2 * F.log(uniform(k, 0))) * F.cos(2 * F.pi() * uniform(k, 1))
    return df.withColumn(out, F.array(*[normal(k) for k in range(dims)]))


def linear_classifier(train: DataFrame, test: DataFrame, features: str = "features", label: str = "label_id", scale: bool = False, regularisation: float = 1e-4, max_iter: int = 100) -> DataFrame:
    """Multinomial logistic regression; the test rows with ``predicted``."""
    if scale:
        scaler = StandardScaler(inputCol=features, outputCol="_scaled", withMean=True).fit(train)
        train, test, features = scaler.transform(train), scaler.transform(test), "_scaled"
    model = LogisticRegression(featuresCol=features, labelCol=label, predictionCol="predicted", family="multinomial", regParam=regularisation, maxIter=max_iter).fit(train)
    return model.transform(test).drop("rawPrediction", "probability", "_scaled")


def cross_validate(df: DataFrame, folds: int = 5, seed: int = 42, group: str = "group", **fit) -> DataFrame:
    """Predictions for all rows, each from a model that saw no row of its group; with ``fold``."""
    rows = group_folds(df, folds, seed, group)
    out = None
    for k in range(folds):
        part = linear_classifier(rows.where(F.col("fold") != k), rows.where(F.col("fold") == k), **fit)
        out = part if out is None else out.unionByName(part)
    return out


def vectors(df: DataFrame, col: str = "embedding", out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(col).cast("array<double>")))
