"""K-Means customer segments."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import partial

from pyspark.ml import PipelineModel
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subscope import constants as K
from subscope.models.matrix import assembler, fit_pipeline, fits_at_once, training_rows
from subscope.operators.explain import label_clusters
from subscope.operators.reports import cluster_profiles
from subscope.session import side_by_side


def _scaler() -> StandardScaler:
    # the sample deviation differs from the population one by one common factor
    return StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True)


def fit_segments(
    df: DataFrame, features: Sequence[str], k: int = K.N_CLUSTERS, n_init: int = 10, seed: int = K.SEED
) -> PipelineModel:
    """Scale and cluster; of ``n_init`` starts the one with the smallest cost is kept.

    The scaled vectors are written once and every start reads them.
    """
    raw, assembled = assembler(features, "raw"), "features" in df.columns
    vectors = df.withColumnRenamed("features", "raw") if assembled else raw.transform(df)
    scaler = _scaler().fit(vectors)
    rows = training_rows(scaler.transform(vectors).select("features"), "scaled", even=assembled)
    return PipelineModel(stages=[raw, scaler, _best_starts(rows, [k], n_init, seed)[k]])


def _best_starts(rows: DataFrame, ks: Iterable[int], n_init: int, seed: int) -> dict[int, KMeansModel]:
    """For every k the model of the cheapest of ``n_init`` starts, the first of equal ones; starts run side by side."""

    def start(k: int, i: int) -> tuple[float, int, int, KMeansModel]:
        model = KMeans(k=k, seed=seed + i, featuresCol="features", predictionCol="cluster").fit(rows)
        return float(model.summary.trainingCost), i, k, model

    found = side_by_side([partial(start, k, i) for k in ks for i in range(n_init)], fits_at_once(rows))
    found.sort(key=lambda f: f[:2])
    return {k: next(model for _, _, of, model in found if of == k) for k in ks}


def assign_segments(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Cluster, label, description and campaign of every customer.

    Labels depend on cluster profiles only (k rows), so the join back is on k keys.
    """
    clustered = model.transform(df).drop("raw", "features")
    labels = label_clusters(cluster_profiles(clustered))
    return clustered.join(F.broadcast(labels), "cluster", "left")  # k rows


def silhouette(df: DataFrame, features: Sequence[str], cluster: str = "cluster") -> float:
    """Mean silhouette with squared euclidean distances, computed from cluster sums."""
    rows = assembler(features, "_v").transform(df.drop("_v"))
    return ClusteringEvaluator(featuresCol="_v", predictionCol=cluster).evaluate(rows)


def k_selection(
    df: DataFrame, features: Sequence[str], ks: Iterable[int] = range(3, 10), seed: int = K.SEED, n_init: int = 10
) -> DataFrame:
    """Inertia and silhouette per k on the unscaled matrix, the best silhouette marked; of ``n_init`` starts the cheapest counts."""
    rows = training_rows(assembler(features).transform(df).select("features"), "matrix")
    judge = ClusteringEvaluator(featuresCol="features", predictionCol="cluster")
    models = _best_starts(rows, list(ks), n_init, seed)
    quality = side_by_side([partial(lambda m: float(judge.evaluate(m.transform(rows))), m) for m in models.values()])
    found = [(k, float(m.summary.trainingCost), q) for (k, m), q in zip(models.items(), quality)]
    best = max(found, key=lambda r: r[2])[0]
    return df.sparkSession.createDataFrame(
        [(*r, r[0] == best) for r in found], "k int, inertia double, silhouette double, is_best boolean"
    )


def pca_2d(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """First two principal components of the scaled features, their largest loading positive."""
    model = fit_pipeline(
        df, assembler(features, "raw"), _scaler(), PCA(k=2, inputCol="features", outputCol="pc")
    )
    loadings = model.stages[-1].pc.toArray()
    signs = [1.0 if side[abs(side).argmax()] >= 0 else -1.0 for side in loadings.T]
    xy = vector_to_array("pc")
    return model.transform(df).select("customer_id", *[(xy[i] * sign).alias(f"pc{i + 1}") for i, sign in enumerate(signs)])
