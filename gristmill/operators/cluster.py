"""K-means clusters and assignment to centroids."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import coerce as co
from ..functions.expression import quoted


def k_means(df: DataFrame, columns: Iterable[str], k: int = 3, seed: int = 1, iterations: int = 20) -> list[list[float]]:
    """Centroids, sorted."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    columns = list(columns)
    rows = df.select(*(co.num(quoted(c), co.kind_of(df.schema[c].dataType)).alias(f"x{i}") for i, c in enumerate(columns))).dropna()
    rows = VectorAssembler(inputCols=[f"x{i}" for i in range(len(columns))], outputCol="features").transform(rows)
    model = KMeans(k=k, seed=seed, maxIter=iterations, featuresCol="features").fit(rows)
    return sorted([float(x) for x in c] for c in model.clusterCenters())


def assign(df: DataFrame, columns: Iterable[str], centroids: list[list[float]]) -> DataFrame:
    """Adds _cluster_id and _cluster_distance of the nearest centroid; null where a value is no number."""
    x = [co.num(quoted(c), co.kind_of(df.schema[c].dataType)) for c in columns]
    far = [F.sqrt(sum(((v - c) * (v - c) for v, c in zip(x, centre, strict=True)), F.lit(0.0))) for centre in centroids]
    best = F.array_min(F.array(*(F.struct(d.alias("d"), F.lit(i).alias("i")) for i, d in enumerate(far))))
    valid = far[0].isNotNull()
    return df.withColumns({"_cluster_id": F.when(valid, best["i"]), "_cluster_distance": F.when(valid, co.half_up(best["d"], 3))})
