"""Two-component PCA of the feature set (the data behind the cluster map)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pca_projection(df: DataFrame, features: Sequence[str], keep: str | Sequence[str] = ()) -> tuple[DataFrame, list]:
    """Centre the features (PCA in Spark does not), project on two components.

    Returns (rows with pc1, pc2 and the kept columns, explained-variance ratios). The sign of
    each axis is arbitrary, as with any PCA."""
    keep = [keep] if isinstance(keep, str) else list(keep)
    x = df.select(*keep, *[F.col(f"`{f}`").cast("double").alias(f"f{i}") for i, f in enumerate(features)])
    pipe = Pipeline(stages=[
        VectorAssembler(inputCols=[f"f{i}" for i in range(len(features))], outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="centred", withMean=True, withStd=False),
        PCA(k=2, inputCol="centred", outputCol="pc"),
    ])
    model = pipe.fit(x)
    out = model.transform(x).select(*keep, vector_to_array("pc").alias("pc"))
    ratio = list(model.stages[-1].explainedVariance.toArray())
    return out.select(*keep, F.col("pc")[0].alias("pc1"), F.col("pc")[1].alias("pc2")), ratio
