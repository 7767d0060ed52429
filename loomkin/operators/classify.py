"""The misclassification experiment: how well a classifier trained on (synthetic) rows does on held-out real ones.

The classifier is a support vector machine with a Gaussian kernel of width 1 / (number of features) over
scaled codes, in its random-feature form: cosines of seeded random projections, whose inner products
approach the kernel as their number grows, and a linear machine on them, one against the rest.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomkin.sources.io import train_test

#: Random features, and passes of the linear machine.
FEATURES, PASSES = 256, 50


def _scales(rows: DataFrame, attrs: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each attribute; an attribute that doesn't vary is only centred."""
    r = rows.agg(*(f(a) for a in attrs for f in (F.avg, F.stddev_pop))).first()
    values = np.array([float(x or 0.0) for x in r]).reshape(-1, 2)
    return values[:, 0], np.where(values[:, 1] > 0, values[:, 1], 1.0)


def kernel_features(rows: DataFrame, attrs: Sequence[str], mean: np.ndarray, deviation: np.ndarray, count: int = FEATURES, seed: int = 0) -> DataFrame:
    """rows with `features`: sqrt(2 / count) * cos(W x + b), made in Arrow batches."""
    rng = np.random.default_rng(seed)
    w = rng.normal(scale=np.sqrt(2 / len(attrs)), size=(len(attrs), count))
    b = rng.uniform(0, 2 * np.pi, count)

    def run(batches):
        for batch in batches:
            x = np.stack([batch.column(batch.schema.get_field_index(a)).to_numpy(zero_copy_only=False).astype(float) for a in attrs], axis=1)
            z = np.sqrt(2 / count) * np.cos((x - mean) / deviation @ w + b)
            own = pa.ListArray.from_arrays(pa.array(np.arange(0, z.size + 1, count, dtype=np.int32)), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, own], names=[*batch.schema.names, "_z"])

    out = rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("_z", T.ArrayType(T.DoubleType()))]))
    return out.withColumn("features", array_to_vector("_z")).drop("_z")


def misclassification(train: DataFrame, test: DataFrame, target: str, attrs: Sequence[str], seed: int = 0) -> float:
    """Share of test rows whose target the classifier trained on `train` gets wrong."""
    attrs = [a for a in attrs if a != target]
    mean, deviation = _scales(train, attrs)
    made = lambda df: kernel_features(df.select(*attrs, F.col(target).cast("double").alias("label")), attrs, mean, deviation, seed=seed).select("label", "features")
    seen = train.select(target).distinct().limit(2).count()
    if seen < 2:  # one class only: all rows are called that
        value = train.select(target).first()
        wrong = test.where(F.col(target) != value[0]) if value else test
        return wrong.count() / max(1, test.count())
    held = made(train).persist()
    model = OneVsRest(classifier=LinearSVC(maxIter=PASSES, regParam=0.0), labelCol="label", featuresCol="features").fit(held)
    held.unpersist()
    wrong = model.transform(made(test)).agg(F.avg((F.col("prediction") != F.col("label")).cast("double"))).first()[0]
    return float(wrong or 0.0)


def misclassification_experiment(df: DataFrame, key: str, attrs: Sequence[str], targets: Sequence[str], synthesize: Callable[[DataFrame, int], DataFrame], folds: int = 5, seed: int = 0) -> dict[str, float]:
    """Mean misclassification of each target over the folds: train on what `synthesize(rows outside the fold, seed)` makes, test on the fold."""
    out = dict.fromkeys(targets, 0.0)
    dealt = train_test(df, key, seed, folds)
    for k in range(folds):
        made = synthesize(dealt.where(F.col("fold") != k).drop("fold"), seed + k)
        for t in targets:
            out[t] += misclassification(made, dealt.where(F.col("fold") == k), t, attrs, seed) / folds
    return out
