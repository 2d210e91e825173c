"""Versions of models: fitted on moving windows, kept in a table, used by a bar only while they are fresh."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.asof import asof_join
from ..schemas import ACTIONS
from .strategies import softmax

HOUR = 3_600_000
WEIGHTS = T.ArrayType(T.ArrayType(T.DoubleType(), False), False)


def target(label: Column) -> Column:
    """The place of the action that a label stands for: above 0 to enter long, below 0 short, else neutral."""
    return F.when(label > 0, 1).when(label < 0, 3).otherwise(0)


def retrained(d: DataFrame, features: Sequence[str], label: str = "label", every: int = 100, window: int = 200, ahead: int = 0, rate: float = 0.1, epochs: int = 1, keys: Sequence[str] = ("symbol",), time: str = "close_time") -> DataFrame:
    """A version (keys, version, trained_at, samples, weights) after each ``every`` rows of numbered bars.

    Version v is fitted at row v * every, on the last ``window`` rows whose label
    was known then: a label looks ``ahead`` rows ahead. A window is what a task
    holds. Weights start at zero and follow the mean gradient, ``epochs`` times.
    """
    import numpy as np
    import pandas as pd

    x = d.where(F.col(label).isNotNull()).select(*keys, "rn", F.array(*(F.col(f).cast("double") for f in features)).alias("x"), target(F.col(label)).alias("y"))
    last = F.col("rn") + ahead  # the row at which the label is known
    versions = F.sequence(F.ceil(last / every), F.floor((last + window - 1) / every))
    x = x.withColumn("version", F.explode(F.when(F.ceil(last / every) <= F.floor((last + window - 1) / every), versions)))
    at = d.where(F.col("rn") % every == 0).select(*keys, (F.col("rn") / every).cast("long").alias("version"), F.col(time).alias("trained_at"))
    schema = T.StructType([*(d.schema[k] for k in keys), T.StructField("version", T.LongType()), T.StructField("samples", T.LongType()), T.StructField("weights", T.ArrayType(T.ArrayType(T.DoubleType()), False))])
    # What isn't a number comes back from pandas as null.
    numbers = F.transform("weights", lambda w: F.transform(w, lambda v: F.coalesce(v, F.lit(float("nan")))))

    def fit(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("rn")
        rows, wanted = np.array(p["x"].tolist(), float), np.eye(len(ACTIONS))[p["y"].to_numpy()]
        weights = np.zeros((len(ACTIONS), rows.shape[1]))
        for epoch in range(epochs):
            # Zero weights give equal chances, whatever the features; of infinite ones they would give none.
            scores = rows @ weights.T if epoch else np.zeros((len(rows), len(ACTIONS)))
            chance = np.exp(scores - scores.max(1, keepdims=True))
            weights += rate / len(rows) * (wanted - chance / chance.sum(1, keepdims=True)).T @ rows
        return pd.DataFrame([[*(p[k].iloc[0] for k in keys), p["version"].iloc[0], len(p), weights.tolist()]], columns=schema.names)

    return x.groupBy(*keys, "version").applyInPandas(fit, schema).join(at, [*keys, "version"]).select(*keys, "version", "trained_at", "samples", numbers.alias("weights"))


def save(versions: DataFrame, path: str) -> None:
    """Add versions to a table of models."""
    versions.write.mode("append").parquet(path)


def load(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    d = spark.read.parquet(path)
    return d if version is None else d.where(F.col("version") == version)


def expired(trained_at: Column, now: Column, hours: float) -> Column:
    """A model that was never trained is expired."""
    return F.coalesce(now - trained_at >= int(hours * HOUR), F.lit(True))


def needs_retraining(trained_at: Column, now: Column, hours: float) -> Column:
    return expired(trained_at, now, hours)


def predict_fresh(d: DataFrame, versions: DataFrame, features: Sequence[str], expiration_hours: float, retrain_hours: float = 0.0, keys: Sequence[str] = ("symbol",), time: str = "close_time") -> DataFrame:
    """``d`` with the latest version trained by its time, its age, whether it is to be retrained, and its action and probability, null once it is expired."""
    d = asof_join(d, versions.select(*keys, "trained_at", "version", "weights"), time, "trained_at", keys, "_model")
    c = F.col
    x = F.array(*(c(f).cast("double") for f in features))
    scores = F.transform(c("_model.weights"), lambda w: F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))
    fresh = ~expired(c("_model.trained_at"), c(time), expiration_hours)
    d = d.withColumns({"version": c("_model.version"), "age": c(time) - c("_model.trained_at"), "retrain": needs_retraining(c("_model.trained_at"), c(time), retrain_hours), "_s": F.when(fresh, scores)})
    at = F.array_position("_s", F.array_max("_s")).cast("int")
    said = lambda x: F.when(c("_s").isNotNull(), F.element_at(x, at))
    return d.withColumns({"action": said(F.array(*map(F.lit, ACTIONS))), "confidence": said(softmax(c("_s")))}).drop("_model", "_s")
