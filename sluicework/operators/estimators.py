"""Models around estimators that others made: Spark ML pipelines, and anything with fit and predict."""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .models import Model, read_about, reloaded, write_about


def arrays(data: Any, features: Sequence[str], target: str | None = None, max_rows: int = 1_000_000) -> tuple[np.ndarray, np.ndarray | None]:
    """Features and target as numpy arrays, from a table, a pandas frame or an array.

    A table comes to the driver, so one of more than ``max_rows`` rows is cut to about that many by
    the hash of its rows: a documented sample to fit on, never a way to score.
    """
    if isinstance(data, DataFrame):
        rows = data.select(*features, *([target] if target else []))
        total = rows.count()
        if total > max_rows:
            rows = rows.filter(F.pmod(F.xxhash64(*rows.columns), F.lit(1_000_000)) < int(1_000_000 * max_rows / total))
        data = rows.toPandas()
    if isinstance(data, pd.DataFrame):
        return data[list(features)].to_numpy(), data[target].to_numpy() if target and target in data.columns else None
    return np.asarray(data), None


class PipelineModelOf(Model):
    """A Spark ML estimator or list of stages: fitted and applied where the rows are.

    ``stages`` are pyspark.ml objects, or names of functions without arguments that make them
    ("module.function"), so that a task file can name them. ``outputs`` are the columns that scoring
    adds; all that the stages add, if none are named.
    """

    def __init__(self, stages: Sequence[Any] = (), outputs: Sequence[str] = (), metric: Any = None):
        self.stages, self.outputs, self.metric, self.fitted = list(stages), list(outputs), metric, None

    def _made(self) -> list:
        from .models import load_class

        made: list = []
        for s in self.stages:
            s = load_class(s)() if isinstance(s, str) else s
            made += s if isinstance(s, list) else [s]
        return made

    def train(self, df: DataFrame) -> dict[str, float]:
        """Fit on all rows. With ``metric``, a pyspark.ml evaluator, its value over the same rows is returned."""
        from pyspark.ml import Pipeline

        self.fitted = reloaded(Pipeline(stages=self._made()).fit(df), df.sparkSession)
        out = {"rows": float(df.count())}
        if self.metric is not None:
            out[self.metric.getMetricName()] = float(self.metric.evaluate(self.fitted.transform(df)))
        return out

    def predict(self, df: DataFrame) -> DataFrame:
        scored = self.fitted.transform(df)
        return scored.select(*df.columns, *self.outputs) if self.outputs else scored

    def save(self, path: str) -> None:
        self.fitted.write().overwrite().save(f"{path}/pipeline")
        write_about(path, {"outputs": self.outputs})

    @classmethod
    def load(cls, path: str) -> PipelineModelOf:
        from pyspark.ml import PipelineModel

        made = cls(outputs=read_about(path)["outputs"])
        made.fitted = PipelineModel.load(f"{path}/pipeline")
        return made

    def metadata(self) -> dict[str, Any]:
        return {"stages": [s if isinstance(s, str) else type(s).__name__ for s in self.stages], "outputs": self.outputs}


class ArrayModel(Model):
    """An estimator with fit(X, y) and predict(X), such as scikit-learn's: fitted on the driver from a
    bounded sample, applied on the executors batch by batch.

    If the estimator has predict_proba, its last column is the score and 0.5 or more is the label 1.
    """

    def __init__(self, features: Sequence[str] = (), target: str | None = None, estimator: Any = None, max_rows: int = 1_000_000):
        from .models import load_class

        self.features, self.target, self.max_rows = list(features), target, max_rows
        self.estimator = load_class(estimator)() if isinstance(estimator, str) else estimator

    def train(self, df: DataFrame) -> dict[str, float]:
        x, y = arrays(df, self.features, self.target, self.max_rows)
        self.estimator.fit(x, y)
        labels, _ = _labelled(self.estimator, x)
        found = {"rows": float(len(x))}
        return found | ({"accuracy": float((labels == y).mean())} if y is not None and len(y) else {})

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` with prediction and, where the estimator gives one, proba; null otherwise."""
        estimator, features = self.estimator, self.features

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                labels, scores = _labelled(estimator, batch[features].to_numpy())
                yield batch.assign(prediction=np.asarray(labels, float), proba=np.nan if scores is None else scores)

        kept = df.drop("prediction", "proba")
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
        return kept.mapInPandas(run, f"{kinds}, prediction double, proba double").withColumn("proba", F.nanvl("proba", F.lit(None).cast("double")))

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        spark.createDataFrame([(bytearray(pickle.dumps(self.estimator)),)], "model binary").coalesce(1).write.mode("overwrite").parquet(f"{path}/estimator")
        write_about(path, {"features": self.features, "target": self.target, "max_rows": self.max_rows})

    @classmethod
    def load(cls, path: str) -> ArrayModel:
        """A saved estimator is unpickled, so load only what you trust."""
        made = cls(**read_about(path))
        made.estimator = pickle.loads(SparkSession.getActiveSession().read.parquet(f"{path}/estimator").first()[0])
        return made

    def metadata(self) -> dict[str, Any]:
        params = getattr(self.estimator, "get_params", dict)()
        return {"features": self.features, "target": self.target, "estimator": type(self.estimator).__name__, "params": json.loads(json.dumps(params, default=str))}


def _labelled(estimator: Any, x: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    if hasattr(estimator, "predict_proba"):
        scores = np.asarray(estimator.predict_proba(x))[:, -1].astype(float)
        return (scores >= 0.5).astype(int), scores
    return np.asarray(estimator.predict(x)), None
