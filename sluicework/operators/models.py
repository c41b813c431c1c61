"""Models as operators over tables: contract, registry, promotion gates, training and scoring."""

from __future__ import annotations

import hashlib
import importlib
import importlib.util
import json
import sys
from collections.abc import Callable, Iterator, Mapping
from datetime import datetime, timezone
from pathlib import Path
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import served_folder, shared_folder

STAGES = ("development", "staging", "production", "archived")


class Model:
    """What the engine asks of a model. Training takes and scoring gives DataFrames."""

    def train(self, df: DataFrame) -> dict[str, float]:
        raise NotImplementedError

    def predict(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def save(self, path: str) -> None:
        raise NotImplementedError

    @classmethod
    def load(cls, path: str) -> Model:
        raise NotImplementedError

    def metadata(self) -> dict[str, Any]:
        return {}

    def validate(self, df: DataFrame) -> dict[str, float]:
        return {}


def reloaded(fitted: Any, spark: SparkSession) -> Any:
    """The fitted pipeline without its training summaries, which hold on to the session and so cannot go
    to executors once anything was observed in it."""
    from pyspark.ml import PipelineModel

    path = shared_folder(spark, "fitted")
    fitted.write().overwrite().save(path)
    return PipelineModel.load(path)


def write_about(path: str, about: Mapping[str, Any]) -> None:
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def read_about(path: str) -> dict[str, Any]:
    return json.loads(SparkSession.getActiveSession().read.text(f"{path}/about").first()[0])


class ForestModel(Model):
    """Random forest over imputed, scaled numbers and one-hot categories, all in pyspark.ml."""

    def __init__(self, numbers: list[str], categories: list[str], label: str, trees: int = 20, depth: int = 6, seed: int = 42, key: str | None = None):
        self.numbers, self.categories, self.label, self.trees, self.depth, self.seed, self.key = numbers, categories, label, trees, depth, seed, key
        self.fitted = None

    def _stages(self) -> list:
        from pyspark.ml.classification import RandomForestClassifier
        from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler

        filled = [f"{c}_filled" for c in self.numbers]
        coded, hot = [f"{c}_code" for c in self.categories], [f"{c}_hot" for c in self.categories]
        stages = [Imputer(inputCols=self.numbers, outputCols=filled, strategy="median")] if self.numbers else []
        stages += [VectorAssembler(inputCols=filled, outputCol="numbers_raw"), StandardScaler(inputCol="numbers_raw", outputCol="numbers_scaled")] if self.numbers else []
        if self.categories:
            stages += [StringIndexer(inputCols=self.categories, outputCols=coded, handleInvalid="keep"), OneHotEncoder(inputCols=coded, outputCols=hot)]
        stages.append(VectorAssembler(inputCols=(["numbers_scaled"] if self.numbers else []) + hot, outputCol="features"))
        stages.append(RandomForestClassifier(labelCol=self.label, featuresCol="features", numTrees=self.trees, maxDepth=self.depth, seed=self.seed))
        return stages

    def _prepared(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.col(c).cast("double") for c in self.numbers})

    def train(self, df: DataFrame) -> dict[str, float]:
        """Fit on 80 % of each label's rows, chosen by hash, and measure on the rest."""
        from pyspark.ml import Pipeline

        from .cleaning import split_by_hash
        from .statistics import accuracy_f1, auc

        rows = self._prepared(df).filter(F.col(self.label).isNotNull()).withColumn(self.label, F.col(self.label).cast("int"))
        key = self.key or "_key"
        if not self.key:
            rows = rows.withColumn("_key", F.xxhash64(*df.columns))
        parts = split_by_hash(rows, key, self.label).cache()
        try:
            self.fitted = reloaded(Pipeline(stages=self._stages()).fit(parts.filter("split = 'train'")), df.sparkSession)
            scored = self.predict(parts.filter("split = 'test'")).cache()
            first = accuracy_f1(scored, self.label, "prediction").first()
            area = auc(scored, self.label, "proba").first()["auc"]
            return {"accuracy": float(first["accuracy"] or 0), "f1": float(first["f1"] or 0), "auc": float(area or 0), "rows": float(parts.count())}
        finally:
            parts.unpersist()

    def predict(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        out = self.fitted.transform(self._prepared(df))
        return out.select(*df.columns, F.col("prediction"), F.round(vector_to_array("probability")[1], 6).alias("proba"))

    def save(self, path: str) -> None:
        self.fitted.write().overwrite().save(f"{path}/pipeline")
        write_about(path, self.metadata())

    @classmethod
    def load(cls, path: str) -> ForestModel:
        from pyspark.ml import PipelineModel

        made = cls(**read_about(path))
        made.fitted = PipelineModel.load(f"{path}/pipeline")
        return made

    def metadata(self) -> dict[str, Any]:
        return {"numbers": self.numbers, "categories": self.categories, "label": self.label, "trees": self.trees, "depth": self.depth, "seed": self.seed, "key": self.key}


def batch_score(df: DataFrame, columns: list[str], score: Callable[[pd.DataFrame], pd.Series], out: str = "score") -> DataFrame:
    """Score with any Python model, Arrow batches at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{out: score(batch[columns]).astype("float64")})

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{kinds}, `{out}` double")


def load_class(spec: str, folder: str | None = None) -> type:
    """``module.Class``, from ``folder`` first. Files get module names of their own, so that
    two folders may hold modules of the same name."""
    module_name, _, name = spec.rpartition(".")
    if not module_name:
        raise ValueError(f"{spec!r} is not of the form module.Class")
    if folder and (path := Path(folder, *module_name.split(".")).with_suffix(".py")).exists():
        unique = f"sluice_{hashlib.sha1(str(path.resolve()).encode()).hexdigest()[:12]}_{path.stem}"
        if unique not in sys.modules:
            spec_ = importlib.util.spec_from_file_location(unique, path)
            module = importlib.util.module_from_spec(spec_)
            sys.modules[unique] = module
            try:
                spec_.loader.exec_module(module)
            except BaseException:
                del sys.modules[unique]
                raise
        module = sys.modules[unique]
        if (spark := SparkSession.getActiveSession()) is not None:
            _ship(spark, path, unique)
    else:
        module = importlib.import_module(module_name)
    if not hasattr(module, name):
        raise ImportError(f"{module_name} has no {name}")
    return getattr(module, name)


_shipped: set[tuple[str, str]] = set()


def _ship(spark: SparkSession, path: Path, name: str) -> None:
    """Give the workers the module under the name that the driver knows it by, once a session, so that
    what it defines can be unpickled there."""
    if (key := (spark.sparkContext.applicationId, name)) in _shipped:
        return
    file = Path(served_folder(), f"{name}.py")
    file.write_bytes(path.read_bytes())
    spark.sparkContext.addPyFile(str(file))
    _shipped.add(key)


class GateFailed(ValueError):
    """A version that misses its gates."""


def evaluate_gates(gates: Mapping[str, Any], metrics: Mapping[str, float], metadata: Mapping[str, Any] | None = None) -> list[tuple[str, bool, float | None, str]]:
    """(gate, passed, actual, message) for min_<metric>, max_<metric> and require_drift_check.
    A metric that is missing fails; a gate set to false or null is off."""
    out = []
    for gate, bound in gates.items():
        if bound is None or bound is False:
            continue
        if gate == "require_drift_check":
            done = bool({**metrics, **(metadata or {})}.get("drift_check_passed"))
            out.append((gate, done, None, "" if done else "no passed drift check is recorded"))
            continue
        kind, _, metric = gate.partition("_")
        if kind not in ("min", "max") or not metric:
            raise ValueError(f"unknown gate {gate!r}")
        actual = metrics.get(metric)
        if actual is None:
            out.append((gate, False, None, f"metric {metric} is missing"))
            continue
        ok = actual >= bound if kind == "min" else actual <= bound
        out.append((gate, ok, float(actual), "" if ok else f"{metric} is {actual}, the {kind}imum is {bound}"))
    return out


def now() -> str:
    return datetime.now(timezone.utc).isoformat()


class Changed(RuntimeError):
    """Someone else changed a model's record at the same time."""


class ModelRegistry:
    """Versions of a model in JSON records, on any file system that Spark reaches.

    Every change writes a new record beside the old ones, numbered one higher, by a creation that fails
    if that number is there already. So of two changes at a time one is told to start over, and
    a reader always finds a whole record: the one with the highest number.
    """

    def __init__(self, store: str):
        self.store = str(store).rstrip("/")

    def _path(self, *parts: str):
        spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        path = spark._jvm.org.apache.hadoop.fs.Path("/".join([self.store, *parts]))
        return path.getFileSystem(spark._jsc.hadoopConfiguration()), path

    def _read(self, use_case: str, name: str) -> dict[str, Any]:
        fs, path = self._path(use_case, name, "records")
        found = sorted(s.getPath().getName() for s in fs.listStatus(path) if s.getPath().getName().endswith(".json")) if fs.exists(path) else []
        if not found:
            return {"model_name": name, "use_case": use_case, "revision": 0, "versions": {}}
        _, file = self._path(use_case, name, "records", found[-1])
        stream = fs.open(file)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _write(self, record: dict[str, Any]) -> None:
        record = record | {"revision": record["revision"] + 1}
        fs, folder = self._path(record["use_case"], record["model_name"], "records")
        fs.mkdirs(folder)
        _, file = self._path(record["use_case"], record["model_name"], "records", f"{record['revision']:08d}.json")
        try:
            stream = fs.create(file, False)
        except Exception as e:
            raise Changed(f"{record['model_name']} was changed by someone else; read it again") from e
        try:
            stream.write(bytearray(json.dumps(record, indent=2, sort_keys=True).encode()))
        finally:
            stream.close()

    def folder(self, use_case: str, name: str, version: str) -> str:
        return "/".join([self.store, use_case, name, "versions", version, "model"])

    def register(self, use_case: str, name: str, model: Model, metrics: Mapping[str, float] | None = None, version: str | None = None, metadata: Mapping[str, Any] | None = None, run_id: str | None = None, config_hash: str | None = None) -> dict[str, Any]:
        record = self._read(use_case, name)
        known = record["versions"]
        if version is None:
            numbers = sorted(tuple(map(int, v.split("-")[0].split("."))) for v in known)
            version = ".".join(map(str, (*numbers[-1][:2], numbers[-1][2] + 1))) if numbers else "1.0.0"
        if version in known:
            raise ValueError(f"{name} {version} is registered already")
        model.save(self.folder(use_case, name, version))
        entry = {"version": version, "stage": "development", "registered_at": now(), "metrics": dict(metrics or {}), "metadata": {**model.metadata(), **(metadata or {})}, "lineage_run_id": run_id, "config_hash": config_hash}
        known[version] = entry
        self._write(record)
        return entry

    def get(self, use_case: str, name: str, version: str | None = None, stage: str | None = None) -> dict[str, Any]:
        known = self._read(use_case, name)["versions"]
        if version:
            if version not in known:
                raise KeyError(f"{name} has no version {version}")
            return known[version]
        found = [v for v in known.values() if stage is None or v["stage"] == stage]
        if not found:
            raise KeyError(f"{name} has no version in stage {stage}" if stage else f"{name} has no versions")
        return max(found, key=lambda v: (v.get("promoted_to_prod") or v.get("promoted_to_staging") or v["registered_at"], v["version"]))

    def first_in(self, use_case: str, name: str, stages: tuple[str, ...] = ("production", "staging")) -> dict[str, Any]:
        for stage in stages:
            try:
                return self.get(use_case, name, stage=stage)
            except KeyError:
                continue
        raise KeyError(f"{name} has no version in {', '.join(stages)}")

    def promote(self, use_case: str, name: str, version: str, to: str, gates: Mapping[str, Any] | None = None, by: str | None = None) -> dict[str, Any]:
        """A promotion to production archives the version that was there."""
        if to not in STAGES[1:3]:
            raise ValueError(f"cannot promote to {to!r}")
        record = self._read(use_case, name)
        entry = record["versions"].get(version)
        if entry is None:
            raise KeyError(f"{name} has no version {version}")
        failed = [m for _, ok, _, m in evaluate_gates(gates or {}, entry["metrics"], entry["metadata"]) if not ok]
        if failed:
            raise GateFailed("; ".join(failed))
        if to == "production":
            for other in record["versions"].values():
                if other["stage"] == "production" and other is not entry:
                    other |= {"stage": "archived", "archived_at": now()}
        entry |= {"stage": to, ("promoted_to_prod" if to == "production" else "promoted_to_staging"): now(), "promoted_by": by}
        self._write(record)
        return entry

    def _move(self, use_case: str, name: str, version: str, to: str) -> dict[str, Any]:
        record = self._read(use_case, name)
        if version not in record["versions"]:
            raise KeyError(f"{name} has no version {version}")
        record["versions"][version] |= {"stage": to} | ({"archived_at": now()} if to == "archived" else {})
        self._write(record)
        return record["versions"][version]

    def demote(self, use_case: str, name: str, version: str, to: str = "development") -> dict[str, Any]:
        if STAGES.index(to) >= STAGES.index(self.get(use_case, name, version)["stage"]):
            raise ValueError("a version is demoted to a lower stage")
        return self._move(use_case, name, version, to)

    def archive(self, use_case: str, name: str, version: str) -> dict[str, Any]:
        return self._move(use_case, name, version, "archived")

    def rollback(self, use_case: str, name: str, version: str) -> dict[str, Any]:
        """Bring an archived version back to production."""
        if self.get(use_case, name, version)["stage"] != "archived":
            raise ValueError("only an archived version can be rolled back to")
        return self.promote(use_case, name, version, "production")

    def versions(self, spark: SparkSession, use_case: str, name: str) -> DataFrame:
        rows = [(v["version"], v["stage"], v["registered_at"], v.get("promoted_to_prod"), json.dumps(v["metrics"], sort_keys=True)) for v in self._read(use_case, name)["versions"].values()]
        return spark.createDataFrame(rows, "version string, stage string, registered_at string, promoted_to_prod string, metrics string")

    def compare(self, spark: SparkSession, use_case: str, name: str, a: str, b: str) -> DataFrame:
        """(metric, value_a, value_b, delta) over all metrics of either version."""
        from .joins import compare

        side = lambda v: spark.createDataFrame([(k, float(x)) for k, x in self.get(use_case, name, v)["metrics"].items()], "metric string, value double")
        return compare(side(a), side(b), "metric", "value")

    def remove(self, use_case: str, name: str) -> None:
        fs, path = self._path(use_case, name)
        fs.delete(path, True)


def model_transform(inputs: Mapping[str, DataFrame], params: Mapping[str, Any], context: Any = None) -> dict[str, DataFrame]:
    """``action`` train or predict. Training gives the metrics as a table, so that a writer
    can take it; a missed gate is a status in that table, or an error with ``fail_on_gate``."""
    action = params.get("action")
    name = params.get("input_name")
    if name is None:
        if len(inputs) != 1:
            raise ValueError("with several inputs, a model transform needs input_name")
        name = next(iter(inputs))
    df = inputs[name]
    spark = df.sparkSession
    cls = load_class(params.get("model_class", f"{__name__}.ForestModel"), getattr(context, "folder", None))
    out = params.get("output_name", "model_output")
    registry = params.get("registry") or {}
    if action == "train":
        model = cls(**(params.get("model_params") or {}))
        metrics = {k: float(v) for k, v in model.train(df).items()}
        version, status, message = None, "trained", ""
        if registry.get("store"):
            store = ModelRegistry(registry["store"])
            where = registry["use_case"], registry["model_name"]
            version = store.register(*where, model, metrics, registry.get("version"), run_id=getattr(context, "run_id", None))["version"]
            if registry.get("promote_to"):
                try:
                    store.promote(*where, version, registry["promote_to"], registry.get("gates"))
                    status = registry["promote_to"]
                except GateFailed as e:
                    if registry.get("fail_on_gate"):
                        raise
                    status, message = "gate_failed", str(e)
        elif params.get("model_path"):
            model.save(params["model_path"])
        rows = [(k, v, version, status, message) for k, v in sorted(metrics.items())]
        return {out: spark.createDataFrame(rows, "metric string, value double, model_version string, status string, message string")}
    if action == "predict":
        version, stage = None, None
        if params.get("model_path"):
            path = params["model_path"]
        else:
            store = ModelRegistry(registry["store"])
            where = registry["use_case"], registry["model_name"]
            stages = params.get("stages") or [params.get("stage", "production")]
            entry = store.get(*where, version=registry.get("version")) if registry.get("version") else store.first_in(*where, stages=tuple(stages))
            version, stage, path = entry["version"], entry["stage"], store.folder(*where, entry["version"])
        scored = cls.load(path).predict(df)
        return {out: scored.withColumns({"model_version": F.lit(version).cast("string"), "model_stage": F.lit(stage).cast("string")})}
    raise ValueError(f"unknown model action {action!r}")
