"""Cases that the standard tables do not hold: repeated and null keys, order of near ties, concurrent
changes, models after observed writes, estimators made elsewhere, monitors."""

import json

import numpy as np
import pytest
from conftest import SMALL, rows

from sluicework.operators import cleaning, joins, models, statistics
from sluicework.operators.estimators import ArrayModel, PipelineModelOf, arrays
from sluicework.plans import runner
from sluicework.plans.hooks import Context, Hook, named_hooks
from sluicework.plans.spec import MonitorSpec, parse
from sluicework.session import shared_folder
from sluicework.sources import readers, rest, writers
from sluicework.sources.registry import default_registry


def test_training_after_an_observed_write(spark):
    """An observation leaves something in the session that cannot go to executors."""
    from pyspark.sql import Observation

    watch = Observation("n")
    from pyspark.sql import functions as F

    spark.range(10).observe(watch, F.count("*").alias("n")).write.format("noop").mode("overwrite").save()
    assert watch.get["n"] == 10
    df = spark.createDataFrame([(i, float(i % 7), "ab"[i % 2], int(i % 7 > 3)) for i in range(200)], "id long, x double, c string, y int")
    model = models.ForestModel(["x"], ["c"], "y", trees=3, key="id")
    assert model.train(df)["accuracy"] > 0.9 and model.predict(df).count() == 200


def test_upsert_of_repeated_and_null_keys(spark):
    target = spark.createDataFrame([(1, "a"), (None, "b"), (3, "c")], "k long, v string")
    fresh = spark.createDataFrame([(1, "x"), (None, "n"), (4, "y")], "k long, v string")
    assert rows(joins.upsert(target, fresh, ["k"])) == rows(spark.createDataFrame([(1, "x"), (None, "b"), (None, "n"), (3, "c"), (4, "y")], "k long, v string"))
    twice = spark.createDataFrame([(1, "x"), (1, "y"), (None, "p"), (None, "q")], "k long, v string")
    with pytest.raises(Exception, match="repeats the key"):
        joins.upsert(target, twice, ["k"]).collect()
    assert joins.upsert(target, twice.filter("k is null"), ["k"]).count() == 5


def test_merges_leave_the_target_whole(spark):
    path, df = shared_folder(spark, "merge"), spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    writers.write_path(df, {"path": path})
    bad = spark.createDataFrame([(1, "x"), (1, "y")], "k long, v string")
    with pytest.raises(Exception, match="repeats the key"):
        writers.write_path(bad, {"path": path, "mode": "merge", "merge_keys": "k"})
    assert rows(spark.read.parquet(path)) == rows(df)
    writers.write_table(df, {"table": "merged_here", "mode": "overwrite"})
    writers.write_table(spark.createDataFrame([(2, "z"), (5, "n")], df.schema), {"table": "merged_here", "mode": "merge", "merge_keys": ["k"]})
    assert rows(spark.table("merged_here")) == [(1, "a"), (2, "z"), (5, "n")]
    with pytest.raises(Exception, match="repeats the key"):
        writers.write_table(bad, {"table": "merged_here", "mode": "merge", "merge_keys": ["k"]})
    assert spark.table("merged_here").count() == 3
    spark.sql("DROP TABLE merged_here")


def test_nearest_is_by_the_unrounded_similarity(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1e-4])], "id long, v array<double>")
    assert statistics.most_similar(df, "id", "v", [1.0, 1e-4], 1).first()["id"] == 2


@pytest.mark.parametrize("values", [[3.0], [1.0, 2.0], [5.0] * 50, [float(i * i % 997) for i in range(3000)], [None, 4.0, None]])
def test_quantiles_against_numpy(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = {r["i"]: r["value"] for r in statistics.quantiles(df, ["x"], [0, 0.1, 0.25, 0.5, 0.99, 1]).collect()}
    want = np.quantile([v for v in values if v is not None], [0, 0.1, 0.25, 0.5, 0.99, 1])
    assert np.allclose([got[i] for i in range(6)], want)
    assert statistics.quantiles(df.limit(0), ["x"], [0.5]).count() == 0
    assert cleaning.impute_median(df, "x").filter("x is null").count() == 0


def test_split_keeps_shares_and_null_keys(spark):
    df = spark.createDataFrame([(i, i % 3 if i % 10 else None) for i in range(1000)] + [(None, 1)], "id long, s int")
    found = {(r["s"], r["split"]): r["count"] for r in cleaning.split_by_hash(df, "id", "s").groupBy("s", "split").count().collect()}
    for s in (None, 0, 1, 2):
        n = found[s, "train"] + found.get((s, "test"), 0)
        assert found[s, "train"] == int(n * 0.8)


def test_contract_and_names(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert cleaning.select_contract(df, ["b"]).columns == ["b"]
    with pytest.raises(ValueError, match="missing columns: c"):
        cleaning.select_contract(df, ["b", "c"])
    with pytest.raises(ValueError):
        cleaning.normalise_names(df.toDF("a", " a"))


def test_registry_tells_of_changes_at_once(spark):
    class Nothing(models.Model):
        def save(self, path):
            pass

    store = models.ModelRegistry(shared_folder(spark, "registry"))
    store.register("u", "m", Nothing(), {"a": 1.0})
    seen = store._read("u", "m")
    store.promote("u", "m", "1.0.0", "staging")
    with pytest.raises(models.Changed):
        store._write(seen)
    assert store.get("u", "m", stage="staging")["version"] == "1.0.0"
    store.remove("u", "m")
    with pytest.raises(KeyError):
        store.get("u", "m")


MIDDLE = '''
import numpy as np


class Middle:
    """Says 1 above the middle of what it saw."""

    def fit(self, x, y=None):
        self.middle = float(np.median(x[:, 0]))

    def predict_proba(self, x):
        score = (x[:, 0] > self.middle).astype(float)
        return np.stack([1 - score, score], axis=1)
'''


def stages():
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    return [VectorAssembler(inputCols=["x"], outputCol="features"), LinearRegression(labelCol="y")]


def test_estimators_made_elsewhere(spark, tmp_path):
    (tmp_path / "middle.py").write_text(MIDDLE)
    df = spark.createDataFrame([(i, float(i), int(i > 49)) for i in range(100)], "id long, x double, y int")
    model = ArrayModel(["x"], "y", models.load_class("middle.Middle", str(tmp_path))())
    assert model.train(df) == {"rows": 100.0, "accuracy": 1.0}
    path = shared_folder(spark, "array-model")
    model.save(path)
    scored = ArrayModel.load(path).predict(df.withColumnRenamed("y", "proba")).collect()
    assert all(r["prediction"] == r["proba"] == float(r["id"] > 49) for r in scored)
    assert len(arrays(df, ["x"], "y", max_rows=20)[0]) < 60 and arrays(np.ones((2, 1)), [])[0].shape == (2, 1)

    pipeline = PipelineModelOf([f"{__name__}.stages"], ["prediction"])
    pipeline.train(df)
    path = shared_folder(spark, "pipeline-model")
    pipeline.save(path)
    assert PipelineModelOf.load(path).predict(df).columns == ["id", "x", "y", "prediction"]


def test_classes_of_a_folder_reach_the_workers(spark, tmp_path):
    (tmp_path / "shape.py").write_text("class Twice:\n    def __call__(self, x):\n        return 2 * x\n")
    twice = models.load_class("shape.Twice", str(tmp_path))()
    df = spark.range(4).selectExpr("cast(id as double) x")
    assert sorted(r["score"] for r in models.batch_score(df, ["x"], lambda p: twice(p["x"])).collect()) == [0.0, 2.0, 4.0, 6.0]


def test_monitors_of_a_task_file(spark, tmp_path):
    said = []

    class Watch:
        def __init__(self, name):
            self.name = name

        def task_start(self, context):
            said.append((self.name, "start"))

        def task_end(self, context, status):
            said.append((self.name, status))

    registry = default_registry()
    registry.add("monitors", "watch", Watch)
    port = {"format": "path", "path": f"{SMALL}/region.parquet"}
    wanted = [{"type": "watch", "params": {"name": "w"}}, {"type": "absent", "optional": True}, {"type": "events", "params": {"path": str(tmp_path / "e.jsonl")}}, {"type": "mlflow"}]
    config = parse({"CONFIG": {"inputs": {"r": port}, "outputs": {"r": {"format": "path", "path": f"file://{tmp_path}/mode=dev/dt=2024-01-01"}}, "monitors": wanted}}, {}, {})
    hooks = named_hooks(config.CONFIG.hooks, config.CONFIG.monitors, registry)
    assert len(hooks) == 3 and all(isinstance(h, Hook) for h in hooks)
    runner.Engine(spark, registry, hooks).run(config, Context("r", "t"))
    assert said == [("w", "start"), ("w", "success")]
    assert json.loads((tmp_path / "e.jsonl").read_text().splitlines()[0])["event"] == "task_start"
    # The folders of the path are columns when it is read back.
    back = spark.read.option("basePath", f"file://{tmp_path}").parquet(f"file://{tmp_path}/mode=dev")
    assert {r["mode"] for r in back.collect()} == {"dev"} and back.count() == 5
    with pytest.raises(KeyError):
        named_hooks([], [MonitorSpec(type="absent")], registry)


def test_rest_offsets_and_retries_as_set(monkeypatch):
    asked = []

    class Reply:
        status_code = 503

        def raise_for_status(self):
            raise RuntimeError("refused")

    client = rest.Client({"url": "u", "rate_limit": {"max_retries": 1, "retry_on": [503]}})
    client._sleep = lambda s: None
    client._session.request = lambda *a, **k: asked.append(k["params"]) or Reply()
    with pytest.raises(RuntimeError):
        client.send("u", {})
    assert len(asked) == 2

    client = rest.Client({"url": "u", "params": {"offset": 30}, "pagination": {"type": "offset", "page_size": 10, "max_pages": 2}})
    asked.clear()
    monkeypatch.setattr(client, "send", lambda url, params, body=None: asked.append(dict(params)) or type("R", (), {"json": lambda self: [1]})())
    list(client.pages())
    assert [p["offset"] for p in asked] == [30, 40]


@pytest.mark.parametrize("auth, found", [
    ({"type": "api_key_header", "key": "k"}, lambda s: s.headers["X-Api-Key"] == "k"), ({"type": "api_key_query", "key": "k"}, lambda s: s.params == {"api_key": "k"}),
    ({"type": "basic", "username": "u", "password": "p"}, lambda s: s.auth == ("u", "p")), ({"type": "bearer", "token": "t"}, lambda s: s.headers["Authorization"] == "Bearer t"),
])
def test_rest_auth(auth, found):
    assert found(rest.Client({"url": "u", "auth": auth})._session)


def test_missing_formats_say_so(spark):
    for kind in ("delta", "avro"):
        with pytest.raises(ValueError, match=kind):
            readers.read_path(spark, {"path": "/nowhere", "file_format": kind})
