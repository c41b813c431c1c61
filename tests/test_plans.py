"""Templates, task files, running, lineage, hooks, export, the command line."""

import json

import pytest

from sluicework.operators.models import GateFailed, Model, ModelRegistry, evaluate_gates, load_class
from sluicework.plans import cli, export
from sluicework.plans.hooks import Context, EventLog, Hook, Hooks
from sluicework.plans.lineage import LineageStore
from sluicework.plans.runner import run_pipeline, run_task
from sluicework.plans.spec import ConfigError, load, parse
from sluicework.plans.template import Template, TemplateError


@pytest.mark.parametrize("text,out", [
    ("{{ a }}", "1"), ("x{{ b | upper }}y", "xQy"), ("{{ c | default('z') }}", "z"), ("{{ none_given | default('d') | upper }}", "D"),
    ("{{ env.HOME_X | default('h') }}", "h"), ("{{ env.KEY }}", "v"), ("{{ 'a b' | replace('a', 'c') }}", "c b"), ("{{ ' q ' | trim }}", "q"),
    ("{{ '7' | int }}", "7"), ("{{ 'x' | float }}", "0.0"), ("{{ 'p' if mode == 'prod' else 'd' }}", "d"), ("{{ 'p' if a else 'd' }}", "p"), ("plain", "plain"),
])
def test_template(text, out):
    assert Template({"a": 1, "b": "q", "mode": "dev", "none_given": None}, {"KEY": "v"}).render(text) == out


@pytest.mark.parametrize("text", ["{{ nope }}", "{{ env.NOPE }}", "{{ a | sing }}", "{{ nope | upper }}"])
def test_template_errors_name_the_cause(text):
    with pytest.raises(TemplateError):
        Template({"a": 1}, {}).render(text)


def port(**k):
    return {"format": "path", "path": "p", **k}


def raw(**k):
    return {"CONFIG": {"inputs": {"a": port()}, "outputs": {"a": port()}, **k}}


@pytest.mark.parametrize("bad", [
    {"CONFIG": {"inputs": {}, "outputs": {"a": port()}}}, {"MODEL": "streaming", **raw()}, {"VERSION": "1", **raw()}, raw(inputs={"a": {"format": "jdbc", "url": "u"}}),
    raw(outputs={"a": port(mode="replace")}), raw(watchers=[]), raw(monitors=[{"params": {}}]), raw(inputs={"a": {"format": "s3"}}), raw(inputs={"a": {"format": "rest_api"}}), [], raw(inputs={"a": {"path": "p"}}),
])
def test_invalid_files(bad):
    with pytest.raises(ConfigError):
        parse(bad)


def test_profiles_and_open_formats():
    c = parse({**raw(inputs={"a": {"format": "their_own", "x": 1}}), "ENGINE": {"spark_conf": {"a": 1, "b": True}, "catalog": "c", "profiles": {"prod": {"spark_conf": {"a": "2"}}}}})
    assert c.profile("prod").spark_conf == {"a": "2", "b": "true"} and c.profile("prod").catalog == "c"
    with pytest.raises(ConfigError):
        c.profile("nope")


@pytest.fixture
def project(tmp_path, spark):
    spark.createDataFrame([(1, "a", 10.0), (2, None, 20.0), (3, "c", 30.0)], "id int, name string, amount double").write.parquet(str(tmp_path / "in"))
    for task, source, target in (("clean", "in", "mid"), ("total", "mid", "out")):
        folder = tmp_path / "uc" / "pk" / task
        folder.mkdir(parents=True)
        (folder / "config.yaml").write_text(f"""
VERSION: "1.0.0"
ENGINE: {{spark_conf: {{spark.sql.shuffle.partitions: "3"}}}}
CONFIG:
  inputs: {{source: {{format: path, path: "{tmp_path}/{source}"}}}}
  outputs: {{result: {{format: path, path: "{tmp_path}/{target}", mode: overwrite}}}}
""")
    (tmp_path / "uc/pk/clean/transformations.py").write_text(
        "from sluicework.plans.runner import Task\nclass Clean(Task):\n    def transform(self, sources):\n        return {'result': sources['source'].dropna()}\n"
    )
    (tmp_path / "uc/pk/total/config.yaml").write_text((tmp_path / "uc/pk/total/config.yaml").read_text() + "  transform:\n    - {type: filter, params: {where: {source: amount > 5}}}\n    - {type: sql, params: {queries: {result: 'SELECT sum(amount) AS total FROM {source}'}}}\n")
    return tmp_path


def test_pipeline_with_lineage(project, spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    run_pipeline(str(project), "uc", "pk", ["clean", "total"], spark=spark, lineage=True, lineage_dir=str(project / "lin"))
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    assert spark.read.parquet(str(project / "out")).collect()[0]["total"] == 40.0
    run_task(str(project / "uc/pk/clean"), spark=spark, lineage=True, lineage_dir=str(project / "lin"))
    store = LineageStore(spark, str(project / "lin"))
    assert store.search(status="success").count() == 3 and store.latest("uc/pk/clean", 1).count() == 1
    a, b = (r["run_id"] for r in store.search(task="clean").orderBy("started_at").collect())
    got = store.compare(a, b).collect()[0]
    assert (got["rows_a"], got["delta"], got["same_data"], got["same_schema"]) == (2, 0, True, True)
    total = store.search(task="total").first()["run_id"]
    assert {r["writer_run"] for r in store.trace(total).filter("direction = 'input'").collect()} == {a}


def test_lineage_costs_no_job(project, spark):
    def jobs(lineage):
        spark.sparkContext.setJobGroup(g := f"g{lineage}", g)
        run_task(str(project / "uc/pk/clean"), spark=spark, lineage=lineage, lineage_dir=str(project / "lin2"))
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(g))

    assert jobs(True) == jobs(False)


def test_failure_is_recorded(project, spark):
    (project / "uc/pk/clean/transformations.py").write_text("from sluicework.plans.runner import Task\nclass C(Task):\n    def transform(self, s):\n        raise RuntimeError('no good')\n")
    with pytest.raises(RuntimeError):
        run_task(str(project / "uc/pk/clean"), spark=spark, lineage=True, lineage_dir=str(project / "lin3"))
    r = LineageStore(spark, str(project / "lin3")).search(status="error").collect()
    assert len(r) == 1 and "no good" in r[0]["error"]


def test_hooks_in_order_and_harmless(tmp_path):
    said = []

    class Loud(Hook):
        def __init__(self, name, broken=False):
            self.name, self.broken = name, broken

        def task(self, context):
            from contextlib import contextmanager

            @contextmanager
            def around():
                if self.broken:
                    raise ValueError("observer")
                said.append(f"+{self.name}")
                yield
                said.append(f"-{self.name}")

            return around()

    with Hooks([Loud("a"), Loud("x", True), Loud("b")]).task(Context("r", "t")):
        pass
    assert said == ["+a", "+b", "-b", "-a"]
    log = EventLog(str(tmp_path / "e.jsonl"))
    with pytest.raises(KeyError):
        with Hooks([log]).step(Context("r", "t"), "s"):
            raise KeyError("k")
    assert [json.loads(x)["event"] for x in (tmp_path / "e.jsonl").read_text().splitlines()] == ["step_start", "step_error"]


def test_cli(project, capsys):
    base = ["-d", str(project), "-u", "uc", "-p", "pk"]
    assert cli.main(["validate", *base, "--all"]) == 0
    (project / "uc/pk/total/config.yaml").write_text("CONFIG: {}")
    assert cli.main(["validate", *base, "--all"]) == 1
    assert cli.main(["init", *base, "-t", "fresh"]) == 0 and load(project / "uc/pk/fresh").CONFIG.inputs
    assert cli.main(["plan", *base, "-t", "clean"]) == 0 and "read source" in capsys.readouterr().out
    assert cli.main(["plugins"]) == 0 and "rest_api" in capsys.readouterr().out
    assert cli.main(["run", *base, "-t", "clean", "--lineage", "--lineage-dir", str(project / "lc")]) == 0
    args = cli.parser().parse_args(export.command(project / "uc/pk/clean", "prod")[1:])
    assert args.profile == "prod" and args.task == ["clean"]
    compile(export.airflow(str(project / "uc/pk/clean")), "dag", "exec")
    assert json.loads(export.databricks(str(project / "uc/pk/clean")))["tasks"][0]["task_key"] == "clean"


class Dull(Model):
    def save(self, path):
        import os

        os.makedirs(path)


def test_model_registry(tmp_path, spark):
    r = ModelRegistry(str(tmp_path))
    assert [r.register("u", "m", Dull(), {"auc": a})["version"] for a in (0.7, 0.9)] == ["1.0.0", "1.0.1"]
    with pytest.raises(GateFailed):
        r.promote("u", "m", "1.0.0", "production", {"min_auc": 0.8})
    r.promote("u", "m", "1.0.0", "production")
    r.promote("u", "m", "1.0.1", "production", {"min_auc": 0.8})
    assert r.get("u", "m", "1.0.0")["stage"] == "archived" and r.first_in("u", "m")["version"] == "1.0.1"
    r.rollback("u", "m", "1.0.0")
    assert r.first_in("u", "m")["version"] == "1.0.0" and r.versions(spark, "u", "m").count() == 2
    assert r.compare(spark, "u", "m", "1.0.0", "1.0.1").collect()[0]["delta"] == 0.2
    with pytest.raises(ValueError):
        r.demote("u", "m", "1.0.0", "production")


def test_gates():
    got = evaluate_gates({"min_auc": 0.5, "max_loss": 1, "min_f1": 0.1, "require_drift_check": True, "min_x": False}, {"auc": 0.5, "loss": 2}, {"drift_check_passed": True})
    assert [(g, ok) for g, ok, *_ in got] == [("min_auc", True), ("max_loss", False), ("min_f1", False), ("require_drift_check", True)]
    with pytest.raises(ValueError):
        evaluate_gates({"about_auc": 1}, {})


def test_classes_of_one_name(tmp_path):
    for n in ("a", "b"):
        (tmp_path / n).mkdir()
        (tmp_path / n / "mod.py").write_text(f"class K:\n    name = '{n}'\n")
    assert [load_class("mod.K", str(tmp_path / n)).name for n in ("a", "b")] == ["a", "b"]
