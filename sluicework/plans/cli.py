"""The command line: ``python -m sluicework ...``."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence
from pathlib import Path

from .. import __version__
from ..operators.models import STAGES, ModelRegistry
from ..session import session
from . import export
from .lineage import LineageStore
from .runner import run_task
from .spec import ConfigError, load

CONFIG_TEXT = """MODEL: etl
VERSION: "0.1.0"
ENGINE:
  spark_conf: {{}}
CONFIG:
  inputs:
    source:
      format: path
      path: "{{{{ env.INPUT_PATH | default('data/input') }}}}"
  transform:
    type: noop
  outputs:
    result:
      format: path
      path: "{{{{ env.OUTPUT_PATH | default('data/{task}') }}}}"
      mode: overwrite
"""
TASK_TEXT = '''"""The {task} task."""

from sluicework.plans.runner import Task


class {name}(Task):
    def transform(self, sources):
        return {{"result": sources["source"]}}
'''


def _notebook(task: str) -> str:
    cell = lambda kind, text: {"cell_type": kind, "metadata": {}, "source": text.splitlines(keepends=True)} | ({"outputs": [], "execution_count": None} if kind == "code" else {})
    cells = [cell("markdown", f"# {task}\n"), cell("code", "from sluicework.plans.runner import run_task\n\nframes = run_task('.')\nframes['result'].show()\n")]
    return json.dumps({"cells": cells, "metadata": {}, "nbformat": 4, "nbformat_minor": 5}, indent=1)


def _folders(args: argparse.Namespace) -> list[Path]:
    base = Path(args.usecase_dir, args.usecase, args.package)
    if getattr(args, "all", False):
        return sorted(p.parent for p in base.glob("*/config.yaml"))
    if not args.task:
        raise ConfigError("name at least one task by -t")
    return [base / t for t in args.task]


def _variables(args: argparse.Namespace) -> dict[str, str]:
    given = {"dt": args.data_timestamp, "dtf": getattr(args, "data_timestamp_format", None), "mode": getattr(args, "mode", None)}
    return {k: v for k, v in given.items() if v is not None}


def cmd_init(args) -> int:
    for folder in _folders(args):
        folder.mkdir(parents=True, exist_ok=True)
        name = "".join(p.capitalize() for p in folder.name.split("_"))
        for file, text in (("config.yaml", CONFIG_TEXT.format(task=folder.name)), ("transformations.py", TASK_TEXT.format(task=folder.name, name=name)), (f"{folder.name}.ipynb", _notebook(folder.name))):
            if args.overwrite or not (folder / file).exists():
                (folder / file).write_text(text)
        print(f"made {folder}")
    return 0


def cmd_validate(args) -> int:
    failed = 0
    for folder in _folders(args):
        try:
            load(folder, _variables(args)).profile(args.profile)
            print(f"OK   {folder}")
        except ConfigError as e:
            failed += 1
            print(f"FAIL {folder}\n{e}")
    return int(failed > 0)


def cmd_config(args) -> int:
    for folder in _folders(args):
        print(json.dumps(load(folder, _variables(args)).model_dump(), indent=2))
    return 0


def cmd_plan(args) -> int:
    """The formats of each task and, with --explain, the physical plan of each output."""
    from ..operators.transforms import chain
    from ..sources.registry import default_registry
    from .runner import find_task

    for folder in _folders(args):
        config = load(folder, _variables(args))
        spec = config.CONFIG
        for name, port in sorted(spec.inputs.items()):
            print(f"{folder.name}: read {name} ({port.format})")
        for step in spec.transform:
            print(f"{folder.name}: transform {step.type}")
        for name, port in sorted(spec.outputs.items()):
            print(f"{folder.name}: write {name} ({port.format}, {port.mode or 'default mode'})")
        if args.explain:
            registry = default_registry()
            with session(conf=config.profile(None).spark_conf) as spark:
                frames = {n: registry.get("readers", p.format)(spark, p.settings()) for n, p in spec.inputs.items()}
                frames = chain(frames, spec.transform, registry)
                if task := find_task(folder):
                    frames = task(spec.model_dump()).transform(frames)
                for name in sorted(spec.outputs):
                    frames[name].explain("formatted")
    return 0


def cmd_run(args) -> int:
    folders = _folders(args)
    for folder in folders:
        load(folder, _variables(args))  # all files before the first session
    conf = {"spark.submit.deployMode": args.deploy_mode} if getattr(args, "deploy_mode", None) else {}
    with session("sluicework", conf) as spark:
        for folder in folders:
            run_task(str(folder), mode=args.mode, dt=args.data_timestamp, dtf=args.data_timestamp_format, spark=spark, lineage=args.lineage, lineage_dir=args.lineage_dir, profile=args.profile)
            print(f"done {folder}")
    return 0


def cmd_test(args) -> int:
    """Run with the test profile and lineage on; a failure does not stop the others."""
    results = []
    with session("sluicework-test") as spark:
        for folder in _folders(args):
            try:
                run_task(str(folder), dt=args.data_timestamp, spark=spark, lineage=True, lineage_dir=args.lineage_dir, profile=args.profile or "test")
                results.append((folder.name, True, ""))
            except Exception as e:
                results.append((folder.name, False, str(e).splitlines()[0] if str(e) else type(e).__name__))
    for name, ok, message in results:
        print(f"{'PASS' if ok else 'FAIL'} {name} {message}".rstrip())
    return int(not all(ok for _, ok, _ in results))


def cmd_plugins(args) -> int:
    from ..sources.registry import default_registry

    registry = default_registry()
    for group in registry.groups:
        print(f"{group}: {', '.join(sorted(getattr(registry, group)))}")
    return 0


def cmd_lineage(args) -> int:
    with session("sluicework-lineage") as spark:
        store = LineageStore(spark, args.lineage_dir)
        path = "/".join(x for x in (args.usecase, args.package, args.task) if x) if args.usecase and args.package and args.task else None
        made = {
            "list": lambda: store.latest(path, args.n).select("run_id", "task_path", "status", "started_at", "duration_sec"),
            "show": lambda: store.find(args.run_id),
            "compare": lambda: store.compare(args.run_id, args.other),
            "search": lambda: store.search(args.status, args.since, args.usecase, args.package, args.task).select("run_id", "task_path", "status", "started_at"),
            "trace": lambda: store.trace(args.run_id),
        }[args.what]()
        for line in made.toJSON().take(args.n):
            print(line)
    return 0


def cmd_models(args) -> int:
    store = ModelRegistry(args.store)
    where = args.use_case, args.model
    if args.what in ("list", "compare"):
        with session("sluicework-models") as spark:
            table = store.versions(spark, *where) if args.what == "list" else store.compare(spark, *where, *args.versions.split(","))
            for line in table.toJSON().take(1000):
                print(line)
        return 0
    made = {
        "info": lambda: store.get(*where, version=args.version),
        "promote": lambda: store.promote(*where, args.version, args.to or "staging", by=args.by),
        "demote": lambda: store.demote(*where, args.version, args.to or "development"),
        "rollback": lambda: store.rollback(*where, args.version),
        "archive": lambda: store.archive(*where, args.version),
    }[args.what]()
    print(json.dumps(made, indent=2))
    return 0


def cmd_export(args) -> int:
    text = {"airflow": export.airflow, "databricks": export.databricks}[args.what](args.config, args.profile)
    Path(args.output).write_text(text) if args.output else print(text)
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("sluicework")
    subs = top.add_subparsers(dest="command", required=True)

    def tasks(name: str, run, many: bool = True) -> argparse.ArgumentParser:
        p = subs.add_parser(name)
        p.set_defaults(run=run)
        p.add_argument("-d", "--usecase-dir", default=".")
        p.add_argument("-u", "--usecase", required=True)
        p.add_argument("-p", "--package", required=True)
        p.add_argument("-t", "--task", action="append", default=[])
        p.add_argument("-dt", "--data-timestamp")
        p.add_argument("-dtf", "--data-timestamp-format")
        p.add_argument("-m", "--mode")
        p.add_argument("--profile")
        return p

    tasks("init", cmd_init).add_argument("--overwrite", action="store_true")
    tasks("validate", cmd_validate).add_argument("--all", action="store_true")
    tasks("config", cmd_config)
    tasks("plan", cmd_plan).add_argument("--explain", action="store_true")
    run = tasks("run", cmd_run)
    run.add_argument("--deploy-mode", choices=("client", "cluster"))
    run.add_argument("--lineage", action="store_true")
    run.add_argument("--lineage-dir")
    tasks("test", cmd_test).add_argument("--lineage-dir")
    subs.add_parser("plugins").set_defaults(run=cmd_plugins)
    subs.add_parser("version").set_defaults(run=lambda a: print(__version__) or 0)
    lineage = subs.add_parser("lineage")
    lineage.set_defaults(run=cmd_lineage)
    lineage.add_argument("what", choices=("show", "list", "compare", "search", "trace"))
    for flag in ("--usecase", "--package", "--task", "--run-id", "--other", "--status", "--since"):
        lineage.add_argument(flag)
    lineage.add_argument("--lineage-dir", default=".lineage")
    lineage.add_argument("-n", type=int, default=10)
    models = subs.add_parser("models")
    models.set_defaults(run=cmd_models)
    models.add_argument("what", choices=("list", "info", "promote", "demote", "rollback", "archive", "compare"))
    for flag, needed in (("--use-case", True), ("--model", True), ("--store", True), ("--version", False), ("--versions", False), ("--by", False)):
        models.add_argument(flag, required=needed)
    models.add_argument("--to", choices=STAGES)
    out = subs.add_parser("export")
    out.set_defaults(run=cmd_export)
    out.add_argument("what", choices=("airflow", "databricks"))
    out.add_argument("-c", "--config", required=True)
    out.add_argument("-o", "--output")
    out.add_argument("--profile")
    return top


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return args.run(args)
    except (ConfigError, KeyError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
