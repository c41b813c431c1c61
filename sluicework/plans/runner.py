"""Running tasks and pipelines, by the Python API and the command line alike."""

from __future__ import annotations

import hashlib
import importlib.util
import inspect
import sys
import time
import uuid
from collections.abc import Mapping, Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..functions.fingerprints import config_fingerprint
from ..operators.models import now
from ..operators.transforms import chain
from ..session import overlaid, select_catalog, session
from ..sources.registry import Registry, default_registry
from .hooks import Context, Hook, Hooks, named_hooks
from .lineage import LineageStore, RunRecord, StepRecord, location_of, observed, settled
from .spec import Config, load


class Task:
    """A unit of work: subclass it in a task folder's ``transformations.py``."""

    def __init__(self, config: Mapping[str, Any]):
        self.config = config

    def setup(self) -> None:
        """Called once before ``transform``."""

    def transform(self, sources: dict[str, DataFrame]) -> dict[str, DataFrame]:
        raise NotImplementedError


def find_task(folder: Path) -> type[Task] | None:
    """The Task subclass that the folder's own module defines, not one it imports."""
    if not (folder / "transformations.py").exists():
        return None
    module = _module(folder)
    own = [c for c in vars(module).values() if inspect.isclass(c) and issubclass(c, Task) and c is not Task and c.__module__ == module.__name__]
    if len(own) > 1:
        raise ValueError(f"{folder} defines several tasks: {', '.join(c.__name__ for c in own)}")
    return own[0] if own else None


def _module(folder: Path):
    """The folder's module, under a name of its own."""
    path = (folder / "transformations.py").resolve()
    name = f"sluice_task_{hashlib.sha1(str(path).encode()).hexdigest()[:12]}"
    spec = importlib.util.spec_from_file_location(name, path)
    module = importlib.util.module_from_spec(spec)
    sys.modules[name] = module
    sys.path.insert(0, str(folder))
    try:
        spec.loader.exec_module(module)
    finally:
        sys.path.remove(str(folder))
    return module


class Engine:
    """Reads a task's inputs, applies its transforms, writes its outputs. All lazy up to the
    writes: Catalyst sees each output's whole plan."""

    def __init__(self, spark: SparkSession, registry: Registry | None = None, hooks: Sequence[Hook] = ()):
        self.spark, self.registry, self.hooks = spark, registry or default_registry(), Hooks(hooks)

    def run(self, config: Config, context: Context, task: Task | None = None, record: RunRecord | None = None, dry_run: bool = False) -> dict[str, DataFrame]:
        spec = config.CONFIG
        with self.hooks.task(context):
            if dry_run:
                for group, ports in (("readers", spec.inputs), ("writers", spec.outputs)):
                    for port in ports.values():
                        self.registry.get(group, port.format)
                return {}
            frames: dict[str, DataFrame] = {}
            for name in sorted(spec.inputs):
                settings = spec.inputs[name].settings()
                with self.hooks.step(context, f"read:{name}", {"format": settings["format"]}):
                    frames[name] = self.registry.get("readers", settings["format"])(self.spark, settings)
                if record:
                    record.inputs.append(StepRecord(name, "input", settings["format"], location_of(settings)))
            with self.hooks.step(context, "transform", {}):
                frames = chain(frames, spec.transform, self.registry, context)
                if task is not None:
                    frames = task.transform(frames)
                    if not isinstance(frames, Mapping):
                        raise TypeError(f"the task returned {type(frames).__name__}, not a mapping")
            missing = sorted(set(spec.outputs) - set(frames))
            if missing:
                raise ValueError(f"the transforms made no {', '.join(missing)}; they made {', '.join(sorted(frames))}")
            for name in sorted(spec.outputs):
                settings = spec.outputs[name].settings()
                df = frames[name]
                with self.hooks.step(context, f"write:{name}", {"format": settings["format"]}) as meta:
                    write = self.registry.get("writers", settings["format"])
                    if record is None:
                        write(df, settings)
                        continue
                    watched, watch = observed(df, name)
                    write(watched, settings)
                    step = settled(StepRecord(name, "output", settings["format"], location_of(settings)), df, watch)
                    record.outputs.append(step)
                    meta["row_count"] = step.row_count
            return dict(frames)


def _address(folder: Path) -> tuple[str, str, str]:
    parts = folder.resolve().parts
    return parts[-3], parts[-2], parts[-1]


def run_task(task_dir: str, *, mode: str | None = None, dt: str | None = None, dtf: str | None = None, spark: SparkSession | None = None, lineage: bool = False, lineage_dir: str | None = None, profile: str | None = None, hooks: Sequence[Hook] = (), registry: Registry | None = None, dry_run: bool = False, variables: Mapping[str, Any] | None = None) -> dict[str, DataFrame]:
    """Run one task folder. ``mode`` is the default profile; ``dt``, ``dtf`` and ``mode`` are
    template variables, absent where they are None."""
    folder = Path(task_dir)
    given = {"mode": mode, "dt": dt, "dtf": dtf, **(variables or {})}
    config = load(folder, {k: v for k, v in given.items() if v is not None})
    return _run(folder, config, spark, profile or mode, lineage, lineage_dir, hooks, registry, dry_run)


def _run(folder: Path, config: Config, spark: SparkSession | None, profile: str | None, lineage: bool, lineage_dir: str | None, hooks: Sequence[Hook], registry: Registry | None, dry_run: bool) -> dict[str, DataFrame]:
    usecase, package, name = _address(folder)
    settings = config.profile(profile if config.ENGINE.profiles else None)
    path = f"{usecase}/{package}/{name}"
    context = Context(uuid.uuid4().hex, path, profile, str(folder))
    registry = registry or default_registry()
    extra = named_hooks(config.CONFIG.hooks, config.CONFIG.monitors, registry)
    task_class = find_task(folder)
    if dry_run:
        return Engine(spark, registry, [*hooks, *extra]).run(config, context, dry_run=True)
    with session(f"sluicework:{path}", settings.spark_conf, spark) as active, overlaid(active, settings.spark_conf):
        select_catalog(active, settings.catalog, settings.schema_name)
        engine = Engine(active, registry, [*hooks, *extra])
        task = task_class(config.CONFIG.model_dump()) if task_class else None
        if task is not None:
            task.setup()
        if not lineage:
            return engine.run(config, context, task)
        store = LineageStore(active, lineage_dir or str(folder.parents[2] / ".lineage"))
        record = RunRecord(context.run_id, path, usecase, package, name, profile, config.MODEL, config.VERSION, config_fingerprint(config.model_dump()))
        store.save(record)
        began = time.monotonic()
        try:
            frames = engine.run(config, context, task, record)
            record.status = "success"
            return frames
        except BaseException as e:
            record.status, record.error = "error", str(e)[:2000]
            raise
        finally:
            record.ended_at, record.duration_sec = now(), time.monotonic() - began
            store.save(record)


def run_pipeline(usecase_dir: str, usecase: str, package: str, tasks: Sequence[str], *, mode: str | None = None, dt: str | None = None, dtf: str | None = None, spark: SparkSession | None = None, lineage: bool = False, lineage_dir: str | None = None, profile: str | None = None, hooks: Sequence[Hook] = (), registry: Registry | None = None) -> dict[str, dict[str, DataFrame]]:
    """Run tasks in order in one session, each under its own settings. All files are
    validated before the first task starts."""
    folders = [Path(usecase_dir, usecase, package, t) for t in tasks]
    given = {k: v for k, v in {"mode": mode, "dt": dt, "dtf": dtf}.items() if v is not None}
    configs = [load(f, given) for f in folders]
    first = configs[0].profile((profile or mode) if configs[0].ENGINE.profiles else None)
    out = {}
    with session(f"sluicework:{usecase}/{package}", first.spark_conf, spark) as active:
        for folder, config in zip(folders, configs):
            out[folder.name] = _run(folder, config, active, profile or mode, lineage, lineage_dir, hooks, registry, False)
    return out
