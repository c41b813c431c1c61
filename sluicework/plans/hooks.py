"""Hooks around tasks and steps, and the observers that ship with the engine."""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Iterator, Sequence
from contextlib import ExitStack, contextmanager
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

log = logging.getLogger("sluicework")


@dataclass
class Context:
    """What a run knows about itself."""

    run_id: str
    task: str
    profile: str | None = None
    folder: str | None = None
    state: dict[str, Any] = field(default_factory=dict)


class Hook:
    """An observer. ``task`` and ``step`` surround what they observe; an observer that fails
    never fails the run, an error of the run passes through it."""

    @contextmanager
    def task(self, context: Context) -> Iterator[None]:
        yield

    @contextmanager
    def step(self, context: Context, name: str, meta: dict[str, Any]) -> Iterator[None]:
        yield


@contextmanager
def _guarded(made) -> Iterator[None]:
    """Enter, and leave in spite of failures of the observer itself."""
    try:
        made.__enter__()
    except Exception as e:
        log.warning("an observer failed to start: %s", e)
        yield
        return
    try:
        yield
    except BaseException as e:
        try:
            made.__exit__(type(e), e, e.__traceback__)
        except BaseException as other:
            if other is not e:
                log.warning("an observer failed to end: %s", other)
        raise
    else:
        try:
            made.__exit__(None, None, None)
        except Exception as e:
            log.warning("an observer failed to end: %s", e)


class Hooks:
    """Several hooks: entered in order, left in reverse."""

    def __init__(self, hooks: Sequence[Hook] = ()):
        self.hooks = list(hooks)

    @contextmanager
    def task(self, context: Context) -> Iterator[None]:
        with ExitStack() as stack:
            for hook in self.hooks:
                stack.enter_context(_guarded(hook.task(context)))
            yield

    @contextmanager
    def step(self, context: Context, name: str, meta: dict[str, Any] | None = None) -> Iterator[dict[str, Any]]:
        meta = {} if meta is None else meta
        with ExitStack() as stack:
            for hook in self.hooks:
                stack.enter_context(_guarded(hook.step(context, name, meta)))
            yield meta


class EventLog(Hook):
    """One JSON line per event; ``spark.read.json`` makes a table of them."""

    def __init__(self, path: str):
        self.path = Path(path)

    def _say(self, context: Context, event: str, **more: Any) -> None:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        with self.path.open("a") as f:
            f.write(json.dumps({"ts": time.time(), "task": context.task, "profile": context.profile, "run_id": context.run_id, "event": event, **more}, default=str) + "\n")

    @contextmanager
    def _around(self, context: Context, kind: str, **more: Any) -> Iterator[None]:
        began = time.monotonic()
        self._say(context, f"{kind}_start", **more)
        try:
            yield
        except BaseException as e:
            self._say(context, f"{kind}_error", error=str(e)[:500], seconds=time.monotonic() - began, **more)
            raise
        self._say(context, f"{kind}_end", seconds=time.monotonic() - began, **more)

    @contextmanager
    def task(self, context: Context) -> Iterator[None]:
        with self._around(context, "task"):
            yield

    @contextmanager
    def step(self, context: Context, name: str, meta: dict[str, Any]) -> Iterator[None]:
        with self._around(context, "step", step=name):
            yield


class Timings(Hook):
    """Seconds of every step, kept in the context's state."""

    @contextmanager
    def step(self, context: Context, name: str, meta: dict[str, Any]) -> Iterator[None]:
        began = time.monotonic()
        try:
            yield
        finally:
            context.state.setdefault("timings", {})[name] = time.monotonic() - began


class Monitor(Hook):
    """Adapts an object with task_start and task_end to a hook."""

    def __init__(self, target: Any):
        self.target = target

    @contextmanager
    def task(self, context: Context) -> Iterator[None]:
        self._call("task_start", context, None)
        try:
            yield
        except BaseException:
            self._call("task_end", context, "error")
            raise
        self._call("task_end", context, "success")

    def _call(self, name: str, context: Context, status: str | None) -> None:
        if callable(f := getattr(self.target, name, None)):
            try:
                f(context=context, status=status) if status else f(context=context)
            except Exception as e:
                log.warning("a monitor failed in %s: %s", name, e)


class Counters(Hook):
    """Prometheus counters, where that library is installed; otherwise does nothing."""

    def __init__(self) -> None:
        try:
            from prometheus_client import Counter, Histogram
        except ImportError:
            self._runs = self._seconds = None
        else:
            self._runs = Counter("sluicework_steps", "steps run", ["task", "step", "status"])
            self._seconds = Histogram("sluicework_step_seconds", "seconds a step took", ["task", "step"])

    @contextmanager
    def step(self, context: Context, name: str, meta: dict[str, Any]) -> Iterator[None]:
        began, status = time.monotonic(), "error"
        try:
            yield
            status = "success"
        finally:
            if self._runs is not None:
                self._runs.labels(context.task, name, status).inc()
                self._seconds.labels(context.task, name).observe(time.monotonic() - began)


class Spans(Hook):
    """OpenTelemetry spans, where that library is installed; otherwise does nothing."""

    def __init__(self) -> None:
        try:
            from opentelemetry import trace
        except ImportError:
            self._tracer = None
        else:
            self._tracer = trace.get_tracer("sluicework")

    @contextmanager
    def step(self, context: Context, name: str, meta: dict[str, Any]) -> Iterator[None]:
        if self._tracer is None:
            yield
            return
        with self._tracer.start_as_current_span(name):
            yield


class Experiment(Hook):
    """An MLflow run per task with its settings, step seconds and row counts, where that library is
    installed; otherwise does nothing."""

    def __init__(self, experiment: str | None = None, run_name: str | None = None, tags: dict[str, str] | None = None) -> None:
        try:
            import mlflow
        except ImportError:
            mlflow = None
        self._mlflow, self.experiment, self.run_name, self.tags = mlflow, experiment, run_name, tags or {}

    @contextmanager
    def task(self, context: Context) -> Iterator[None]:
        if self._mlflow is None:
            yield
            return
        if self.experiment:
            self._mlflow.set_experiment(self.experiment)
        began = time.monotonic()
        with self._mlflow.start_run(run_name=self.run_name or context.task, tags=self.tags):
            self._mlflow.log_params({"task": context.task, "profile": context.profile, "run_id": context.run_id})
            status = "error"
            try:
                yield
                status = "success"
            finally:
                self._mlflow.set_tag("status", status)
                self._mlflow.log_metric("seconds", time.monotonic() - began)

    @contextmanager
    def step(self, context: Context, name: str, meta: dict[str, Any]) -> Iterator[None]:
        began = time.monotonic()
        yield
        if self._mlflow is not None:
            clean = name.replace(":", ".")
            self._mlflow.log_metric(f"{clean}.seconds", time.monotonic() - began)
            if meta.get("row_count") is not None:
                self._mlflow.log_metric(f"{clean}.rows", float(meta["row_count"]))


NAMED = {"timings": Timings, "counters": Counters, "spans": Spans, "events": EventLog, "mlflow": Experiment}


def named_hooks(names: Sequence[str], monitors: Sequence[Any], registry: Any) -> list[Hook]:
    """The hooks that a task file names, and its monitors: each (type, params, optional) names an
    observer of this engine or one that the registry knows; an unknown one is an error unless optional."""
    made: list[Hook] = [NAMED[n]() for n in names]
    for monitor in monitors:
        target = NAMED.get(monitor.type)
        if target is None:
            try:
                target = registry.get("monitors", monitor.type)
            except KeyError:
                if monitor.optional:
                    continue
                raise
        built = target(**monitor.params)
        made.append(built if isinstance(built, Hook) else Monitor(built))
    return made
