"""Transforms that task files name: a map of DataFrames in, a map of DataFrames out."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame

Frames = dict[str, DataFrame]


def noop(inputs: Frames, params: Mapping[str, Any], context: Any = None) -> Frames:
    return dict(inputs)


def sql(inputs: Frames, params: Mapping[str, Any], context: Any = None) -> Frames:
    """``queries``: output names to SQL over the inputs, which are referred to as {name}. The
    other inputs pass through if ``keep`` is set."""
    queries = params.get("queries")
    if not isinstance(queries, Mapping) or not queries:
        raise ValueError("a sql transform needs queries")
    made = {}
    for name, text in queries.items():
        frames = {**inputs, **made}
        spark = next(iter(frames.values())).sparkSession
        made[name] = spark.sql(text, args=params.get("args"), **{k: v for k, v in frames.items() if f"{{{k}}}" in text})
    return {**inputs, **made} if params.get("keep") else made


def filter_rows(inputs: Frames, params: Mapping[str, Any], context: Any = None) -> Frames:
    """``where``: input names to SQL predicates."""
    where = params.get("where") or {}
    unknown = set(where) - set(inputs)
    if unknown:
        raise ValueError(f"no such inputs: {sorted(unknown)}")
    return {k: v.filter(where[k]) if k in where else v for k, v in inputs.items()}


def model(inputs: Frames, params: Mapping[str, Any], context: Any = None) -> Frames:
    from .models import model_transform

    return model_transform(inputs, params, context)


def chain(inputs: Frames, steps, registry, context: Any = None) -> Frames:
    """Steps one after another, each on what the one before returned. All lazy: Catalyst sees
    one plan."""
    frames = dict(inputs)
    for step in steps:
        frames = registry.get("transforms", step.type)(frames, step.params, context)
        if not isinstance(frames, Mapping):
            raise TypeError(f"transform {step.type!r} returned {type(frames).__name__}, not a mapping")
    return dict(frames)


TRANSFORMS = {"noop": noop, "sql": sql, "filter": filter_rows, "model": model}
