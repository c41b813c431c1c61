"""Formats by name. Third parties register their own, here or by an entry point."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from importlib.metadata import entry_points
from typing import Any

from pyspark.sql import DataFrame, SparkSession

Read = Callable[[SparkSession, Mapping[str, Any]], DataFrame]
Write = Callable[[DataFrame, Mapping[str, Any]], None]


class Registry:
    """Readers, writers, transforms and monitors. A later registration replaces an earlier one."""

    groups = ("readers", "writers", "transforms", "monitors")

    def __init__(self) -> None:
        self.readers: dict[str, Read] = {}
        self.writers: dict[str, Write] = {}
        self.transforms: dict[str, Callable[..., dict[str, DataFrame]]] = {}
        self.monitors: dict[str, Callable[..., Any]] = {}

    def add(self, group: str, name: str, item: Callable) -> None:
        if group not in self.groups:
            raise ValueError(f"no such group: {group}")
        getattr(self, group)[name] = item

    def get(self, group: str, name: str) -> Callable:
        known = getattr(self, group)
        if name not in known:
            raise KeyError(f"{group[:-1]} {name!r} is not registered; known: {', '.join(sorted(known))}")
        return known[name]

    def load_entry_points(self) -> Registry:
        for group in self.groups:
            for point in entry_points(group=f"sluicework.{group}"):
                self.add(group, point.name, point.load())
        return self


def default_registry() -> Registry:
    from ..operators.transforms import TRANSFORMS
    from .readers import READERS
    from .writers import WRITERS

    registry = Registry()
    for group, items in (("readers", READERS), ("writers", WRITERS), ("transforms", TRANSFORMS)):
        for name, item in items.items():
            registry.add(group, name, item)
    return registry.load_entry_points()
