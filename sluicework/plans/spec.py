"""Task files: loading, rendering and validation, all before a session exists."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from pathlib import Path
from typing import Any, Literal

import yaml
from pydantic import BaseModel, ConfigDict, Field, ValidationError, field_validator, model_validator

from ..sources.writers import MODES
from .template import Template, TemplateError

SEMVER = re.compile(r"\d+\.\d+\.\d+(-[0-9A-Za-z.-]+)?")


class ConfigError(ValueError):
    """A task file that cannot run, with all that is wrong with it."""


class _Strict(BaseModel):
    model_config = ConfigDict(extra="forbid")


class Profile(_Strict):
    spark_conf: dict[str, str] = Field(default_factory=dict)
    catalog: str | None = None
    schema_name: str | None = None

    @field_validator("spark_conf", mode="before")
    @classmethod
    def _texts(cls, value: Any) -> Any:
        return {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in value.items()} if isinstance(value, Mapping) else value


class EngineSpec(Profile):
    profiles: dict[str, Profile] = Field(default_factory=dict)


class PortSpec(BaseModel):
    """One input or output. ``format`` is any registered name; what a format needs is checked
    for the built-in ones."""

    model_config = ConfigDict(extra="allow")
    format: str
    mode: str | None = None

    def settings(self) -> dict[str, Any]:
        return {k: v for k, v in self.model_dump().items() if v is not None}

    @model_validator(mode="after")
    def _complete(self) -> PortSpec:
        has = {k for k, v in self.settings().items() if v not in ("", None)}
        named = "table" in has or "tbl_name" in has
        needs = {
            "hive": (named and ("db_name" in has or "table" in has)) or "sql" in has,
            "unity": named or "sql" in has, "table": named or "sql" in has,
            "jdbc": "url" in has and bool(has & {"table", "dbtable", "sql"}),
            "s3": "path" in has, "path": "path" in has, "binary": "path" in has,
            "delta": bool(has & {"path", "table", "tbl_name"}), "rest_api": "url" in has,
        }
        if not needs.get(self.format, True):
            raise ValueError(f"format {self.format} lacks a setting that it needs")
        if self.mode is not None and self.mode not in MODES:
            raise ValueError(f"unknown mode {self.mode!r}; known: {', '.join(MODES)}")
        return self


class Step(_Strict):
    type: str = "noop"
    params: dict[str, Any] = Field(default_factory=dict)


class MonitorSpec(_Strict):
    type: str
    params: dict[str, Any] = Field(default_factory=dict)
    optional: bool = False


class TaskSpec(_Strict):
    inputs: dict[str, PortSpec] = Field(min_length=1)
    transform: list[Step] = Field(default_factory=lambda: [Step()])
    outputs: dict[str, PortSpec] = Field(min_length=1)
    hooks: list[str] = Field(default_factory=list)
    monitors: list[MonitorSpec] = Field(default_factory=list)

    @field_validator("transform", "monitors", mode="before")
    @classmethod
    def _as_list(cls, value: Any) -> Any:
        return [value] if isinstance(value, Mapping) else value


class Orchestration(BaseModel):
    model_config = ConfigDict(extra="allow")
    type: Literal["airflow", "databricks"] = "airflow"
    schedule: str | None = None
    retries: int = 2
    owner: str = "data"
    tags: list[str] = Field(default_factory=list)


class Config(_Strict):
    MODEL: Literal["etl", "ml"] = "etl"
    VERSION: str = "0.0.0-dev"
    ENGINE: EngineSpec = Field(default_factory=EngineSpec)
    CONFIG: TaskSpec
    ORCHESTRATION: Orchestration | None = None

    @field_validator("VERSION")
    @classmethod
    def _version(cls, value: str) -> str:
        if not SEMVER.fullmatch(value):
            raise ValueError(f"{value!r} is not a semantic version")
        return value

    def profile(self, name: str | None) -> Profile:
        """The base settings with a profile's laid over. A profile that does not exist is an
        error only where the file lists profiles at all."""
        base = self.ENGINE
        if name and base.profiles and name not in base.profiles:
            raise ConfigError(f"no profile {name!r}; known: {', '.join(sorted(base.profiles))}")
        over = base.profiles.get(name or "", Profile())
        return Profile(spark_conf={**base.spark_conf, **over.spark_conf}, catalog=over.catalog or base.catalog, schema_name=over.schema_name or base.schema_name)


def config_file(path: str | Path) -> Path:
    path = Path(path)
    file = path / "config.yaml" if path.is_dir() else path
    if not file.exists():
        raise ConfigError(f"{file} does not exist")
    return file


def parse(raw: Any, variables: Mapping[str, Any] | None = None, env: Mapping[str, str] | None = None, origin: str = "config") -> Config:
    if not isinstance(raw, Mapping):
        raise ConfigError(f"{origin}: the file does not hold a mapping")
    try:
        rendered = Template(variables or {}, os.environ if env is None else env).render(raw)
        return Config.model_validate(rendered)
    except TemplateError as e:
        raise ConfigError(f"{origin}: {e}") from None
    except ValidationError as e:
        lines = [f"  {'.'.join(map(str, x['loc']))}: {x['msg']}" for x in e.errors()]
        raise ConfigError(f"{origin} is not valid:\n" + "\n".join(lines)) from None


def load(path: str | Path, variables: Mapping[str, Any] | None = None, env: Mapping[str, str] | None = None) -> Config:
    file = config_file(path)
    try:
        raw = yaml.safe_load(file.read_text())
    except yaml.YAMLError as e:
        raise ConfigError(f"{file}: {e}") from None
    return parse(raw, variables, env, str(file))
