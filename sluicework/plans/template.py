"""Templates in task files: ``{{ name | filter(...) }}`` and ``{{ a if cond else b }}``.

Only string leaves are rendered, after the YAML was parsed, so a value can never change the
file's structure. A name that is unset without a default is an error that names it.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Mapping
from typing import Any

_SPOT = re.compile(r"\{\{(.*?)\}\}", re.S)


class Unset:
    def __init__(self, name: str):
        self.name = name


class TemplateError(ValueError):
    pass


def _truthy(value: Any) -> bool:
    return not isinstance(value, Unset) and bool(value)


FILTERS = {
    "default": lambda v, d="", boolean=False: d if isinstance(v, Unset) or (boolean and not v) else v,
    "upper": lambda v: str(v).upper(),
    "lower": lambda v: str(v).lower(),
    "trim": lambda v: str(v).strip(),
    "replace": lambda v, old, new: str(v).replace(old, new),
    "int": lambda v, d=0: _number(int, v, d),
    "float": lambda v, d=0.0: _number(float, v, d),
}


def _number(kind, value, default):
    try:
        return kind(value)
    except (TypeError, ValueError):
        return default


def _split(text: str, mark: str) -> list[str]:
    """Split at ``mark`` outside quotes and brackets."""
    parts, depth, quote, start = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif not depth and text.startswith(mark, i) and (mark.strip() == mark or i):
            parts.append(text[start:i])
            start = i + len(mark)
    return [*parts, text[start:]]


class Template:
    def __init__(self, variables: Mapping[str, Any], env: Mapping[str, str]):
        self.names = {k: v for k, v in variables.items() if v is not None}
        self.env = env

    def _name(self, path: str) -> Any:
        head, *rest = path.split(".")
        if head == "env":
            return self.env[rest[0]] if len(rest) == 1 and rest[0] in self.env else Unset(path)
        value = self.names.get(head, Unset(path))
        for key in rest:
            value = value[key] if isinstance(value, Mapping) and key in value else Unset(path)
        return value

    def _term(self, text: str) -> Any:
        text = text.strip()
        try:
            return ast.literal_eval(text)
        except (ValueError, SyntaxError):
            pass
        if text in ("true", "false", "none"):
            return {"true": True, "false": False, "none": None}[text]
        if re.fullmatch(r"[A-Za-z_]\w*(\.\w+)*", text):
            return self._name(text)
        raise TemplateError(f"cannot read {text!r}")

    def _condition(self, text: str) -> bool:
        for mark, test in (("==", lambda a, b: a == b), ("!=", lambda a, b: a != b)):
            parts = _split(text, mark)
            if len(parts) == 2:
                return test(self._piped(parts[0]), self._piped(parts[1]))
        text = text.strip()
        if text.startswith("not "):
            return not self._condition(text[4:])
        if text.endswith(" is defined"):
            return not isinstance(self._term(text[: -len(" is defined")]), Unset)
        return _truthy(self._piped(text))

    def _piped(self, text: str) -> Any:
        first, *steps = _split(text, "|")
        value = self._term(first)
        for step in steps:
            m = re.fullmatch(r"\s*(\w+)\s*(?:\((.*)\))?\s*", step, re.S)
            if not m or m[1] not in FILTERS:
                raise TemplateError(f"unknown filter {step.strip()!r}")
            args = [self._piped(a) for a in _split(m[2], ",")] if m[2] and m[2].strip() else []
            if isinstance(value, Unset) and m[1] != "default":
                raise TemplateError(f"{value.name!r} is not set")
            value = FILTERS[m[1]](value, *args)
        return value

    def expression(self, text: str) -> Any:
        by_if = _split(text, " if ")
        if len(by_if) == 2:
            condition, *other = _split(by_if[1], " else ")
            value = self.expression(by_if[0]) if self._condition(condition) else (self.expression(other[0]) if other else "")
        else:
            value = self._piped(text)
        if isinstance(value, Unset):
            raise TemplateError(f"{value.name!r} is not set")
        return value

    def render(self, node: Any) -> Any:
        if isinstance(node, Mapping):
            return {k: self.render(v) for k, v in node.items()}
        if isinstance(node, list):
            return [self.render(v) for v in node]
        return _SPOT.sub(lambda m: str(self.expression(m[1].strip())), node) if isinstance(node, str) and "{{" in node else node
