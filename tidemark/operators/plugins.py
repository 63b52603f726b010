"""User detectors: a registry, a runner over files, and checks of a plugin's form."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from tidemark.functions.tables import WEIGHTS
from tidemark.operators.functions import FINDING


@dataclass(frozen=True)
class Plugin:
    """detect(content, language, path) gives dicts with type and, where known, severity, function_name, line, metric_value."""

    name: str
    detect: Callable[[str, str, str], list[dict]]
    languages: tuple[str, ...] = ()
    weights: dict[str, float] = field(default_factory=dict)


class Registry:
    def __init__(self):
        self.plugins: dict[str, Plugin] = {}

    def register(self, plugin: Plugin) -> list[str]:
        """Adds a plugin; a name twice is an error, weights of built-in types are only warned of."""
        if plugin.name in self.plugins:
            raise ValueError(f"{plugin.name} is registered")
        if found := validate(plugin):
            raise ValueError("; ".join(found))
        self.plugins[plugin.name] = plugin
        return [f"{k} is a built-in type" for k in plugin.weights if k in WEIGHTS]

    def unregister(self, name: str) -> bool:
        return self.plugins.pop(name, None) is not None

    def clear(self) -> None:
        self.plugins.clear()

    def weight(self, kind: str) -> float:
        """Built-in first, then a plugin's, else 0."""
        return WEIGHTS.get(kind, next((p.weights[kind] for p in self.plugins.values() if kind in p.weights), 0.0))


def run(files: DataFrame, registry: Registry) -> DataFrame:
    """Findings of all plugins over files (path, language, content); a plugin that fails on a file finds nothing there."""
    active = list(registry.plugins.values())
    names = [x.split()[0] for x in FINDING.split(", ")]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, lang, content in zip(b["path"], b["language"], b["content"], strict=True):
                for p in active:
                    if p.languages and lang not in p.languages:
                        continue
                    try:
                        found = p.detect(content or "", lang, path)
                    except Exception:  # noqa: BLE001, S112
                        continue
                    rows += [(path, x.get("type"), x.get("severity", "low"), x.get("function_name"), x.get("line"), x.get("metric_value")) for x in found]
            yield pd.DataFrame(rows, columns=names).astype({"line": "Int32", "metric_value": "float64"})

    return files.selectExpr("cast(path as string) path", "language", "content").mapInPandas(each, FINDING)


def validate(plugin: Plugin) -> list[str]:
    """What is wrong with a plugin's form."""
    out = [] if re.fullmatch(r"[a-z][a-z0-9-]*", plugin.name or "") else ["name: small letters, digits and -"]
    out += [f"weight of {k}" for k, w in plugin.weights.items() if not re.fullmatch(r"[A-Z]\w+", k) or not 0 <= w <= 5]
    try:
        if not isinstance(plugin.detect("", "python", "x.py"), list):
            out.append("detect doesn't give a list")
    except Exception as e:  # noqa: BLE001
        out.append(f"detect fails on empty content: {e}")
    return out


def conforms(plugin: Plugin, positive: list[str] = (), negative: list[str] = ()) -> list[str]:
    """validate, and: fixtures are found or not found, twice alike."""
    out = validate(plugin)
    lang = plugin.languages[0] if plugin.languages else "python"
    for code in (*positive, *negative):
        a, b = plugin.detect(code, lang, "x"), plugin.detect(code, lang, "x")
        if a != b:
            out.append("detect isn't deterministic")
        if bool(a) != (code in positive):
            out.append(f"{'nothing' if code in positive else 'something'} found in {code[:30]!r}")
    return out
