"""Registries of extension points, looked up by case-insensitive names and aliases."""

from __future__ import annotations

import importlib
import pkgutil
import sys
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from importlib.metadata import entry_points
from pathlib import Path
from typing import Any


class Registry:
    """Named objects; a name or alias is taken once."""

    def __init__(self, kind: str) -> None:
        self.kind = kind
        self._items: dict[str, Any] = {}
        self._names: list[str] = []

    def register(self, name: str, aliases: Iterable[str] = ()) -> Callable[[Any], Any]:
        def add(item: Any) -> Any:
            for n in (name, *aliases):
                if self._items.setdefault(n.lower(), item) is not item:
                    raise ValueError(f"{self.kind} {n!r} is registered already")
            self._names.append(name.lower())
            return item

        return add

    def get(self, name: str) -> Any:
        if (found := self._items.get(name.lower())) is None:
            raise KeyError(f"there is no {self.kind} {name!r}; known are {', '.join(self.names())}")
        return found

    def names(self) -> list[str]:
        return sorted(self._names)


@dataclass(frozen=True)
class Benchmark:
    """A table of evaluation rows and how it is scored.

    load takes (spark, path, subsets) and gives rows; score takes rows with ``prediction`` and gives
    them with ``score``; rollup turns scored rows into (scope, task, metric, value).
    """

    name: str
    description: str
    subsets: tuple[str, ...]
    load: Callable
    score: Callable
    rollup: Callable
    defaults: dict = field(default_factory=dict)


benchmarks = Registry("benchmark")
#: Compressors take (kv, **parameters) and give the relation with a score, or the surviving rows.
compressors = Registry("compressor")
#: Attention methods take (queries, kv, **parameters) and give the output.
attention_methods = Registry("attention method")
#: The former name of the same registry.
prefill_methods = attention_methods
#: Positional methods give (inverse frequencies, position factor, attention scale).
positional_methods = Registry("positional method")
#: Answerers take a DataFrame of prompts and give it with a prediction.
answerers = Registry("answerer")
#: Retrievers are answerers of contexts (``plans.contexts``): setup, predict, teardown.
retrievers = Registry("retriever")


#: The group of entry points by which an installed package names modules that register plug-ins.
GROUP = "evalloom.plugins"


def discover(package: str | None = None, folder: str | Path | None = None) -> dict[str, Exception]:
    """Imports modules, which register what they hold: all below a package, all of a folder, and those that installed
    packages name as entry points of ``GROUP``.

    A module that cannot be imported keeps no other from being found; the result is what went wrong, by module. Names
    that start with an underscore are left out. What is imported already is not imported again.
    """
    names, failed = [], {}
    if folder is not None:
        folder = Path(folder).resolve()
        if str(folder) not in sys.path:
            sys.path.append(str(folder))
        names += [m.name for m in pkgutil.iter_modules([str(folder)])]
    if package is not None:
        try:
            root = importlib.import_module(package)
            names += [m.name for m in pkgutil.walk_packages(getattr(root, "__path__", []), f"{package}.", onerror=lambda _: None)]
        except Exception as e:  # noqa: BLE001 - reported by module
            failed[package] = e
    names += [e.module for e in entry_points(group=GROUP)]
    for name in dict.fromkeys(names):
        if any(part.startswith("_") for part in name.split(".")):
            continue
        try:
            importlib.import_module(name)
        except Exception as e:  # noqa: BLE001 - a plug-in may raise anything; it is reported by module
            failed[name] = e
    return failed


def subset_list(text: str | None, default: Iterable[str] = ()) -> list[str]:
    """Names of a comma-separated list, the default if it has none."""
    return [s for p in (text or "").split(",") if (s := p.strip())] or list(default)
