"""Extension points: extractors, enrichers, evolvers, grounders, stages and pattern stores, with their metadata."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from importlib.metadata import entry_points
from typing import Any, Protocol, runtime_checkable

from pyspark.sql import DataFrame

KINDS = ("extractor", "enricher", "evolver", "grounder", "stage")


@runtime_checkable
class PatternStore(Protocol):
    """Patterns of a workspace."""

    def load(self, workspace: str) -> DataFrame: ...

    def save(self, name: str, label: str, confidence: float, count: int, workspace: str, source: str) -> None: ...

    def delete(self, name: str, label: str, workspace: str) -> bool: ...


@runtime_checkable
class Stage(Protocol):
    """A step of the pipeline: `execute` makes the next table, `undo` goes back to an earlier one."""

    def execute(self, items: DataFrame) -> DataFrame: ...

    def undo(self, items: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class Plugin:
    name: str
    kind: str
    make: Callable[..., Any]
    version: str = "0"
    needs: tuple[str, ...] = ()
    network: bool = False
    llm: bool = False
    profile: str = "standard"


@dataclass
class Registry:
    """Plugins by kind and name; those that need the network or a language model are refused unless allowed."""

    allow_network: bool = False
    allow_llm: bool = False
    held: dict[tuple[str, str], Plugin] = field(default_factory=dict)

    def add(self, plugin: Plugin) -> None:
        if plugin.kind not in KINDS:
            raise ValueError(f"no such kind of plugin: {plugin.kind}")
        if plugin.network and not self.allow_network or plugin.llm and not self.allow_llm:
            raise PermissionError(f"{plugin.name} asks for more than is allowed")
        self.held[plugin.kind, plugin.name] = plugin

    def get(self, kind: str, name: str) -> Plugin:
        """The plugin, once all it needs is there."""
        plugin = self.held[kind, name]
        missing = [n for n in plugin.needs if not any(n == other for _, other in self.held)]
        if missing:
            raise LookupError(f"{name} needs {', '.join(missing)}")
        return plugin

    def names(self, kind: str) -> list[str]:
        return sorted(n for k, n in self.held if k == kind)

    def discover(self, group: str) -> int:
        """Add what installed packages offer under an entry-point group; each loads to a Plugin."""
        found = [e.load() for e in entry_points(group=group)]
        for plugin in found:
            self.add(plugin)
        return len(found)

    def apply(self, kind: str, name: str, items: DataFrame, **settings: Any) -> DataFrame:
        return self.get(kind, name).make(items, **settings)
