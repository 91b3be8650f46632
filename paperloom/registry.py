"""Named lookup of interchangeable parts: models, retrievers, templates."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any


class Registry:
    def __init__(self, kind: str):
        self.kind = kind
        self._parts: dict[str, Any] = {}

    def register(self, name: str) -> Callable[[Any], Any]:
        def add(part: Any) -> Any:
            if name in self._parts:
                raise KeyError(f"{self.kind} {name!r} is registered twice")
            self._parts[name] = part
            return part

        return add

    def get(self, name: str) -> Any:
        if name not in self._parts:
            raise KeyError(f"no {self.kind} {name!r}; there are {self.names()}")
        return self._parts[name]

    def names(self) -> list[str]:
        return sorted(self._parts)


MODELS, RETRIEVERS, METRICS = Registry("model"), Registry("retriever"), Registry("metric")
