"""Models by kind and name, loaded when they are first asked for and then kept."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any


class Registry:
    """register(kind, model)(load): load makes the processor; get returns it, made once; an unknown one is an error."""

    def __init__(self) -> None:
        self._loaders: dict[tuple[str, str], Callable[[], Any]] = {}
        self._made: dict[tuple[str, str], Any] = {}

    def register(self, kind: str, model: str) -> Callable[[Callable[[], Any]], Callable[[], Any]]:
        def keep(load: Callable[[], Any]) -> Callable[[], Any]:
            self._loaders[kind, model] = load
            self._made.pop((kind, model), None)
            return load

        return keep

    def models(self, kind: str) -> list[str]:
        return sorted(m for k, m in self._loaders if k == kind)

    def get(self, kind: str, model: str) -> Any:
        if (kind, model) not in self._made:
            if (kind, model) not in self._loaders:
                raise KeyError(f"no {kind} model {model!r}; there are {self.models(kind)}")
            self._made[kind, model] = self._loaders[kind, model]()
        return self._made[kind, model]

    def has(self, kind: str, model: str | None) -> bool:
        return (kind, model) in self._loaders
