"""Types of sources and sinks by name."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any


class Registry:
    def __init__(self, what: str):
        self.what, self._makers = what, {}

    def register(self, name: str) -> Callable:
        def add(make: Callable[..., Any]) -> Callable[..., Any]:
            if name in self._makers:
                raise ValueError(f"there is a {self.what} of type {name!r}")
            self._makers[name] = make
            return make

        return add

    def make(self, name: str, *args, **kwargs) -> Any:
        if name not in self._makers:
            raise ValueError(f"no {self.what} of type {name!r}; there are: {', '.join(self.names())}")
        return self._makers[name](*args, **kwargs)

    def names(self) -> list[str]:
        return sorted(self._makers)


SOURCES, SINKS = Registry("source"), Registry("sink")
