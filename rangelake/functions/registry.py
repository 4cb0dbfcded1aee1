"""Named builders that callers can add to."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    def __init__(self, kind: str, **builders: Callable):
        self.kind, self._builders = kind, dict(builders)
        self._active = next(iter(builders), None)

    def register(self, name: str, builder: Callable) -> Registry:
        """Adds or replaces a builder; calls can be chained."""
        if not callable(builder):
            raise TypeError(f"{self.kind} {name!r} isn't callable")
        self._builders[name] = builder
        self._active = self._active or name
        return self

    def get(self, name: str | None = None) -> Callable:
        key = self._active if name is None else name
        if key not in self._builders:
            raise KeyError(f"no {self.kind} {key!r}; there are {', '.join(self._builders)}")
        return self._builders[key]

    def set_active(self, name: str) -> Registry:
        self.get(name)
        self._active = name
        return self

    def active(self) -> str | None:
        return self._active

    def names(self) -> list[str]:
        return list(self._builders)

    def call(self, name: str | None, *args, **options):
        return self.get(name)(*args, **options)

    def summary(self) -> dict:
        return {"kind": self.kind, "active": self._active, "names": self.names()}
