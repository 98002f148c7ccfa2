"""A namespace of tables that notes which names are used, for a ``VersionStore``."""

from __future__ import annotations

from collections.abc import Iterator, MutableMapping
from contextlib import contextmanager

from pyspark.sql import DataFrame


class Namespace(MutableMapping):
    """name -> (rows, key column).

    Reading or binding a name makes it active, and so do all ways built on these two
    (``get``, ``pop``, ``update``, ``items``, ``values``); ``in``, ``len`` and iteration
    over names do not. A name that is deleted is not active.
    """

    def __init__(self, tables: dict[str, tuple[DataFrame, str]] | None = None):
        self._held: dict[str, tuple[DataFrame, str]] = {}
        self.active: set[str] = set()
        self._tracking = True
        self.update(tables or {})

    def __getitem__(self, name: str) -> tuple[DataFrame, str]:
        held = self._held[name]
        if self._tracking:
            self.active.add(name)
        return held

    def __setitem__(self, name: str, table: tuple[DataFrame, str]) -> None:
        self._held[name] = table
        if self._tracking:
            self.active.add(name)

    def __delitem__(self, name: str) -> None:
        del self._held[name]
        self.active.discard(name)

    def __contains__(self, name: object) -> bool:
        return name in self._held

    def __iter__(self) -> Iterator[str]:
        return iter(self._held)

    def __len__(self) -> int:
        return len(self._held)

    @contextmanager
    def untracked(self):
        """Inside, no access makes a name active; for code that is known to change nothing."""
        before, self._tracking = self._tracking, False
        try:
            yield self
        finally:
            self._tracking = before

    def tables(self, names) -> dict[str, tuple[DataFrame, str]]:
        """What is held under ``names``, without making them active."""
        return {n: self._held[n] for n in names if n in self._held}
