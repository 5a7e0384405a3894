"""Open repositories by name, a bounded number of them."""

from __future__ import annotations

import threading
from collections import OrderedDict
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from lamina.sources.repository import Repository, valid_name


class Registry:
    """Resolves names to repositories.  The least recently used is dropped beyond
    ``capacity``; pinned ones stay, even if that exceeds it."""

    def __init__(self, open_: Callable[[str], Repository], capacity: int = 16):
        self.open, self.capacity = open_, capacity
        self._warm: OrderedDict[str, Repository] = OrderedDict()
        self._known: set[str] = set()
        self._quiet: set[str] = set()
        self._pins: dict[str, int] = {}
        self._lock = threading.Condition(threading.RLock())

    def register(self, name: str) -> None:
        if not valid_name(name):
            raise ValueError(f"bad repository name {name!r}")
        with self._lock:
            self._known.add(name)

    def unregister(self, name: str) -> bool:
        """Forget a name; whether it was known.  One that is pinned cannot go."""
        with self._lock:
            if self._pins.get(name):
                raise RuntimeError(f"{name} is in use")
            self._warm.pop(name, None)
            known = name in self._known
            self._known.discard(name)
            return known

    def quiesce(self, name: str, timeout: float) -> bool:
        """Let nobody begin to use the repository, wait until nobody does, then forget it;
        False, and all as before, if that takes longer than ``timeout`` seconds."""
        with self._lock:
            if name not in self._known:
                raise KeyError(name)
            self._quiet.add(name)
            try:
                return self._lock.wait_for(lambda: not self._pins.get(name), timeout) and self.unregister(name)
            finally:
                self._quiet.discard(name)

    def names(self) -> list[str]:
        with self._lock:
            return sorted(self._known)

    def resolve(self, name: str) -> Repository:
        with self._lock:
            if name not in self._known or name in self._quiet:
                raise KeyError(name)
            repo = self._warm.pop(name, None) or self.open(name)
            self._warm[name] = repo
            for old in [n for n in self._warm if n != name and not self._pins.get(n)]:
                if len(self._warm) <= self.capacity:
                    break
                del self._warm[old]
            return repo

    @contextmanager
    def pinned(self, name: str) -> Iterator[Repository]:
        with self._lock:
            repo = self.resolve(name)
            self._pins[name] = self._pins.get(name, 0) + 1
        try:
            yield repo
        finally:
            with self._lock:
                self._pins[name] -= 1
                self._lock.notify_all()


class Warehouse:
    """Repositories of one folder, a folder each, opened by name with one bound on how many
    stay open."""

    def __init__(self, spark, path: str, spec_of: Callable[[str], object], capacity: int = 16):
        from lamina.sources.files import Files

        self.spark, self.path = spark, path.rstrip("/")
        self.files = Files(spark, path)
        self.registry = Registry(lambda name: Repository(spark, f"{self.path}/{name}", spec_of(name)), capacity)
        for name in self.files.folders(""):
            if valid_name(name):
                self.registry.register(name)

    def create(self, name: str) -> Repository:
        self.registry.register(name)
        return self.registry.resolve(name)

    def open(self, name: str) -> Repository:
        return self.registry.resolve(name)

    def sizes(self) -> dict[str, int]:
        """Bytes of each repository."""
        return {n: self.files.size(n) for n in self.registry.names()}
