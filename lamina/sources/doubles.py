"""Stand-ins for a store's files that fail or are slow, for tests and simulations."""

from __future__ import annotations

import time

from lamina.sources.files import Files


class Injected(OSError):
    """The failure that was asked for."""


class FailingFiles(Files):
    """Files of which every operation after the ``after``-th fails, until ``heal``.  With
    ``steps`` also the single steps within a publication count: after its temporary file is
    written, and after it has its name."""

    def __init__(self, spark, base: str, after: int | None = None):
        self.left = after
        self.seen = 0
        super().__init__(spark, base)

    def _count(self) -> None:
        self.seen += 1
        if self.left is not None:
            if self.left <= 0:
                raise Injected("injected failure")
            self.left -= 1

    def heal(self) -> None:
        self.left = None

    def read(self, name):
        self._count()
        return super().read(name)

    def _staged(self, name, text):
        self._count()
        tmp = super()._staged(name, text)
        self._count()
        return tmp

    def publish(self, name, text):
        done = super().publish(name, text)
        self._count()
        return done

    def delete(self, name):
        self._count()
        return super().delete(name)


class SlowFiles(Files):
    """Files that answer after ``seconds``, as a remote store does; ``calls`` counts."""

    def __init__(self, spark, base: str, seconds: float):
        self.seconds, self.calls = seconds, 0
        super().__init__(spark, base)

    def _wait(self) -> None:
        self.calls += 1
        time.sleep(self.seconds)

    def read(self, name):
        self._wait()
        return super().read(name)

    def publish(self, name, text):
        self._wait()
        return super().publish(name, text)

    def list(self, folder):
        self._wait()
        return super().list(folder)
