"""A bounded lookup cache of one Python worker."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any


class Cache:
    """Results of `make` by key. At most two generations of `size` entries are held: when the young one is full the old one is
    dropped, so what is used often stays and memory is bounded."""

    def __init__(self, make: Callable[[Any], Any], size: int):
        self.make, self.size = make, size
        self.young: dict = {}
        self.old: dict = {}

    def __call__(self, key: Any) -> Any:
        got = self.young.get(key)
        if got is None:
            got = self.old.get(key)
            if got is None:
                got = self.make(key)
            if len(self.young) >= self.size:
                self.old, self.young = self.young, {}
            self.young[key] = got
        return got
