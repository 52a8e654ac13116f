"""What a Python worker keeps from batch to batch and from task to task, bounded in bytes."""

from __future__ import annotations

import gc
from collections.abc import Callable
from typing import Any

import pyarrow as pa

#: Bytes of a short key, a small value and their place in a dict.
ENTRY = 200
_HELD: dict[str, Any] = {}


class Memo(dict):
    """Answers by key; when their bytes would pass ``most`` it starts anew, which costs time, not results."""

    def __init__(self, most: int = 32 << 20):
        super().__init__()
        self.most, self.used = most, 0

    def room(self, size: int) -> None:
        """Called before entries of ``size`` bytes are added."""
        if self.used + size > self.most:
            self.clear()
        self.used += size

    def clear(self) -> None:
        super().clear()
        self.used = 0


class Generations(dict):
    """Answers by key in two generations of half of ``most`` bytes each: a full one becomes the old one, in place of the one before, and what is
    asked for again moves over.  What is used stays, what isn't falls out; ``make`` answers what neither holds."""

    def __init__(self, make: Callable[[Any], Any], cost: Callable[[Any, Any], int], most: int):
        super().__init__()
        self.make, self.cost, self.most, self.used, self.old = make, cost, most, 0, {}

    def __missing__(self, key: Any) -> Any:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        size = self.cost(key, value)
        if self.used + size > self.most // 2:
            self.old, self.used = dict(self), 0
            super().clear()
        self.used += size
        self[key] = value
        return value


def held(name: str, make: Callable[[], Any]) -> Any:
    """The object ``name`` of this worker, made at first use.  A worker holds that of one operator at a time: the
    next operator's takes its place, so that the stages of a pipeline do not add up."""
    if name not in _HELD:
        _HELD.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _HELD[name] = make()
    return _HELD[name]
