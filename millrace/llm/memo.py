"""What Python workers remember between rows: bounded tables, of one operator at a time.

A worker lives on from task to task and from stage to stage. So that the tables of several operators do not add up, a task says
whose tables it uses, and those of others are emptied.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa

_tables: dict[str, list[Memo]] = {}
_owner: list[str] = [""]


class Memo(dict):
    """Results of a function by key, about ``entries`` at most, in two generations: when the younger one has half of that, it
    becomes the elder and what the elder had is forgotten, unless it was looked up since."""

    def __init__(self, owner: str, entries: int, make: Callable | None = None, keep: Callable[[object], bool] = lambda key: True) -> None:
        super().__init__()
        self.half, self.elder, self.make, self.keep = max(1, entries // 2), {}, make, keep
        _tables.setdefault(owner, []).append(self)

    def __missing__(self, key: object) -> object:
        value = self.elder.get(key)
        if value is None:
            if self.make is None:
                raise KeyError(key)
            value = self.make(key)
            if not self.keep(key):
                return value
            self.age()
        self[key] = value
        return value

    def age(self) -> None:
        """Makes room, if there is need."""
        if len(self) >= self.half:
            self.elder = dict(self)
            super().clear()

    def clear(self) -> None:
        super().clear()
        self.elder = {}


def own(owner: str) -> None:
    """Says that this worker's task is the owner's; forgets what other owners have remembered, and gives the memory back."""
    if _owner[0] == owner:
        return
    _owner[0] = owner
    for name, tables in _tables.items():
        if name != owner:
            for table in tables:
                table.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
