"""What a Python worker holds between tasks.

One worker serves tasks of many operators in turn, so what an operator remembers (encoded pieces,
power tables, the allocator's free pages) would add up over the stages of a pipeline.  A task
function wrapped by ``task`` forgets what other operators remembered before it starts, and gives
free pages back to the system when it ends.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable

import pyarrow as pa

_forget: dict[str, Callable[[], None]] = {}
_last = None

#: What a remembered pair of short strings takes besides its characters, about.
ENTRY_BYTES = 170


def keeps(owner: str, forget: Callable[[], None]) -> None:
    """Register how to drop what ``owner`` remembers in this worker."""
    _forget[owner] = forget


def release() -> None:
    """Give free memory back to the system; without glibc only Arrow's pool is emptied."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def take_turn(owner: str) -> None:
    global _last
    if _last != owner:
        for name, forget in _forget.items():
            if name != owner:
                forget()
        release()
        _last = owner


def task(owner: str):
    """Wrap a function from batches to batches that belongs to ``owner``."""

    def wrap(run):
        @functools.wraps(run)
        def turn(batches):
            take_turn(owner)
            try:
                yield from run(batches)
            finally:
                release()

        return turn

    return wrap


class Memory(dict):
    """A dict of short keys and values whose older half goes when it holds more than ``limit`` bytes."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.held = limit, 0

    def learn(self, keys: list, values: list) -> None:
        self.update(zip(keys, values, strict=True))
        self.held += sum(map(len, keys)) + sum(map(len, values)) + ENTRY_BYTES * len(keys)

    def shrink(self) -> None:
        """To be called between rounds, when no round relies on what it holds."""
        if self.held > self.limit:
            for key in list(self)[: len(self) // 2]:
                del self[key]
            self.held = sum(map(len, self.keys())) + sum(map(len, self.values())) + ENTRY_BYTES * len(self)
