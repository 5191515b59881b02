"""What a task made of a text, remembered while it lasts: a small, bounded helper for texts that occur again."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

#: Bytes of keys and of what was made of them that a task remembers; beyond that it forgets all.
MOST = 32 << 20


class Remembered(dict):
    """``make(key)`` gives a value and its size in bytes; a key that is there is not made again. What is held stays under ``most``,
    whatever the texts are."""

    def __init__(self, make: Callable[[Any], tuple[Any, int]], most: int = MOST) -> None:
        super().__init__()
        self.make, self.most, self.held = make, most, 0

    def __missing__(self, key: Any) -> Any:
        value, size = self.make(key)
        self.held += size
        if self.held > self.most:
            self.clear()
            self.held = size
        if size <= self.most:
            self[key] = value
        return value
