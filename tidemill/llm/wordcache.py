"""Numbers for words, with the token ids of each word found once.

Words recur, tokenisers are slow: a task keeps the ids of the words it has
met. The table is emptied between slices of a batch when it is full, so its
memory is bounded; what is emptied is encoded again, and results don't depend
on it. A worker keeps the tokeniser for its next task, but no words.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable, Sequence

_KEPT: dict = {}


def kept(key: Hashable, make: Callable):
    """What ``make`` returned first in this process: a worker's next task finds it again."""
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


class WordCache(dict):
    """word -> number, in the order met; ``ids`` has the token ids of each number, as bytes."""

    def __init__(self, encode: Callable[[list], Sequence[bytes | None]], most: int = 200_000):
        super().__init__()
        self.encode, self.most = encode, most
        self.ids: list[bytes | None] = []
        self.new: list = []

    def __missing__(self, word):
        self[word] = number = len(self)
        self.new.append(word)
        return number

    def fill(self) -> None:
        """Encode the words met since the last call."""
        if self.new:
            self.ids.extend(self.encode(self.new))
            self.new = []

    def trim(self) -> bool:
        """Empty a full table; only between slices, since numbers change."""
        if len(self) <= self.most:
            return False
        self.empty()
        return True

    def empty(self) -> None:
        self.clear()
        self.ids, self.new = [], []
