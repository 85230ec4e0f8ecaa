"""Double-array tries over byte strings, walked by many text positions at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


class DoubleArray:
    """A trie of distinct byte strings: the child of state s by byte b is s' = base[s] + b, if owner[s'] is s.

    ``accepts[s]`` is the number (place in sorted order) of the string that ends at s, or -1. The root is state 0.
    """

    def __init__(self, strings: list[bytes]):
        """Of strings in ascending order; built depth by depth, so each depth's branches lie together."""
        lengths = np.fromiter(map(len, strings), np.int64, len(strings))
        starts = np.cumsum(lengths) - lengths
        text = np.frombuffer(b"".join(strings), np.uint8)
        self.base, self.owner, self.accepts = (np.full(1 << 12, -1, np.int64) for _ in range(3))
        self.owner[0] = 0
        self.used = 1  # all states below may be taken, none above is
        numbers = np.arange(len(strings))
        state = np.zeros(len(strings), np.int64)
        depth = 0
        while len(numbers):
            ends = lengths[numbers] == depth
            self.accepts[state[ends]] = numbers[ends]
            numbers, state = numbers[~ends], state[~ends]
            byte = text[starts[numbers] + depth].astype(np.int64)
            # the strings are sorted, so those of one branch are neighbours
            new = np.ones(len(numbers), bool)
            new[1:] = (state[1:] != state[:-1]) | (byte[1:] != byte[:-1])
            branch = np.cumsum(new) - 1
            state = self._place(state[new], byte[new])[branch] if len(numbers) else state
            depth += 1
        self.base, self.owner, self.accepts = (a[: self.used + 256].astype(np.int32) for a in (self.base, self.owner, self.accepts))

    def _place(self, parents: np.ndarray, bytes_: np.ndarray) -> np.ndarray:
        """States for the branches (parent, byte), which come in ascending order."""
        count = len(parents)
        self._grow(self.used + 256 * 4 + count)
        first = np.flatnonzero(np.concatenate([[True], parents[1:] != parents[:-1]]))
        fan = np.diff(np.append(first, count))
        out = np.empty(count, np.int64)
        for at, size in zip(first[fan > 1].tolist(), fan[fan > 1].tolist()):  # the first place at which all branches of a parent are free
            steps = bytes_[at : at + size] - bytes_[at]
            low = max(int(bytes_[at]), self.used - 512)
            free = low + np.flatnonzero(self.owner[low : max(low, self.used) + 1] < 0)
            for step in steps[1:]:
                free = free[self.owner[free + step] < 0]
            begin = int(free[0])
            out[at : at + size] = begin + steps
            self.owner[out[at : at + size]] = parents[at]
            self.base[parents[at]] = begin - bytes_[at]
            self.used = max(self.used, begin + int(steps[-1]) + 1)
            self._grow(self.used + 256 * 4 + count)
        alone = first[fan == 1]  # may lie anywhere: holes first, then beyond
        low = max(256, self.used - (1 << 16))
        holes = low + np.flatnonzero(self.owner[low : self.used] < 0)[: len(alone)]
        beyond = max(self.used, 256) + np.arange(len(alone) - len(holes))
        out[alone] = np.concatenate([holes, beyond])
        self.owner[out[alone]] = parents[alone]
        self.base[parents[alone]] = out[alone] - bytes_[alone]
        self.used = max(self.used, int(out.max()) + 1)
        return out

    def _grow(self, size: int) -> None:
        if size > len(self.owner):
            more = max(size, 2 * len(self.owner)) - len(self.owner)
            self.base, self.owner, self.accepts = (np.concatenate([a, np.full(more, -1, np.int64)]) for a in (self.base, self.owner, self.accepts))

    def walk(self, string: bytes) -> int:
        """The state that ``string`` leads to from the root, or -1."""
        state = 0
        for byte in string:
            below = int(self.base[state]) + byte
            if below <= 0 or self.owner[below] != state:
                return -1
            state = below
        return state

    def accepted(self, text: np.ndarray, positions: np.ndarray, state: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """From ``state`` at all ``positions`` of ``text`` (bytes) at once, a byte a level: (rows of positions, numbers of strings that end, places after them)."""
        rows = np.arange(len(positions))
        at, states = positions, np.full(len(positions), state, np.int32)
        while len(rows):
            number = self.accepts[states]
            ends = number >= 0
            if ends.any():
                yield rows[ends], number[ends], at[ends]
            inside = at < len(text)
            if not inside.all():
                rows, at, states = rows[inside], at[inside], states[inside]
            below = self.base[states] + text[at]
            on = (below > 0) & (self.owner[below] == states)
            rows, at, states = rows[on], at[on] + 1, below[on]
