"""Numbers of words, by their bytes, in numpy: a look-up costs some gathers, no string of Python's."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Masks of the first 0 to 8 bytes of a little-endian number.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Words that are looked up at a time: their arrays stay in a core's cache, and memory is bounded.
AT_A_TIME = 1 << 16
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _packed(eights: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Bytes at : at + size (8 at most) as numbers; eights: all bytes, eight by eight."""
    i, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
    high = eights.take(i + 1) << (np.uint64(64) - shift)  # numpy shifts everything out by 64
    return ((eights.take(i) >> shift) | high) & _FIRST.take(size)


def cut(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where words are and their sizes, as bytes.split() has them."""
    space = np.ones(len(raw) + 2, bool)
    _SPACE.take(np.frombuffer(raw, np.uint8), out=space[1:-1], mode="clip")
    edges = np.flatnonzero(space[1:] != space[:-1])
    return edges[::2], edges[1::2] - edges[::2]


class _Table:
    """Open addressing over keys of one or two numbers, the first never 0."""

    def __init__(self, wide: int, bits: int = 12) -> None:
        self.keys, self.number = [np.zeros(1 << bits, np.uint64) for _ in range(wide)], np.full(1 << bits, -1, np.int32)
        self.bits, self.n = bits, 0

    def _slots(self, keys: list[np.ndarray]) -> np.ndarray:
        h = keys[0] * _MIX[0]
        if len(keys) > 1:
            h = (h ^ keys[1]) * _MIX[1]
        return (h >> np.uint64(64 - self.bits)).view(np.int64)

    def _differ(self, keys: list[np.ndarray], slot: np.ndarray) -> np.ndarray:
        """Where a slot has another key, or none."""
        out = self.keys[0].take(slot) != keys[0]
        for own, k in zip(self.keys[1:], keys[1:], strict=True):
            out |= own.take(slot) != k
        return out

    def find(self, keys: list[np.ndarray]) -> np.ndarray:
        """Numbers of keys; -1 for those that are not there."""
        slot = self._slots(keys)
        out = self.number.take(slot)
        left = np.flatnonzero(self._differ(keys, slot) & (out >= 0))
        while len(left):
            at = (slot[left] + 1) & ((1 << self.bits) - 1)
            slot[left], found = at, self.number.take(at)
            out[left] = found
            left = left[self._differ([k.take(left) for k in keys], at) & (found >= 0)]
        return out

    def add(self, keys: list[np.ndarray], numbers: np.ndarray) -> None:
        """Distinct keys that are not there yet."""
        self.n += len(numbers)
        if 3 * self.n > 1 << self.bits:
            held = np.flatnonzero(self.number >= 0)
            keys = [np.r_[own[held], k] for own, k in zip(self.keys, keys, strict=True)]
            numbers = np.r_[self.number[held], numbers]
            self.__init__(len(keys), (3 * len(numbers)).bit_length())
            self.n = len(numbers)
        slot, left = self._slots(keys), np.arange(len(numbers))
        while len(left):
            free = left[self.number[slot[left]] < 0]
            self.number[slot[free]] = numbers[free]  # of those that want a slot, one gets it
            got = self.number[slot[left]] == numbers[left]
            new = left[got]
            for own, k in zip(self.keys, keys, strict=True):
                own[slot[new]] = k[new]
            left = left[~got]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)


def _distinct(keys: list[np.ndarray]) -> np.ndarray:
    """One place of each key."""
    order = np.lexsort(keys)
    differs = np.zeros(len(order), bool)
    differs[:1] = True
    for k in keys:
        x = k[order]
        differs[1:] |= x[1:] != x[:-1]
    return order[differs]


def _apart(raw: bytes, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which words can't be keys: longer ones, and those with a zero byte."""
    out = size > 16
    if b"\0" in raw:
        zeros = np.r_[0, np.cumsum(np.frombuffer(raw, np.uint8) == 0)]
        out |= zeros.take(at + size) > zeros.take(at)
    return out


class Words:
    """Numbers 0, 1, ... of words. Words of up to 8 bytes are keys of one number, of up to 16 of two, so that equal keys are
    equal words; longer ones and those with a zero byte are in a dict."""

    def __init__(self) -> None:
        self.n, self.tables, self.longer = 0, (_Table(1), _Table(2)), {}

    def __len__(self) -> int:
        return self.n

    def numbers(self, raw: bytes, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words raw[at : at + size]; and, by number, where the words are (once each) that got one now."""
        eights, apart = np.frombuffer(raw + bytes(24 - len(raw) % 8), "<u8"), _apart(raw, at, size)
        out, new = np.zeros(len(at), np.int64), [np.zeros(0, np.int64)]
        for i in range(0, len(at), AT_A_TIME):
            part = slice(i, i + AT_A_TIME)
            out[part], found = self._numbers(raw, eights, at[part], size[part], apart[part])
            new += [i + x for x in found]
        return out, np.concatenate(new)

    def find(self, raw: bytes, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Numbers of the words raw[at : at + size]; -1 for those that have none."""
        eights, apart = np.frombuffer(raw + bytes(24 - len(raw) % 8), "<u8"), _apart(raw, at, size)
        out = np.full(len(at), -1, np.int32)
        for i in range(0, len(at), AT_A_TIME):
            part = slice(i, i + AT_A_TIME)
            for table, who, keys in self._keys(eights, at[part], size[part], apart[part]):
                out[part][who] = table.find(keys)
        for i in np.flatnonzero(apart).tolist():
            out[i] = self.longer.get(raw[at[i] : at[i] + size[i]], -1)
        return out

    def _keys(self, eights: np.ndarray, at: np.ndarray, size: np.ndarray, apart: np.ndarray) -> Iterator[tuple[_Table, np.ndarray, list[np.ndarray]]]:
        """By table: which words are in it, and their keys."""
        short = size <= 8
        for table, who in zip(self.tables, (np.flatnonzero(short & ~apart), np.flatnonzero(~short & ~apart)), strict=True):
            start, length = at.take(who), size.take(who)
            yield table, who, [_packed(eights, start + 8 * j, np.clip(length - 8 * j, 0, 8)) for j in range(len(table.keys))]

    def _numbers(self, raw: bytes, eights: np.ndarray, at: np.ndarray, size: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        out, new = np.zeros(len(at), np.int64), []
        for table, who, keys in self._keys(eights, at, size, apart):
            found = table.find(keys)
            miss = np.flatnonzero(found < 0)
            if len(miss):
                missed = [k.take(miss) for k in keys]
                one = _distinct(missed)
                table.add([k.take(one) for k in missed], np.arange(self.n, self.n + len(one), dtype=np.int32))
                found[miss] = table.find(missed)
                self.n += len(one)
                new.append(who.take(miss.take(one)))
            out[who] = found
        for i in np.flatnonzero(apart).tolist():
            word = raw[at[i] : at[i] + size[i]]
            if word not in self.longer:
                self.longer[word] = self.n
                self.n += 1
                new.append(np.array([i]))
            out[i] = self.longer[word]
        return out, new

    def only(self, numbers: np.ndarray) -> Words:
        """The words of some numbers (ascending), which are numbered anew in the same order."""
        to = np.full(self.n, -1, np.int32)
        to[numbers] = np.arange(len(numbers))
        out = Words()
        out.n = len(numbers)
        for old, table in zip(self.tables, out.tables, strict=True):
            held = np.flatnonzero(old.number >= 0)
            held = held[to[old.number[held]] >= 0]
            table.add([k[held] for k in old.keys], to[old.number[held]])
        out.longer = {w: int(to[k]) for w, k in self.longer.items() if to[k] >= 0}
        return out
