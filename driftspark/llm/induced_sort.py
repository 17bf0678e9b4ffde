"""Suffix array and common-prefix values of a byte string by induced sorting with queues that spill to disk.

Suffixes are of type S (smaller than the next suffix) or L. The leftmost S suffixes are sorted first: their substrings
get names by one round of induction, and the string of names is sorted in turn. From them, L suffixes are induced bucket
by bucket in ascending order and S suffixes in descending order. All suffixes that a bucket induces go, in order, to the
queues of the buckets of their first bytes. A bucket's queue thus yields its suffixes in order, which is what a priority
queue over (byte, rank) would do; queues beyond ``MEMORY`` rows go to a file. Everything works on whole buckets at once.

Common-prefix values of neighbours come from hashes of prefixes; where ``most`` is given, a value is ``most`` if that many
bytes or more are shared, else 0. A queue's file is the task's own scratch: it lies in the folders that Spark gives its
executors, is written only when a queue outgrows memory, and anew when a task runs again.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

MEMORY = 1 << 20
_MULT = np.uint64(0xC2B2AE3D27D4EB4F)


class Queue:
    """First in, first out, of positions; what is beyond a number of rows is kept in a file."""

    def __init__(self, folder: str, name: str, memory: int):
        self.held: list[np.ndarray] = []
        self.rows, self.memory, self.path, self.spilled = 0, memory, os.path.join(folder, name), False

    def push(self, rows: np.ndarray) -> None:
        self.held.append(rows)
        self.rows += len(rows)
        if self.rows > self.memory:
            with open(self.path, "ab") as f:
                for x in self.held:
                    f.write(x.tobytes())
            self.held, self.rows, self.spilled = [], 0, True

    def drain(self) -> np.ndarray:
        out = self.held
        if self.spilled:
            out = [np.fromfile(self.path, np.int32), *out]
            os.unlink(self.path)
        self.held, self.rows, self.spilled = [], 0, False
        return np.concatenate(out) if out else np.zeros(0, np.int32)


def s_types(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is of type S; the last is L, as the end counts as smaller than any byte."""
    n = len(t)
    up = np.zeros(n, bool)
    up[:-1] = t[:-1] < t[1:]
    known = np.ones(n, bool)
    known[:-1] = t[:-1] != t[1:]
    at = np.where(known, np.arange(n), n)
    return up[np.minimum.accumulate(at[::-1])[::-1]]


def _spread(queues: list[Queue], chars: np.ndarray, rows: np.ndarray) -> None:
    if not len(rows):
        return
    order = np.argsort(chars, kind="stable")
    chars, rows = chars[order], rows[order]
    cuts = [0, *(np.flatnonzero(chars[1:] != chars[:-1]) + 1).tolist(), len(chars)]
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        queues[int(chars[i])].push(rows[i:j])


def induce(t: np.ndarray, is_s: np.ndarray, first: np.ndarray, size: int, memory: int = MEMORY) -> np.ndarray:
    """All suffixes in order, from the leftmost S suffixes in order (or their substrings' order, if only those are)."""
    # Spark names its executors' own folders to their workers
    own = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None
    with tempfile.TemporaryDirectory(dir=own) as folder:
        starts = np.searchsorted(t[first], np.arange(size + 1))  # ``first`` ascends by its first byte
        queues = [Queue(folder, f"l{c}", memory) for c in range(size)]
        queues[int(t[-1])].push(np.array([len(t) - 1], np.int32))
        lower: list[np.ndarray] = []
        for c in range(size):
            parts, wave = [], queues[c].drain()
            while len(wave):
                parts.append(wave)
                before = wave[wave > 0] - 1
                before = before[~is_s[before]]
                chars = t[before]
                same = chars == c
                _spread(queues, chars[~same], before[~same])
                wave = before[same]
            lower.append(np.concatenate(parts) if parts else np.zeros(0, np.int32))
            mine = first[starts[c] : starts[c + 1]]
            before = mine[mine > 0] - 1
            _spread(queues, t[before], before)
        queues = [Queue(folder, f"s{c}", memory) for c in range(size)]
        out: list[np.ndarray] = []
        for c in range(size - 1, -1, -1):
            parts, wave = [], queues[c].drain()
            while len(wave):
                parts.append(wave)
                before = wave[wave > 0] - 1
                before = before[is_s[before]]
                chars = t[before]
                same = chars == c
                _spread(queues, chars[~same], before[~same])
                wave = before[same]
            down = lower[c][::-1]
            before = down[down > 0] - 1
            before = before[is_s[before]]
            _spread(queues, t[before], before)
            out += [*parts, down]
        return np.concatenate(out)[::-1]


def by_doubling(names: np.ndarray, most: int | None) -> np.ndarray:
    """Order of the suffixes of a string over a large alphabet, by their first ``most`` names at least."""
    n, width = len(names), 1
    rank = names.astype(np.int64)
    while True:
        key = rank * (n + 1)
        key[:-width] += rank[width:] + 1
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate(([0], np.diff(key[order]) != 0)))
        rank, width = new, width * 2
        if rank[order[-1]] == n - 1 or width >= n or (most and width >= most):
            return order


class Sorter:
    """Sorts the suffixes of ``text`` (uint8), by their first ``most`` bytes at least if that is given."""

    def __init__(self, text: np.ndarray, most: int | None = None, memory: int = MEMORY):
        self.text, self.most, self.memory = text, most, memory

    def sort(self) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes in order, and of each but the first the length of the prefix that it shares with the one before."""
        if not len(self.text):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        order = self._order(self.text, 256)
        return order.astype(np.int64), self._common(order)

    def _order(self, t: np.ndarray, size: int) -> np.ndarray:
        is_s = s_types(t)
        left = np.flatnonzero(is_s[1:] & ~is_s[:-1]).astype(np.int32) + 1
        if len(left) < 2:
            return induce(t, is_s, left, size, self.memory)
        rough = induce(t, is_s, left[np.argsort(t[left], kind="stable")], size, self.memory)
        mark = np.zeros(len(t), bool)
        mark[left] = True
        sorted_left = rough[mark[rough]]
        # names: neighbours with equal substrings (up to the next leftmost S suffix, inclusive) share one
        sums, powers = self._sums(t)
        place = np.empty(len(t), np.int32)
        place[left] = np.arange(len(left))
        ends = np.append(left[1:] + 1, len(t)).astype(np.int64)[place[sorted_left]]
        begin = sorted_left.astype(np.int64)
        width = ends - begin
        h = sums[ends] - sums[begin] * powers[width]
        last = place[sorted_left] == len(left) - 1  # ends with the text, so equals no other
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (width[1:] != width[:-1]) | last[1:] | last[:-1]))
        names = np.empty(len(left), np.int64)
        names[place[sorted_left]] = np.cumsum(new) - 1
        count = int(new.sum())
        if count == len(left):
            return induce(t, is_s, sorted_left, size, self.memory)
        if count <= 1024:
            inner = self._order(names.astype(np.int32), count)
        else:
            inner = by_doubling(names, self.most and self.most // 2 + 2)
        return induce(t, is_s, left[inner], size, self.memory)

    @staticmethod
    def _sums(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """sums[j] - sums[i] * powers[j - i] is the hash of t[i:j]."""
        n = len(t)
        powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, _MULT))), dtype=np.uint64)
        back = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, np.uint64(pow(int(_MULT), -1, 1 << 64))))), dtype=np.uint64)
        x = t.astype(np.uint64) + np.uint64(1)
        x = (x ^ (x << np.uint64(31))) * np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(29)
        sums = np.concatenate(([np.uint64(0)], np.cumsum(x * back[1:], dtype=np.uint64))) * powers
        return sums, powers

    def _common(self, order: np.ndarray) -> np.ndarray:
        n = len(order)
        sums, powers = self._sums(self.text)
        a, b = order[:-1].astype(np.int64), order[1:].astype(np.int64)
        out = np.zeros(n, np.int64)
        least = self.most or 0
        at = np.flatnonzero(np.maximum(a, b) + least <= n)
        if least:
            # only prefixes of ``most`` or more count, and one comparison finds them
            at = at[self._equal(sums, powers, a[at], b[at], least)]
            out[at + 1] = least
            return out
        shared = np.zeros(n - 1, np.int64)
        bit = 1 << (n.bit_length() - 1)
        while bit:
            at = np.flatnonzero(np.maximum(a, b) + shared + bit <= n)
            same = self._equal(sums, powers, a[at] + shared[at], b[at] + shared[at], bit)
            shared[at[same]] += bit
            bit >>= 1
        out[1:] = shared
        return out

    @staticmethod
    def _equal(sums: np.ndarray, powers: np.ndarray, i: np.ndarray, j: np.ndarray, width: int) -> np.ndarray:
        return sums[i + width] - sums[i] * powers[width] == sums[j + width] - sums[j] * powers[width]
