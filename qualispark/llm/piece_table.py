"""Short byte strings and their token ids in arrays, many looked up at a time.

A string of at most ``SHORT`` bytes without zero bytes is its own key: three
64-bit words, padded with zeros, so that equal keys are equal strings. Rows are
found by a hash of the key and those after it (open addressing); a table is half full
at most and doubles before it is more.
"""

from __future__ import annotations

import numpy as np

SHORT = 24
_MASKS = np.array([[(1 << 8 * min(max(n - 8 * k, 0), 8)) - 1 for k in range(3)] for n in range(SHORT + 1)], np.uint64)
_FACTORS = [np.uint64(f) for f in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]


def padded(data: bytes) -> np.ndarray:
    """The bytes with room after them for ``keys_of``."""
    return np.frombuffer(data + bytes(SHORT), np.uint8)


def keys_of(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Keys of the strings that begin at ``starts``; of longer ones the first bytes."""
    windows = np.ndarray((len(data) - SHORT + 1,), f"V{SHORT}", data, 0, (1,))
    return windows[starts].view("<u8").reshape(-1, 3) & _MASKS[np.minimum(lengths, SHORT)]


def gathered(pool: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The runs of ``pool`` from each start on, one after another."""
    shift = starts - (np.cumsum(counts) - counts)
    return pool[np.repeat(shift, counts) + np.arange(counts.sum())]


class PieceTable:
    """Ids of strings; a place is where they begin in ``pool`` plus one, times 65536, plus their number.

    No string has a place of 0; a string of 65536 ids or more is not for the table.
    """

    def __init__(self, slots: int = 1 << 15):
        self.rows = np.zeros((slots, 4), np.uint64)  # key, place
        self.pool = np.zeros(slots, np.uint32)
        self.n = self.used = 0
        self.long: dict[bytes, int] = {}

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        a, b, c = _FACTORS
        h = keys[:, 0] * a
        h ^= (keys[:, 1] + (h >> np.uint64(29))) * b
        h ^= (keys[:, 2] + (h >> np.uint64(31))) * c
        h = (h ^ (h >> np.uint64(32))) * a
        return (h >> np.uint64(65 - len(self.rows).bit_length())).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, 0 if it has none."""
        slots, last = self._slots(keys), len(self.rows) - 1
        rows = self.rows[slots]
        same = (rows[:, 0] == keys[:, 0]) & (rows[:, 1] == keys[:, 1]) & (rows[:, 2] == keys[:, 2])
        places = np.where(same, rows[:, 3], np.uint64(0)).astype(np.int64)
        open_ = np.flatnonzero(~same & (rows[:, 3] != 0))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & last
            rows = self.rows[slots[open_]]
            same = (rows[:, :3] == keys[open_]).all(axis=1)
            places[open_[same]] = rows[same, 3]
            open_ = open_[~same & (rows[:, 3] != 0)]
        return places

    def store(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Places of new runs of ids."""
        end = self.used + len(ids)
        if end > len(self.pool):
            pool = np.zeros(max(end, 2 * len(self.pool)), np.uint32)
            pool[: self.used] = self.pool[: self.used]
            self.pool = pool
        self.pool[self.used : end] = ids
        starts = self.used + np.cumsum(counts) - counts
        self.used = end
        return (starts + 1) << 16 | counts

    def add(self, keys: np.ndarray, places: np.ndarray) -> None:
        """New keys, each once."""
        self.n += len(keys)
        if 2 * self.n > len(self.rows):
            old = self.rows[self.rows[:, 3] != 0]
            self.rows = np.zeros((1 << (4 * self.n - 1).bit_length(), 4), np.uint64)
            self._put(old)
        self._put(np.column_stack((keys, places.astype(np.uint64))))

    def _put(self, rows: np.ndarray) -> None:
        slots, last = self._slots(rows), len(self.rows) - 1
        while len(rows):
            free = np.flatnonzero(self.rows[slots, 3] == 0)
            self.rows[slots[free]] = rows[free]  # of several rows for a slot one is written
            left = self.rows[slots, 3] != rows[:, 3]
            rows, slots = rows[left], (slots[left] + 1) & last

    def runs(self, places: np.ndarray) -> np.ndarray:
        """The ids of the places, one after another."""
        return gathered(self.pool, (places >> 16) - 1, places & 0xFFFF)
