"""A cuckoo filter over the keys of one shard: buckets of four 16-bit fingerprints; a key has two buckets, each known from the other."""

from __future__ import annotations

import numpy as np

SLOTS, KICKS = 4, 500
#: Spreads a fingerprint over the bits of a bucket's number.
SPREAD = np.uint32(0x9E3779B1)


def words(keys: list[bytes]) -> np.ndarray:
    """16-byte keys as rows of four 32-bit words: for the shard, the bucket, the fingerprint, and one to spare."""
    return np.frombuffer(b"".join(keys), ">u4").astype(np.uint32).reshape(-1, 4)


def prints(w: np.ndarray) -> np.ndarray:
    """Fingerprints, none of them 0: that marks a free slot."""
    return np.maximum(w[:, 2].astype(np.uint16), 1)


def other(bucket: np.ndarray, mark: np.ndarray, mask: np.ndarray | int) -> np.ndarray:
    """The second bucket of a fingerprint in ``bucket``; of that one, the first."""
    return (bucket ^ (mark.astype(np.uint32) * SPREAD >> np.uint32(7)).astype(np.int64)) & mask


class Cuckoo:
    def __init__(self, slots: np.ndarray):
        self.slots = slots
        self.mask = len(slots) - 1

    @classmethod
    def sized(cls, keys: int) -> Cuckoo:
        """An empty filter that ``keys`` keys fill by half at most."""
        return cls(np.zeros((1 << max(2, int(np.ceil(np.log2(max(keys, 1) * 2 / SLOTS)))), SLOTS), np.uint16))

    @classmethod
    def read(cls, data: bytes) -> Cuckoo:
        return cls(np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())

    @property
    def used(self) -> int:
        return int(np.count_nonzero(self.slots))

    def _places(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mark, first = prints(w), w[:, 1].astype(np.int64) & self.mask
        return mark, first, other(first, mark, self.mask)

    def contains(self, w: np.ndarray) -> np.ndarray:
        mark, first, second = self._places(w)
        return ((self.slots[first] == mark[:, None]) | (self.slots[second] == mark[:, None])).any(1)

    def insert(self, w: np.ndarray) -> bool:
        """Put in each key once more; False if one found no place, whereupon the filter must be built anew, larger."""
        mark, *buckets = self._places(w)
        left = np.arange(len(w))
        for bucket in buckets:  # as many as find a free slot of a bucket of theirs
            at = bucket[left]
            order = np.argsort(at, kind="stable")
            at, left = at[order], left[order]
            nth = np.arange(len(at)) - np.searchsorted(at, at)
            free = self.slots[at] == 0
            fits = nth < free.sum(1)
            slot = np.argsort(~free[fits], axis=1, kind="stable")[np.arange(fits.sum()), nth[fits]]
            self.slots[at[fits], slot] = mark[left[fits]]
            left = left[~fits]
        turn = 0
        for i in left.tolist():  # the rest push others out to their second bucket
            moved, bucket = mark[i], int(buckets[0][i])
            for _ in range(KICKS):
                free = np.flatnonzero(self.slots[bucket] == 0)
                if len(free):
                    self.slots[bucket, free[0]] = moved
                    break
                turn = (turn + 1) % SLOTS
                moved, self.slots[bucket, turn] = self.slots[bucket, turn], moved
                bucket = int(other(np.array([bucket]), np.array([moved]), self.mask)[0])
            else:
                return False
        return True

    def remove(self, w: np.ndarray) -> None:
        """Take out each key once; only keys that were put in may be taken out."""
        for mark, *buckets in zip(*self._places(w)):
            for bucket in buckets:
                held = np.flatnonzero(self.slots[bucket] == mark)
                if len(held):
                    self.slots[bucket, held[0]] = 0
                    break
            else:
                raise KeyError("a key that the filter does not hold")
