"""A counting quotient filter, built and merged in bulk with numpy.

A fingerprint of `bits` bits is cut into a quotient, the home slot, and a remainder, kept in the
slot. Remainders with one quotient form a sorted run; runs lie in quotient order, shifted right past
their home where slots are taken. A remainder seen twice or more is followed by a counter slot. The
metadata bits (occupied quotients, used slots, run ends, counters) give every fingerprint and its
count back, so that filters merge without loss.
"""

from __future__ import annotations

import struct

import numpy as np

#: Most of the home slots that a bulk build fills.
LOAD = 0.75


class CountingQuotientFilter:
    """A static filter over sorted distinct fingerprints below 2**bits and their counts."""

    def __init__(self, bits: int, qbits: int, occupied, used, runend, counter, slots):
        self.bits, self.qbits = bits, qbits
        self.occupied, self.used, self.runend, self.counter, self.slots = occupied, used, runend, counter, slots

    @classmethod
    def build(cls, prints: np.ndarray, counts: np.ndarray, bits: int) -> CountingQuotientFilter:
        """prints: sorted distinct uint64; counts: int64, each below 2**32."""
        wide = counts > 1
        n_slots = len(prints) + int(wide.sum())
        qbits = min(bits, max(1, int(np.ceil(np.log2(max(n_slots, 1) / LOAD + 1)))))
        rbits = bits - qbits
        quotient = (prints >> np.uint64(rbits)).astype(np.int64)
        remainder = prints & np.uint64((1 << rbits) - 1)
        # each entry takes one slot, or two with its counter
        start = np.cumsum(1 + wide) - (1 + wide)
        home = np.repeat(quotient, 1 + wide)
        value = np.zeros(n_slots, np.uint64)
        value[start] = remainder
        is_counter = np.zeros(n_slots, bool)
        is_counter[start[wide] + 1] = True
        value[start[wide] + 1] = counts[wide].astype(np.uint64)
        last = np.ones(n_slots, bool)
        last[:-1] = home[1:] != home[:-1]
        place = np.arange(n_slots)
        at = place + np.maximum.accumulate(home - place) if n_slots else place
        size = max(1 << qbits, int(at[-1]) + 1 if n_slots else 1)
        occupied, used, runend, counter = (np.zeros(size, bool) for _ in range(4))
        slots = np.zeros(size, np.uint64)
        occupied[np.unique(quotient)] = True
        used[at], runend[at], counter[at], slots[at] = True, last, is_counter, value
        return cls(bits, qbits, occupied, used, runend, counter, slots)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """All fingerprints, sorted, and their counts."""
        at = np.flatnonzero(self.used)
        if not len(at):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        ends = self.runend[at]
        run = np.cumsum(ends) - ends
        quotient = np.flatnonzero(self.occupied)[run].astype(np.uint64)
        entry = ~self.counter[at]
        prints = (quotient << np.uint64(self.bits - self.qbits) | self.slots[at])[entry]
        counts = np.ones(len(at), np.int64)
        counted = np.flatnonzero(self.counter[at])
        counts[counted - 1] = self.slots[at[counted]].astype(np.int64)
        return prints, counts[entry]

    def count(self, print_: int) -> int:
        """The count of one fingerprint, by rank over the occupied quotients and select over the run ends."""
        rbits = self.bits - self.qbits
        quotient, remainder = int(print_) >> rbits, int(print_) & ((1 << rbits) - 1)
        if not self.occupied[quotient]:
            return 0
        rank = int(self.occupied[: quotient + 1].sum())
        ends = np.flatnonzero(self.runend)
        end = int(ends[rank - 1])
        first = max(quotient, int(ends[rank - 2]) + 1 if rank > 1 else 0)
        for i in range(first, end + 1):
            if not self.counter[i] and int(self.slots[i]) == remainder:
                return int(self.slots[i + 1]) if i < end and self.counter[i + 1] else 1
        return 0

    def to_bytes(self) -> bytes:
        width = max((self.bits - self.qbits + 7) // 8, 4)
        flags = [np.packbits(x).tobytes() for x in (self.occupied, self.used, self.runend, self.counter)]
        body = self.slots.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
        return struct.pack("<BBBQ", self.bits, self.qbits, width, len(self.slots)) + b"".join(flags) + body

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingQuotientFilter:
        bits, qbits, width, size = struct.unpack_from("<BBBQ", data)
        at, each = struct.calcsize("<BBBQ"), (size + 7) // 8
        flags = [np.unpackbits(np.frombuffer(data, np.uint8, each, at + i * each), count=size).astype(bool) for i in range(4)]
        wide = np.zeros((size, 8), np.uint8)
        wide[:, :width] = np.frombuffer(data, np.uint8, size * width, at + 4 * each).reshape(size, width)
        return cls(bits, qbits, *flags, wide.view("<u8").reshape(-1).astype(np.uint64))


def merged(filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
    """One filter with the sums of the counts: the sorted remainders of all are merged, so nothing is lost."""
    prints, counts = (np.concatenate(x) for x in zip(*(f.items() for f in filters), strict=True))
    order = np.argsort(prints, kind="stable")
    prints, counts = prints[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], prints[1:] != prints[:-1]))) if len(prints) else np.zeros(0, np.int64)
    return CountingQuotientFilter.build(prints[first], np.add.reduceat(counts, first) if len(first) else counts, filters[0].bits)
