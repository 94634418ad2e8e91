"""What packing and byte-level BPE share: pieces that are encoded apart, each distinct one once in a while."""

from __future__ import annotations

from collections.abc import Callable

#: Bytes in a generation of what a Python worker remembers, counting ENTRY for an entry besides its piece and ids. Bounds memory, not results.
REMEMBERED, ENTRY = 128 << 20, 160
#: Longer pieces, in bytes or characters, are encoded anew each time: they hardly come twice.
LONGEST = 64


class Remembered(dict):
    """piece -> its ids as little-endian unsigned 32-bit integers, by encode for those not remembered.

    When a generation is full it becomes the old one; what is used again moves to the new one, the rest goes
    when that is full in turn. So common pieces are never encoded again, and two generations bound memory.
    """

    def __init__(self, encode: Callable, most: int = REMEMBERED, longest: int = LONGEST):
        super().__init__()
        self.encode, self.most, self.longest, self.size, self.old = encode, most, longest, 0, {}

    def __missing__(self, piece) -> bytes:
        if len(piece) > self.longest:
            return self.encode(piece)
        found = self.old.get(piece)
        if found is None:
            found = self.encode(piece)
        self.size += ENTRY + (len(piece) if isinstance(piece, bytes) else 4 * len(piece)) + len(found)
        if self.size > self.most:
            self.old, self.size = self.copy(), 0
            self.clear()
        self[piece] = found
        return found

    def ids(self, pieces: list) -> bytes:
        return b"".join(map(self.__getitem__, pieces))
