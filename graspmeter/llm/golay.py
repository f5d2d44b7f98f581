"""The binary Golay code as a fuzzy hash of 23-bit words.

The code is perfect: every 23-bit word has one nearest codeword, at most 3 bits away. Of two
words that differ in one bit, one may lie 3 bits from its nearest codeword and the other 4
bits from it. The other's nearest codeword is then one of the five codewords that are 4 bits
away from the first. So a word's nearest index together with those five (``near``) always holds
the nearest index (``nearest``) of a word that differs in one bit or none.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

LENGTH, CHECK_BITS = 23, 11
#: Fixed value: generator polynomial of the code.
GENERATOR = 0b110001110101


def _remainder(word: int) -> int:
    for bit in range(LENGTH - 1, CHECK_BITS - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECK_BITS)
    return word


class Golay:
    """Lookup tables by syndrome, made once by each worker."""

    def __init__(self):
        unit = [_remainder(1 << bit) for bit in range(LENGTH)]
        self.low, self.high = (self._sums(unit[:12]), self._sums(unit[12:]))
        self.error = np.zeros(1 << CHECK_BITS, np.int64)
        self.more = np.zeros((1 << CHECK_BITS, 5), np.int64)
        codewords = [m << CHECK_BITS ^ _remainder(m << CHECK_BITS) for m in range(1 << 12)]
        seven = [c for c in codewords if c.bit_count() == 7]
        for weight in (1, 2, 3):
            for places in combinations(range(LENGTH), weight):
                pattern = sum(1 << p for p in places)
                syndrome = int(np.bitwise_xor.reduce([unit[p] for p in places]))
                self.error[syndrome] = pattern
                if weight == 3:
                    self.more[syndrome] = [c >> CHECK_BITS for c in seven if c & pattern == pattern]

    @staticmethod
    def _sums(units: list[int]) -> np.ndarray:
        sums = np.zeros(1, np.int64)
        for unit in units:
            sums = np.r_[sums, sums ^ unit]
        return sums

    def nearest(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """12-bit index of the nearest codeword, and the syndrome."""
        syndrome = self.low[words & 0xFFF] ^ self.high[words >> 12]
        return (words ^ self.error[syndrome]) >> CHECK_BITS, syndrome

    def near(self, words: np.ndarray) -> np.ndarray:
        """Six indices a row: the nearest, and the five that are 4 bits away (else the nearest again)."""
        index, syndrome = self.nearest(words)
        return index[:, None] ^ np.c_[np.zeros(len(words), np.int64), self.more[syndrome]]


_code: list[Golay] = []


def code() -> Golay:
    if not _code:
        _code.append(Golay())
    return _code[0]
