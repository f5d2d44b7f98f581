"""CRC-32 of any part of a byte string from running CRCs at its two ends.

The register of a CRC is linear over GF(2): feeding a register with ``n`` zero bytes is a
32 x 32 bit matrix. With the running registers R of a stream, started at zero, the register of
the part from ``a`` to ``b`` is ``R[b] ^ shift(R[a], b - a)``: what came before ``a`` cancels.
Shifts by powers of two are kept as four tables of 256 entries; others are composed of them.
"""

from __future__ import annotations

from functools import cache

import numpy as np

#: The reflected polynomial of CRC-32, and the register's start and final exclusive or.
POLYNOMIAL, ONES = 0xEDB88320, np.uint32(0xFFFFFFFF)
#: Bytes of a block; all blocks of a stream advance by one byte at once.
BLOCK_BITS = 6
BLOCK = 1 << BLOCK_BITS


@cache
def byte_table() -> np.ndarray:
    """What each low byte of the register turns into while it is shifted out."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> 1) ^ np.where(table & 1, np.uint32(POLYNOMIAL), np.uint32(0))
    return table


def _apply(tables: np.ndarray, state: np.ndarray) -> np.ndarray:
    return tables[0][state & 255] ^ tables[1][state >> 8 & 255] ^ tables[2][state >> 16 & 255] ^ tables[3][state >> 24]


@cache
def shift_tables(power: int) -> np.ndarray:
    """The shift by ``2 ** power`` zero bytes: a table for each byte of the register."""
    single = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    if power == 0:
        return byte_table()[single & 255] ^ (single >> 8)
    half = shift_tables(power - 1)
    return _apply(half, _apply(half, single))


def shifted(state: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Each register after ``count`` zero bytes."""
    state = state.copy()
    for power in range(int(count.max(initial=0)).bit_length()):
        at = np.flatnonzero(count >> power & 1)
        state[at] = _apply(shift_tables(power), state[at])
    return state


class Running:
    """The running registers of a stream: within its blocks, and at the beginning of each block."""

    def __init__(self, stream: bytes):
        size = -(-len(stream) // BLOCK)
        columns = np.zeros(size * BLOCK, np.uint8)
        columns[: len(stream)] = np.frombuffer(stream, np.uint8)
        columns = np.ascontiguousarray(columns.reshape(size, BLOCK).T)
        self.inside = np.zeros((BLOCK + 1, size), np.uint32)
        table = byte_table()
        for step in range(BLOCK):
            state = self.inside[step]
            self.inside[step + 1] = table[(state ^ columns[step]) & 255] ^ (state >> 8)
        # Prefix sums over the blocks, by doubling the number of blocks that an entry covers.
        until, reach, power = self.inside[BLOCK].copy(), 1, BLOCK_BITS
        while reach < size:
            until[reach:] ^= _apply(shift_tables(power), until[:-reach])
            reach, power = 2 * reach, power + 1
        self.before = np.r_[np.uint32(0), until]
        self.inside = np.c_[self.inside, np.zeros(BLOCK + 1, np.uint32)]

    def at(self, place: np.ndarray) -> np.ndarray:
        """The registers after ``place`` bytes of the stream."""
        block, rest = place >> BLOCK_BITS, place & (BLOCK - 1)
        return shifted(self.before[block], rest) ^ self.inside[rest, block]


def crc_of_parts(before: np.ndarray, after: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of parts of ``length`` bytes, given the registers at their beginnings and ends."""
    return shifted(before ^ ONES, length) ^ after ^ ONES
