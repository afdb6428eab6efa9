"""CRC-32C of many messages of 16-bit units at once."""

from __future__ import annotations

import numpy as np

# The reflected Castagnoli polynomial, and what record files add to a rotated checksum.
POLYNOMIAL = 0x82F63B78
MASK_ADDED = 0xA282EAD8
#: Units of a chunk; messages are cut into chunks that are summed up side by side.
CHUNK = 64


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1).astype(np.uint32)
    return table


_BYTE = _byte_table()
#: A unit's effect on the state, by its value.
_UNIT = _BYTE[_BYTE[np.arange(1 << 16) & 255] & 255 ^ np.arange(1 << 16) >> 8] ^ (_BYTE[np.arange(1 << 16) & 255] >> 8)


def _after(state: np.ndarray, unit: np.ndarray | int) -> np.ndarray:
    return _UNIT[(state ^ unit) & 0xFFFF] ^ (state >> 16)


def _prefix() -> np.ndarray:
    """The two units that bring a state of zero to that with which a checksum begins."""
    above = np.argsort(_BYTE >> 24)  # the table's entry with a given highest byte
    state = 0xFFFFFFFF
    for _ in range(4):
        entry = int(above[state >> 24])
        state = ((state ^ int(_BYTE[entry])) << 8 | entry) & 0xFFFFFFFF
    return np.array([state & 0xFFFF, state >> 16], np.uint16)


_PREFIX = _prefix()


def _past_chunk() -> list[np.ndarray]:
    """For each half of a state: what it becomes over a chunk of zeros."""
    halves = [np.arange(1 << 16, dtype=np.uint32) << np.uint32(16 * k) for k in range(2)]
    for _ in range(CHUNK):
        halves = [_after(h, 0) for h in halves]
    return halves


_LOW_PAST, _HIGH_PAST = _past_chunk()


def crc32c(units: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Checksums of messages ``units[ends[i]:ends[i + 1]]`` of little-endian 16-bit units.

    Zeros in front of a message whose state is zero change nothing, so each message,
    with the prefix that gives the first state, is filled up to whole chunks there.
    """
    size = np.diff(ends)
    if not len(size):
        return np.empty(0, np.uint32)
    many = -(-(size + 2) // CHUNK)
    upto = np.cumsum(many) * CHUNK
    filled = np.zeros(int(upto[-1]), np.uint16)
    filled[np.arange(ends[0], ends[-1]) + np.repeat(upto - ends[1:], size)] = units[ends[0]:ends[-1]]
    filled[upto - size - 2], filled[upto - size - 1] = _PREFIX
    state = np.zeros(len(filled) // CHUNK, np.uint32)
    for column in np.ascontiguousarray(filled.reshape(-1, CHUNK).T):
        state = _after(state, column)
    out = np.zeros(len(size), np.uint32)
    first = upto // CHUNK - many
    order = np.argsort(-many, kind="stable")
    left = many[order]
    for k in range(int(left[0])):
        own = order[: np.searchsorted(-left, -k, "left")]  # those with more than k chunks
        out[own] = _LOW_PAST[out[own] & 0xFFFF] ^ _HIGH_PAST[out[own] >> 16] ^ state[first[own] + k]
    return out ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    """The form in which record files store a checksum of data that may itself hold checksums."""
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK_ADDED)
