"""The hash draws of `dna.hash_uniform` for every base of many sequences at once, by numpy within a task.

A draw is an MD5 digest of the sequence's prefix (seed and keys, each followed by a bar) and the base's place from 1. Digests are
worked out for some thousand bases together, so a base costs a few hundred nanoseconds instead of an expression of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bases whose digests are worked out together; arrays of that many words stay in a core's cache.
CHUNK = 16384
_SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2**32).astype(np.uint64).astype(np.uint32)
_START = np.array([0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476], dtype=np.uint32)


def _md5(words: np.ndarray) -> list[np.ndarray]:
    """The digests' four words of padded messages: words[k] is the k-th word of all of them, sixteen a block."""
    n = words.shape[1]
    state = [np.full(n, s, dtype=np.uint32) for s in _START]
    f, g = np.empty(n, dtype=np.uint32), np.empty(n, dtype=np.uint32)
    for block in range(0, len(words), 16):
        a, b, c, d = (x.copy() for x in state)
        for i in range(64):
            turn = i // 16
            if turn == 0:  # d ^ (b & (c ^ d))
                np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
            elif turn == 1:  # c ^ (d & (b ^ c))
                np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
            elif turn == 2:
                np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
            else:  # c ^ (b | ~d)
                np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
            word = (i, 5 * i + 1, 3 * i + 5, 7 * i)[turn] % 16
            np.add(f, a, out=f), np.add(f, _SINES[i], out=f), np.add(f, words[block + word], out=f)
            shift = np.uint32(_SHIFTS[turn][i % 4])
            np.right_shift(f, np.uint32(32) - shift, out=g), np.left_shift(f, shift, out=f), np.bitwise_or(f, g, out=f), np.add(f, b, out=f)
            a, b, c, d, f = d, f, b, c, a
        state = [x + y for x, y in zip(state, (a, b, c, d))]
    return state


def digests(prefixes: list[bytes], lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(sequence, place from 0, the digest's four eight-digit numbers) of all bases in order, some thousand at a time."""
    sizes = np.array([len(p) for p in prefixes], dtype=np.int64)
    most = len(str(int(lengths.max(initial=1))))
    width = 64 * ((int(sizes.max(initial=0)) + most + 8) // 64 + 1)
    table = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in prefixes), dtype=np.uint8).reshape(-1, width)
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    for at in range(0, total, CHUNK):
        flat = np.arange(at, min(at + CHUNK, total))
        seq = np.searchsorted(ends, flat, side="right")
        place = flat - (ends[seq] - lengths[seq])
        number, digits = place + 1, np.ones(len(flat), dtype=np.int64)
        for k in range(1, most):
            digits += number >= 10**k
        rows, begin, size = table[seq], np.arange(len(flat)) * width + sizes[seq], sizes[seq] + digits
        cells = rows.reshape(-1)
        for k in range(most):  # the digit with k ones behind it
            has = digits > k
            cells[(begin + digits - 1 - k)[has]] = (48 + number // 10**k % 10)[has]
        cells[begin + digits] = 0x80
        out = [np.empty(len(flat), dtype=np.uint32) for _ in range(4)]
        blocks = (size + 8) // 64 + 1
        for n in np.unique(blocks):
            own = np.flatnonzero(blocks == n)
            message = np.ascontiguousarray(rows[own, : 64 * n])
            message.view("<u8")[:, -1] = size[own] * 8
            for o, part in zip(out, _md5(np.ascontiguousarray(message.view("<u4").T))):
                o[own] = part.byteswap()
        yield seq, place, out


def strings(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings without nulls, and each one's number of bytes."""
    array = array.cast(pa.large_string())
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data and len(array) else np.empty(0, dtype=np.uint8)
    return flat, np.diff(offsets)


def to_strings(flat: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A column of strings of these bytes, each of so many."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))).cast(pa.string())
