"""Numbers of resampling: the first 32 bits of md5(prefix + i), for many i at once."""

from __future__ import annotations

import hashlib
import math
from functools import cache

#: Numbers that share all digits but the last four are hashed together.
LOW, DIGITS = 10_000, 4
_SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_SINES = tuple(int(abs(math.sin(i + 1)) * 2**32) for i in range(64))


@cache
def _last_digits(place: int):
    """The last four digits of 0 to 9999 as they stand from a byte of a word on: what they add to this word and to the next."""
    import numpy as np

    text = np.arange(LOW)
    digits = [text // 10**k % 10 + 48 for k in reversed(range(DIGITS))]
    both = sum(d.astype(np.uint64) << np.uint64(8 * (place + k)) for k, d in enumerate(digits))
    return (both & np.uint64(0xFFFFFFFF)).astype(np.uint32), (both >> np.uint64(32)).astype(np.uint32)


def _block(head: bytes):
    """The numbers of head + four digits, for all of these; a message of one md5 block."""
    import numpy as np

    size = len(head) + DIGITS
    if size > 55:
        raise ValueError("the prefix is too long")
    message = bytearray(64)
    message[: len(head)] = head
    message[size] = 0x80
    message[56:64] = (8 * size).to_bytes(8, "little")
    words = [int.from_bytes(message[4 * i : 4 * i + 4], "little") for i in range(16)]
    at, place = divmod(len(head), 4)
    low, high = _last_digits(place)
    varied = {at: low + np.uint32(words[at])}
    if place:
        varied[at + 1] = high + np.uint32(words[at + 1])
    a, b, c, d = (np.full(LOW, x, np.uint32) for x in _START)
    f, t = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        turn = i // 16
        word = (i, 5 * i + 1, 3 * i + 5, 7 * i)[turn] % 16
        if turn == 0:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif turn == 1:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif turn == 2:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        if word in varied:
            f += varied[word]
            f += np.uint32(_SINES[i])
        else:
            f += np.uint32((_SINES[i] + words[word]) & 0xFFFFFFFF)
        shift = _SHIFTS[turn][i % 4]
        np.left_shift(f, np.uint32(shift), out=t)
        f >>= np.uint32(32 - shift)
        f |= t
        f += b
        a, d, c, b, f = d, c, b, f, a
    a += np.uint32(_START[0])
    return a.byteswap()


def numbers(prefix: str, first: int, count: int):
    """The first eight hex digits of md5(prefix + i) as numbers, for i from first on."""
    import numpy as np

    head, last, parts = prefix.encode(), first + count, []
    while first < last:
        block, skip = divmod(first, LOW)
        taken = min(last - first, LOW - skip)
        if block == 0:
            parts.append(np.array([int.from_bytes(hashlib.md5(head + b"%d" % i).digest()[:4]) for i in range(first, first + taken)], np.uint32))
        else:
            parts.append(_block(head + b"%d" % block)[skip : skip + taken])
        first += taken
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def rows(numbers, n: int):
    """Numbers modulo n, as 32 bits."""
    import numpy as np

    if n > 0xFFFFFFFF:
        return numbers
    return numbers - numbers // np.uint32(n) * np.uint32(n)
