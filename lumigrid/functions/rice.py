"""Rice coding of whole numbers, as tiled FITS images use it (FITS standard 4.0, section 10.4.1).

A tile starts with its first value. The differences of neighbours, turned into
non-negative numbers, are coded in blocks of 32: a block's width code, then each
number's upper bits in unary and its lower ``width`` bits as they are. Width code
0 is a block of zeros, the greatest one a block that is not coded.
"""

from __future__ import annotations

import numpy as np

BLOCK = 32
#: fixed values of the format, by bytes a number: bits of the width code, the code of a block that is not coded (less one), bits of a number
CODES = {1: (3, 6, 8), 2: (4, 14, 16), 4: (5, 25, 32)}


def encode(values: np.ndarray) -> bytes:
    """values: a flat array of int8/uint8, int16 or int32."""
    size = values.dtype.itemsize
    code_bits, most, width = CODES[size]
    mask = (1 << width) - 1
    flat = values.astype(np.int64)
    step = np.diff(flat, prepend=flat[:1])
    # differences wrap around like the numbers themselves
    step = ((step + (1 << (width - 1))) & mask) - (1 << (width - 1))
    folded = np.where(step < 0, -2 * step - 1, 2 * step)
    starts = np.arange(0, len(folded), BLOCK)
    counts = np.diff(np.append(starts, len(folded)))
    sums = np.add.reduceat(folded, starts)
    mean = np.maximum((sums - counts // 2 - 1) / counts, 0).astype(np.int64) >> 1
    low = np.frexp(mean.astype(float))[1].astype(np.int64)
    zero, plain = sums == 0, (low >= most) & (sums > 0)
    each = np.repeat(np.arange(len(starts)), counts)
    lows, bare = low[each], plain[each]
    upper = np.where(bare, 0, folded >> lows)
    sizes = np.where(zero[each], 0, np.where(bare, width, upper + 1 + lows))
    # a block's code stands before its first number
    ends = np.cumsum(sizes + np.where(np.arange(len(folded)) % BLOCK == 0, code_bits, 0))
    at = ends - sizes
    bits = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)

    def put(place, number, n):
        """``number`` in ``n`` bits, the highest first."""
        for j in range(int(n.max()) if len(n) else 0):
            has = n > j
            bits[place[has] + n[has] - 1 - j] = (number[has] >> j) & 1

    code = np.where(zero, 0, np.where(plain, most + 1, low + 1))
    put(at[starts] - code_bits, code, np.full(len(starts), code_bits))
    coded = ~zero[each] & ~bare
    bits[at[coded] + upper[coded]] = 1
    put((at + upper + 1)[coded], folded[coded] & ((1 << lows[coded]) - 1), lows[coded])
    put(at[bare], folded[bare], np.full(int(bare.sum()), width))
    return values[:1].astype(values.dtype.newbyteorder(">")).tobytes() + np.packbits(bits).tobytes()


def decode(data: bytes, count: int, dtype) -> np.ndarray:
    dtype = np.dtype(dtype)
    size = dtype.itemsize
    code_bits, most, width = CODES[size]
    first = int(np.frombuffer(data, dtype.newbyteorder(">"), 1)[0])
    bits = np.unpackbits(np.frombuffer(data, np.uint8, offset=size))
    ones = np.append(np.flatnonzero(bits), len(bits))
    folded, at = np.zeros(count, np.int64), 0
    weights = lambda n: 1 << np.arange(n - 1, -1, -1, dtype=np.int64)
    for lo in range(0, count, BLOCK):
        n = min(BLOCK, count - lo)
        code = int(bits[at : at + code_bits] @ weights(code_bits))
        at += code_bits
        if code == most + 1:
            folded[lo : lo + n] = bits[at : at + n * width].reshape(n, width) @ weights(width)
            at += n * width
        elif code:
            low = code - 1
            k = int(np.searchsorted(ones, at))
            for i in range(lo, lo + n):
                while ones[k] < at:
                    k += 1
                stop = int(ones[k])
                rest = 0
                for b in bits[stop + 1 : stop + 1 + low].tolist():
                    rest = 2 * rest + b
                folded[i] = ((stop - at) << low) + rest
                at = stop + 1 + low
    step = np.where(folded & 1, -(folded + 1) // 2, folded // 2)
    flat = first + np.cumsum(step)
    if dtype.kind == "u":
        return (flat & ((1 << width) - 1)).astype(dtype)
    return (((flat + (1 << (width - 1))) & ((1 << width) - 1)) - (1 << (width - 1))).astype(dtype)
