"""Rolling hashes of all windows of many sequences at once, with numpy.

A window's hash is the polynomial of its mixed elements in an odd base, modulo
2^64.  Prefix sums of element times base^i give every window by one difference
and one product with base^-i, whatever the window's length.  Hashes depend on
nothing but the elements, so all machines agree.
"""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
OTHER_BASE = 0xC2B2AE3D27D4EB4F | 1


def mix(values: np.ndarray, salt: int = 0) -> np.ndarray:
    """uint64 hashes of whole numbers, by two xor-shift multiplications."""
    x = values.astype(np.uint64) + np.uint64((salt * 2 + 1) * 0x632BE59BD9B4E019 % (1 << 64))
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def windows(values: np.ndarray, width: int, base: int = BASE, salt: int = 0) -> np.ndarray:
    """The hash of each window of ``width`` elements; empty if there are fewer."""
    n = len(values)
    if n < width:
        return np.empty(0, np.uint64)
    powers = np.full(n + 1, np.uint64(base))
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    inverse = np.full(n - width + 1, np.uint64(pow(base, -1, 1 << 64)))
    inverse[0] = 1
    np.multiply.accumulate(inverse, out=inverse)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(values, salt) * powers[:n], out=sums[1:])
    return (sums[width:] - sums[: n - width + 1]) * inverse


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def joined_windows(parts: list[np.ndarray], width: int, base: int = BASE, salt: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, part, position) of each window that lies inside one part."""
    lengths = np.array([len(p) for p in parts], np.int64)
    if not len(parts) or lengths.sum() < width:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    hashes = windows(np.concatenate(parts), width, base, salt)
    starts = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(parts)), lengths)[: len(hashes)]
    position = np.arange(len(hashes)) - starts[owner]
    inside = position + width <= lengths[owner]
    return hashes[inside], owner[inside], position[inside]


def window_runs(parts: list[np.ndarray], width: int, base: int = BASE, salt: int = 0, most: int = 1 << 20):
    """As ``joined_windows``, in runs of at most ``most`` windows and a little more, so that memory follows neither the number nor the length of the parts."""
    run: list[np.ndarray] = []
    names: list[tuple[int, int]] = []
    size = 0

    def flush():
        hashes, owner, position = joined_windows(run, width, base, salt)
        whose = np.array(names, np.int64).reshape(-1, 2)
        return hashes, whose[owner, 0], position + whose[owner, 1]

    for i, part in enumerate(parts):
        for offset in range(0, max(0, len(part) - width + 1), most):
            piece = part[offset : offset + most + width - 1]
            run.append(piece)
            names.append((i, offset))
            size += len(piece)
            if size >= most:
                yield flush()
                run, names, size = [], [], 0
    if run:
        yield flush()
