"""Vectorised hashing of bytes, words and windows in tasks."""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C55 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: A number of 64 bits per byte value, from a fixed rule.
_BYTE = np.array([(0xD1342543DE82EF95 * (i + 1) ** 3 + 0x2545F4914F6CDD1D * (i + 7)) % (1 << 64) for i in range(256)], U)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = [np.ones(1, U), np.ones(1, U)]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of each, modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, factor in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, factor, U)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    x = x ^ U(salt * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums from which ``span_hash`` reads the hash of any stretch of ``data`` (uint8)."""
    powers, _ = _tables(len(data) + 1)
    return np.concatenate([np.zeros(1, U), np.cumsum(_BYTE[data] * powers[:len(data)])])


def span_hash(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of the bytes from ``start`` to ``stop``, equal for equal bytes wherever they stand."""
    _, inverse = _tables(len(sums))
    return mix((sums[stop] - sums[start]) * inverse[start], 1) ^ mix((stop - start).astype(U), 2)


def words(data: bytes) -> np.ndarray:
    """Hashes of the words of ``data``, A-Z lower-cased; words end at bytes 9 to 13 and 32."""
    view = np.frombuffer(data.lower(), np.uint8)
    if not len(view):
        return np.zeros(0, U)
    edges = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[view], [True]]).astype(np.int8)))
    if not len(edges):
        return np.zeros(0, U)
    return span_hash(prefix_sums(view), edges[::2], edges[1::2])


def shingles(data: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; of all words when they are fewer; none without words."""
    found = words(data)
    if not len(found):
        return found
    return np.unique(_runs(found, min(size, len(found))))


def _runs(found: np.ndarray, size: int) -> np.ndarray:
    n = len(found) - size + 1
    out = np.full(n, size, U)
    for k in range(size):
        out = mix(out ^ found[k:k + n], k + 3)
    return out


#: Bytes of text worked on in one go.
GROUP_BYTES = 1 << 19


def shingle_groups(texts: list[str | None], size: int):
    """(first, bounds, tokens) for consecutive texts: the ``shingles`` of text ``first + i`` are ``tokens[bounds[i]:bounds[i + 1]]``."""
    first = 0
    while first < len(texts):
        data, total = [], 0
        while first + len(data) < len(texts) and (not data or total < GROUP_BYTES) and len(data) < 60_000:
            data.append((texts[first + len(data)] or "").encode("utf-8", "replace"))
            total += len(data[-1]) + 1
        yield first, *_group(data, size)
        first += len(data)


def _group(data: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    view = np.frombuffer(b"\n".join(data).lower(), np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[view], [True]]).astype(np.int8)))
    start, stop = edges[::2], edges[1::2]
    if not len(start):
        return np.zeros(len(data) + 1, np.int64), np.zeros(0, U)
    found = span_hash(prefix_sums(view), start, stop)
    begins = np.cumsum([0, *(len(d) + 1 for d in data[:-1])])
    owner = np.searchsorted(begins, start, side="right") - 1
    count = np.bincount(owner, minlength=len(data))
    tokens, owners = np.zeros(0, U), np.zeros(0, np.int64)
    if len(found) >= size:
        inside = owner[:len(owner) - size + 1] == owner[size - 1:]
        tokens, owners = _runs(found, size)[inside], owner[:len(inside)][inside]
    # Texts of fewer words are one run each.
    last = np.cumsum(count)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        tokens = np.concatenate([tokens, *(_runs(found[last[i] - count[i]:last[i]], count[i]) for i in short)])
        owners = np.concatenate([owners, short])
    order = np.argsort(tokens)
    order = order[np.argsort(owners[order].astype(np.uint16), kind="stable")]
    tokens, owners = tokens[order], owners[order]
    new = np.append(True, (tokens[1:] != tokens[:-1]) | (owners[1:] != owners[:-1]))
    tokens, owners = tokens[new], owners[new]
    return np.searchsorted(owners, np.arange(len(data) + 1)), tokens
