"""64-bit hashes of words and word shingles with numpy, for many texts in one pass.

Inside tasks only. A word's hash is a polynomial over its bytes modulo 2**64, taken from
one running sum over the buffer, then mixed; equal words have equal hashes anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
#: Bytes that are hashed together; a longer text or word makes its own larger buffer.
TOGETHER = 1 << 18
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, _U)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=_U)
    return _powers[0], _powers[1]


def _buffer_words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start offsets of the words of one buffer of lower-case bytes."""
    b = np.frombuffer(raw, np.uint8)
    inside = np.zeros(len(b) + 2, np.int8)
    inside[1:-1] = (b != 32) & ((b < 9) | (b > 13))
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.empty(0, _U), starts
    up, down = _power(len(b) + 1)
    run = np.empty(len(b) + 1, _U)
    run[0] = 0
    np.cumsum((b.astype(_U) + _U(1)) * up[: len(b)], out=run[1:])
    return mix((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(_U)), starts


def _long_words(raw: bytes) -> np.ndarray:
    """Word hashes of a long text, cut at white space into buffers."""
    found, at = [], 0
    while at < len(raw):
        stop = at + TOGETHER
        if stop < len(raw):
            cut = max(raw.rfind(c, at, stop) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            if cut < 0:
                after = [k for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (k := raw.find(c, stop)) >= 0]
                cut = min(after, default=len(raw))
            stop = cut + 1
        found.append(_buffer_words(raw[at:stop])[0])
        at = stop
    return np.concatenate(found) if found else np.empty(0, _U)


def batches_of(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts whose bytes are hashed together."""
    first, held = 0, 0
    for k, t in enumerate(texts):
        if k > first and held + len(t) > TOGETHER:
            yield first, k
            first, held = k, 0
        held += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


def word_hashes(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The word hashes of each text, A-Z in lower case, in order."""
    for first, last in batches_of(texts):
        if last - first == 1 and len(texts[first]) > TOGETHER:
            yield _long_words(texts[first].lower())
            continue
        some = texts[first:last]
        hashes, starts = _buffer_words(b"\n".join(some).lower())
        ends = np.cumsum([len(t) + 1 for t in some])
        cuts = np.searchsorted(starts, ends)
        yield from np.split(hashes, cuts[:-1])


def shingle_hashes(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of the k-word shingles, sorted and distinct; fewer words are one shingle, no words none."""
    if not len(words):
        return words
    n = len(words) - k + 1
    odd = [_U(2 * int(m) + 1) for m in mix(np.arange(1, k + 1, dtype=_U)) >> _U(1)]
    if n <= 0:
        total = _U(len(words)) + sum((words[j : j + 1] * odd[j] for j in range(len(words))), np.zeros(1, _U))
        return mix(total ^ _U(0xA5A5A5A5A5A5A5A5))
    total = words[:n] * odd[0]
    for j in range(1, k):
        total += words[j : j + n] * odd[j]
    return np.unique(mix(total))
