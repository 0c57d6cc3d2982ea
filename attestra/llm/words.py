"""Hashes of whole words, worked out for a run of text at once and without a store of words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

#: Bytes hashed together, about; longer texts are split at a space.
SPAN = 1 << 20
_SPACE = re.compile(rb"[\t-\r ]")
_GAPS = np.zeros(256, bool)
_GAPS[[9, 10, 11, 12, 13, 32]] = True
_ODD = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def mixed(value: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    """xxhash64 of 64-bit numbers, as the SQL function of that name has it."""
    rotate = lambda x, k: x << np.uint64(k) | x >> np.uint64(64 - k)
    one, two, three, four, five = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    h = np.asarray(seed, np.uint64) + (five + np.uint64(8))
    h = rotate(h ^ rotate(value * two, 31) * one, 27) * one + four
    h = (h ^ h >> np.uint64(33)) * two
    h = (h ^ h >> np.uint64(29)) * three
    return h ^ h >> np.uint64(32)


_BYTES = mixed(np.arange(256, dtype=np.uint64), np.full(1, 7, np.uint64))


def _powers(many: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, and those of its inverse."""
    if not _POWERS or len(_POWERS[0]) < many:
        size = max(many, SPAN + (1 << 16))
        _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)])) for x in (_ODD, pow(_ODD, -1, 1 << 64))]
    return _POWERS[0], _POWERS[1]


def hashes(raw: bytes, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs without ASCII white space) in bytes that end in a space, and where they start: polynomials of their bytes, read off running sums."""
    codes = np.frombuffer(raw, np.uint8)
    gap = _GAPS[codes]
    edge = gap[1:] != gap[:-1]
    starts = np.flatnonzero(edge & gap[:-1]) + 1
    ends = np.flatnonzero(edge & gap[1:]) + 1
    if len(codes) and not gap[0]:
        starts = np.concatenate([[0], starts])
    up, down = _powers(len(codes) + 1)
    with np.errstate(over="ignore"):
        upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[codes] * up[: len(codes)])])
        return mixed((upto[ends] - upto[starts]) * down[starts], np.uint64(seed)), starts


def of_texts(texts: list[bytes], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of the texts in one run, and how many words each text has. A long text is split piece by piece."""
    if any(len(x) > SPAN for x in texts):
        parts = [(k, part) for k, x in enumerate(texts) for part in pieces(x)]
        some = [hashes(part + b" ", seed)[0] for _, part in parts]
        sizes = np.bincount([k for k, _ in parts], [len(x) for x in some], minlength=len(texts)).astype(np.int64)
        return np.concatenate(some), sizes
    found, starts = hashes(b" ".join([*texts, b""]), seed)
    ends = np.cumsum([len(x) + 1 for x in texts])
    return found, np.diff(np.searchsorted(starts, ends), prepend=0)


def pieces(text: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(text):
        cut = _SPACE.search(text, at + SPAN)
        end = cut.end() if cut else len(text)
        yield text[at:end]
        at = end
