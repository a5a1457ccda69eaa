"""Small array helpers that run inside tasks: hashes of words and packed numbers."""

from __future__ import annotations

import ctypes
import zlib

import numpy as np
import pyarrow as pa

BYTE = np.random.default_rng(3).integers(0, 2**64, 256, dtype=np.uint64)
POWER = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_words(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of non-empty byte strings: polynomials over random byte values, mixed."""
    if not words:
        return np.zeros(0, np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(size) - size
    data = np.frombuffer(b"".join(words), np.uint8)
    place = np.arange(len(data)) - np.repeat(start, size)
    powers = np.multiply.accumulate(np.full(int(size.max()), POWER, np.uint64))
    return mixed(np.add.reduceat(BYTE[data] * powers[place], start) + size.astype(np.uint64))


def pack(values: np.ndarray, kind: str) -> bytes:
    return zlib.compress(values.astype(kind, copy=False).tobytes(), 1)


def unpack(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), kind)


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending unsigned numbers as differences, in 4 bytes each where they fit."""
    steps = np.diff(values, prepend=np.zeros(1, values.dtype))
    kind = "<u4" if len(steps) == 0 or steps.max() < 2**32 else "<u8"
    return kind.encode() + steps.astype(kind).tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    kind = data[:3].decode()
    return np.cumsum(np.frombuffer(data[3:], kind).astype(np.uint64), dtype=np.uint64)


def release() -> None:
    """Give freed memory back to the system. Python workers live on from stage to stage, and what
    an earlier one needed would count against the executor for good."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
