"""Compact binary columns for numbers that travel between tasks."""

import numpy as np
import zstandard


def pack(values: np.ndarray) -> bytes:
    """Numbers of one type, their bytes grouped by significance and compressed."""
    values = np.ascontiguousarray(values)
    planes = values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, dtype) -> np.ndarray:
    dtype = np.dtype(dtype)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(dtype.itemsize, -1).T).reshape(-1).view(dtype)


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending unsigned 64-bit numbers, as differences."""
    return pack(np.diff(values, prepend=np.zeros(1, np.uint64)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)
