"""Numpy arrays as bytes in a binary column."""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<2sI")


def pack(*arrays: np.ndarray) -> bytes:
    out = []
    for a in arrays:
        out.append(_HEAD.pack(f"{a.dtype.kind}{a.dtype.itemsize}".encode(), len(a)))
        out.append(a.tobytes())
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    found, at = [], 0
    while at < len(data):
        kind, n = _HEAD.unpack_from(data, at)
        at += _HEAD.size
        found.append(np.frombuffer(data, "<" + kind.decode(), n, at))
        at += found[-1].nbytes
    return found


def numbers48(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers below 2^48 as 6 bytes each."""
    return (values & np.uint64(0xFFFFFFFF)).astype("<u4"), (
        values >> np.uint64(32)).astype("<u2")


def join48(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32))
