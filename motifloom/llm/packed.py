"""Arrays as compact bytes: what tasks hand on in binary columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def pack(arrays: list[np.ndarray], rest: bytes = b"") -> bytes:
    """One-dimensional arrays, each as its bytes of one significance after the other, compressed, and ``rest``."""
    held = []
    head = [len(arrays)]
    for a in arrays:
        a = np.ascontiguousarray(a)
        held.append(pa.compress(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes(), codec="zstd", asbytes=True) if len(a) else b"")
        head += [a.itemsize, len(a), len(held[-1])]
    return b"".join([np.array(head, "<i8").tobytes(), *held, rest])


def unpack(raw: bytes) -> tuple[list[np.ndarray], bytes]:
    """What ``pack`` was given; arrays come back as unsigned integers of their width."""
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    head = np.frombuffer(raw, "<i8", 3 * n, 8).reshape(n, 3)
    at, out = 8 + 24 * n, []
    for width, size, stored in head.tolist():
        plain = pa.decompress(raw[at : at + stored], decompressed_size=width * size, codec="zstd", asbytes=True) if size else b""
        out.append(np.ascontiguousarray(np.frombuffer(plain, np.uint8).reshape(width, size).T).view(f"<u{width}").ravel())
        at += stored
    return out, raw[at:]


def steps(values: np.ndarray) -> np.ndarray:
    """Differences of neighbours, modulo the values' width; ``summed`` undoes it."""
    out = values.copy()
    out[1:] -= values[:-1]
    return out


def summed(values: np.ndarray) -> np.ndarray:
    return np.cumsum(values, dtype=values.dtype)
