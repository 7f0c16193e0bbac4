"""Compressed bitmaps over the ordinals of a block: sorted places, runs, or bits, whichever is smallest."""

from __future__ import annotations

import numpy as np

Bitmap = tuple[str, np.ndarray]


def compressed(places: np.ndarray, size: int) -> Bitmap:
    """The bitmap of distinct places below `size`. Bytes decide: 2 a place, 4 a run, size / 8 for bits."""
    places = np.sort(places).astype(np.uint16)
    breaks = np.flatnonzero(np.diff(places.astype(np.int32)) != 1) + 1
    runs = 0 if not places.size else breaks.size + 1
    if runs * 4 <= min(places.size * 2, size // 8) and places.size:
        first = places[np.concatenate(([0], breaks))]
        last = places[np.concatenate((breaks - 1, [places.size - 1]))]
        return "runs", np.stack([first, last], axis=1)
    if places.size * 2 <= size // 8:
        return "places", places
    return "bits", _bits(places, size)


def _bits(places: np.ndarray, size: int) -> np.ndarray:
    has = np.zeros(size, bool)
    has[places] = True
    return np.packbits(has)


def places_of(b: Bitmap) -> np.ndarray:
    """The places of a bitmap, in order."""
    kind, data = b
    if kind == "places":
        return data.astype(np.int64)
    if kind == "bits":
        return np.flatnonzero(np.unpackbits(data))
    if not data.size:
        return np.zeros(0, np.int64)
    first, n = data[:, 0].astype(np.int64), (data[:, 1].astype(np.int64) - data[:, 0] + 1)
    return np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())


def holds(b: Bitmap, at: np.ndarray) -> np.ndarray:
    """Which of the places `at` a bitmap holds, found in its compressed form."""
    kind, data = b
    if kind == "bits":
        return (data[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)
    if not data.size:
        return np.zeros(at.size, bool)
    if kind == "places":
        i = np.searchsorted(data, at)
        return (i < data.size) & (data[np.minimum(i, data.size - 1)] == at)
    i = np.searchsorted(data[:, 0], at, side="right") - 1
    return (i >= 0) & (at <= data[np.maximum(i, 0), 1])


def and_not(a: Bitmap, b: Bitmap) -> np.ndarray:
    """The places of a that b lacks."""
    if a[0] == b[0] == "bits":
        return np.flatnonzero(np.unpackbits(a[1] & ~b[1]))
    at = places_of(a)
    return at[~holds(b, at)]


def both(a: Bitmap, b: Bitmap) -> np.ndarray:
    """The places that a and b hold."""
    if a[0] == b[0] == "bits":
        return np.flatnonzero(np.unpackbits(a[1] & b[1]))
    at = places_of(a)
    return at[holds(b, at)]
