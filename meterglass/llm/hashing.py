"""XXH64 of many slices of one buffer at once, on arrays."""

from __future__ import annotations

import numpy as np

#: The hash's primes.
PRIMES = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
P1, P2, P3, P4, P5 = map(np.uint64, PRIMES)
#: Bytes that may be read beyond a slice's end.
PAD = 8


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return x << np.uint64(by) | x >> np.uint64(64 - by)


def _mixed(lane: np.ndarray, into=np.uint64(0)) -> np.ndarray:
    return _turned(into + lane * P2, 31) * P1


def xxh64(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """The hash of data[start:end] for arrays of places; ``data`` (bytes) has PAD more at its end.

    Every step is made for all slices that still need it.
    """
    eights = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    fours = np.ndarray((len(data) - 3,), "<u4", data, strides=(1,))
    at, seed = start.copy(), np.uint64(seed)
    with np.errstate(over="ignore"):
        h = np.full(len(at), seed + P5)
        long = np.flatnonzero(end - at >= 32)
        if len(long):
            lanes = [np.full(len(long), x) for x in (seed + P1 + P2, seed + P2, seed, seed - P1)]
            live = np.arange(len(long))
            while len(live):
                for k, lane in enumerate(lanes):
                    lane[live] = _mixed(eights[at[long[live]] + 8 * k], lane[live])
                at[long[live]] += 32
                live = live[end[long[live]] - at[long[live]] >= 32]
            one = sum((_turned(x, by) for x, by in zip(lanes[1:], (7, 12, 18))), _turned(lanes[0], 1))
            for lane in lanes:
                one = (one ^ _mixed(lane)) * P1 + P4
            h[long] = one
        h += (end - start).astype(np.uint64)
        live = np.flatnonzero(end - at >= 8)
        while len(live):
            h[live] = _turned(h[live] ^ _mixed(eights[at[live]]), 27) * P1 + P4
            at[live] += 8
            live = live[end[live] - at[live] >= 8]
        live = np.flatnonzero(end - at >= 4)
        h[live] = _turned(h[live] ^ fours[at[live]].astype(np.uint64) * P1, 23) * P2 + P3
        at[live] += 4
        while len(live := np.flatnonzero(at < end)):
            h[live] = _turned(h[live] ^ data[at[live]].astype(np.uint64) * P5, 11) * P1
            at[live] += 1
        h = (h ^ h >> np.uint64(33)) * P2
        h = (h ^ h >> np.uint64(29)) * P3
        return h ^ h >> np.uint64(32)
