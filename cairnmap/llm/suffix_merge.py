"""Merging front-coded sorted runs with a loser tree that knows common prefixes.

A run is a sorted list of keys of one width, stored as the length each key shares
with the one before and the bytes that follow.  While merging, every waiting key
carries the length it shares with the last key put out.  Of two keys the one that
shares more is smaller, without looking at a byte; only at equal lengths are
bytes compared, and only from there on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import zstandard


def shared(a: bytes, b: bytes, start: int) -> int:
    """Length of the common prefix of two keys of one width that agree up to ``start``."""
    low, high = start, len(a)
    step = 8
    while low < high:  # doubling, then halving
        stop = min(high, low + step)
        if a[low:stop] == b[low:stop]:
            low, step = stop, step * 2
        else:
            high = stop - 1 if stop - low == 1 else stop
            if stop - low == 1:
                return low
            step = max(1, (high - low) // 2)
    return low


def shared_rows(keys: np.ndarray) -> np.ndarray:
    """What each row of a sorted matrix shares with the row before (the first: 0)."""
    out = np.zeros(len(keys), np.int64)
    if len(keys) > 1:
        differ = keys[1:] != keys[:-1]
        first = differ.argmax(1)
        out[1:] = np.where(differ[np.arange(len(first)), first], first, keys.shape[1])
    return out


def front_coded(keys: np.ndarray, lcp: np.ndarray) -> bytes:
    """The rows' bytes after what they share with the row before, compressed."""
    rest = keys[np.arange(keys.shape[1]) >= lcp[:, None]]
    return zstandard.ZstdCompressor(level=3).compress(rest.tobytes())


def decoded(lcp: np.ndarray, rest: bytes, width: int) -> Iterator[bytes]:
    raw, at, last = zstandard.ZstdDecompressor().decompress(rest, max_output_size=len(lcp) * width + 1), 0, b""
    for n in lcp.tolist():
        stop = at + width - n
        last = last[:n] + raw[at:stop]
        at = stop
        yield last


def merged(runs: list[tuple[np.ndarray, bytes]], width: int) -> Iterator[tuple[bytes, int, int, int]]:
    """(key, length shared with the key before, run, place in the run), sorted."""
    if not runs:
        return
    k = len(runs)
    streams = [decoded(lcp, rest, width) for lcp, rest in runs]
    lengths = [lcp.tolist() for lcp, _ in runs]
    place = [0] * k
    key: list[bytes | None] = [next(s, None) for s in streams]
    common = [0] * k
    tree = [-1] * k

    def play(i: int, node: int) -> int:
        """Run ``i`` meets the loser at ``node``: the loser stays, the winner goes on."""
        j = tree[node]
        a, b = key[i], key[j]
        if b is None:
            return i
        if a is None:
            tree[node] = i
            return j
        p, q = common[i], common[j]
        if p > q:
            return i
        if p < q:
            tree[node] = i
            return j
        n = shared(a, b, p)
        if n == width:
            less = i < j
        else:
            less = a[n] < b[n]
        if less:
            common[j] = n
            return i
        common[i] = n
        tree[node] = i
        return j

    winner = -1
    for i in range(k):  # a run climbs until it finds an empty node and waits there
        winner, node = i, (i + k) // 2
        while node:
            if tree[node] < 0:
                tree[node] = winner
                winner = -1
                break
            winner = play(winner, node)
            node //= 2
    if k == 1:
        winner = 0
    while (out := key[winner]) is not None:
        i = winner
        yield out, common[i], i, place[i]
        place[i] += 1
        key[i] = next(streams[i], None)
        common[i] = lengths[i][place[i]] if key[i] is not None else 0
        node = (i + k) // 2
        winner = i
        while node:
            winner = play(winner, node)
            node //= 2
