"""Sorted runs of suffixes: front coding, and merging with a loser tree that keeps prefixes.

A run is a sorted list of distinct strings; in its coded form each string is the length of the
prefix it shares with the one before and the rest.  While runs are merged, every string in the
tree carries the length of the prefix it shares with the last string put out.  Of two strings
the one that shares more is smaller, without looking at either; only where both share the same
length are they compared, from there on.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np


def common(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix, given that ``start`` bytes are known to agree."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[start:n], "big") ^ int.from_bytes(b[start:n], "big")
    return n - (x.bit_length() + 7) // 8


def front_code(strings: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Shared prefix lengths, lengths of the rests, and all rests, of a sorted list."""
    shared, rests, last = [], [], b""
    for s in strings:
        n = common(last, s)
        shared.append(n)
        rests.append(s[n:])
        last = s
    return np.asarray(shared, "<u2"), np.asarray([len(r) for r in rests], "<u2"), b"".join(rests)


def decode(shared: np.ndarray, lengths: np.ndarray, rests: bytes) -> Iterator[tuple[int, bytes]]:
    """``(length shared with the one before, string)`` of a coded run."""
    at, last = 0, b""
    for n, m in zip(shared.tolist(), lengths.tolist()):
        last = last[:n] + rests[at : at + m]
        at += m
        yield n, last


_DONE = -1  # shares less than any string: loses every game


def merge(runs: Sequence[Iterator[tuple[int, bytes]]]) -> Iterator[tuple[int, bytes, int]]:
    """``(length shared with the string put out before, string, number of its run)`` in order.

    Equal strings of different runs follow each other.
    """
    k = 1
    while k < max(1, len(runs)):
        k *= 2
    heads: list[bytes] = []
    shares: list[int] = []
    for i in range(k):
        first = next(runs[i], None) if i < len(runs) else None
        heads.append(b"" if first is None else first[1])
        shares.append(_DONE if first is None else 0)
    # The first games: nothing has been put out, so all share the empty prefix.
    losers = [0] * k
    winners = [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        if shares[a] < shares[b]:
            a, b = b, a
        elif shares[a] == shares[b] != _DONE:
            s, t = heads[a], heads[b]
            n = common(s, t, shares[a])
            if t[n : n + 1] < s[n : n + 1]:
                a, b = b, a
            shares[b] = n
        winners[node], losers[node] = a, b
    top = winners[1]
    while (share := shares[top]) != _DONE:
        yield share, heads[top], top
        following = next(runs[top], None)
        if following is None:
            heads[top], share = b"", _DONE
        else:
            share, heads[top] = following
        shares[top] = share
        node = (top + k) >> 1
        while node:
            other = losers[node]
            theirs = shares[other]
            if theirs > share:
                losers[node], top, share = top, other, theirs
            elif theirs == share and share != _DONE:
                s, t = heads[top], heads[other]
                n = common(s, t, share)
                if t[n : n + 1] < s[n : n + 1]:
                    losers[node], shares[top], top = top, n, other
                else:
                    shares[other] = n
            node >>= 1
