"""Sorted suffix runs: front coding, and merging that never compares a known prefix.

A run is a sorted list of suffixes, each stored as the length of the prefix it shares
with the one before, the rest of its bytes and a payload of fixed size. The loser tree
keeps, for every losing suffix, how much it shares with the last winner. Two suffixes
with different such lengths are ordered by the lengths alone; only equal lengths are
compared further, from that position on.
"""

from __future__ import annotations

from collections.abc import Iterator


def shared_prefix(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix, which is known to be ``start`` at least."""
    n = min(len(a), len(b))
    if a[start:n] == b[start:n]:
        return n
    lo, hi = start, n
    while hi - lo > 8:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    while a[lo] == b[lo]:
        lo += 1
    return lo


def encode(rows: list[tuple[bytes, bytes]]) -> bytes:
    """Front-coded run of sorted ``(suffix, payload)``; suffixes hold under 256 bytes."""
    out, before = [], b""
    for suffix, payload in rows:
        same = shared_prefix(before, suffix)
        out += (bytes((same, len(suffix) - same)), suffix[same:], payload)
        before = suffix
    return b"".join(out)


def decode(run: bytes, payload: int) -> Iterator[tuple[int, bytes, bytes]]:
    """``(shared with the one before, suffix, payload)`` of a run."""
    at, before, end = 0, b"", len(run)
    while at < end:
        same, rest = run[at], run[at + 1]
        stop = at + 2 + rest
        before = before[:same] + run[at + 2 : stop]
        yield same, before, run[stop : stop + payload]
        at = stop + payload


class LoserTree:
    """Merge of front-coded runs into ``(shared with the one before, suffix, payload)``.

    Every entry is ``[shared with the last winner, suffix, payload, run]``; finished
    runs are None and lose against all.
    """

    def __init__(self, runs: list[Iterator[tuple[int, bytes, bytes]]]):
        self.runs = runs
        self.size = 1
        while self.size < len(runs):
            self.size *= 2
        self.losers: list[list | None] = [None] * self.size
        entries = [self._first(i) for i in range(self.size)]
        level = entries
        base = self.size // 2
        while len(level) > 1:
            winners = []
            for i in range(0, len(level), 2):
                winner, loser = self._match(level[i], level[i + 1])
                self.losers[base + i // 2] = loser
                winners.append(winner)
            level, base = winners, base // 2
        self.top = level[0]

    def _first(self, run: int) -> list | None:
        if run >= len(self.runs):
            return None
        got = next(self.runs[run], None)
        return None if got is None else [0, got[1], got[2], run]

    @staticmethod
    def _match(a: list | None, b: list | None) -> tuple[list | None, list | None]:
        """Winner and loser of two entries measured against the same earlier winner."""
        if b is None:
            return a, b
        if a is None:
            return b, a
        if a[0] != b[0]:
            return (a, b) if a[0] > b[0] else (b, a)
        same = shared_prefix(a[1], b[1], a[0])
        if a[1][same:] <= b[1][same:]:
            b[0] = same
            return a, b
        a[0] = same
        return b, a

    def __iter__(self) -> Iterator[tuple[int, bytes, bytes]]:
        while self.top is not None:
            same, suffix, payload, run = self.top
            yield same, suffix, payload
            got = next(self.runs[run], None)
            # The next suffix of the run is coded against the one that just won.
            entry = None if got is None else [got[0], got[1], got[2], run]
            at = (self.size + run) // 2
            while at:
                entry, self.losers[at] = self._match(entry, self.losers[at])
                at //= 2
            self.top = entry
