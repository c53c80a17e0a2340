"""Which vocabulary pieces end at a byte: a suffix automaton filled on demand.

A state is the longest suffix of the bytes read so far that begins some piece;
``ends`` lists the pieces that are suffixes of a state, longest first. Both
tables only ever hold states of the fixed vocabulary."""

from __future__ import annotations

from collections.abc import Iterable


class Endings:
    START = b""

    def __init__(self, pieces: Iterable[bytes]):
        self.pieces = frozenset(pieces)
        self.heads = {p[:i] for p in self.pieces for i in range(len(p) + 1)} | {b""}
        self.go: dict[bytes, dict[int, bytes]] = {b"": {}}
        self.ends: dict[bytes, list[bytes]] = {b"": []}

    def step(self, state: bytes, byte: int) -> bytes:
        """The state after one more byte; fills ``go`` and ``ends``."""
        to = self.go[state].get(byte)
        if to is None:
            to = state + bytes((byte,))
            while to not in self.heads:
                to = to[1:]
            self.go[state][byte] = to
            if to not in self.go:
                self.go[to] = {}
                self.ends[to] = [to[i:] for i in range(len(to)) if to[i:] in self.pieces]
        return to
