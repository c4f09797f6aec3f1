"""A minimal acyclic transducer over sorted terms: term to lexicographic ordinal and back."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np


class Transducer:
    """Maps each of a set of byte strings to its place in their order.

    Transitions lie in one array, by state and byte; each has an output, the number of terms of its state that
    come before those behind it, so the outputs along a term's path add up to its ordinal.
    """

    def __init__(self, keys: np.ndarray, targets: np.ndarray, outputs: np.ndarray, final: np.ndarray, root: int):
        self.keys, self.targets, self.outputs, self.final, self.root = keys, targets, outputs, final, root

    @classmethod
    def build(cls, terms: Iterable[bytes]) -> Transducer:
        """From terms in ascending order, each once: a state is closed as soon as no later term can reach it, and
        states with equal futures are one (Daciuk et al., 2000)."""
        known: dict[tuple, int] = {}  # (final, (byte, state), ...) to state
        forms: list[tuple] = []
        path: list[list] = [[False]]  # open states of the last term: final, then (byte, state)
        last = b""

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                form = tuple(path.pop())
                state = known.get(form)
                if state is None:
                    state = known[form] = len(forms)
                    forms.append(form)
                path[-1].append((last[len(path) - 1], state))

        for term in terms:
            shared = 0
            for x, y in zip(term, last, strict=False):
                if x != y:
                    break
                shared += 1
            close(shared)
            path.extend([False] for _ in range(len(term) - shared))
            path[-1][0] = True
            last = term
        close(0)
        forms.append(tuple(path[0]))
        sizes = np.zeros(len(forms), "i8")  # terms behind each state; targets come before their sources
        keys, targets, outputs = [], [], []
        for state, (final, *steps) in enumerate(forms):
            n = int(final)
            for byte, target in steps:
                keys.append(state * 256 + byte)
                targets.append(target)
                outputs.append(n)
                n += int(sizes[target])
            sizes[state] = n
        return cls(np.array(keys, "i8"), np.array(targets, "i8"), np.array(outputs, "i8"), np.array([f[0] for f in forms], bool), len(forms) - 1)

    def pack(self) -> bytes:
        head = np.array([len(self.keys), len(self.final), self.root], "<i8")
        return b"".join([head.tobytes(), *(x.astype("<i4").tobytes() for x in (self.keys, self.targets, self.outputs)), self.final.tobytes()])

    @classmethod
    def unpack(cls, packed: bytes) -> Transducer:
        n, _, root = np.frombuffer(packed, "<i8", 3)
        keys, targets, outputs = np.frombuffer(packed, "<i4", 3 * int(n), 24).reshape(3, -1).astype("i8")
        return cls(keys, targets, outputs, np.frombuffer(packed, bool, offset=24 + 12 * int(n)), int(root))

    def ordinals(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """The ordinal of each term data[start : stop], or -1. All terms take a step at a time; those without one drop out."""
        out = np.full(len(starts), -1, "i8")
        if not len(self.keys):
            out[starts == stops] = 0 if self.final[self.root] else -1
            return out
        live, at = np.arange(len(starts)), starts.copy()
        state, ordinal = np.full(len(starts), self.root), np.zeros(len(starts), "i8")
        while len(live):
            over = at == stops[live]
            ended = over & self.final[state]
            out[live[ended]] = ordinal[ended]
            go = ~over
            live, at, state, ordinal = live[go], at[go], state[go], ordinal[go]
            key = state * 256 + data[at]
            i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[i] == key
            i = i[hit]
            live, at, state, ordinal = live[hit], at[hit] + 1, self.targets[i], ordinal[hit] + self.outputs[i]
        return out

    def term(self, ordinal: int) -> bytes:
        """The term with this ordinal."""
        state, out = self.root, bytearray()
        while True:
            if self.final[state] and ordinal == 0:
                return bytes(out)
            a, b = np.searchsorted(self.keys, (state * 256, state * 256 + 256))
            i = a + int(np.searchsorted(self.outputs[a:b], ordinal, side="right")) - 1
            if i < a:
                raise IndexError("no such ordinal")
            out.append(int(self.keys[i]) & 255)
            state, ordinal = int(self.targets[i]), ordinal - int(self.outputs[i])
