"""A minimal acyclic transducer from words to ordinals, in flat arrays that can be mapped from a file.

Words are added in byte order; states with the same continuations are one state (shared suffixes). A word's output is
the sum of the outputs of its transitions: each transition holds how many words of its state come before it. So the
output is the word's rank among all words, whatever suffixes it shares, and its ids are found by the rank.
"""

from __future__ import annotations

from pathlib import Path

import numpy as np


class Transducer:
    """Arrays: `arcs` holds state * 256 + byte of each transition, sorted; `targets` and `skips` the state it leads to and
    its output; `final` marks accepting states; `starts` and `ids` hold the ids of each rank."""

    FIELDS = ("arcs", "targets", "skips", "final", "starts", "ids", "root")

    def __init__(self, **arrays: np.ndarray):
        for name in self.FIELDS:
            setattr(self, name, arrays[name])

    @classmethod
    def compile(cls, words: dict[bytes, list[int]]) -> Transducer:
        register: dict[tuple, int] = {}
        made: list[tuple[bool, tuple]] = []  # (accepting, ((byte, state), ..)) of each state

        def settle(node: list) -> int:
            signature = (node[0], tuple(node[1]))
            if signature not in register:
                register[signature] = len(made)
                made.append(signature)
            return register[signature]

        path: list[list] = [[False, []]]  # the states along the last word, not yet settled
        last = b""
        ordered = sorted(words)
        for word in ordered:
            shared = 0
            while shared < min(len(word), len(last)) and word[shared] == last[shared]:
                shared += 1
            while len(path) > shared + 1:
                state = settle(path.pop())
                path[-1][1].append((last[len(path) - 1], state))
            for _ in word[shared:]:
                path.append([False, []])
            path[-1][0] = True
            last = word
        while len(path) > 1:
            state = settle(path.pop())
            path[-1][1].append((last[len(path) - 1], state))
        root = settle(path.pop())
        count = np.zeros(len(made), dtype=np.int64)  # words accepted from a state; states are made after their targets
        arcs, targets, skips = [], [], []
        for state, (accepts, out) in enumerate(made):
            below = int(accepts)
            for byte, target in out:
                arcs.append(state * 256 + byte)
                targets.append(target)
                skips.append(below)
                below += count[target]
            count[state] = below
        sizes = np.array([len(words[w]) for w in ordered], dtype=np.int64)
        return cls(
            arcs=np.array(arcs, dtype=np.int64), targets=np.array(targets, dtype=np.int64), skips=np.array(skips, dtype=np.int64),
            final=np.array([a for a, _ in made], dtype=bool), starts=np.concatenate(([0], np.cumsum(sizes))), ids=np.array([i for w in ordered for i in words[w]], dtype=np.int32), root=np.array([root]),
        )

    def save(self, folder: str) -> None:
        Path(folder).mkdir(parents=True, exist_ok=True)
        for name in self.FIELDS:
            np.save(Path(folder, f"{name}.npy"), getattr(self, name))

    @classmethod
    def mapped(cls, folder: str) -> Transducer:
        return cls(**{name: np.load(Path(folder, f"{name}.npy"), mmap_mode="r") for name in cls.FIELDS})

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """The rank of each word, -1 for those not in the lexicon; all words take a step at once."""
        out = np.full(len(words), -1, dtype=np.int64)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        if not len(words) or not len(self.arcs):
            return out
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        active = np.arange(len(words))
        state, total = np.full(len(words), int(self.root[0])), np.zeros(len(words), dtype=np.int64)
        step = 0
        while len(active):
            done = sizes[active] == step
            ended = active[done]
            out[ended] = np.where(self.final[state[ended]], total[ended], -1)
            active = active[~done]
            wanted = state[active] * 256 + flat[begin[active] + step]
            at = np.minimum(np.searchsorted(self.arcs, wanted), len(self.arcs) - 1)
            there = self.arcs[at] == wanted
            active, at = active[there], at[there]
            total[active] += self.skips[at]
            state[active] = self.targets[at]
            step += 1
        return out
