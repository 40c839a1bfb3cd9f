"""Word sequences of many documents side by side, so that recursions over words run in arrays, all documents a word at a time."""

from __future__ import annotations

import numpy as np


class Lockstep:
    """Symbols of documents laid out by position: first the first symbols of all documents, then the second ones, and so on.

    Documents are sorted by length, longest first, so those of a step are the first ``active[t]`` of ``order``, and their symbols
    lie in one run of ``flat``.
    """

    def __init__(self, sequences: list[np.ndarray]):
        lengths = np.array([len(s) for s in sequences], dtype=np.int64)
        self.order = np.argsort(-lengths, kind="stable")
        longest = lengths[self.order]
        steps = int(longest[0]) if len(lengths) else 0
        active = np.searchsorted(-longest, -np.arange(steps), side="left")
        first = np.concatenate(([0], np.cumsum(active)))
        self.active, self.first = active.tolist(), first.tolist()
        lane = np.empty(len(lengths), dtype=np.int64)
        lane[self.order] = np.arange(len(lengths))
        position = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        #: Where in ``flat`` the symbols of the sequences, one after another, lie.
        self.place = first[position] + np.repeat(lane, lengths)
        self.flat = np.zeros(len(self.place), dtype=sequences[0].dtype if sequences else np.int64)
        if sequences:
            self.flat[self.place] = np.concatenate(sequences)

    def run(self, step: int) -> slice:
        """The symbols of this step in ``flat``."""
        return slice(self.first[step], self.first[step + 1])
