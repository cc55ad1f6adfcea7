"""Complete linkage of a square similarity matrix, in numpy."""

from __future__ import annotations

import numpy as np


def complete_linkage(sim: np.ndarray, least: float) -> np.ndarray:
    """Label of every row: the first row of its cluster.

    The two most similar clusters are joined while their lowest similarity is at least
    ``least``; ties go to the pair whose first rows come first. Rows must be in the order
    that breaks ties. Each step reads one maximum per row, which is kept up to date, so
    the work is about rows squared.
    """
    n = len(sim)
    label = np.arange(n)
    if n < 2:
        return label
    sim = sim.copy()
    low = -2 if sim.dtype.kind == "f" else np.iinfo(sim.dtype).min
    sim[np.tril_indices(n)] = low  # row < column only
    best = sim.argmax(1)
    top = sim[np.arange(n), best]
    while True:
        i = int(top.argmax())
        if top[i] < least:
            return label
        j = int(best[i])
        label[label == j] = i
        new = np.minimum(np.r_[sim[:i, i], sim[i, i:]], np.r_[sim[:j, j], sim[j, j:]])
        new[i] = new[j] = low
        sim[:i, i], sim[i, i + 1 :] = new[:i], new[i + 1 :]
        sim[:j, j], sim[j, j:] = low, low
        top[j] = low
        stale = np.union1d(np.flatnonzero((best[:j] == i) | (best[:j] == j)), [i])
        stale = stale[stale != j]
        best[stale] = sim[stale].argmax(1)
        top[stale] = sim[stale, best[stale]]
