"""Fast similarity sketching (Dahlgaard, Knudsen and Thorup, 2017), vectorised.

A sketch of a set has ``t`` coordinates.  In round ``i < t`` every element goes
to one hashed bin and offers the value ``i + v`` with ``v`` hashed into [0, 1);
in round ``t + j`` every element goes to bin ``j``, so after ``2 t`` rounds each bin
of a non-empty set is filled.  A bin keeps its smallest offer, which is from its
first round.  Two sets agree in a coordinate with probability equal to their
Jaccard similarity, and the number of agreements is concentrated as for
independent coordinates.  Large sets need about one round in all instead of ``t``.
"""

from __future__ import annotations

import numpy as np
from codeloom.llm.bytewords import U64, mix, seeds

EMPTY = ~U64(0)


def sketches(values: np.ndarray, bounds: np.ndarray, t: int = 128) -> np.ndarray:
    """Sketches of the sets ``values[bounds[i]:bounds[i+1]]``: an array of shape (sets, t).

    ``t`` must be a power of two.  The empty set has ``EMPTY`` in every coordinate.
    """
    if t & (t - 1):
        raise ValueError("t must be a power of two")
    n = len(bounds) - 1
    out = np.full(n * t, EMPTY, dtype=U64)
    if not n or not len(values):
        return out.reshape(n, t)
    shift = U64(64 - t.bit_length() + 1)
    low = U64((1 << 48) - 1)
    seed = seeds(2 * t, 23)
    doc = np.repeat(np.arange(n), np.diff(bounds))
    for i in range(2 * t):
        h = mix(values ^ seed[i])
        slot = (h >> shift).astype(np.int64) if i < t else np.int64(i - t)
        np.minimum.at(out, doc * t + slot, (h & low) | (U64(i) << U64(48)))
        open_sets = (out.reshape(n, t) == EMPTY).any(axis=1)
        if i == 0:
            open_sets &= np.diff(bounds) > 0
        todo = open_sets[doc]
        if not todo.any():
            break
        if not todo.all():
            doc, values = doc[todo], values[todo]
    return out.reshape(n, t)


def miss_probability(similarity: float, bands: int, rows: int) -> float:
    """Chance that two sets of this similarity share no band."""
    return (1 - similarity**rows) ** bands
