"""Array helper shared by the grouped kernels: merge index pairs into classes."""

from __future__ import annotations

import numpy as np


def smallest_members(size: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For ``size`` items joined by index pairs, the smallest index of each item's class.

    Every sweep hooks the larger of two differing representatives onto the
    smaller one and then flattens the pointers, so the number of sweeps grows
    with the logarithm of the longest chain.
    """
    parent = np.arange(size)
    while left.size:
        a, b = parent[left], parent[right]
        open_pairs = a != b
        if not open_pairs.any():
            break
        left, right, a, b = left[open_pairs], right[open_pairs], a[open_pairs], b[open_pairs]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            jumped = parent[parent]
            if np.array_equal(jumped, parent):
                break
            parent = jumped
    return parent
