"""Permutations of a treatment of few values: only rows of the ranges at a cut are put in order."""

import numpy as np

from causeway.operators import permutation as P


def test_rows_under_way_are_those_of_the_cut_ranges():
    counts = np.full((4, 50), 100)
    first = np.cumsum(counts, axis=1) - counts
    whole = P._whole(first, counts, [(0.0, 3456), (1.0, 1544)], 0.25)
    assert (np.isnan(whole).sum(axis=1) == 1).all() and np.isnan(whole[:, 15]).all()
    assert (whole[:, :15] == 0.75).all() and (whole[:, 16:] == -0.25).all()
    at_edge = P._whole(first, counts, [(0.0, 3000), (1.0, 2000)], 0.25)
    assert not np.isnan(at_edge).any()
    assert P._rounds(np.full(4, 100), 5 * 5000) == [range(0, 4)]
    assert P._rounds(np.full(4, 5000), 2 * 5000) == [range(0, 2), range(2, 4)]
    assert P._rounds(np.full(2, 5000), 10) == [range(0, 1), range(1, 2)]
