"""Sums of runs of rows against plain loops."""

import numpy as np
import pytest

from stocktake.llm.decontam import PIECE, row_sums


@pytest.mark.parametrize("sizes", [[1], [3, 1, 2], [PIECE, PIECE + 1, 1], [5 * PIECE + 3, 2, PIECE * PIECE + 1, 1, 1], []])
def test_sums_equal_plain_loops(sizes):
    r = np.random.default_rng(1)
    table = r.integers(-1000, 1000, (50, 7)).astype(np.float32)
    place = r.integers(0, 50, sum(sizes))
    starts = np.cumsum([0, *sizes])[:-1].astype(np.int64)
    expected = [table[place[at : at + n]].sum(axis=0) for at, n in zip(starts, sizes, strict=True)]
    found = row_sums(table, place, starts)
    assert found.dtype == np.float32 and found.shape == (len(sizes), 7)
    assert all((a == b).all() for a, b in zip(found, expected, strict=True))
