"""Points keep every count, however large."""

import numpy as np
import pytest

pytest.importorskip("kindred.llm")
from kindred.llm import rtree_join  # noqa: E402


def test_points_of_large_sets_are_exact():
    p = np.zeros((5, rtree_join.GROUPS), np.int32)
    p[1:, 3], p[:, 5] = (255, 256, 65_535, 65_536), (7, 255, 1, 2, 3_000_000)
    packed = [rtree_join.pack_point(x) for x in p]
    assert [len(b) // rtree_join.GROUPS for b in packed] == [1, 1, 2, 2, 4]
    assert (rtree_join.unpack_points(packed) == p).all()
    sizes = np.full(2, 3_065_536)
    assert rtree_join.near_pairs([7, 8], list(rtree_join.unpack_points([packed[4]] * 2)), sizes, np.ones(2, bool), 90, 100, rtree_join.Forest()) != []


def test_bitmap_grows_with_the_count():
    assert rtree_join.bits_for(0) == rtree_join.bits_for(1000) == rtree_join.LEAST_BITS
    for n in (10**5, 10**6, 8 * 10**6):
        assert 16 * n <= rtree_join.bits_for(n) < 64 * n
    assert rtree_join.bits_for(5 * 10**7) == rtree_join.MOST_BITS and rtree_join.bits_for(10**8) == 0
