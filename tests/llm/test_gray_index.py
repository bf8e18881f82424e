import numpy as np
import pytest

from kinloom.llm.gray_index import Forest, blocks, gray_rank, linked_pairs, upper_masks


def test_gray_neighbours_differ_in_one_bit():
    n = np.arange(4096, dtype=np.uint64)
    code = n ^ (n >> np.uint64(1))
    assert (gray_rank(code) == n).all()


def test_blocks_cover_all_bits_once():
    assert sum(blocks(4)) == (1 << 64) - 1
    assert len(upper_masks(4)) == 15 and len(upper_masks(10, 3)) == 286
    assert all(bin(m & (1 << 64) - 1).count('1') >= 12 for m in upper_masks(10, 3))


@pytest.mark.parametrize("spread", [3, 10, 64])
def test_pairs_equal_brute_force(spread):
    rng = np.random.default_rng(spread)
    base = rng.integers(0, 1 << 63, 5, dtype=np.uint64)
    prints = base[rng.integers(0, 5, 700)]
    for _ in range(min(spread, 8)):
        prints = prints ^ (np.uint64(1) << rng.integers(0, min(spread, 64), 700, dtype=np.uint64))
    group = np.sort(rng.integers(0, 4, 700))
    order = np.lexsort((gray_rank(prints), group))
    prints, group = prints[order], group[order]
    side = rng.integers(0, 2, 700)
    near = (np.bitwise_count(prints[:, None] ^ prints[None]) <= 4) & (group[:, None] == group[None]) & np.triu(np.ones((700, 700), bool), 1)
    for s, want in ((None, near), (side, near & (side[:, None] != side[None]))):
        got = np.zeros_like(want)
        for a, b in linked_pairs(prints, group, 4, side=s):
            got[a, b] = True
        assert (got == want).all()


def test_forest_roots():
    f = Forest(6)
    f.join(np.array([5, 4, 2]), np.array([4, 3, 1]))
    f.join(np.array([5]), np.array([1]))
    assert f.roots().tolist() == [0, 1, 1, 1, 1, 1]
