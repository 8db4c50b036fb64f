"""The index of sums against all combinations, and plans against the least number of sequences."""

import itertools
import math
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import packing


def brute(gap, stock, parts):
    lengths = sorted(stock)
    return {c for k in range(1, parts + 1) for c in itertools.combinations_with_replacement(lengths, k) if sum(c) == gap}


@pytest.mark.parametrize("parts", [1, 2, 3])
def test_every_combination_is_found(parts):
    rng = np.random.default_rng(parts)
    for _ in range(20):
        stock = {int(x) for x in rng.integers(1, 60, 14)}
        count = np.zeros(65, np.int64)
        count[list(stock)] = 9
        sums = packing.Sums(stock, 64)
        for gap in range(1, 64):
            for even in (False, True):
                found = [tuple(sorted(c)) for c in sums.filling(gap, count, parts, even)]
                assert len(found) == len(set(found)) and set(found) == brute(gap, stock, parts)


def test_counts_bound_what_is_taken():
    count = np.zeros(11, np.int64)
    count[[1, 2, 3]] = 4, 3, 1
    sums = packing.Sums([1, 2, 3], 10)
    taken = list(sums.take((6,), 9, 4, count, 3, False))
    assert taken == [((6, 3, 1), 1), ((6, 2, 2), 1), ((6, 2, 1, 1), 1)] and count.tolist() == [0, 1, 0, 0] + [0] * 7


@pytest.mark.parametrize("seed", range(6))
def test_plans_use_each_piece_once(seed):
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.exponential([40, 90, 300, 700, 20, 500][seed], 4000).astype(int) + 1, 1, 256)
    histogram = dict(Counter(lengths.tolist()))
    plan = packing.make_plan(histogram, 256)
    used = Counter()
    for pattern, n in plan.patterns:
        assert n > 0 and sum(pattern) <= 256
        for x in pattern:
            used[x] += n
    assert used == histogram
    least = max(math.ceil(lengths.sum() / 256), int((lengths > 128).sum()))
    assert least <= plan.sequences <= 1.02 * least + 2
    assert sum(len(p) > 2 and sum(p) == 256 for p, _ in plan.patterns) > 0
    for order in packing.ORDERS:
        count = np.bincount(lengths, minlength=257)
        again = packing._plan(count, packing.Sums(histogram, 256), 256, *order)
        assert plan.sequences <= again.sequences


def test_no_pieces():
    assert packing.make_plan({}).patterns == []
    with pytest.raises(ValueError):
        packing.make_plan({1025: 1})
