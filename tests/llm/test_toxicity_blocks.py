"""Block-max lists: exact on random, tied and skewed vectors, and blocks are skipped."""

import random
from collections import Counter

import numpy as np
import pytest

from tallyframe.llm import toxicity


def brute(index, query, k):
    own, value = index.vector(query)
    dense = np.zeros(len(index.factor))
    dense[own] = value
    every = [(-float(dense[index.terms[a:b]] @ index.weights[a:b]), p)
             for p, (a, b) in enumerate(zip(index.ends[:-1], index.ends[1:]))]
    return [(-c, p) for c, p in sorted(every)[:k] if c < 0]


@pytest.mark.parametrize("block, dense", [(1, 0.0), (3, 0.02), (8, 0.03), (8, 1.0), (1000, 0.1)])
def test_any_layout_finds_the_same(block, dense):
    rng = random.Random(block)
    factor = np.array([rng.uniform(0.5, 4) for _ in range(2000)])
    draw = lambda size: Counter(
        int(rng.paretovariate(0.6)) % 2000 for _ in range(size))
    rows = [(i, i % 2, draw(rng.randint(1, 60))) for i in range(500)]
    rows += [(1000 + i, 1, rows[9][2]) for i in range(40)]  # ties
    index = toxicity.build_index(rows, factor, block, dense)
    for size in (1, 4, 30, 200):
        for _ in range(15):
            query = draw(size)
            got, want = index.nearest(query, 15), brute(index, query, 15)
            assert [p for _, p in got] == [p for _, p in want]
            assert np.allclose([c for c, _ in got], [c for c, _ in want])
    own = index.nearest(rows[3][2], 5, skip=3)
    assert 3 not in [p for _, p in own] and index.nearest(rows[3][2], 5)[0][0] > 0.999


def test_blocks_are_skipped():
    """Examples of many subjects: a text can only be near to those of its own."""
    rng = random.Random(2)
    factor = np.ones(40_000)
    rows = []
    for i in range(2000):
        subject = i // 20
        rows.append((i, i % 2, Counter(subject * 300 + rng.randrange(300) for _ in range(40))
                     + Counter(39_000 + rng.randrange(50) for _ in range(10))))
    index = toxicity.build_index(rows, factor, block=8)
    for i in range(0, 2000, 50):
        query = rows[i][2]
        got, want = index.nearest(query, 10), brute(index, query, 10)
        assert [p for _, p in got] == [p for _, p in want]
    assert index.skipped > 5 * index.opened


def test_sparse_lists_are_read_at_once():
    """Without subjects a block holds one posting of a list: there are no bounds to read before."""
    rng = random.Random(3)
    factor = np.array([rng.uniform(0.5, 4) for _ in range(40_000)])
    rows = [(i, i % 2, Counter(rng.randrange(39_000) for _ in range(40))
             + Counter(39_000 + rng.randrange(50) for _ in range(10))) for i in range(2000)]
    index = toxicity.build_index(rows, factor, block=8)
    assert not index.lists.bounded and not hasattr(index.lists, "entry_most")
    assert len(index.lists.places) == int((index.lists.row[index.terms] >= 0).sum()) > 70_000
    for i in range(0, 2000, 50):
        got, want = index.nearest(rows[i][2], 10, skip=i), brute(index, rows[i][2], 11)
        assert [p for _, p in got] == [p for _, p in want if p != i][:10]
    assert not index.skipped


def test_empty_index():
    index = toxicity.build_index([], np.ones(10))
    assert index.nearest(Counter({3: 1}), 5) == [] and index.nearest(Counter(), 5) == []
