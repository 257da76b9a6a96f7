"""Jaccard join against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import setjoin


def slow_set(text, shingle=3):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(c, " ")
    words = [w for w in lowered.split(" ") if w]
    count = max(1, len(words) - shingle + 1) if words else 0
    return {tuple(words[i:i + shingle]) for i in range(count)}


def slow_groups(rows, percent=90, shingle=3):
    """``n, component`` of each row of ``id, text`` by flooding over all pairs that share a shingle."""
    sets = [slow_set(t, shingle) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders, pairs = {}, set()
    for i, own in enumerate(sets):
        for s in own:
            pairs.update((j, i) for j in holders.setdefault(s, []))
            holders[s].append(i)
    for i, j in pairs:
        both = len(sets[i] & sets[j])
        if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            root[find(j)] = find(i)
    best = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            best[find(i)] = min(best.get(find(i), doc_id), doc_id)
    return [(len(own), best.get(find(i))) for i, own in enumerate(sets)]


def near_copies(rng, groups, copies, words, edits):
    rows = []
    for _ in range(groups):
        base = [rng.choice("abcdefghijkl") * rng.randrange(1, 9) for _ in range(words())]
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randrange(edits(len(base)) + 1)):
                own[rng.randrange(len(own))] = f"edit{rng.randrange(10**6)}"
            rows.append(" ".join(own))
            if rng.random() < 0.3:
                base = own  # chains: the ends need not link directly
    rng.shuffle(rows)
    return list(enumerate(rows))


def check(spark, rows, percent=90, **limits):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in setjoin.near_duplicates(
        docs, percent=percent, **limits).collect()}
    want = dict(zip((i for i, _ in rows), slow_groups(rows, percent)))
    assert got == want
    return want


def test_documents(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", "text").collect()]
    want = check(spark, rows)
    assert len({c for _, c in want.values()}) < len(rows)


@pytest.mark.parametrize("percent", [50, 80, 90, 95, 100])
def test_no_link_is_lost(spark, percent):
    rng = random.Random(percent)
    rows = near_copies(rng, 25, 12, lambda: rng.choice([3, 5, 9, 11, 12, 14, 30, 100, 400]),
                       lambda n: max(1, n // 25))
    check(spark, rows, percent)


@pytest.mark.parametrize("limits", [{"points": 7, "centres": 2}, {"shingles": 300, "centres": 1},
                                    {"points": 5, "centres": 0}])
def test_large_groups_are_dealt_into_pieces(spark, limits):
    rng = random.Random(3)
    rows = near_copies(rng, 3, 60, lambda: 60, lambda n: 3)
    want = check(spark, rows, **limits)
    assert len({c for _, c in want.values()}) > 3


@pytest.mark.parametrize("most", [0, 10_000])
def test_components_in_one_task_and_in_rounds(spark, most):
    rng = random.Random(most)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    pairs += [(i, i + 1) for i in range(1000, 1040)] + [(2000 + i, 2000) for i in range(1, 40)]
    edges = spark.createDataFrame([p for p in pairs if p[0] != p[1]], "a long, b long")
    got = {r.node: r.root for r in setjoin.roots_of(edges, most).collect()}
    want = {i: i for p in pairs if p[0] != p[1] for i in p}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            if a != b and want[a] != want[b]:
                want[a] = want[b] = min(want[a], want[b])
                changed = True
    assert got == want
    assert setjoin.roots_of(edges.limit(0), most).collect() == []


def test_linked_sets_share_a_part():
    rng = np.random.default_rng(1)
    for _ in range(400):
        size = int(rng.choice([1, 5, 9, 10, 11, 13, 40, 300]))
        own = rng.integers(0, 2**63, size, dtype=np.uint64)
        percent = int(rng.choice([40, 80, 90]))
        least = setjoin.need(2 * size, percent)
        keep = int(rng.integers(least, size + 1))
        extra = rng.integers(0, 2**63, int(rng.integers(0, size - keep + 1)), dtype=np.uint64)
        other = np.concatenate([own[:keep], extra])
        if 100 * keep >= percent * (size + len(other) - keep) and keep < max(size, len(other)):
            assert set(setjoin.part_names(own, percent)) & set(setjoin.part_names(other, percent))


@pytest.mark.parametrize("turns", [1, 2, 4])
def test_linked_sets_share_a_part_when_few_parts_hold_their_shingles(monkeypatch, turns):
    monkeypatch.setattr(setjoin, "TURNS", turns)
    rng = np.random.default_rng(turns)
    for _ in range(400):
        size = int(rng.choice([10, 11, 12, 16, 20, 25, 31, 38]))
        crowded = rng.integers(0, 2**40, 2 * size, dtype=np.uint64) * np.uint64(2520)
        other = rng.permutation(crowded[:size])
        edits = int(rng.integers(0, (size + 18) // 19 + 1))
        other[:edits] = crowded[size:size + edits]
        if 100 * (size - edits) >= 90 * (size + edits):
            assert set(setjoin.part_names(crowded[:size], 90)) & set(setjoin.part_names(other, 90))


def test_unrelated_sets_share_hardly_a_part():
    """Not in empty parts, nor in parts that hold a common shingle or two alone."""
    rng = np.random.default_rng(4)
    common = rng.integers(0, 2**63, 40, dtype=np.uint64)
    holders = {}
    for i in range(4000):
        size = int(rng.integers(100, 500))
        own = np.concatenate([common, rng.integers(0, 2**63, size, dtype=np.uint64)])
        for name in set(setjoin.part_names(own, 90).tolist()):
            holders.setdefault(name, set()).add(i)
    gathered = set().union(*(x for x in holders.values() if len(x) > 1))
    assert len(gathered) < 40


def test_trees_prune_and_lose_nothing():
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.poisson(lam, (150, setjoin.GROUPS)) for lam in (1, 2, 5)])
    points[200:230] = points[7] + rng.poisson(0.02, (30, setjoin.GROUPS))
    tree = setjoin.Tree(points)
    opened, found = 0, set()
    for a, b, near in setjoin.close_pairs(tree, tree, 90, True):
        opened += near.size
        found |= {frozenset((a[i], b[j])) for i, j in zip(*np.nonzero(near))}
    sizes = points.sum(axis=1)
    want = {frozenset((i, j)) for i in range(len(points)) for j in range(i, len(points))
            if np.minimum(points[i], points[j]).sum() >= setjoin.need(sizes[i] + sizes[j], 90)}
    assert found == want
    assert opened < len(points) ** 2 / 4


def test_edges(spark):
    long = "word " * 5 + " ".join(f"w{i}" for i in range(30_000))
    rows = [(5, None), (3, ""), (9, " \n"), (None, "A b c d"), (7, "a b c d"), (7, "a b c d"),
            (None, "lonely text of its own"), (8, long), (2, long + " end"), (1, "two words"),
            (6, "TWO words"), (4, "a b c e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {n: F.lit(1) for n in ("id", "th", "n", "c", "name", "parts", "root")})
    got = sorted((str(tuple(r)) for r in setjoin.near_duplicates(docs).collect()))
    want = slow_groups(rows)
    assert got == sorted(str((i, n, c)) for (i, _), (n, c) in zip(rows, want))
    assert setjoin.near_duplicates(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        setjoin.near_duplicates(docs, percent=0)
