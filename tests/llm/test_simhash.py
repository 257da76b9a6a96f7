"""SimHash near-dedup against brute force."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from tallyframe.llm import simhash


def slow_fingerprint(text, shingle=3):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(c, " ")
    words = [w for w in lowered.split(" ") if w]
    if not words:
        return 0
    parts = [" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(pairs, limit):
    """Root of every (id, fingerprint) by flooding over all pairs."""
    root = {i: i for i, _ in pairs}
    changed = True
    while changed:
        changed = False
        for i, a in pairs:
            for j, b in pairs:
                if (a ^ b).bit_count() <= limit and root[j] < root[i]:
                    root[i], changed = root[j], True
    return root


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.collect()
    fps = [(r.doc_id, slow_fingerprint(r.text)) for r in rows]
    want = {i: (f"{f:016x}", c) for (i, f), c in zip(fps, slow_components(fps, 2).values())}
    got = {r.doc_id: (r.fingerprint, r.component_id)
           for r in simhash.near_duplicates(docs).collect()}
    assert got == want and len(set(c for _, c in want.values())) < len(want)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {c for _, c in want.values()}


@pytest.mark.parametrize("limit", [0, 1, 2, 3])
def test_links_lose_nothing(spark, limit):
    rng = random.Random(limit)
    values = set()
    for _ in range(12):
        value = rng.getrandbits(64)
        for _ in range(8):
            values.add(value)
            for b in rng.sample(range(64), rng.choice([1, 1, 2, 3, 4])):
                value ^= 1 << b
    signed = [v - (1 << 64) if v >> 63 else v for v in sorted(values)]
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    edges = [tuple(r) for r in simhash.links(fps, limit).collect()]
    mask = (1 << 64) - 1
    assert all(((a & mask) ^ (b & mask)).bit_count() <= limit for a, b in edges)
    found = {r.node: r.root for r in simhash.components(
        spark.createDataFrame(edges or [(0, 0)], "a long, b long")).collect()}
    want = slow_components([(v, v & mask) for v in signed], limit)
    assert {v: found.get(v, v) for v in signed} == want


def test_edges(spark):
    rows = [(5, None, 1), (3, "", 1), (9, " \n", 1), (None, "a b c d", 1), (7, "A b c d", 1),
            (7, "A b c d", 1), (None, "lonely text of its own", 1), (8, "x " * 50_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int").withColumn(
        "component_id", F.lit(1)).withColumn("root", F.lit(2))
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got if r.doc_id}
    assert by_id[5].fingerprint == "0" * 16 and by_id[5].component_id == 3 == by_id[9].component_id
    assert {r.component_id for r in got if r.fingerprint == by_id[7].fingerprint} == {7}
    assert simhash.near_duplicates(docs.limit(0)).collect() == []
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [3, 7, 7, 8]


def test_one_row_of_each_group(spark):
    one, two = "alpha beta gamma delta epsilon", "one two three four five six seven"
    rows = [(7, one, "a"), (7, one, "a"), (7, one, "b"), (None, one, "c"), (9, one, "d"),
            (5, two, "e"), (9, two + " other eight nine ten", "f"), (8, two, "g"),
            (None, "rain snow wind sun fog", "h"), (None, "rain snow wind sun fog", "h"),
            (None, "cat dog cow hen pig", "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tag string").withColumn(
        "m", F.create_map(F.lit("x"), "tag"))
    groups = {r.fingerprint for r in simhash.near_duplicates(docs).collect()}
    assert len(groups) == 5
    kept = simhash.keep_one(docs, repeats=False)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id or 0, r.text) for r in kept.collect())
    assert got == sorted([(7, one), (5, two), (9, two + " other eight nine ten"),
                          (0, "rain snow wind sun fog"), (0, "cat dog cow hen pig")])
    # By default rows that repeat the document itself stay, and no other row of the group.
    every = simhash.keep_one(docs).collect()
    assert len(every) == 3 + 1 + 1 + 2 + 1
