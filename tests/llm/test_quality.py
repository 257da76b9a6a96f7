"""Quality rules against brute force."""

import math
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from tallyframe.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
B = 1 << 16


def slow_base(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1
               for k in range(8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""),
            len(lines) - len(set(lines)), len(covered), failed)


def slow_grams(text):
    ends = [w[-2:] for w in WORD.findall(text or "")]
    out = []
    for a, b in zip(ends, ends[1:]):
        out.append(xxhash.xxh64_intdigest(b.encode(), xxhash.xxh64_intdigest(a.encode(), 42)))
    return [(h - (1 << 64) if h >> 63 else h) % B for h in out]


def base(row):
    return (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words,
            row.base_failed)


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = {r.doc_id: r for r in quality.quality_rules(docs, labels).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    assert len(got) == len(texts)
    raw = Counter(g for t in texts.values() for g in slow_grams(t))
    target = Counter(g for i in good if i in texts for g in slow_grams(texts[i]))
    share = sum(target.values()) / sum(raw.values())
    for i, text in texts.items():
        assert base(got[i]) == slow_base(text), i
        grams = slow_grams(text)
        score = sum(math.log((target[g] + 1) / (raw[g] * share + 1)) for g in grams)
        score /= len(grams) + 16
        assert got[i].score == pytest.approx(score, abs=1e-9)
        assert got[i].kept == (not got[i].base_failed and got[i].score >= -0.15)


def test_tells_junk(spark, sf_dir):
    where = sf_dir.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{where}/documents.parquet")
    labels = spark.read.parquet(f"{where}/labels.parquet")
    found = quality.quality_rules(docs, labels).join(labels, "doc_id").collect()
    bad = [r.kept for r in found if r.quality == 0]
    good = [r.kept for r in found if r.quality == 1 and not r.base_failed]
    assert sum(bad) / len(bad) < 0.02 and sum(good) / len(good) > 0.98


def test_edges(spark):
    texts = [None, "", " \n\t", "a " * 9, "one", "x y z\n" * 3 + "\n \n", "# * $ <>|&%",
             "\x0b\x0cé\x85ö ñ", ("a b c d e f g h i " * 2500), "w" * 100_000,
             " ".join(f"w{i}" for i in range(30)) + " w0 w1 w2 w3 w4 w5 w6 w7"]
    rows = [(i if i else None, t, 1) for i, t in enumerate(texts)] + [(4, "one", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int").withColumn(
        "words", F.lit("x"))
    labels = spark.createDataFrame([(4, 1, 0), (None, 1, 0), (99, 1, 1), (5, None, None)],
                                   "doc_id long, quality int, toxic int")
    got = quality.quality_rules(docs, labels).collect()
    assert sorted(map(base, got)) == sorted(slow_base(r[1]) for r in rows)
    assert quality.quality_rules(docs.limit(0), labels).collect() == []
    assert len(quality.quality_rules(docs, labels.limit(0)).collect()) == len(rows)
