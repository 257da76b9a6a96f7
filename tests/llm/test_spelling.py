"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyframe.llm import spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def slow_words(rows, min_chars=7, min_count=2, drop_every=31):
    seen = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % drop_every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= min_chars and n >= min_count}


def slow_groups(words, ratio=10):
    """Pairs from equal texts after one deletion on either side, each checked."""
    where = {}
    for w in words:
        for key in {w} | {w[:i] + w[i + 1:] for i in range(len(w))}:
            where.setdefault(key, []).append(w)
    near = {w: set() for w in words}
    for group in where.values():
        for a in group:
            near[a].update(b for b in group if a != b and one_edit(a, b))
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        if best and words[best] >= ratio * words[w]:
            form[w] = best
    out = {}
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, words[w], len(near[w]), words.get(form.get(w)))
    return out


def fast(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("name", ["sf0.001", "sf0.01"])
def test_documents(spark, name):
    docs = spark.read.parquet(f"/root/testdata/{name}/documents.parquet")
    words = slow_words([(r.doc_id, r.text) for r in docs.collect()])
    want = slow_groups(words)
    assert fast(spelling.spelling_variants(docs)) == want
    assert any(v[0] for v in want.values())


@pytest.mark.parametrize("share", [0.0, 0.002, 0.2, 1e9])
def test_no_pair_is_lost(spark, share):
    rng = random.Random(int(share * 1000))
    words = set()
    for _ in range(60):
        word = "".join(rng.choice("abcé") for _ in range(rng.choice([7, 8, 9, 12, 140])))
        for _ in range(8):
            words.add(word)
            i, c = rng.randrange(len(word) + 1), rng.choice("abcéÿ")
            word = rng.choice([word[:i] + c + word[i:], word[:i] + c + word[i + 1:],
                               word[:i] + word[i + 1:] if len(word) > 7 else word])
    counts = {w: rng.choice([2, 2, 3, 30, 30, 400]) for w in words}
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert fast(spelling.spelling_groups(table, share=share)) == slow_groups(counts)


def test_every_edit_leaves_a_merged_list():
    rng = random.Random(5)
    for _ in range(3000):
        word = "".join(rng.choice("abc") for _ in range(rng.randrange(7, 12)))
        dictionary = {a + b + c: 1 for a in "abc" for b in "abc" for c in "abc"
                      if hash((a + b, _)) % 2}
        i, c = rng.randrange(len(word) + 1), rng.choice("abcd")
        for other in (word[:i] + c + word[i:], word[:i] + c + word[i + 1:]):
            if other != word and len(other) >= 7:
                assert set(spelling.keys(word, dictionary)[1]) & set(
                    spelling.keys(other, dictionary)[0])


def test_every_word_has_two_grams_that_no_edit_affects():
    for size in range(spelling.SHORTEST, 15):
        word = "".join(chr(97 + i) for i in range(size))
        for kind in range(2 ** (size - 1)):
            dictionary = {word[i:i + 3]: 1 for i in range(size - 1) if kind >> i & 1}
            assert len(spelling.keys(word, dictionary)[1]) == 6


def test_edges(spark):
    long = "abcdefgh" * 250
    rows = [(1, "Receive RECEIVE receive. " * 20, 0), (2, None, 0), (3, "", 0), (None, "recieve", 0),
            (4, "receeive receeive ÉTUDIANT Étudiant étudiants", 0), (4, "receeive receeive", 0),
            (5, f"{long} {long} {long}x {long}x", 0), (6, "1234567 short ×÷×÷"
                                                       "×÷× " * 2, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int").withColumns(
        {"word": F.lit("x"), "key": F.lit(1)})
    want = slow_groups(slow_words([r[:2] for r in rows]))
    got = fast(spelling.spelling_variants(docs))
    assert got == want and got["receeive"][0] == "receive" and got[long][3] == 1
    assert spelling.spelling_variants(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        spelling.spelling_groups(spark.createDataFrame([("short", 3)], "word string, n long"))


def test_parity_passes_every_edit(spark):
    """One edit changes two bits at most, and the join asks for that before it compares letters."""
    rng = random.Random(31)
    letters = "abcdefghijklmnopqrstuvwxyzàéößÿÉ"
    for _ in range(3000):
        word = "".join(rng.choice(letters) for _ in range(rng.randint(7, 20)))
        at = rng.randrange(len(word))
        for edited in (word[:at] + word[at + 1:], word[:at] + rng.choice(letters) + word[at:],
                       word[:at] + rng.choice(letters) + word[at + 1:]):
            assert 0 <= spelling.parity(edited) < 1 << 31
            assert bin(spelling.parity(word) ^ spelling.parity(edited)).count("1") <= 2
    words = spark.createDataFrame([("letters", 5), ("lettérs", 3), ("setters", 2), ("strings", 1)],
                                  "word string, n long")
    near = spelling.near_words(words)
    assert {(r.word, r.other) for r in near.collect()} == {
        ("letters", "lettérs"), ("lettérs", "letters"), ("letters", "setters"), ("setters", "letters")}
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    plan = near._jdf.queryExecution().explainString(mode)
    assert 0 < plan.index("bit_count") < plan.index("levenshtein")
