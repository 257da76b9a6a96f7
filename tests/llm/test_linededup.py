"""Line dedup against the definition: longest earlier match of every line."""

import random

from pyspark.sql import functions as F

from tallyframe.llm import linededup


def slow_dedup(docs, min_words):
    """Texts by (id, text) of distinct rows: every run that occurs earlier and is long enough goes."""
    order = sorted({(i, t or "") for i, t in docs}, key=lambda d: (d[0] is not None, d[0] or 0))
    lines, places = [], []
    for d, (_, text) in enumerate(order):
        for n, line in enumerate(text.split("\n")):
            if line.split():
                lines.append((d, line))
                places.append((d, n))
    gone = set()
    for i in range(len(lines)):
        for j in range(i):
            k = words = 0
            while (i + k < len(lines) and lines[i + k][1] == lines[j + k][1]
                   and lines[i + k][0] == lines[i][0] and lines[j + k][0] == lines[j][0]):
                words += len(lines[i + k][1].split())
                k += 1
            if words >= min_words:
                gone.update(places[i:i + k])
    return {doc: "\n".join(x for n, x in enumerate(doc[1].split("\n")) if (d, n) not in gone)
            for d, doc in enumerate(order)}


def test_random_documents(spark):
    rng = random.Random(5)
    alphabet = [" ".join(rng.choices("abc", k=rng.randint(1, 6))) for _ in range(5)] + ["", " "]
    docs = []
    for i in range(40):
        lines = [rng.choice(alphabet) for _ in range(rng.randint(1, 25))]
        if docs and rng.random() < 0.5:
            other = rng.choice(docs)[1].split("\n")
            at = rng.randrange(len(other))
            lines[rng.randrange(len(lines)):0] = other[at:at + rng.randint(1, 12)]
        docs.append((i, "\n".join(lines)))
    for min_words in (1, 7, 20):
        want = slow_dedup(docs, min_words)
        got = linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"),
                                    min_words).collect()
        assert {(r.doc_id, dict(docs)[r.doc_id]): r.text for r in got} == want


def test_long_run_and_ranks(spark):
    body = "\n".join(f"line number {i} of a long passage" for i in range(300))
    docs = spark.createDataFrame([(2, "intro\n" + body + "\nend"), (1, body), (3, body)],
                                 "doc_id long, text string")
    got = {r.doc_id: r for r in linededup.dedup_lines(docs).collect()}
    assert got[1].text == body and got[3].text == "" and got[2].text == "intro\nend"
    assert got[2]["__n_deleted"] == 300 and got[2]["__n_lines"] == 302


def test_ranks_are_an_order(spark):
    rng = random.Random(1)
    keys = sorted({(rng.randrange(3), rng.randrange(50)) for _ in range(60)})
    counts = [rng.randint(1, 4) for _ in keys]
    rows = [(b * 1000, k, n) for (b, k), n in zip(keys, counts)]
    pairs = spark.createDataFrame(rows, "base long, key long, n long")
    got = {(r.base, r.key): r["rank"] for r in linededup.ranked(
        pairs, ["key"], F.floor(F.col("key") / 7)).collect()}
    assert got == {(b, k): b + sum(n for c, j, n in rows if c == b and j < k) for b, k, _ in rows}


def test_edges(spark):
    passage = "\n".join(" ".join(f"w{i}{j}" for j in range(12)) for i in range(5))
    rows = [(None, passage, 1), (1, None, 1), (2, "", 1), (3, passage, 1), (3, passage, 1),
            (3, passage + "\ntail", 1), (4, "\n\n" + passage + "\n \nrest", 1), (5, "short", 1),
            (6, "short", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").withColumn(
        "th", F.lit(1)).withColumn("i", F.lit(2))
    out = linededup.dedup_lines(docs)
    assert out.columns == [*docs.columns, "__n_lines", "__n_deleted"]
    got = sorted(((r.doc_id or 0, r.text, r.n_chars) for r in out.collect()), key=str)
    assert got == sorted([(0, passage, 1), (1, None, 1), (2, "", 1), (3, "", 0), (3, "", 0),
                          (3, "tail", 4), (4, "\n\n \nrest", 8), (5, "short", 1),
                          (6, "short", 1)], key=str)
    assert linededup.dedup_lines(docs.limit(0)).collect() == []
