"""Fill-in-middle against plain Python, with exact round trips."""

import hashlib
import re

import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyframe.llm import infill


def slow(doc_id, text, rate=100, spm=50, seed=7, marks=("<P>", "<S>", "<M>")):
    name = "" if doc_id is None else doc_id
    h = hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(lines)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not text or any(x in text for x in marks) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    if h4 % 100 < spm:
        return n, "spm", len(p), len(m), marks[1] + s + marks[0] + p + marks[2] + m
    return n, "psm", len(p), len(m), marks[0] + p + marks[1] + s + marks[2] + m


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    made = infill.restore(infill.fill_in_middle(docs)).collect()
    assert len(made) == len(rows) and len({r.form for r in made}) > 1
    for r in made:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == slow(
            r.doc_id, rows[r.doc_id])
        assert r.restored == (rows[r.doc_id] or "")
    got = {r.doc_id: r for r in infill.digests(docs).collect()}
    for r in made:
        assert got[r.doc_id].output_sha256 == hashlib.sha256(r.output.encode()).hexdigest()
        assert got[r.doc_id].restored_sha256 == hashlib.sha256(r.restored.encode()).hexdigest()


@given(st.lists(st.text(alphabet="ab\n<PSM>é \r\x00", max_size=20), min_size=1, max_size=9),
       st.lists(st.integers(0, 2**32 - 1), min_size=4, max_size=4))
def test_round_trip(texts, h):
    draws = [pa.array([x] * len(texts)) for x in h]
    n, form, _, _, output = infill.rearranged(pa.array(texts), draws, 100, 50)
    assert infill.rebuilt(output, form).to_pylist() == texts
    assert n.to_pylist() == [len(re.findall(r"[^\n]*\n|[^\n]+", t)) for t in texts]


def test_edges(spark):
    long = "a line of words\n" * 40_000
    rows = [(1, None, 1), (2, "", 1), (3, "\n", 1), (4, "\n\n\nno end", 1), (5, "a<S>b\nc", 1),
            (None, "one\ntwo\nthree", 1), (6, "é\nü\r\nß", 1), (6, "é\nü\r\nß", 1), (7, long, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int").withColumns(
        {"output": F.lit("x"), "form": F.lit(1), "h1": F.lit(2)})
    got = infill.restore(infill.fill_in_middle(docs)).collect()
    want = sorted((str((i, *slow(i, t))), t or "") for i, t, _ in rows)
    assert sorted((str(tuple(r)[:-1]), r.restored) for r in got) == want
    assert infill.restore(infill.fill_in_middle(docs.limit(0))).collect() == []
    other = infill.fill_in_middle(docs, rate=40, spm=0, seed=3, marks=("[p", "[s", "[m")).collect()
    assert sorted(str(tuple(r)) for r in other) == sorted(
        str((i, *slow(i, t, 40, 0, 3, ("[p", "[s", "[m")))) for i, t, _ in rows)


def test_slices_bound_what_is_held():
    batch = pa.record_batch({"text": ["aaaa", None, "bbbb", "cccc", "d" * 50, "", "e"]})
    parts = [p.column(0).to_pylist() for p in infill.slices(batch, 0, 10)]
    assert parts == [["aaaa", None, "bbbb"], ["cccc"], ["d" * 50], ["", "e"]]


def test_marks_must_be_told_apart(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for marks in (("<P>", "P>", "<M>"), ("", "a", "b"), ("ab", "bc", "x"), ("aa", "b", "c"),
                  ("a", "a", "b")):
        with pytest.raises(ValueError):
            infill.fill_in_middle(docs, marks=marks)
