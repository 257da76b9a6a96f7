"""Every stage of the pipeline against the operators' own brute-force checks on its input."""

import sys

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tallyframe.llm import mixing, toxicity

sys.path.insert(0, __file__.rsplit("/", 1)[0])

from test_linededup import slow_dedup  # noqa: E402
from test_simhash import slow_components, slow_fingerprint  # noqa: E402


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        out[name] = (before, {r.doc_id: r for r in docs.collect()})
        if name != "bpe":
            assert docs.columns == before.columns
    before, after = out["toxicity"]
    gone = {r.doc_id for r in toxicity.toxicity(before, labels).where("predicted = 1").collect()}
    assert set(after) == {r.doc_id for r in before.collect()} - gone
    before, after = out["line_dedup"]
    want = slow_dedup([(r.doc_id, r.text) for r in before.collect()], 50)
    assert {i: r.text for i, r in after.items()} == {i: t for (i, _), t in want.items()}
    assert all(r.n_chars == len(r.text) for r in after.values())
    before, after = out["near_dedup"]
    fps = [(r.doc_id, slow_fingerprint(r.text)) for r in before.collect()]
    assert set(after) == set(slow_components(fps, 2).values())
    before, after = out["mixing"]
    kept = {r.doc_id for r in mixing.mixing_weights(before, keep=0.5).collect() if r.kept}
    assert set(after) == kept
    before, after = out["bpe"]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for row in before.collect():
        ids = library.encode(row.text or "", add_special_tokens=False).ids
        assert list(after[row.doc_id].ids) == ids and after[row.doc_id].n_tokens == len(ids)
    ran = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id: r for r in ran.collect()} == after


def odd_tables(spark, path):
    """Nulls in every column, an empty and a long text, repeated rows and ids, clashing names."""
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text, "en", "a", 5), (1, text, "en", "a", 5), (1, "other text here", "de", None, 1),
            (None, None, None, None, None), (None, text, "en", "b", 2), (2, "", "en", "a", 0),
            (3, "wonderful word " * 40_000, "en", "a", 9), (4, "line one\n" * 30, None, "b", 3),
            (5, text + "\n" + text, "en", "a", 7)]
    rows += [(10 + i, f"a text of its own, number {i}", "en", "a", i) for i in range(13)]
    docs = spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("score", "fp", "topic", "factor", "h1", "w", "n_tokens"):
        docs = docs.withColumn(name, F.lit(1))
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(10, 1, 0), (11, 0, 1), (None, 1, 1), (12, None, None)],
                          "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return rows


def test_pipeline_on_odd_tables(spark, tmp_path):
    path = str(tmp_path / "odd")
    rows = odd_tables(spark, path)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        assert name == "bpe" or docs.columns == names
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert 0 < docs.count() <= len(rows)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/mixing").collect()}
    for r in docs.collect():
        assert list(r.ids) == library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids


def test_pipeline_tokenizes_each_row_of_a_repeated_id(spark, tmp_path):
    """Rows that share an id but not a text each keep their own tokens."""
    path = str(tmp_path / "odd")
    odd_tables(spark, path)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((str(r.doc_id), library.encode(r.text or "", add_special_tokens=False).ids)
                  for r in docs.collect())
    got = dict(corpus_pipeline.STAGES)["bpe"](spark, docs, path).collect()
    assert sorted((str(r.doc_id), list(r.ids)) for r in got) == want


def test_pipeline_on_empty_tables(spark, tmp_path):
    path = str(tmp_path / "empty")
    odd_tables(spark, str(tmp_path / "odd"))
    for name in ("documents", "labels"):
        spark.read.parquet(f"{tmp_path}/odd/{name}.parquet").limit(0).write.parquet(
            f"{path}/{name}.parquet")
    assert corpus_pipeline.run(spark, path).collect() == []
