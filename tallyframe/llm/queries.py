"""Registered queries of the subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import (
    bpe,
    htmltext,
    infill,
    langid,
    linededup,
    mixing,
    neighbours,
    quality,
    setjoin,
    simhash,
    spelling,
    toxicity,
    warc,
)
from tallyframe.session import new_path

VOCABULARY = "word_bpe_49k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_quality_rules(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.quality_rules(docs, labels)


@query
def op2_line_dedup(spark, sf_dir):
    docs = linededup.dedup_lines(table(spark, sf_dir, "documents"), min_words=50)
    return docs.select("doc_id", "text", docs["__n_lines"].alias("n_lines"),
                       docs["__n_deleted"].alias("n_deleted"))


ORACLES["op2_line_dedup"] = linededup.SQL


@query
def op3_mixing_weights(spark, sf_dir):
    return mixing.mixing_weights(table(spark, sf_dir, "documents"), keep=0.5)


@query
def op4_nearest_neighbours(spark, sf_dir):
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


ORACLES["op4_nearest_neighbours"] = neighbours.SQL


@query
def op5_warc(spark, sf_dir):
    path = new_path(spark, "archive")
    warc.write_archive(table(spark, sf_dir, "pages"), path, min_bytes=0)
    return warc.read_archive(spark, path).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op5_warc"] = warc.SQL


@query
def op6_simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_distance=2)


@query
def op7_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return bpe.token_digests(docs, public_tokenizers.path(VOCABULARY))


@query
def op8_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.toxicity(docs, labels)


@query
def op10_language_id(spark, sf_dir):
    return langid.language_id(table(spark, sf_dir, "documents"))


@query
def op9_html_text(spark, sf_dir):
    return htmltext.main_text(table(spark, sf_dir, "pages"))


@query
def op12_fill_in_middle(spark, sf_dir):
    return infill.digests(table(spark, sf_dir, "documents"), rate=100, spm=50, seed=7)


ORACLES["op12_fill_in_middle"] = infill.SQL


@query
def op13_spelling_variants(spark, sf_dir):
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


@query
def op11_jaccard_join(spark, sf_dir):
    return setjoin.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=90)


ORACLES["op11_jaccard_join"] = setjoin.SQL
