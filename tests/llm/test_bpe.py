"""BPE against the tokenizers library."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyframe.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "Hello world", "", None, "  \t\n ", "it's THE dog's 123 4½ x² don't we'll",
    "<|startoftext|>Hi<|endoftext|> mid<|endoftext|>dle < |endoftext|>",
    "ΣΑΣ ΟΔΟΣ İstanbul ÀÉ été ﬁ", "naïve—café…  wide　 \x1c a\x1db \x85",
    "日本語テキスト と 한국어 emoji 😀👍🏽!!", "a" * 3000, "ab" * 700 + " " + "!" * 100,
    "THE!! erer*** %%% ## x​y ﻿", "aaaa aaaaa aaaaaaa banana bananana",
    "Ouwhea the of rend\nand threlyes " * 50, "́́ ͅ ǅ ß ẞ \U00010400",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_same_as_library(spark, library):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: r for r in bpe.encode(docs, PATH, decoded=True).collect()}
    for i, text in enumerate(TEXTS):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert list(got[i].ids) == ids, text
        assert got[i].decoded == library.decode(ids, skip_special_tokens=False), text


def test_documents(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r for r in bpe.token_digests(docs, PATH).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for row in rows:
        ids = library.encode(row.text or "", add_special_tokens=False).ids
        sha = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        text = library.decode(ids, skip_special_tokens=False).encode()
        assert (got[row.doc_id].n_tokens, got[row.doc_id].ids_sha256) == (len(ids), sha)
        assert got[row.doc_id].decoded_sha256 == hashlib.sha256(text).hexdigest()


def test_both_trees_agree(library):
    vocab = bpe.Vocabulary.read(PATH)
    rng = np.random.default_rng(3)
    letters = np.frombuffer(b"aehinorst", np.uint8)
    words = [rng.choice(letters, rng.integers(1, 60)).tobytes() for _ in range(300)]
    side = bpe.encode_pieces(vocab, words)
    for w in words:
        symbols = vocab.first[np.frombuffer(w, np.uint8)]
        symbols[-1] = vocab.last[w[-1]]
        ids = bpe.merge_one(vocab, symbols.tolist())
        assert np.frombuffer(side[w], np.int32).tolist() == ids
        assert ids == library.encode(w.decode(), add_special_tokens=False).ids


def test_decode_alone(spark):
    rows = spark.createDataFrame([(1, [320, 49407]), (2, []), (3, None)],
                                 "doc_id long, ids array<int>")
    got = dict(bpe.decode(rows, PATH).collect())
    assert got[1].endswith("<|endoftext|>") and got[2] == got[3] == ""


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(empty, PATH).collect() == []
    odd = spark.createDataFrame([(None, "hi", 1), (7, "hi", 2), (7, "hi", 2)],
                                "doc_id long, text string, ids int")
    got = bpe.encode(odd.withColumn("decoded", F.lit(1)), PATH).collect()
    assert len(got) == 3 and len({tuple(r.ids) for r in got}) == 1
