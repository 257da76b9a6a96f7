"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import stored
from tallyframe.llm.graph import components

#: Row v holds the bits of the byte v, lowest first.
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
BYTE_BASE = np.arange(8) * 256


def fingerprint(text: bytes | None, shingle: int) -> int:
    """64 majority bits of the XXH64 (seed 42) of all word shingles, as a signed number."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(joined)]
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(joined, 42)]
    else:
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1:])]
    packed = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    seen = np.bincount((packed + BYTE_BASE).ravel(), minlength=2048).reshape(8, 256)
    ones = (seen @ BITS).ravel()
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id, text_hash, fp`` of whole texts, one row per input row. Null, empty and blank texts
    have the fingerprint zero. Texts go to Python once, in Arrow batches; no other column travels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            fps = [fingerprint(t.as_py(), shingle) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(fps, pa.int64())],
                names=["doc_id", "text_hash", "fp"])

    rows = docs.select(*_key(), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


def _key() -> tuple[Column, Column]:
    """What tells documents apart: the id, which may be null or given twice, and the whole text."""
    return (F.col("doc_id").cast("long").alias("doc_id"),
            F.xxhash64(F.col("text").cast("string")).alias("text_hash"))


def _masks(radius: int) -> list[int]:
    """All 64-bit masks with at most ``radius`` ones, as signed numbers."""
    found = [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(64), r)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def links(fps: DataFrame, max_distance: int) -> DataFrame:
    """Edges ``a, b`` between distinct fingerprints ``fp`` whose components are those of all pairs
    at most ``max_distance`` bits apart.

    Each fingerprint is sent to every variant within half the distance (rounded up). Two
    fingerprints that are close enough meet at a variant between them, where at least one of them
    is within half the distance rounded down. That one can be the bucket's centre: it is within the
    limit of everything in the bucket, so a star around the smallest such centre loses no link and
    makes no false one. A bucket is a ball of 64-bit numbers, hence bounded. Collisions are
    deduplicated and their distance is verified.
    """
    near, far = max_distance // 2, (max_distance + 1) // 2
    masks = F.array(*[F.lit(m) for m in _masks(far)])
    variants = fps.select("fp", F.explode(F.transform(masks, lambda m: m.bitwiseXOR(F.col("fp")))
                                          ).alias("variant"))
    close = F.bit_count(F.col("fp").bitwiseXOR(F.col("variant"))) <= near
    buckets = variants.groupBy("variant").agg(
        F.min(F.when(close, F.col("fp"))).alias("a"), F.collect_list("fp").alias("bs")
    ).where((F.size("bs") > 1) & F.col("a").isNotNull())
    pairs = buckets.select("a", F.explode("bs").alias("b")).where("a <> b").distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance)


def near_duplicates(docs: DataFrame, shingle: int = 3, max_distance: int = 2) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``.

    Texts are lower-cased in A-Z and cut into words ``[^\\x20\\x09-\\x0D]+`` and shingles of
    ``shingle`` words (a shorter text is one shingle); a bit is set if over half of all shingle
    hashes set it. Documents link at ``max_distance`` or fewer differing bits; ``component_id`` is
    the smallest ``doc_id`` reachable.

    * Null, empty and blank texts: fingerprint zero, linked like any other.
    * Null ``doc_id``: kept; its component is named by the smallest known id in it, null if none.
    * Repeated rows and ties: each row is returned; equal fingerprints are one class.
    * Empty table: empty result. Other columns are ignored, whatever they are called.

    Linking runs on distinct fingerprints, so exact copies cost one row however many there are.
    """
    return _grouped(docs, shingle, max_distance).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("best.doc_id").alias("component_id"))


def _grouped(docs: DataFrame, shingle: int, max_distance: int) -> DataFrame:
    """``doc_id, text_hash, fp, best`` for every row: ``best`` is the key of the document that stands
    for the component, the one with the smallest id, nulls last, then the smallest text hash."""
    fps = stored(fingerprints(docs, shingle), "fingerprints")
    key = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    classes = stored(fps.groupBy("fp").agg(F.min(key).alias("rep")), "classes")
    linked = components(links(classes.select("fp"), max_distance))
    rooted = classes.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "rep", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("rep").alias("best"))
    named = stored(rooted.join(names, "root").select("fp", "best"), "components")
    return fps.join(named, "fp").select("doc_id", "text_hash", "fp", "best")


def keep_one(docs: DataFrame, shingle: int = 3, max_distance: int = 2, repeats: bool = True
             ) -> DataFrame:
    """The document that stands for each component, with all its columns: the one with the smallest
    id, nulls last, then the smallest text hash. Rows that share an id but differ in text are
    different documents. Of rows that repeat it, id and text alike, all stay, or with ``repeats``
    false the one with the smallest hash of its columns."""
    found = stored(_grouped(docs, shingle, max_distance), "grouped")
    first = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (
        F.col("text_hash") == F.col("best.text_hash"))
    names = F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")
    doc_id, text_hash = _key()

    def among(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        keyed = rows.withColumns({"__own_id": doc_id, "__own_hash": text_hash})
        return keyed.join(keys, F.col("__own_id").eqNullSafe(F.col("__id")) & (
            F.col("__own_hash") == F.col("__hash")), how).drop("__own_id", "__own_hash")

    kept = among(docs, found.where(~first).select(*names).distinct(), "left_anti")
    again = found.where(first).groupBy(*names).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    if repeats or again.isEmpty():
        return kept
    again = stored(again, "repeated")
    plain = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = among(docs, again, "left_semi").groupBy(doc_id.alias("__id"), text_hash.alias("__hash")
                                                  ).agg(F.min_by(row, F.xxhash64(*plain)).alias("r"))
    return among(kept, again, "left_anti").union(one.select("r.*"))
