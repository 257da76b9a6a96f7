"""Fill-in-middle: texts cut at unit borders and rearranged around sentinels, with pyarrow.compute."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import slices

#: Marks of prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
SLICE_BYTES = 16 << 20  # rows of a batch that are worked on together
TEXT = pa.large_string()
NOTHING = pa.scalar("", TEXT)
PIECES = "n long, form string, prefix_chars long, middle_chars long, output string"


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from the SHA-256 of ``seed:doc_id``; a null id counts as empty."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    digest = F.sha2(name.cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _modulo(value: pa.Array, by) -> pa.Array:
    return pc.subtract(value, pc.multiply(pc.divide(value, by), by))


def _lists(lengths: pa.Array, values: pa.Array) -> pa.LargeListArray:
    ends = np.cumsum(lengths.to_numpy(zero_copy_only=False))
    return pa.LargeListArray.from_arrays(pa.array(np.append(0, ends), pa.int64()), values)


def units(texts: pa.Array) -> pa.LargeListArray:
    """The lines of each text, with their line ends; an empty text has none."""
    parts = pc.split_pattern(texts, "\n")
    sizes = pc.cast(pc.list_value_length(parts), pa.int64())
    flat, parents = pc.list_flatten(parts), pc.list_parent_indices(parts)
    ends = np.cumsum(sizes.to_numpy(zero_copy_only=False))
    last = np.zeros(len(flat), bool)
    last[ends - 1] = True
    last = pa.array(last)
    lines = pc.binary_join_element_wise(flat, pc.if_else(last, NOTHING, pa.scalar("\n", TEXT)),
                                        NOTHING)
    some = pc.not_equal(pc.binary_length(lines), 0)
    counts = np.bincount(pc.filter(parents, some).to_numpy(zero_copy_only=False),
                         minlength=len(texts))
    return _lists(pa.array(counts), pc.filter(lines, some))


def rearranged(texts: pa.Array, h: list[pa.Array], rate: int, spm: int,
               marks: tuple[str, str, str] = SENTINELS) -> list[pa.Array]:
    """``n, form, prefix_chars, middle_chars, output`` of texts without nulls and four draws each."""
    texts = texts.cast(TEXT)
    lists = units(texts)
    n = pc.list_value_length(lists)
    flat, parents = pc.list_flatten(lists), pc.list_parent_indices(lists)
    one = pc.add(n, 1)
    cuts = [_modulo(x, one) for x in h[:2]]
    low, high = pc.min_element_wise(*cuts), pc.max_element_wise(*cuts)
    # Places inside each list, and the role that the place has there.
    starts = lists.offsets.slice(0, len(lists))
    ordinal = pc.subtract(pa.array(np.arange(len(flat))), pc.take(starts, parents))
    in_prefix = pc.less(ordinal, pc.take(low, parents))
    in_suffix = pc.greater_equal(ordinal, pc.take(high, parents))
    in_middle = pc.invert(pc.or_(in_prefix, in_suffix))
    sizes = (low, pc.subtract(high, low), pc.subtract(n, high))
    prefix, middle, suffix = (pc.binary_join(_lists(size, pc.filter(flat, role)), NOTHING)
                              for size, role in zip(sizes, (in_prefix, in_middle, in_suffix)))
    plain = pc.or_(pc.equal(n, 0), pc.greater_equal(_modulo(h[2], 100), rate))
    for mark in marks:
        plain = pc.or_(plain, pc.match_substring(texts, mark))
    turned = pc.less(_modulo(h[3], 100), spm)
    p, s, m = (pa.scalar(mark, TEXT) for mark in marks)
    psm = pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, NOTHING)
    spm_text = pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, NOTHING)
    form = pc.if_else(plain, "plain", pc.if_else(turned, "spm", "psm"))
    nothing = pa.scalar(None, pa.int64())
    chars = [pc.if_else(plain, nothing, pc.cast(pc.utf8_length(x), pa.int64()))
             for x in (prefix, middle)]
    return [n, form, *chars, pc.if_else(plain, texts, pc.if_else(turned, spm_text, psm))]


def rebuilt(outputs: pa.Array, forms: pa.Array, marks: tuple[str, str, str] = SENTINELS) -> pa.Array:
    """The texts that ``rearranged`` made the outputs of, from output and form alone. No piece holds
    a mark, so each mark stands where the form puts it and nowhere else."""
    outputs = outputs.cast(TEXT)
    text = outputs
    for form, first, second in (("psm", marks[0], marks[1]), ("spm", marks[1], marks[0])):
        own = pc.equal(forms, form)
        body = pc.filter(outputs, own)
        if not len(body):
            continue
        halves = pc.list_flatten(pc.split_pattern(pc.utf8_slice_codeunits(body, len(first)), second,
                                                  max_splits=1))
        tails = pc.list_flatten(pc.split_pattern(halves[1::2], marks[2], max_splits=1))
        head, tail, middle = halves[0::2], tails[0::2], tails[1::2]
        prefix, suffix = (head, tail) if form == "psm" else (tail, head)
        text = pc.replace_with_mask(text, own, pc.binary_join_element_wise(prefix, middle, suffix,
                                                                           NOTHING))
    return text


def _check(rate: int, spm: int, marks: tuple[str, str, str]) -> None:
    if not (0 <= rate <= 100 and 0 <= spm <= 100):
        raise ValueError("rates are percentages")
    if len(marks) != 3 or "" in marks or len(set(marks)) < 3:
        raise ValueError("there must be three different marks")
    if any(a.endswith(b[:k]) for a in marks for b in marks
           for k in range(1, len(b) + (a != b))) or any(a != b and a in b for a in marks
                                                        for b in marks):
        raise ValueError("no mark may overlap another or itself")


def fill_in_middle(docs: DataFrame, rate: int = 100, spm: int = 50, seed: int = 7,
                   marks: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` for every row of ``docs``.

    A text is cut into ``n`` lines with their ends. Prefix, middle and suffix end at lines drawn from
    a hash of the id; ``rate`` percent of the texts are rearranged, ``spm`` percent of those with the
    suffix first. One map over Arrow batches: nothing is shuffled, and a task holds the rows of one
    slice of ``SLICE_BYTES``, or one longer text.

    * Null and empty texts: plain, output empty, lengths null. Texts that hold a mark: plain.
    * Null ``doc_id``: drawn like the empty id; rows that share an id share the draws.
    * Repeated rows: each is returned. Empty table: empty result.
    * Very long texts: whole. Other columns are ignored, whatever they are called.
    """
    _check(rate, spm, marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, SLICE_BYTES):
                own = rearranged(part.column(1), part.columns[2:], rate, spm, marks)
                own[-1] = own[-1].cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *own], names=["doc_id", "n", "form", "prefix_chars",
                                                   "middle_chars", "output"])

    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")
                                                          ).alias("text"),
                       *[h.alias(f"h{i}") for i, h in enumerate(draws(F.col("doc_id"), seed), 1)])
    return rows.mapInArrow(run, f"doc_id long, {PIECES}")


def restore(made: DataFrame, marks: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """``made`` with one more column, ``restored``: the exact text, rebuilt from ``output`` and
    ``form``. Null outputs give null."""
    names = made.columns
    at, form_at = names.index("output"), names.index("form")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at, SLICE_BYTES):
                forms = pc.fill_null(part.column(form_at), "plain")
                text = rebuilt(part.column(at), forms, marks)
                yield pa.RecordBatch.from_arrays([*part.columns, text.cast(pa.string())],
                                                 names=[*names, "restored"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema.fields)
    return made.mapInArrow(run, f"{fields}, restored string")


def digests(docs: DataFrame, **options) -> DataFrame:
    """``fill_in_middle`` with the SHA-256 of output and of the restored text in place of the texts."""
    made = restore(fill_in_middle(docs, **options))
    sha = [F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *sha)


#: The same cuts on lists of lines.
SQL = """
WITH lines AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS units
  FROM documents),
drawn AS (
  SELECT *, len(units)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
         ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM lines),
cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>')
                OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
pieces AS (
  SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle,
         array_to_string(units[b + 1:], '') AS suffix FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text
              WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(CASE WHEN form = 'plain' THEN text ELSE prefix || middle || suffix END)
         AS restored_sha256
FROM pieces
"""
