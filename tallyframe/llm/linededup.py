"""Line dedup: repeated line runs from suffix ranks over line ids, by distributed prefix doubling.
DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import let, stored
from tallyframe.llm.quality import words

ROWS = 250_000  # rows of a task that orders them
TASKS = 50_000  # beyond so many tasks of ROWS rows, sorts spill
DOC = ["doc_id", "th"]
LINE = ["h1", "h2"]


def _text(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def _n_words(line: Column) -> Column:
    return F.size(words(line))


def line_table(docs: DataFrame) -> DataFrame:
    """``doc_id, th, i, w, h1, h2``: the lines that hold a word, numbered from 0 in each text, with
    their number of words and 128 bits that stand for their exact content. Texts stay behind."""
    rows = docs.select(F.col("doc_id").cast("long"), _text(F.col("text")).alias("text"))
    lines = F.filter(F.transform(F.split("text", "\n"), lambda s: F.struct(
        _n_words(s).alias("w"), F.xxhash64(s).alias("h1"), F.xxhash64(F.lit(1), s).alias("h2"))),
        lambda x: x["w"] > 0)
    return rows.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(lines).alias(
        "i", "x")).select(*DOC, "i", "x.*")


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df``, of ``rows`` rows at most, dealt by ``keys`` into tasks small enough to order their rows
    in memory. Partitions are sized by rows here, as AQE would merge them by their compressed bytes."""
    return df.repartition(min(max(1, -(-rows // ROWS)), TASKS), *keys)


def ranked(pairs: DataFrame, by: list[str], part: Column,
           rows: int | None = None) -> DataFrame:
    """``rank`` of distinct keys ``base, *by`` that occur ``n`` times: ``base`` plus the number of
    occurrences of smaller keys with the same base. There are ``rows`` keys at most.

    ``part`` is a number that grows with ``by``. It cuts a base into slices, so a base that holds a
    third of all keys is summed in many tasks: running sums inside each slice, and running sums over
    the totals of the slices.
    """
    cut = pairs.withColumn("part", part)
    if rows is not None:
        cut = dealt(cut, rows, "base", "part")
    inner = Window.partitionBy("base", "part").orderBy(*by).rowsBetween(
        Window.unboundedPreceding, -1)
    outer = Window.partitionBy("base").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy("base", "part").agg(F.sum("n").alias("t")).select(
        "base", "part", F.coalesce(F.sum("t").over(outer), F.lit(0)).alias("ahead"))
    within = cut.withColumn("less", F.coalesce(F.sum("n").over(inner), F.lit(0)))
    return within.join(totals, ["base", "part"]).select(
        "base", *by, (F.col("base") + F.col("ahead") + F.col("less")).alias("rank"))


def first_ranks(lines: DataFrame) -> tuple[DataFrame, int]:
    """``doc_id, th, i, r`` of the lines that occur more than once, ranked by line id, and the
    number of such lines. Lines that occur once end every repeated run, so they drop out here."""
    ids = lines.groupBy(*LINE).agg(F.count("*").alias("n")).where("n > 1")
    ids = stored(ids.withColumn("base", F.lit(0).cast("long")), "line-ids")
    total, rows = ids.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # Half of the bits of the total: so many slices as a slice has keys, about.
    bits = total.bit_length() // 2 + 1
    ranks = ranked(ids, LINE, F.shiftright("h1", 64 - bits), rows).select(
        *LINE, F.col("rank").alias("r"))
    return lines.join(ranks, LINE).select(*DOC, "i", "r"), total


def doubled(ranks: DataFrame, span: int, total: int) -> DataFrame:
    """Ranks by the first ``2 * span`` lines from ranks by the first ``span``: one doubling.

    The second half of a suffix is the rank ``span`` lines further on, if the document has that
    many lines left that repeat. Pairs are counted before anything is joined, so a hot pair costs a
    row a task, and pairs that occur once are settled and drop out.
    """
    ahead = Window.partitionBy(*DOC).orderBy("i").rangeBetween(span, span)
    both = dealt(ranks, total, *DOC).withColumn("r2", F.max("r").over(ahead))
    both = stored(both.where("r2 is not null").withColumnRenamed("r", "base"),
                  f"suffixes-{2 * span}")
    pairs = both.groupBy("base", "r2").agg(F.count("*").alias("n")).where("n > 1")
    part = F.shiftright("r2", total.bit_length() // 2)
    order = ranked(pairs, ["r2"], part, both.count() // 2)
    return both.join(order, ["base", "r2"]).select(
        *DOC, "i", F.col("rank").alias("r"))


def shortest_runs(lines: DataFrame, min_words: int, n_lines: int) -> DataFrame:
    """``doc_id, th, a, b``: for each line the shortest run of ``min_words`` words or more that
    starts with it, and the shortest one that ends with it; lines a to b - 1.

    Every run of ``min_words`` words or more is the union of the shortest runs inside it: a line
    with enough words from it to the end of the run starts one, a line with enough words up to it
    ends one, and any other line lies in the one that starts with the run.
    """
    order = Window.partitionBy(*DOC).orderBy("i")
    rows = dealt(lines, n_lines, *DOC).select(*DOC, "i", "w", F.sum("w").over(order).alias("upto")).withColumn(
        "base", F.col("upto") - F.col("w"))
    whole = Window.partitionBy(*DOC)
    up, down = whole.orderBy("base"), whole.orderBy("upto")
    rows = rows.select(
        *DOC, "i", "base", "upto", F.sum("w").over(whole).alias("total"),
        F.count("*").over(up.rangeBetween(Window.unboundedPreceding, min_words - 1)).alias("end"),
        F.count("*").over(down.rangeBetween(Window.unboundedPreceding, -min_words)).alias("start"))
    forward = rows.where(F.col("total") - F.col("base") >= min_words).select(
        *DOC, F.col("i").alias("a"), F.col("end").cast("int").alias("b"))
    backward = rows.where(F.col("upto") >= min_words).select(
        *DOC, F.col("start").cast("int").alias("a"), (F.col("i") + 1).alias("b"))
    return forward.union(backward).distinct()


def _at(runs: DataFrame, ranks: DataFrame, place: Column, name: str) -> DataFrame:
    """``runs`` with the rank of the suffix at ``place``; runs without one are not repeated."""
    found = ranks.select(*[F.col(c).alias(f"__{c}") for c in DOC], F.col("i").alias("__i"),
                         F.col("r").alias(name))
    on = F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (F.col("th") == F.col("__th"))
    return runs.join(found, on & (place == F.col("__i"))).drop("__doc_id", "__th", "__i")


def later_copies(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """``doc_id, th, i``: the numbers of the lines to delete, ``th`` being the hash of the text.

    Suffixes of the line sequences are ranked by their first 1, 2, 4, ... lines until the ranks
    decide the longest of the shortest runs, at most ``min_words`` lines. A run of n lines lies in
    the interval of suffixes that share n lines or more; with ``span`` the largest power of two in
    n, that interval is named by n and two ranks, at the run's start and ``span`` lines before its
    end. The first member, by document and line, stays; all later ones go.
    """
    lines = stored(line_table(docs).dropDuplicates([*DOC, "i"]), "lines")
    ranks, total = first_ranks(lines)
    ranks = stored(ranks, "suffixes-1")
    kept = lines.join(ranks.select(*DOC).distinct().withColumnsRenamed(
        {c: f"__{c}" for c in DOC}), F.col("doc_id").eqNullSafe(F.col("__doc_id"))
        & (F.col("th") == F.col("__th")), "left_semi")
    runs = stored(shortest_runs(kept, min_words, lines.count()), "runs")
    longest = runs.agg(F.coalesce(F.max(F.col("b") - F.col("a")), F.lit(0))).first()[0]
    named, span, size = None, 1, F.col("b") - F.col("a")
    while span <= longest:
        level = runs.where((size >= span) & (size < 2 * span))
        level = _at(_at(level, ranks, F.col("a"), "x"), ranks, F.col("b") - span, "y")
        named = level if named is None else named.union(level)
        if 2 * span <= longest:
            ranks = stored(doubled(ranks, span, total), f"suffixes-{2 * span}")
        span *= 2
    if named is None:
        return lines.where(F.lit(False)).select(*DOC, "i")
    name = [size.alias("size"), "x", "y"]
    named = stored(named.select(*DOC, "a", "b", *name), "intervals")
    # Written out, so that both sides of the join are shuffled for it and AQE can split hot runs.
    first = stored(named.groupBy("size", "x", "y").agg(F.count("*").alias("n"), F.min(
        F.struct(*DOC, "a")).alias("first")).where("n > 1").drop("n"), "firsts")
    later = named.join(first, ["size", "x", "y"]).where(F.struct(*DOC, "a") > F.col("first"))
    later = dealt(later.select(*DOC, "a", "b"), named.count(), *DOC)
    # Merge the deleted runs of a document before they become lines.
    so_far = Window.partitionBy(*DOC).orderBy("a", "b")
    reach = F.max("b").over(so_far.rowsBetween(Window.unboundedPreceding, -1))
    fresh = later.select(*DOC, F.greatest(F.col("a"), F.coalesce(reach, F.lit(0))).alias("a"), "b")
    return fresh.where("a < b").select(*DOC, F.explode(F.sequence("a", F.col("b") - 1)).alias("i"))


def dedup_lines(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """``docs`` with later copies of repeated line runs deleted from ``text``, ``n_chars`` (where
    there is one) counted anew, and two more columns: ``__n_lines``, ``__n_deleted``.

    A run is a sequence of consecutive lines of one document; lines without a word are passed over
    and stay. Every maximal run of ``min_words`` words or more that occurs again, in another
    document or later in the same one, also overlapping itself, is kept where it comes first by
    ``doc_id`` and line, and deleted elsewhere. No row is dropped: a document that consists of
    later copies keeps an empty text.

    * Null and empty texts: unchanged. Null ``doc_id``: counts as smaller than every id.
    * Repeated rows (same id and text) are one document, and each gets its result; rows that share
      only the id are told apart by their text, the smaller hash coming first.
    * Very long texts: whole; lines travel as 128-bit ids.
    * Empty table: empty result. Other columns are passed on.
    """
    gone = later_copies(docs, min_words).groupBy(*DOC).agg(F.collect_set("i").alias("__gone"))
    gone = gone.withColumnsRenamed({c: f"__{c}" for c in DOC})
    rows = docs.withColumn("__hash", F.xxhash64(_text(F.col("text"))))
    joined = rows.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col("__doc_id"))
                       & (F.col("__hash") == F.col("__th")), "left")
    filled = lambda lines: F.filter(
        F.sequence(F.lit(0), F.size(lines) - 1), lambda j: _n_words(F.get(lines, j)) > 0)

    def without(lines):
        places = let(filled(lines), lambda at: F.transform(
            "__gone", lambda i: F.get(at, i)))
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), places)
        return F.array_join(F.transform(left, lambda j: F.get(lines, j)), "\n")

    lines = F.split(F.col("text").cast("string"), "\n")
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(let(lines, without))
    out = joined.withColumn("__new", text).withColumn("__n_deleted", F.coalesce(
        F.size("__gone"), F.lit(0)).cast("long"))
    count = let(F.split(_text(F.col("text")), "\n"), lambda x: F.size(
        F.filter(x, lambda s: F.btrim(s, F.lit(" \t\n\x0b\x0c\r")) != "")))
    out = out.withColumn("__n_lines", count.cast("long")).withColumn("text", F.col("__new"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__gone").isNull(), F.col("n_chars"))
                             .otherwise(F.length("text").cast("long")))
    return out.select(*docs.columns, "__n_lines", "__n_deleted")


#: The same deletions from the definition of the shortest runs, with runs compared as strings.
SQL = """
WITH parts AS (
  SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
every AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS n FROM parts),
counted AS (
  SELECT doc_id, n, line, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS w FROM every),
filled AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS i,
         sum(w) OVER (PARTITION BY doc_id ORDER BY n) AS upto,
         sum(w) OVER (PARTITION BY doc_id) AS total,
         count(*) OVER (PARTITION BY doc_id) AS n_lines
  FROM counted WHERE w > 0),
sizes AS (SELECT *, upto - w AS base FROM filled),
runs AS (
  SELECT p.doc_id, p.i AS a, min(q.i) AS b FROM sizes p JOIN sizes q
    ON p.doc_id = q.doc_id AND q.i >= p.i AND q.upto - p.base >= 50 GROUP BY ALL
  UNION
  SELECT q.doc_id, max(p.i) AS a, q.i AS b FROM sizes p JOIN sizes q
    ON p.doc_id = q.doc_id AND q.i >= p.i AND q.upto - p.base >= 50 GROUP BY q.doc_id, q.i),
content AS (
  SELECT r.doc_id, r.a, r.b, string_agg(s.line, chr(10) ORDER BY s.i) AS body
  FROM runs r JOIN sizes s ON r.doc_id = s.doc_id AND s.i BETWEEN r.a AND r.b GROUP BY ALL),
later AS (
  SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, a) AS k FROM content),
gone AS (
  SELECT DISTINCT s.doc_id, s.n FROM later l JOIN sizes s
    ON l.k > 1 AND l.doc_id = s.doc_id AND s.i BETWEEN l.a AND l.b),
result AS (
  SELECT e.doc_id, coalesce(string_agg(CASE WHEN g.n IS NULL THEN e.line END, chr(10)
                                       ORDER BY e.n), '') AS text,
         count(g.n) AS n_deleted
  FROM every e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.n = g.n GROUP BY e.doc_id),
lengths AS (SELECT doc_id, count(*) AS n_lines FROM sizes GROUP BY doc_id)
SELECT d.doc_id, r.text, coalesce(l.n_lines, 0) AS n_lines, coalesce(r.n_deleted, 0) AS n_deleted
FROM documents d LEFT JOIN result r ON d.doc_id = r.doc_id
LEFT JOIN lengths l ON d.doc_id = l.doc_id
"""
