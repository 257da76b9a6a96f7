"""Jaccard join of word-shingle sets: R-trees over the counts of shingles per hash group."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import slices, stored
from tallyframe.llm.graph import components

GROUPS = 64  # coordinates of a point
LEAF = 16  # points of a leaf
GROWTH = 1.25  # of the sizes that share a number of parts
SLICE_BYTES = 16 << 20
NO_ID = -(1 << 63)
FEW_EDGES = 1_000_000  # that one task may join
LIGHT = 3  # shingles that a part needs to be told by its content
TURNS = 4  # hashes by which a set is dealt into parts until enough of them are heavy
POINTS, SHINGLES = 2000, 2_000_000  # of one side of a task's join


def shingle_set(text: bytes | None, shingle: int) -> np.ndarray:
    """The distinct word shingles of a text as sorted 64-bit hashes; a text of fewer words is one
    shingle, a text without words has none."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(joined)]
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined)], np.uint64)
    return np.unique(np.array([digest(joined[a:b]) for a, b in zip(starts, ends[shingle - 1:])],
                              np.uint64))


def need(sizes, percent: int):
    """The least overlap of two sets that link, from the sum of their sizes."""
    return -(-percent * sizes // (100 + percent))


def level_ends(percent: int, largest: int) -> list[int]:
    """The largest size of each level; the first level holds the sizes at which only equal sets link."""
    ends = [max((100 + percent - 1) // (2 * (100 - percent)), 1) if percent < 100 else largest]
    while ends[-1] < largest:
        ends.append(max(ends[-1] + 1, int(ends[-1] * GROWTH)))
    return ends


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def part_names(hashes: np.ndarray, percent: int) -> np.ndarray:
    """Names of the contents of the parts into which a set falls.

    Two sets of sizes a <= b that link differ in at most (a + b)(100 - p) / (100 + p) shingles, so
    when shingles are dealt into more parts than that, one part at least is the same in both. The
    number of parts follows from the level of the larger set; a set is dealt out for each level that a
    partner of its size or more can have.

    Sets without much in common share parts that are empty or hold a common shingle or two, and ever
    more of them do in a larger table. So a part of fewer than ``LIGHT`` shingles has no name, unless
    it may be all that a link has: sets that agree in no heavy part differ in all the heavy parts of
    either, so neither has more of those than linked sets can differ in. A set with so few is dealt
    anew by another hash, as its partner then is too, and names all its parts in the last turn.
    """
    size, out = len(hashes), []
    if size and percent < 100:
        reach = size * 100 // percent
        ends = level_ends(percent, reach)
        light = max(min((100 + percent) // (6 * (100 - percent)), LIGHT), 1)  # a third of a mean part
        last = TURNS - 1 if light > 1 else 0
        for level in range(max(bisect_left(ends, size), 1), bisect_left(ends, reach) + 1):
            parts = 2 * ends[level] * (100 - percent) // (100 + percent) + 1
            most = (size + min(reach, ends[level])) * (100 - percent) // (100 + percent)
            for turn in range(last + 1):
                dealt = _mixed(hashes + np.uint64(turn)) if turn else hashes
                at = (dealt % np.uint64(parts)).astype(np.int64)
                sums = np.zeros(parts, np.uint64)
                np.add.at(sums, at, hashes)
                place = np.arange(parts, dtype=np.uint64) + np.uint64((turn << 56) + (level << 40))
                names = _mixed(sums + _mixed(place))
                heavy = np.bincount(at, minlength=parts) >= light
                few = np.count_nonzero(heavy) <= most
                out.append(names if few and turn == last else names[heavy])
                if not few:
                    break
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


class Tree:
    """An R-tree packed over points, which have one more coordinate, the size of the set: the count of
    the group of all shingles. Nodes split their points at the median of the coordinate that spreads
    most, and keep the largest coordinates and the least size."""

    def __init__(self, points: np.ndarray):
        self.points = np.column_stack([points, points.sum(axis=1)])
        self.sizes = self.points[:, -1]
        self.rows, self.children, high, least = [], [], [], []
        todo = [(np.arange(len(points)), -1)]
        while todo:
            rows, parent = todo.pop()
            node, own = len(self.rows), self.points[rows]
            if parent >= 0:
                self.children[parent].append(node)
            high.append(own.max(axis=0))
            least.append(self.sizes[rows].min())
            self.rows.append(rows)
            self.children.append([])
            if len(rows) > LEAF:
                axis = int(np.argmax(high[-1] - own.min(axis=0)))
                order = rows[np.argsort(own[:, axis], kind="stable")]
                todo += [(order[:len(order) // 2], node), (order[len(order) // 2:], node)]
        self.high, self.least = np.array(high), np.array(least)


def close_pairs(one: Tree, two: Tree, percent: int, same: bool) -> Iterator[tuple]:
    """Blocks of rows ``a, b`` and the mask of their pairs whose summed coordinate minima reach the
    overlap that linked sets need. Pairs of nodes whose corners cannot reach it are not opened; no
    pair of sets overlaps in more than its summed minima, so none is lost."""
    todo = [(0, 0)]
    while todo:
        a, b = todo.pop()
        least = need(one.least[a] + two.least[b], percent)
        corner = np.minimum(one.high[a], two.high[b])
        if corner[-1] < least or corner[:-1].sum() < least:
            continue
        if one.children[a] or two.children[b]:
            lefts, rights = one.children[a] or [a], two.children[b] or [b]
            todo += [(x, y) for x in lefts for y in rights if not (same and a == b and x > y)]
            continue
        rows, others = one.rows[a], two.rows[b]
        bound = np.minimum(one.points[rows][:, None, :-1], two.points[others][None, :, :-1]
                           ).sum(axis=2)
        yield rows, others, bound >= need(
            one.sizes[rows][:, None] + two.sizes[others][None], percent)


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    return int((y[np.minimum(at, len(y) - 1)] == x).sum())


def linked(ids: np.ndarray, sets: list[np.ndarray], labels: np.ndarray, ones: np.ndarray,
           percent: int) -> list[tuple[int, int]]:
    """Links that join all sets which links between the rows ``ones`` and all rows join. Rows of
    equal labels are joined already; a pair that is joined is not verified again."""
    points = np.zeros((len(sets), GROUPS), np.int64)
    for row, own in enumerate(sets):
        points[row] = np.bincount((own >> np.uint64(58)).astype(np.int64), minlength=GROUPS)
    found, (_, group) = [], np.unique(labels, return_inverse=True)
    every = len(ones) == len(sets)
    two = Tree(points)
    one = two if every else Tree(points[ones])
    for a, b, near in close_pairs(one, two, percent, every):
        a = a if every else ones[a]
        for x, y in zip(*np.nonzero(near & (group[a][:, None] != group[b][None]))):
            x, y = a[x], b[y]
            if group[x] != group[y]:
                both = overlap(sets[x], sets[y])
                if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                    found.append((int(ids[x]), int(ids[y])))
                    group[group == group[y]] = group[x]
    return found


def _key() -> list:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"),
            F.xxhash64(F.col("text").cast("string")).alias("th")]


def described(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """``id, th, n, name, parts`` of each row: the id and the hash of the text, the size of the set,
    128 bits that stand for the set, and the names of its parts. Texts go to Python in slices."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, SLICE_BYTES):
                sizes, names, parts = [], [], []
                for text in part.column(2).cast(pa.binary()):
                    own = shingle_set(text.as_py(), shingle)
                    sizes.append(len(own))
                    names.append(xxhash.xxh3_128_digest(own.tobytes()))
                    parts.append(part_names(own, percent))
                edges = np.cumsum([0, *map(len, parts)])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(sizes, pa.int64()),
                     pa.array(names, pa.binary()), pa.ListArray.from_arrays(
                         pa.array(edges, pa.int32()), pa.array(np.concatenate(parts)))],
                    names=["id", "th", "n", "name", "parts"])

    rows = docs.select(*_key(), F.col("text").cast("string"))
    return rows.mapInArrow(run, "id long, th long, n long, name binary, parts array<long>")


def roots_of(edges: DataFrame, most: int = FEW_EDGES) -> DataFrame:
    """``components`` of stored edges ``a, b``. Up to ``most`` edges, a few megabytes, are joined by a
    single task in one job; more of them take the rounds of the distributed form. Both give every
    node the smallest one that it reaches."""
    if edges.limit(most + 1).count() > most:
        return components(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches]
        nodes, at = np.unique(np.concatenate([np.zeros((2, 0), np.int64), *pairs], axis=1),
                              return_inverse=True)
        root = list(range(len(nodes)))
        for x, y in at.reshape(2, -1).T.tolist():
            while root[x] != x:
                root[x] = x = root[root[x]]
            while root[y] != y:
                root[y] = y = root[root[y]]
            root[max(x, y)] = min(x, y)
        for x, y in enumerate(root):  # a root is smaller than what hangs on it
            root[x] = root[y]
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(
            nodes[np.array(root, np.int64)], pa.int64())], names=["node", "root"])

    return stored(edges.select("a", "b").coalesce(1).mapInArrow(run, "node long, root long"), "roots")


def gathered(classes: DataFrame) -> DataFrame:
    """``node, root``: classes that share a part, directly or by others, have one root. Every class
    that links with another is there. A part with many classes becomes a star around its least."""
    parts = classes.select("c", F.explode("parts").alias("part"))
    shared = stored(parts.groupBy("part").agg(
        F.count("*").alias("n"), F.min("c").alias("a"), F.max("c").alias("b")).where("n > 1"),
        "shared-parts")
    pairs = shared.where("n = 2").select("a", "b")
    stars = parts.join(shared.where("n > 2").select("part", "a"), "part").select(
        "a", F.col("c").alias("b"))
    return roots_of(stored(pairs.union(stars).where("a <> b").distinct(), "part-links"))


def member_sets(docs: DataFrame, members: DataFrame, shingle: int) -> DataFrame:
    """``c, root, set`` of the classes ``c`` of ``members`` (``c, root, id, th``): the sorted hashes
    of the text of one document each."""
    texts = docs.select(*_key(), F.col("text").cast("string").alias("text"))
    rows = texts.join(members, ["id", "th"]).groupBy("id", "th").agg(
        F.first("c").alias("c"), F.first("root").alias("root"), F.first("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, SLICE_BYTES):
                sets = [shingle_set(t.as_py(), shingle).tobytes()
                        for t in part.column(2).cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(sets, pa.binary())],
                                                 names=["c", "root", "set"])

    return rows.select("c", "root", "text").mapInArrow(run, "c long, root long, set binary")


def _join(rows: DataFrame, by: list[str], percent: int) -> DataFrame:
    """Links ``a, b`` inside the groups of ``rows`` (``c, set, label, one``): between rows marked
    ``one`` and all rows of the group."""
    def run(table: pa.Table) -> pa.Table:
        ids, first = np.unique(table["c"].to_numpy(), return_index=True)
        marked = np.isin(ids, table["c"].to_numpy()[table["one"].to_numpy()])
        sets = [np.frombuffer(table["set"][i].as_py(), np.uint64) for i in first.tolist()]
        found = linked(ids, sets, table["label"].to_numpy()[first], np.flatnonzero(marked),
                       percent) if marked.any() else []
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()),
                         "b": pa.array([b for _, b in found], pa.int64())})

    return rows.groupBy(*by).applyInArrow(run, "a long, b long")


def links(sets: DataFrame, percent: int, points: int = POINTS, shingles: int = SHINGLES,
          centres: int = 32) -> DataFrame:
    """Links ``a, b`` that join the classes ``c, root, set`` just as all pairs with enough overlap
    do, looked for among classes of one root.

    A root with more than ``points`` classes or ``shingles`` shingles is dealt into pieces of about
    that size. First each piece is joined by itself, together with ``centres`` classes of the root
    that are in every piece; that leaves a group of near copies in one component as a rule. Then the
    classes outside the largest component of the root are joined with all pieces, piece by piece.
    Pairs within the largest component need no look, so no link that joins anything is lost, and no
    task holds more than two pieces.
    """
    size = (F.length("set") / 8).cast("long")
    held = sets.groupBy("root").agg(F.greatest(
        F.ceil(F.count("*") / points), F.ceil(F.sum(size) / shingles)).cast("int").alias("k"))
    large = stored(held.where("k > 1"), "large-roots")
    if not large.limit(1).count():
        alone = sets.select("c", "root", "set", F.col("c").alias("label"), F.lit(True).alias("one"))
        return _join(alone, ["root"], percent)
    order = Window.partitionBy("root").orderBy(F.xxhash64("c"), "c")
    first = sets.join(large, "root").select("root", "c", F.row_number().over(order).alias("place")
                                            ).where(F.col("place") <= centres)
    rows = sets.join(large, "root", "left").join(first, ["root", "c"], "left").withColumns({
        "k": F.coalesce("k", F.lit(1)), "label": F.col("c"), "one": F.lit(True)})
    home = F.expr("cast(pmod(xxhash64(c), k) as int)")
    everywhere = F.sequence(F.lit(0), F.col("k") - 1)
    pieces = rows.withColumn("piece", F.explode(
        F.when(F.col("place").isNull(), F.array(home)).otherwise(everywhere)))
    inner = stored(_join(pieces, ["root", "piece"], percent), "inner-links")
    named = sets.join(large, "root").join(
        roots_of(inner).select(F.col("node").alias("c"), F.col("root").alias("comp")), "c", "left"
    ).withColumn("label", F.coalesce("comp", "c")).drop("comp")
    named = stored(named, "large-sets")
    counts = named.groupBy("root", "label").agg(F.count("*").alias("m"))
    most = counts.groupBy("root").agg(F.max_by("label", F.struct("m", "label")).alias("main"))
    named = named.join(most, "root").withColumn("rest", F.col("label") != F.col("main"))
    left = named.where("rest").groupBy("root").agg(
        F.greatest(F.ceil(F.count("*") / points), F.ceil(F.sum(size) / shingles)).cast("int"
                                                                                        ).alias("l"))
    both = named.join(left, "root")
    every = both.withColumns({"one": F.lit(False), "i": home}).withColumn(
        "j", F.explode(F.sequence(F.lit(0), F.col("l") - 1)))
    some = both.where("rest").withColumns(
        {"one": F.lit(True), "j": F.expr("cast(pmod(xxhash64(c), l) as int)")}).withColumn(
        "i", F.explode(everywhere))
    rows = every.unionByName(some).select("root", "i", "j", "c", "set", "label", "one")
    return inner.union(_join(rows, ["root", "i", "j"], percent))


def near_duplicates(docs: DataFrame, shingle: int = 3, percent: int = 90, **limits) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``.

    Texts are lower-cased in A-Z and cut into words ``[^\\x20\\x09-\\x0D]+``; a document's set holds
    its distinct shingles of ``shingle`` words (a shorter text is one shingle). Documents link if
    100 * intersection >= ``percent`` * union; ``component_id`` is the smallest ``doc_id`` reachable.

    * Equal sets are one class, however many documents share it. Classes that can link share a part
      of their sets (``part_names``) and are gathered by that; inside what is gathered, R-trees over
      the counts of ``GROUPS`` hash groups find the pairs whose summed coordinate minima reach the
      overlap, and these are verified on the sets.
    * Null, empty and blank texts: empty set, linked with nothing, ``component_id`` is the own id.
    * Null ``doc_id``: kept; its component is named by the smallest known id in it, null if none.
    * Repeated rows: each is returned. Empty table: empty result.
    * Very long texts: whole. Other columns are ignored, whatever they are called.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent must be above 0 and at most 100")
    rows = stored(described(docs, shingle, percent), "described")
    known = F.when(F.col("id") != NO_ID, F.col("id"))
    names = rows.where("n > 0").groupBy("name").agg(
        F.min(known).alias("best"), F.min(F.struct("id", "th")).alias("one"))
    classes = stored(names.select("name", "best", "one.*").withColumn(
        "c", F.monotonically_increasing_id()), "classes")
    parts = rows.where("size(parts) > 0").join(
        classes.select("c", "id", "th"), ["id", "th"]).groupBy("id", "th").agg(
        F.first("c").alias("c"), F.first("parts").alias("parts"))
    near = stored(gathered(parts), "gathered")
    members = classes.join(near.withColumnRenamed("node", "c"), "c").select("c", "root", "id", "th")
    sets = stored(member_sets(docs, members, shingle), "sets")
    joined = roots_of(stored(links(sets, percent, **limits), "links")).withColumnsRenamed(
        {"node": "c", "root": "comp"})
    rooted = classes.join(joined, "c", "left").select(
        "name", "best", F.coalesce("comp", "c").alias("comp"))
    best = rooted.groupBy("comp").agg(F.min("best").alias("component_id"))
    named = stored(rooted.join(best, "comp").select("name", "component_id"), "named")
    out = rows.where("n > 0").select("id", "n", "name").join(named, "name").select(
        "id", "n", "component_id")
    alone = rows.where("n = 0").select("id", "n", known.alias("component_id"))
    return out.union(alone).select(known.alias("doc_id"), F.col("n").alias("n_shingles"),
                                   "component_id")


#: The same sets, links counted by shared shingles, and reachability by a recursive query.
SQL = """
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3
           THEN [array_to_string(words, ' ')]
           ELSE list_transform(range(1, len(words) - 1),
                               lambda i: array_to_string(words[i:i + 2], ' ')) END) AS s
  FROM texts),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k
  FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * k >= 90 * (p.n + q.n - k)),
reach AS (
  SELECT doc_id, doc_id AS other FROM texts
  UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT t.doc_id, coalesce(s.n, 0) AS n_shingles, min(r.other) AS component_id
FROM texts t LEFT JOIN sizes s ON s.doc_id = t.doc_id JOIN reach r ON r.doc_id = t.doc_id
GROUP BY ALL
"""
