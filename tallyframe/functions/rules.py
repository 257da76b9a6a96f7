"""Keyword rule sets, and the expression that applies one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.least_squares import let

Rules = Sequence[tuple[str, Sequence[str]]]

OTHER = "other"

# Ordered keyword lists. The first category with a keyword inside the text wins.
DEFAULT: Rules = (
    ("food", ("grocery", "restaurant", "cafe", "food", "dining")),
    ("transport", ("uber", "lyft", "gas", "fuel", "transit", "train", "bus")),
    ("shopping", ("amazon", "walmart", "target", "purchase", "store")),
    ("utilities", ("electric", "water", "gas", "utility", "bill", "phone", "internet")),
    ("entertainment", ("movie", "netflix", "spotify", "hulu", "game")),
    ("health", ("doctor", "pharmacy", "medical", "fitness", "gym")),
    ("housing", ("rent", "mortgage", "home")),
    ("income", ("salary", "deposit", "payment received")),
)
REPORT: Rules = (
    ("food", ("grocery", "restaurant", "cafe", "food", "dining", "eat")),
    ("transport", ("uber", "lyft", "gas", "fuel", "transit", "train")),
    ("shopping", ("amazon", "walmart", "target", "purchase", "store")),
    ("utilities", ("electric", "water", "gas", "utility", "bill", "phone")),
    ("entertainment", ("movie", "netflix", "spotify", "hulu", "game")),
    ("health", ("doctor", "pharmacy", "medical", "fitness", "gym")),
    ("income", ("salary", "deposit", "credit")),
)
TRAIN: Rules = (
    ("food", ("grocery", "restaurant", "cafe", "food", "dining", "eat")),
    ("transport", ("uber", "lyft", "gas", "fuel", "transit", "train", "travel")),
    ("shopping", ("amazon", "walmart", "target", "purchase", "store", "buy")),
    ("utilities", ("electric", "water", "gas", "utility", "bill", "phone")),
    ("entertainment", ("movie", "netflix", "spotify", "hulu", "game")),
    ("health", ("doctor", "pharmacy", "medical", "fitness", "hospital")),
    ("income", ("salary", "deposit", "payment received", "credit")),
    ("transfer", ("transfer", "neft", "imps", "rtgs", "withdrawal")),
)
FORECAST: Rules = (
    ("food", ("grocery", "restaurant", "cafe", "food", "dining", "eat")),
    ("transport", ("uber", "lyft", "gas", "fuel", "transit", "train")),
    ("shopping", ("amazon", "walmart", "target", "purchase", "store")),
    ("utilities", ("electric", "water", "gas", "utility", "bill", "phone")),
    ("entertainment", ("movie", "netflix", "spotify", "hulu", "game")),
)
UI: Rules = (
    ("food", ("grocery", "restaurant", "food", "cafe", "coffee", "pizza", "burger", "deli",
              "bakery")),
    ("transport", ("gas", "uber", "lyft", "taxi", "car", "auto", "parking", "transit", "train",
                   "bus", "subway")),
    ("utilities", ("electric", "water", "gas", "utility", "phone", "internet", "cable", "bill")),
    ("entertainment", ("movie", "theatre", "netflix", "spotify", "hulu", "disney", "game", "book",
                       "music")),
    ("shopping", ("amazon", "walmart", "target", "purchase", "store", "shop", "mall", "clothing",
                  "electronics")),
    ("health", ("doctor", "hospital", "pharmacy", "medical", "dental", "health", "clinic",
                "fitness", "gym")),
    ("housing", ("rent", "mortgage", "home", "apartment", "lease", "property", "housing",
                 "insurance")),
    ("income", ("salary", "payment", "direct deposit", "deposit", "income", "payroll", "wage",
                "refund")),
)

RULE_SETS: dict[str, Rules] = {
    "default": DEFAULT,
    "report": REPORT,
    "train": TRAIN,
    "forecast": FORECAST,
    "ui": UI,
}


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def category_of(lowered: str, rules: Rules = DEFAULT) -> Column:
    """Category of a lower-case text column: substring match, rule order decides, else ``other``.
    One SQL expression, because a hundred Column calls would cost more than the query."""
    cases = [f"WHEN {lowered} IS NULL THEN {_quoted(OTHER)}"]
    for category, keywords in rules:
        if keywords:
            hits = " OR ".join(f"contains({lowered}, {_quoted(word)})" for word in keywords)
            cases.append(f"WHEN {hits} THEN {_quoted(category)}")
    return F.expr(f"CASE {' '.join(cases)} ELSE {_quoted(OTHER)} END")


def with_keyword_category(
    df: DataFrame, column: str, out: str, rules: Rules = DEFAULT
) -> DataFrame:
    """Adds ``out``, the keyword category of a text column. The lower-case text is a column of its
    own: an expression inside the chain would be evaluated again for every keyword."""
    lowered = df.withColumn("_lowered", F.lower(column))
    return lowered.withColumn(out, category_of("_lowered", rules)).drop("_lowered")


def rules_from_table(table: DataFrame, limit: int = 10_000) -> Rules:
    """Rules kept as a table ``(seq, category, keywords)``. They become literals in the plan, so
    the table is refused when it is larger than ``limit`` rows; ``with_rule_table`` joins a table of
    any size instead."""
    rows = table.select("seq", "category", "keywords").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"Rule table has more than {limit} rows")
    return [(r.category, tuple(r.keywords)) for r in sorted(rows, key=lambda r: r.seq)]


GRAM = 4  # letters of a keyword by which it is found
BITS = 18  # first letters are told apart by so many bits of a hash before anything travels
PIECE = 64  # letters of a text that are looked at together, at least
SMALL = 8 << 20  # bytes of keywords that every task may hold


def _bit(gram: Column) -> Column:
    """Bit of first letters, from 1 to ``1 << BITS``."""
    return F.xxhash64(gram).bitwiseAND(F.lit((1 << BITS) - 1)) + 1


def _bits_of(words: DataFrame) -> Column:
    """The bits of all first letters as one literal of 64-bit numbers, whatever the number of rules."""
    bit = _bit(F.col("_gram"))
    maps = words.groupBy(F.bitmap_bucket_number(bit).alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
    held = bytearray((1 << BITS) // 8)
    for part, bits in maps:
        held[(part - 1) * len(bits):part * len(bits)] = bits
    numbers = memoryview(bytes(held)).cast("q")
    # Written out once; a list of literals would cost a call each.
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<bigint>")


def _windows(texts: DataFrame, longest: int, lengths: Sequence[int], known: Column) -> DataFrame:
    """``texts`` with a row for each place of ``_text`` at which first letters of a keyword stand, and
    as ``_window`` the text from there, as long as the longest keyword. Texts are read in pieces, as
    finding a place means counting up to it."""
    step = max(PIECE, longest)

    def overlapping(pieces: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(pieces) - 1), lambda i: F.struct(
            F.length(pieces[i]).alias("_places"),
            F.concat(pieces[i], F.coalesce(F.substring(F.get(pieces, i + 1), 1, longest - 1),
                                           F.lit(""))).alias("_piece")))

    pieces = F.regexp_extract_all("_text", F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    rest = [c for c in texts.columns if c != "_text"]
    places = texts.select(*rest, F.inline(let(pieces, overlapping))).select(
        *rest, "_piece", F.explode(F.expr("sequence(1, _places)")).alias("_place"))
    begins = F.lit(False)
    for n in lengths:
        bit = _bit(F.substring("_piece", F.col("_place"), F.lit(n))) - 1
        number = F.get(known, F.shiftright(bit, 6).cast("int"))
        begins = begins | (F.getbit(number, (bit % 64).cast("int")) == 1)
    return places.where(begins).select(
        *rest, F.substring("_piece", F.col("_place"), F.lit(longest)).alias("_window"))


def with_rule_table(df: DataFrame, rules: DataFrame, column: str, out: str) -> DataFrame:
    """Adds ``out``, the category of the first rule by ``seq`` that has a keyword inside the
    lower-case text of ``column``, else ``other``. ``rules`` is a table ``(seq, category, keywords)``
    of any size; ties in ``seq`` go to the category that sorts first.

    Texts stay where they are read. Only places leave them at which the first letters of a keyword
    stand, as windows of the length of the longest keyword. The lengths of the keywords with these
    letters cut a window to whole keywords, and these are joined as they are, so rules that begin
    alike, such as numbered names, cost no more than others. Rules are broadcast up to a checked size;
    beyond it, windows are dealt by keyword, and AQE splits frequent ones.
    """
    words = rules.select("seq", "category", F.explode("keywords").alias("_word")).where(
        "_word <> ''").withColumn("_gram", F.substring("_word", 1, GRAM))
    # A few numbers: the longest keyword, the lengths of first letters that there are, and bytes.
    longest, lengths, size = words.agg(
        F.max(F.length("_word")), F.collect_set(F.length("_gram")),
        F.sum(F.octet_length("_word") + F.coalesce(F.octet_length("category"), F.lit(0)) + 32)).first()
    if not longest:
        return df.withColumn(out, F.lit(OTHER))
    lengths = sorted(lengths)
    small = F.broadcast if size <= SMALL else lambda side: side
    text = F.lower(column)
    key = [F.xxhash64(text).alias("_h1"), F.xxhash64(F.lit(1), text).alias("_h2")]
    texts = df.where(F.col(column) != "").select(*key, text.alias("_text"))
    spots = _windows(texts, longest, lengths, _bits_of(words))
    grams = F.array(*[F.when(F.length("_window") >= n, F.substring("_window", 1, n))
                      for n in lengths])
    spots = spots.withColumn("_head", F.explode(F.array_compact(grams)))
    heads = words.select(F.col("_gram").alias("_head"), F.length("_word").alias("_length")).distinct()
    cut = spots.join(small(heads), "_head").where(F.length("_window") >= F.col("_length")).select(
        "_h1", "_h2", F.expr("substring(_window, 1, _length)").alias("_word"))
    firsts = words.groupBy("_word").agg(F.min(F.struct("seq", "category")).alias("_first"))
    found = cut.join(small(firsts), "_word").groupBy("_h1", "_h2").agg(
        F.min("_first").alias("_first"))
    joined = df.withColumns({"_h1": key[0], "_h2": key[1]}).join(found, ["_h1", "_h2"], "left")
    return joined.withColumn(out, F.coalesce("_first.category", F.lit(OTHER))).drop(
        "_h1", "_h2", "_first")
