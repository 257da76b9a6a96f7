"""BPE encoding and decoding of whole texts with a segment tree over the ranks of adjacent pairs."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NONE = np.iinfo(np.int32).max  # the rank of a pair that does not merge
#: Unicode White_Space as a character class body.
WHITE = "\t-\r \x85\xa0  -     　"
WHITE_RUN = re.compile(f"[{WHITE}]+")
#: str.split() also splits at these, which are not White_Space.
SEPARATORS = re.compile("[\x1c-\x1f]")
WIDEST = 64  # symbols of the widest pieces that are merged side by side
CACHED = 200_000  # chunks whose ids a task remembers; it only saves time


def byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


@dataclass
class Vocabulary:
    """Tables of a word-level BPE file: NFC, lower case, a split pattern whose gaps are removed,
    byte letters, an end-of-word suffix, and no decoder (tokens are joined by a space)."""

    tokens: list[str]
    pattern: str
    special: dict[str, int]
    first: np.ndarray  # id of a byte inside a piece
    last: np.ndarray  # id of a byte that ends a piece
    pairs: np.ndarray  # left id << 32 | right id, ascending
    ranks: np.ndarray
    merged: np.ndarray
    by_pair: dict = field(default_factory=dict)

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, end = spec["model"], spec["model"]["end_of_word_suffix"] or ""
        ids = model["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = [""] * (max([*ids.values(), *special.values()]) + 1)
        for token, i in [*ids.items(), *special.items()]:
            tokens[i] = token
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        pairs = np.array([ids[a] << 32 | ids[b] for a, b in merges], np.int64)
        merged = np.array([ids[a + b] for a, b in merges], np.int32)
        order = np.argsort(pairs, kind="stable")
        letters = byte_letters()
        return cls(tokens, split["pattern"]["Regex"].replace(r"\s", WHITE), special,
                   np.array([ids[c] for c in letters], np.int32),
                   np.array([ids[c + end] for c in letters], np.int32),
                   pairs[order], order.astype(np.int32), merged[order])

    def look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of pairs; a negative id is no symbol."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        known = (self.pairs[at] == key) & (left >= 0) & (right >= 0)
        return np.where(known, self.ranks[at], NONE), self.merged[at]

    def pair(self, left: int, right: int) -> tuple[int, int]:
        if not self.by_pair:
            self.by_pair.update(zip(self.pairs.tolist(),
                                    zip(self.ranks.tolist(), self.merged.tolist())))
        return self.by_pair.get(left << 32 | right, (NONE, -1))


def merge_side_by_side(vocab: Vocabulary, sym: np.ndarray) -> np.ndarray:
    """Merge all rows of ``sym`` (pieces, padded with -1 to a power of two of columns) to the end.

    Each row has its own segment tree over the ranks of its adjacent pairs, in heap order: leaf
    ``width + i`` is the pair that starts at symbol i, a node is the minimum of its children. The
    root is the lowest rank; walking down, left child first, finds its leftmost place. A merge
    changes three leaves and their paths. All rows take a step together until no root can merge.
    Merged-away symbols become -1.
    """
    m, width = sym.shape
    tree = np.full((m, 2 * width), NONE, np.int32)
    tree[:, width:2 * width - 1] = vocab.look(sym[:, :-1], sym[:, 1:])[0]
    for i in range(width - 1, 0, -1):
        np.minimum(tree[:, 2 * i], tree[:, 2 * i + 1], out=tree[:, i])
    # One more column stands for "none" on both sides.
    sym = np.concatenate([sym, np.full((m, 1), -1, np.int32)], axis=1)
    after = np.tile(np.arange(1, width + 2, dtype=np.int32), (m, 1))
    after[:, -1] = width
    before = np.tile(np.arange(-1, width, dtype=np.int32), (m, 1))
    before[:, 0] = width

    def put(rows: np.ndarray, at: np.ndarray, rank: np.ndarray) -> None:
        node = at + width
        tree[rows, node] = rank
        while node[0] > 1:
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    rows = np.arange(m)
    while len(rows := rows[tree[rows, 1] < NONE]):
        least, node = tree[rows, 1], np.ones(len(rows), np.int64)
        while node[0] < width:
            node = 2 * node
            node += tree[rows, node] != least
        at = node - width
        gone = after[rows, at]
        follow, ahead = after[rows, gone], before[rows, at]
        new = vocab.look(sym[rows, at], sym[rows, gone])[1]
        sym[rows, at], sym[rows, gone] = new, -1
        after[rows, at] = follow
        before[rows, follow] = at
        put(rows, gone, np.full(len(rows), NONE, np.int32))
        put(rows, at, vocab.look(new, sym[rows, follow])[0])
        inner = ahead < width
        if inner.any():
            some, left = rows[inner], ahead[inner]
            put(some, left, vocab.look(sym[some, left], new[inner])[0])
    return sym[:, :width]


def merge_one(vocab: Vocabulary, symbols: list[int]) -> list[int]:
    """The same tree for one long piece: a logarithmic update for each merge."""
    n = len(symbols)
    width = 1 << max(1, (n - 1).bit_length())
    tree = [NONE] * (2 * width)
    for i in range(n - 1):
        tree[width + i] = vocab.pair(symbols[i], symbols[i + 1])[0]
    for i in range(width - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(at: int, rank: int) -> None:
        node = at + width
        tree[node] = rank
        while node > 1:
            node >>= 1
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

    while (least := tree[1]) < NONE:
        node = 1
        while node < width:
            node *= 2
            node += tree[node] != least
        at = node - width
        gone = after[at]
        follow, ahead = after[gone], before[at]
        symbols[at], symbols[gone] = vocab.pair(symbols[at], symbols[gone])[1], -1
        after[at] = follow
        put(gone, NONE)
        put(at, vocab.pair(symbols[at], symbols[follow])[0] if follow < n else NONE)
        if follow < n:
            before[follow] = at
        if ahead >= 0:
            put(ahead, vocab.pair(symbols[ahead], symbols[at])[0])
    return [s for s in symbols if s >= 0]


def encode_pieces(vocab: Vocabulary, pieces: list[bytes]) -> dict[bytes, bytes]:
    """Ids, as int32 bytes, of every distinct piece."""
    found, groups = {}, {}
    for piece in pieces:
        if len(piece) > WIDEST:
            symbols = vocab.first[np.frombuffer(piece, np.uint8)]
            symbols[-1] = vocab.last[piece[-1]]
            found[piece] = np.array(merge_one(vocab, symbols.tolist()), np.int32).tobytes()
        else:
            groups.setdefault(1 << max(1, (len(piece) - 1).bit_length()), []).append(piece)
    for width, group in groups.items():
        sizes = np.fromiter(map(len, group), np.int64, len(group))
        ends = np.cumsum(sizes)
        letters = np.frombuffer(b"".join(group), np.uint8)
        row = np.repeat(np.arange(len(group)), sizes)
        sym = np.full((len(group), width), -1, np.int32)
        sym[row, np.arange(len(letters)) - np.repeat(ends - sizes, sizes)] = vocab.first[letters]
        sym[np.arange(len(group)), sizes - 1] = vocab.last[letters[ends - 1]]
        sym = merge_side_by_side(vocab, sym)
        kept = sym >= 0
        flat, cuts = sym[kept].tobytes(), [0, *(4 * np.cumsum(kept.sum(axis=1))).tolist()]
        found.update((p, flat[a:b]) for p, a, b in zip(group, cuts, cuts[1:]))
    return found


class Encoder:
    """Ids of texts. White space never lies inside a token, so the ids of a chunk between white
    space do not depend on its surroundings and can be remembered."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.known = vocab, {}
        self.pattern = regex.compile(vocab.pattern)
        self.special = re.compile("(" + "|".join(map(re.escape, vocab.special)) + ")")

    def pieces(self, chunk: str) -> Iterator[int | bytes]:
        """Ids of special tokens and the bytes of the pieces between them."""
        parts = self.special.split(chunk) if self.vocab.special else [chunk]
        for i, part in enumerate(parts):
            if i % 2:
                yield self.vocab.special[part]
            elif part:
                # Letter by letter: a capital sigma never takes its final form.
                plain = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                yield from (p.encode() for p in self.pattern.findall(plain))

    def learn(self, chunks: Iterable[str]) -> None:
        split = {c: list(self.pieces(c)) for c in chunks}
        ids = encode_pieces(self.vocab, list(dict.fromkeys(
            p for ps in split.values() for p in ps if isinstance(p, bytes))))
        for chunk, ps in split.items():
            self.known[chunk] = b"".join(
                ids[p] if isinstance(p, bytes) else np.int32(p).tobytes() for p in ps)

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        chunked = [WHITE_RUN.split(t) if t and SEPARATORS.search(t) else (t or "").split()
                   for t in texts]
        if len(self.known) > CACHED:
            self.known = {}
        missing = set().union(*chunked)
        missing.difference_update(self.known)
        self.learn(missing)
        return [b"".join(map(self.known.__getitem__, chunks)) for chunks in chunked]


def _slices(batch: pa.RecordBatch, column: int, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``most`` bytes in a column; a longer value is a run of its own."""
    sizes = np.diff(np.asarray(batch.column(column).cast(pa.binary()).buffers()[1]).view(np.int32)
                    [batch.column(column).offset:][:len(batch) + 1])
    start = total = 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and total + size > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < len(batch):
        yield batch.slice(start)


def _lists(parts: list[bytes]) -> pa.ListArray:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
    values = pa.array(np.frombuffer(b"".join(parts), np.int32))
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def encode(docs: DataFrame, vocabulary: str, decoded: bool = False) -> DataFrame:
    """``doc_id, ids`` (array of int) of every whole text, one row per input row.

    ``vocabulary`` is the path of a word-level BPE file; the driver reads it and tasks get its
    tables. Special tokens in a text keep their own ids; none is added. ``decoded=True`` also
    returns ``decoded``, the text of the ids, from the same pass.

    * Null text: like the empty text, no ids. Null ``doc_id``: kept.
    * Very long texts and words without a space: whole; a word of n bytes takes n log n steps.
    * Ties: of equal ranks the leftmost pair merges first. Repeated rows: each is returned.
    * Empty table: empty result. Other columns are ignored, whatever they are called.
    """
    vocab = Vocabulary.read(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocab)
        for batch in batches:
            for part in _slices(batch, 1):
                ids = encoder(part.column(1).to_pylist())
                columns = {"doc_id": part.column(0), "ids": _lists(ids)}
                if decoded:
                    columns["decoded"] = pa.array([_text(vocab, i) for i in ids], pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, ids array<int>" + ", decoded string" * decoded
    return _rows(docs).mapInArrow(run, schema)


def _text(vocab: Vocabulary, ids: bytes) -> str:
    return " ".join(map(vocab.tokens.__getitem__, np.frombuffer(ids, np.int32).tolist()))


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, decoded`` of ``doc_id, ids``: all tokens, special ones too, joined by a space, as
    the file names no decoder. Null and empty ids give the empty text."""
    vocab = Vocabulary.read(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 200):
                part = batch.slice(start, 200)
                texts = [_text(vocab, np.array(i.as_py() or [], np.int32).tobytes())
                         for i in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())],
                                                 names=["doc_id", "decoded"])

    rows = encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>"))
    return rows.mapInArrow(run, "doc_id long, decoded string")


def token_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: of the decimal ids joined by one space and
    of the decoded text."""
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encode(docs, vocabulary, decoded=True).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
