"""HTML extraction: a bidirectional LSTM in numpy labels every block of a page."""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements of HTML that start and end a block, have no content, or hold no markup.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label "
    "legend li main menu nav noscript ol optgroup option p pre search section select summary table "
    "tbody td tfoot th thead title tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW_TAGS = frozenset("script style textarea template iframe".split())
#: A start tag of the key ends an open element of the value at once.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"},
          "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"},
          "option": {"option"}}
CLOSES |= {t: {"p"} for t in "div article section ul ol table h1 h2 h3 h4 h5 h6 form nav header "
           "footer aside main blockquote pre".split()}
# Names that pages give to the containers of each kind of content.
BODY_NAMES = ["article", "main", "div post", "div content", "div entry content", "div article body",
              "section article", "div story text", "div post content", "main content", "section",
              "div text", "div", "article post", "div body"]
OTHER_NAMES = {
    "menu": ["nav", "div menu", "ul navbar", "div navigation", "ul nav", "div breadcrumb",
             "div topnav", "ul menu"],
    "header": ["header", "div header", "div masthead", "div top bar", "header site header"],
    "footer": ["footer", "div footer", "div copyright", "footer site footer", "div bottom"],
    "sidebar": ["aside", "div sidebar", "div related", "aside widget", "div recommended", "div tags",
                "div widget", "div share social"],
    "notice": ["div cookie notice", "div notice", "div consent banner", "div alert", "div gdpr",
               "div popup", "div paywall", "dialog modal", "noscript"],
    "advert": ["div ad", "div ads", "div advert", "aside sponsored", "div promo", "div banner",
               "div advertisement", "section sponsor"],
    "form": ["form", "div newsletter subscribe", "form search", "div login", "form signup",
             "form comment form", "search"],
    "comments": ["div comments", "section comments", "ol commentlist", "div comment", "div replies",
                 "section discussion", "ul comment list", "article comment", "div disqus thread"],
}

OPEN = re.compile(r"(<!--.*?(?:-->|\Z))|<(/?)([a-zA-Z][^\s/>]*)|<[!?]", re.S)
SPECIAL = re.compile(r"[>\"']")
NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
WORDS = re.compile(r"[a-z]+")
PATH_SIZE, WORD_SIZE, SHAPE_SIZE = 256, 32, 6
WIDTH = PATH_SIZE + WORD_SIZE + SHAPE_SIZE
HIDDEN = 16
BATCH = 2000  # blocks, with padding, that the labeller takes at once


class Ends:
    """Where the tags of a page end: at the first ``>`` outside quotes, or at the first one at all
    where a quote is never closed. Each quote is looked at once, however many tags lead to it: one
    from which no end was found is remembered, and so is the next mark after a place."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.doomed: set[int] = set()
        self.since, self.mark = 0, -1

    def special(self, at: int) -> int:
        """The place of the next ``>`` or quote from ``at`` on."""
        if not self.since <= at <= self.mark:
            found = SPECIAL.search(self.page, at)
            self.since, self.mark = at, found.start() if found else len(self.page)
        return self.mark

    def end(self, at: int, quoted: bool = True) -> int:
        """The place behind the tag whose attributes start at ``at``; -1 if it never ends. Without
        ``quoted``, quotes mean nothing."""
        if at > self.last:
            return -1
        page, seen, place = self.page, [], at
        while quoted and (mark := self.special(place)) < len(page):
            if page[mark] == ">":
                return mark + 1
            if mark in self.doomed:
                break
            seen.append(mark)
            close = page.find(page[mark], mark + 1)
            if close < 0:
                break
            place = close + 1
        self.doomed.update(seen)
        return page.index(">", at) + 1


@dataclass
class Block:
    text: str
    path: tuple[str, ...]  # "tag word word" from the root to the block
    linked: int  # characters inside links


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order: text between the edges of block elements, character
    references decoded, white space turned into single spaces. Scripts, styles and comments are no
    text; elements that are never closed end with their container."""
    found: list[Block] = []
    stack: list[tuple[str, str]] = []
    parts: list[str] = []
    linked = links = at = 0
    opened: Counter[str] = Counter()

    def close_one() -> str:
        tag = stack.pop()[0]
        opened[tag] -= 1
        return tag

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            found.append(Block(text, tuple(p for _, p in stack), linked))
        parts.clear()
        linked = 0

    ends = Ends(page)
    while at < len(page):
        token = OPEN.search(page, at)
        end = -1
        if token:
            end = token.end() if token[1] else ends.end(token.end(), quoted=bool(token[3]))
        if end < 0:
            token = None  # what is left holds no whole tag
        run = page[at:token.start() if token else len(page)]
        if run:
            text = html.unescape(run) if "&" in run else run
            parts.append(text)
            linked += len(text) if links else 0
        if not token:
            break
        attributes, at = page[token.end():end], end
        tag = (token[3] or "").lower()
        if not tag:
            continue
        if token[2]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag in BLOCK_TAGS:
                flush()
                if opened[tag]:
                    while close_one() != tag:
                        pass
        elif tag in RAW_TAGS:
            if not attributes.endswith("/>"):
                close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                at = close.end() if close else len(page)
        elif tag == "br":
            parts.append(" ")
        elif tag == "a":
            links += 1
        elif tag in BLOCK_TAGS:
            flush()
            links = 0
            while stack and stack[-1][0] in CLOSES.get(tag, ()):
                close_one()
            if tag not in VOID_TAGS:
                names = WORDS.findall(" ".join(NAMES.findall(attributes[:-1])).lower())
                stack.append((tag, " ".join([tag, *names])))
                opened[tag] += 1
    flush()
    return found


def _slot(token: str, size: int) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % size


class Features:
    """The input rows of a page: hashed tags and names of the path, with the innermost ones marked,
    hashed words of the text, and its length, links and punctuation."""

    def __init__(self):
        self.paths: dict[tuple, np.ndarray] = {}
        self.words: dict[str, int] = {}

    def path(self, path: tuple[str, ...]) -> np.ndarray:
        if path not in self.paths:
            if len(self.paths) > 5000:
                self.paths = {}
            row = np.zeros(PATH_SIZE, np.float32)
            for depth, step in enumerate(reversed(path)):
                tag, *names = step.split(" ")
                for token in [f"<{tag}", *names]:
                    row[_slot(token, PATH_SIZE)] = 1
                if depth < 2:
                    row[_slot(f"{depth}<{tag}", PATH_SIZE)] = 1
            self.paths[path] = row
        return self.paths[path]

    def __call__(self, page: list[Block]) -> np.ndarray:
        out = np.zeros((len(page), WIDTH), np.float32)
        if len(self.words) > 200_000:
            self.words = {}
        for row, block in zip(out, page):
            row[:PATH_SIZE] = self.path(block.path)
            words = block.text.split(" ")
            for word in set(words).difference(self.words):
                self.words[word] = _slot(word, WORD_SIZE)
            seen = np.bincount(list(map(self.words.__getitem__, words)), minlength=WORD_SIZE)
            row[PATH_SIZE:PATH_SIZE + WORD_SIZE] = seen / len(words)
            size = len(block.text)
            row[-6:] = (np.log1p(size) / 8, min(1.0, block.linked / size), len(words) < 5,
                        block.text[-1] in ".!?", block.text.count("|") > 0,
                        block.text[0] in "©")
        return out


class Labeller:
    """A bidirectional LSTM and a logistic output over the blocks of many pages at once. Pages are
    time-major and padded; padding leaves the state as it is."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.weights = {}
        for side in ("f", "b"):
            self.weights[f"w{side}"] = rng.normal(0, 0.15, (WIDTH, 4 * HIDDEN))
            self.weights[f"u{side}"] = rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN))
            self.weights[f"c{side}"] = np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)
        self.weights["v"] = rng.normal(0, 0.3, 2 * HIDDEN)
        self.weights["o"] = np.zeros(1)

    def _pass(self, x: np.ndarray, mask: np.ndarray, side: str, keep: bool
              ) -> tuple[np.ndarray, list]:
        u = self.weights[f"u{side}"]
        drive = x @ self.weights[f"w{side}"] + self.weights[f"c{side}"]
        steps = range(len(x)) if side == "f" else range(len(x) - 1, -1, -1)
        h, c = np.zeros((2, x.shape[1], HIDDEN))
        states, trail = np.zeros((*x.shape[:2], HIDDEN)), []
        for t in steps:
            gates = drive[t] + h @ u
            sig = 1 / (1 + np.exp(-np.clip(gates[:, :3 * HIDDEN], -30, 30)))
            i, f, o = sig[:, :HIDDEN], sig[:, HIDDEN:2 * HIDDEN], sig[:, 2 * HIDDEN:]
            g = np.tanh(gates[:, 3 * HIDDEN:])
            on = mask[t][:, None]
            fresh = f * c + i * g
            squashed = np.tanh(fresh)
            if keep:
                trail.append((t, h, c, i, f, o, g, squashed, on))
            c = np.where(on, fresh, c)
            h = np.where(on, o * squashed, h)
            states[t] = h
        return states, trail

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False
                ) -> tuple[np.ndarray, tuple]:
        """Probabilities and states; ``keep`` also keeps every step, which only training needs."""
        forth, trail_f = self._pass(x, mask, "f", keep)
        back, trail_b = self._pass(x, mask, "b", keep)
        both = np.concatenate([forth, back], axis=2)
        logits = both @ self.weights["v"] + self.weights["o"]
        return 1 / (1 + np.exp(-np.clip(logits, -30, 30))), (both, trail_f, trail_b)

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, (both, *trails) = self.forward(x, mask, keep=True)
        error = (p - y) * mask / mask.sum()
        out = {"v": error.ravel() @ both.reshape(-1, 2 * HIDDEN), "o": np.array([error.sum()])}
        for k, (side, trail) in enumerate(zip("fb", trails)):
            v = self.weights["v"][k * HIDDEN:(k + 1) * HIDDEN]
            u = self.weights[f"u{side}"]
            du, ddrive = np.zeros_like(u), np.zeros((*x.shape[:2], 4 * HIDDEN))
            dh, dc = np.zeros((2, x.shape[1], HIDDEN))
            for t, h, c, i, f, o, g, squashed, on in reversed(trail):
                dh = dh + error[t][:, None] * v
                live = np.where(on, dh, 0)
                df = np.where(on, dc, 0) + live * o * (1 - squashed ** 2)
                gates = np.concatenate([df * g * i * (1 - i), df * c * f * (1 - f),
                                        live * squashed * o * (1 - o), df * i * (1 - g ** 2)],
                                       axis=1)
                ddrive[t] = gates
                du += h.T @ gates
                dh = np.where(on, gates @ u.T, dh)
                dc = np.where(on, df * f, dc)
            out[f"u{side}"] = du
            out[f"w{side}"] = x.reshape(-1, WIDTH).T @ ddrive.reshape(-1, 4 * HIDDEN)
            out[f"c{side}"] = ddrive.sum(axis=(0, 1))
        return out

    def train(self, pages: list[tuple[np.ndarray, np.ndarray]], rounds: int, seed: int,
              batch: int = 16, rate: float = 0.01) -> None:
        """Adam on the cross-entropy of every block."""
        rng, step = np.random.default_rng(seed), 0
        m = {k: np.zeros_like(w) for k, w in self.weights.items()}
        s = {k: np.zeros_like(w) for k, w in self.weights.items()}
        for _ in range(rounds):
            order = rng.permutation(len(pages))
            for start in range(0, len(order), batch):
                chosen = [pages[i] for i in order[start:start + batch]]
                x, mask = stacked([c[0] for c in chosen])
                y, _ = stacked([c[1][:, None] for c in chosen])
                step += 1
                for k, g in self.gradients(x, mask, y[:, :, 0]).items():
                    g = np.clip(g, -1, 1)
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.999 * s[k] + 0.001 * g * g
                    self.weights[k] -= rate * (m[k] / (1 - 0.9 ** step)) / (
                        np.sqrt(s[k] / (1 - 0.999 ** step)) + 1e-8)

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """The probability of every block of every page to be main text. Pages of like length share
        a batch of at most ``BATCH`` places, padding included; a longer page is alone."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        for some in batches(order, [len(p) for p in pages]):
            x, mask = stacked([pages[i] for i in some])
            p = self.forward(x, mask)[0]
            for k, i in enumerate(some):
                out[i] = p[:len(pages[i]), k]
        return out


def batches(order: list[int], sizes: list[int]) -> Iterator[list[int]]:
    """Runs of ``order``, by ascending size, whose largest size times number is at most ``BATCH``;
    a larger one is alone."""
    some: list[int] = []
    for i in order:
        if some and sizes[i] * (len(some) + 1) > BATCH:
            yield some
            some = []
        some.append(i)
    if some:
        yield some


def stacked(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pages as one time-major array, and which places hold a block."""
    x = np.zeros((max(map(len, pages)), len(pages), pages[0].shape[1]))
    mask = np.zeros(x.shape[:2], bool)
    for k, page in enumerate(pages):
        x[:len(page), k], mask[:len(page), k] = page, True
    return x, mask


def is_main(block: Block) -> bool:
    """The rule that labels real pages for training: inside an article or main element."""
    return any(step.split(" ")[0] in ("article", "main") for step in block.path)


def _dressed(rng: np.random.Generator, texts: list[str], spare: list[str]
             ) -> list[tuple[Block, int]]:
    """A page made of real paragraphs: main text in one kind of container, and other kinds of
    content around it and inside it."""
    root = ("html", "body", *(["div page", "div wrapper", "div container", "div site"][
        rng.integers(4)] for _ in range(rng.integers(3))))
    pick = lambda items: items[rng.integers(len(items))]
    own = (*root, pick(BODY_NAMES))

    def other(kind: str, base: tuple[str, ...]) -> list[tuple[Block, int]]:
        path, made = (*base, pick(OTHER_NAMES[kind])), []
        if kind == "comments" and rng.random() < 0.5:
            path += (pick(["div comment", "li comment", "article comment", "li"]),)
        elif rng.random() < 0.3:
            path += (pick(["div", "div inner", "ul", "section"]),)
        inner = {"menu": "li", "form": "label", "comments": "p"}.get(kind)
        for _ in range(rng.integers(1, 5)):
            text = pick(spare)
            words = text.split(" ")
            text = " ".join(words[:rng.integers(1, 4 if kind in ("menu", "form") else 60)])
            leaf = inner or pick(["p", "div", "h3", "li", ""])
            leaf = "" if rng.random() < 0.3 else leaf
            link = len(text) if kind == "menu" or rng.random() < 0.2 else 0
            made.append((Block(text, path + ((leaf,) if leaf else ()), link), 0))
        return made

    page: list[tuple[Block, int]] = []
    if rng.random() < 0.8:
        page.append((Block(pick(texts)[:60], ("html", "head", "title"), 0), 0))
    for kind in OTHER_NAMES:
        if kind in ("menu", "header", "notice", "advert") and rng.random() < 0.5:
            page += other(kind, root)
    if rng.random() < 0.8:
        page.append((Block(pick(texts)[:60], (*own, pick(["h1", "h2", "header h1"])), 0), 1))
    for text in texts:
        leaf = pick(["p"] * 8 + ["h2", "h3", "li", "blockquote", "pre", "td", "", "figcaption"])
        text = text if rng.random() < 0.8 else " ".join(text.split(" ")[:rng.integers(1, 12)])
        path = own + (("ul",) if leaf == "li" else ()) + ((leaf,) if leaf else ())
        page.append((Block(text, path, 0), 1))
        if rng.random() < 0.12:
            page += other(pick(["advert", "sidebar", "form", "notice"]), own)
    for kind in OTHER_NAMES:
        if kind not in ("header", "menu") and rng.random() < 0.4:
            page += other(kind, own if kind == "comments" and rng.random() < 0.5 else root)
    return page


def fit(pages: DataFrame, sample: int = 300, max_chars: int = 200_000, copies: int = 2,
        rounds: int = 8, seed: int = 7) -> Labeller:
    """Train the labeller on the ``sample`` pages with the smallest hash of their id (pages of at
    most ``max_chars`` characters; both bound what reaches the driver).

    Real pages are labelled by their article and main elements. Their paragraphs are also set anew,
    ``copies`` times a page, into containers that pages use for articles and for everything else, so
    that the labeller learns the names and not one template. All draws are seeded.
    """
    rows = pages.where("html is not null").where(F.length("html") <= max_chars).select(
        F.col("page_id").cast("long"), F.col("html").cast("string"))
    # The cut is found on hashes alone, so that tasks send no page that is not chosen.
    place = F.xxhash64("page_id")
    cut = rows.select(place.alias("h")).orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    chosen = rows.where(place <= F.lit(cut)).orderBy(
        place, "page_id", F.xxhash64("html")).limit(sample)
    parsed = [blocks(r.html) for r in chosen.collect()]
    features, rng, ready = Features(), np.random.default_rng(seed), []
    every = [b.text for page in parsed for b in page] or ["text"]
    for page in parsed:
        main = [b.text for b in page if is_main(b)]
        if main:
            ready.append((features(page), np.array([is_main(b) for b in page], np.float32)))
        for _ in range(copies if page else 0):
            made = _dressed(rng, (main or [b.text for b in page])[:30], every)
            ready.append((features([b for b, _ in made]),
                          np.array([y for _, y in made], np.float32)))
    labeller = Labeller(seed)
    labeller.train(ready, rounds, seed)
    return labeller


def extract(pages: DataFrame, labeller: Labeller, threshold: float = 0.5) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page: the blocks labelled as main text, in page
    order, joined by an empty line.

    * Null and empty html, and pages without text: the empty text. Null ids and urls: kept.
    * Very long pages: whole; the labeller's state runs through all blocks.
    * Ties: a block at the threshold is main text. Repeated rows: each is returned.
    * Broken markup: see ``blocks``. Empty table: empty result.
    * Other columns are ignored, whatever they are called.
    """
    def run(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in arrived:
            for start in range(0, len(batch), 128):
                part = batch.slice(start, 128)
                parsed = [blocks(p or "") for p in part.column(2).to_pylist()]
                texts, sizes = [""] * len(parsed), list(map(len, parsed))
                order = sorted(filter(sizes.__getitem__, range(len(parsed))), key=sizes.__getitem__)
                for some in batches(order, sizes):
                    marks = labeller.label([features(parsed[i]) for i in some])
                    for i, mark in zip(some, marks):
                        texts[i] = "\n\n".join(
                            b.text for b, p in zip(parsed[i], mark) if p >= threshold)
                yield pa.RecordBatch.from_pydict({
                    "page_id": part.column(0), "url": part.column(1),
                    "text": pa.array(texts, pa.string()),
                    "n_chars": pa.array(list(map(len, texts)), pa.int64())})

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def main_text(pages: DataFrame, **fitted) -> DataFrame:
    """Train on a bounded sample of ``pages`` and extract all of them; see ``fit``, ``extract``."""
    return extract(pages, fit(pages, **fitted))
