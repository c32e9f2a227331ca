"""Main text of web pages by a recurrent block labeller.

A page becomes its sequence of leaf blocks. A block is read as two vectors, one summed over its tag path
(tags, and the words of class and id), one averaged over its hashed words, and a few measures. A
bidirectional LSTM over the whole page decides for each block from its surroundings whether it belongs to
the article.

The training pages are a bounded sample. Each is labelled by what its elements mean, and is also taken
apart and put together again in other layouts (other containers, with menus, notices, adverts, sidebars,
forms, reader comments around and between the paragraphs), so that the network learns paths that the
sample does not hold.

Null and empty pages give an empty text, an empty table no rows. Truncated pages and unclosed elements are read as far as they
go; a path holds DEEPEST names at most, so that the work grows with the length of a page however deep it is nested.
Repeated rows are extracted one by one. Columns of the input that clash with text and n_chars are replaced.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import slices, with_fields

PAGES = 240
LONGEST = 60_000
PLACES = 4096
WIDTH = 12
HIDDEN = 16
MEASURES = 6
EPOCHS = 5

#: Elements that begin a block, that hold no text for readers, and that end an open element of their kind: fixed values.
BLOCKS = frozenset("""address article aside blockquote body button caption center dd details dialog div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html label legend li main menu nav ol option p pre section
select summary table tbody td textarea tfoot th thead title tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"p": ("p",), "li": ("li",), "option": ("option",), "dt": ("dt", "dd"), "dd": ("dt", "dd"),
          "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr")}
ENDS_PARAGRAPH = BLOCKS - {"button", "label", "option", "legend", "summary", "caption", "title"}

#: What marks a container as article or as something else, for the labels of the training pages: fixed values.
ARTICLE_TAGS = frozenset(("article", "main"))
OTHER_TAGS = frozenset(("nav", "header", "footer", "aside", "form", "button", "select", "option", "menu", "dialog"))
ARTICLE_NAMES = ("article", "content", "post", "entry", "story", "body", "text", "main")
OTHER_NAMES = {
    "menu": ("menu", "nav", "navigation", "navbar", "breadcrumbs", "tabs", "toc"),
    "header": ("header", "masthead", "topbar", "logo", "site-header"),
    "footer": ("footer", "copyright", "legal", "site-footer", "bottom"),
    "sidebar": ("sidebar", "aside", "related", "widget", "recommended", "popular", "tags"),
    "notice": ("notice", "cookie", "cookie-notice", "consent", "banner", "alert", "popup", "modal"),
    "advert": ("ad", "ads", "advert", "advertisement", "promo", "sponsored", "sponsor"),
    "form": ("form", "search", "subscribe", "newsletter", "login", "signup"),
    "comments": ("comments", "comment", "comment-list", "replies", "discussion", "disqus", "responses"),
    "share": ("share", "social", "follow"),
}

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|svg|iframe|object)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)", re.S | re.I)
#: Elements that bound the search for an open element of the same kind.
CONTAINERS = ("table", "ul", "ol", "select", "dl")
#: A path holds so many names at most: elements further inside have the path of the last one that fits.
DEEPEST = 512
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
PARTS = re.compile(r"[^a-z]+")


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: int


class _Open:
    """The open elements, with the places of each kind, so that a tag costs the same however many are open."""

    def __init__(self):
        self.tags: list[str] = []
        self.paths: list[tuple[str, ...]] = [()]
        self.places: dict[str, list[int]] = {}

    def add(self, tag: str, names: list[str]) -> None:
        here = self.paths[-1]
        self.paths.append((*here, tag, *names) if len(here) + 1 + len(names) <= DEEPEST else here)
        self.places.setdefault(tag, []).append(len(self.tags))
        self.tags.append(tag)

    def last(self, tag: str) -> int:
        places = self.places.get(tag)
        return places[-1] if places else -1

    def close(self, tag: str, above: int = -1) -> None:
        """End the last element of this kind, with all inside it, unless it lies at or below place `above`."""
        first = self.last(tag)
        if first > above:
            while len(self.tags) > first:
                self.places[self.tags.pop()].pop()
                self.paths.pop()


def parse(page: str | None) -> list[Block]:
    """Leaf blocks in page order; their path holds tags, and the names in class, id and role after a dot. What stands in a
    head, which ends at its end tag, at body or at the first block, is no block."""
    blocks: list[Block] = []
    stack = _Open()
    pieces: list[str] = []
    linked = links = at = 0
    in_head = False
    page = page or ""

    def flush() -> None:
        nonlocal linked
        if pieces:
            raw = "".join(pieces)
            text = " ".join((entities.unescape(raw) if "&" in raw else raw).split())
            if text:
                blocks.append(Block(stack.paths[-1], text, linked))
            pieces.clear()
        linked = 0

    def text_until(end: int) -> None:
        nonlocal linked
        if end > at and not in_head:
            pieces.append(page[at:end])
            if links:
                linked += end - at

    for m in MARKUP.finditer(page):
        text_until(m.start())
        at = m.end()
        tag = (m[3] or m[6] or "").lower()
        if not tag:
            if m[1]:
                pieces.append(" ")
            continue
        closing = bool(m[2] or m[5])
        if tag == "head":
            in_head = not closing
            continue
        if in_head and (tag == "title" or tag not in BLOCKS):
            continue
        in_head = False
        if tag == "a":
            links = 0 if closing else 1
        elif tag == "br":
            pieces.append(" ")
        elif tag in BLOCKS:
            flush()
            links = 0
            if closing:
                stack.close(tag)
                continue
            if tag in ENDS_PARAGRAPH:
                stack.close("p")
            for kind in CLOSES.get(tag, ()):
                if kind != "p":
                    stack.close(kind, max(map(stack.last, CONTAINERS)))
            if tag not in VOID:
                names = [x for v in NAMES.findall(m[4] or m[7] or "") for x in PARTS.split(v.lower()) if x]
                stack.add(tag, ["." + x for x in names])
    text_until(len(page))
    flush()
    return blocks


def meaning(path: tuple[str, ...]) -> bool:
    """Whether a block with this path is article text, going by its elements: the innermost telling one decides."""
    others = {x for names in OTHER_NAMES.values() for n in names for x in PARTS.split(n)}
    inside = False
    for x in path:
        name = x.lstrip(".")
        if x in OTHER_TAGS or x[0] == "." and name in others:
            return False
        if x in ARTICLE_TAGS or x[0] == "." and name in ARTICLE_NAMES:
            inside = True
    return inside


def relayout(blocks: list[Block], draw: np.random.Generator) -> list[tuple[Block, bool]]:
    """The blocks of a labelled page in another layout."""
    pick = lambda options: options[int(draw.integers(len(options)))]
    body = [b.text for b in blocks if meaning(b.path)] or ["x"]
    rest = [b.text for b in blocks if not meaning(b.path)] or ["x"]
    words = " ".join(rest + body[:2]).split()

    def phrase(least: int, most: int) -> str:
        a = int(draw.integers(len(words)))
        return " ".join(words[a:a + int(draw.integers(least, most + 1))]) or words[a]

    root = ("html", "body")
    wrap = pick(((), (), ("div",), ("div", ".wrapper"), ("div", ".page"), ("div", ".container")))

    def named(tag: str, kind: str) -> tuple[str, ...]:
        return (tag, *("." + x for x in PARTS.split(pick(OTHER_NAMES[kind])) if x))

    def other(kind: str) -> list[Block]:
        tags = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form"}
        outer = (tags[kind],) if kind in tags and draw.random() < 0.5 else named(pick(("div", "section", "ul", "div")), kind)
        if kind in tags and draw.random() < 0.3:
            outer = (tags[kind], *named("div", kind)[1:])
        here = root + (wrap if draw.random() < 0.5 else ()) + outer
        if kind in ("menu", "share") or kind in ("header", "footer", "sidebar") and draw.random() < 0.5:
            inner = pick((("ul", "li"), ("li",), ("div",), ("p",)))
            out = [Block(here + (pick(("h1", "h2", "p", "div")),), phrase(1, 5), 0)] if draw.random() < 0.3 else []
            for _ in range(int(draw.integers(2, 8))):
                t = phrase(1, 3)
                out.append(Block(here + inner, t, len(t) if draw.random() < 0.85 else 0))
            return out
        if kind == "form":
            return [Block(here + pick((("label",), ("button",), ("p",), ("div",), ("select", "option"), ())), phrase(1, 6), 0)
                    for _ in range(int(draw.integers(1, 5)))]
        if kind in ("comments", "sidebar"):
            inner = pick((("div", ".comment", "p"), ("li", "p"), ("p",), ("div",), ("div", ".comment"))) if kind == "comments" \
                else pick((("p",), ("li",), ("div", "p"), ("h3",)))
            out = [Block(here + ("h3",), phrase(1, 3), 0)] if draw.random() < 0.4 else []
            return out + [Block(here + inner, pick(body) if draw.random() < 0.5 else phrase(3, 40), 0)
                          for _ in range(int(draw.integers(1, 7)))]
        leaves = (("h1",), ("h1",), ("h2",), ("p",), ()) if kind == "header" else ((), ("p",), ("p",), ("div",), ("h3",))
        return [Block(here + pick(leaves), phrase(1, 25), 0)
                for _ in range(int(draw.integers(1, 3)))]

    names = ("." + pick(ARTICLE_NAMES),)
    inside = pick((("article",), ("main",), ("main", "article"), ("article", "div", *names), ("div", *names),
                   ("section", *names), ("main", "div", *names), ("article", *names)))
    out: list[tuple[Block, bool]] = []

    def put(kinds: tuple[str, ...], odds: float) -> None:
        for kind in kinds:
            if draw.random() < odds:
                out.extend((b, False) for b in other(kind))

    put(("header", "menu", "notice", "advert", "sidebar", "form"), 0.45)
    for i, text in enumerate(body):
        leaf = ("h1",) if i == 0 and draw.random() < 0.7 else pick(
            (("p",), ("p",), ("p",), ("p",), ("h2",), ("ul", "li"), ("blockquote", "p"), ("div",), ("pre",), ("table", "tr", "td")))
        if draw.random() < 0.15:
            text = phrase(1, 4)
        out.append((Block(root + wrap + inside + leaf, text, len(text) // 3 if draw.random() < 0.1 else 0), True))
        if draw.random() < 0.06:
            for kind in (pick(("advert", "share", "notice", "form", "sidebar")),):
                out.extend((Block(root + wrap + inside + b.path[2:], b.text, b.linked), False)
                           for b in other(kind) if len(b.path) > 2 and not meaning(b.path))
    put(("share", "comments", "sidebar", "advert", "form", "menu", "footer"), 0.45)
    return out


@dataclass
class Inputs:
    """Blocks of several pages: path places and word places with their owners, measures, blocks per page."""

    path: np.ndarray
    path_owner: np.ndarray
    word: np.ndarray
    word_owner: np.ndarray
    measures: np.ndarray
    sizes: list[int]


class Places(dict):
    def __missing__(self, name: str) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[name] = xxhash.xxh3_64_intdigest(name) % PLACES
        return value


def inputs(pages: list[list[Block]], known: Places) -> Inputs:
    path, path_owner, word, counts, measures = [], [], [], [], []
    row = 0
    for blocks in pages:
        for i, b in enumerate(blocks):
            names = [*b.path, "leaf " + b.path[-1] if b.path else "leaf"]
            path += [known["path " + x] for x in names]
            path_owner += [row] * len(names)
            words = b.text.lower().split(" ")
            word += map(known.__getitem__, words)
            counts.append(len(words))
            n = len(b.text)
            measures.append((np.log1p(n) / 5, min(1.0, b.linked / n), b.text[-1] in ".!?…\"'»”)", np.log1p(len(words)) / 4,
                             i / len(blocks), 1 / (1 + i)))
            row += 1
    return Inputs(np.array(path, np.int64), np.array(path_owner, np.int64), np.array(word, np.int64),
                  np.repeat(np.arange(row), counts), np.array(measures, np.float32).reshape(row, MEASURES),
                  [len(b) for b in pages])


@dataclass
class Model:
    """Embeddings of path and word places, the two directions of the LSTM, the output weights."""

    values: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def new(seed: int = 3) -> Model:
        draw = np.random.default_rng(seed)
        size = 2 * WIDTH + MEASURES
        values = {"path": draw.normal(0, 0.3, (PLACES, WIDTH)), "word": draw.normal(0, 0.1, (PLACES, WIDTH)),
                  "out": draw.normal(0, 0.2, 2 * HIDDEN + size), "bias": np.zeros(1)}
        for way in ("f", "b"):
            values[f"w{way}"] = draw.normal(0, 0.2, (size + HIDDEN, 4 * HIDDEN))
            values[f"c{way}"] = np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)  # gates: in, keep, candidate, out
        return Model({k: v.astype(np.float32) for k, v in values.items()})

    def embed(self, x: Inputs) -> np.ndarray:
        n = len(x.measures)
        made = np.zeros((n, 2 * WIDTH + MEASURES), np.float32)
        for k, (places, owner) in enumerate(((x.path, x.path_owner), (x.word, x.word_owner))):
            table = self.values[("path", "word")[k]]
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else []
            if len(first):
                made[owner[first], k * WIDTH:(k + 1) * WIDTH] = np.add.reduceat(table[places], first)
        made[:, WIDTH:2 * WIDTH] /= np.maximum(np.bincount(x.word_owner, minlength=n), 1)[:, None]
        made[:, 2 * WIDTH:] = x.measures
        return made


def _grid(sizes: list[int], backwards: bool) -> tuple[np.ndarray, np.ndarray]:
    """(steps x pages) index of the block each page reads at a step, and whether it reads one; pages in order of size."""
    offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    sizes = np.array(sizes)
    step = np.arange(max(sizes.max(), 1))[:, None]
    inside = step < sizes
    at = np.where(inside, offsets + (sizes - 1 - step if backwards else step), 0)
    return at, inside


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _read(model: Model, way: str, x: np.ndarray, at: np.ndarray, inside: np.ndarray, keep: list | None) -> np.ndarray:
    """Hidden state of every block in one direction; keep collects what the gradient needs."""
    w, c = model.values[f"w{way}"], model.values[f"c{way}"]
    out = np.zeros((len(x), HIDDEN), np.float32)
    h = s = np.zeros((at.shape[1], HIDDEN), np.float32)
    for t in range(len(at)):
        live = np.flatnonzero(inside[t])
        if not len(live):
            break
        if len(live) < len(h):  # finished pages leave the batch; what is left keeps its order
            alive = inside[t][mask] if t else inside[t]
            h, s = h[alive], s[alive]
        mask = inside[t]
        rows = at[t][live]
        z = np.concatenate([x[rows], h], axis=1)
        g = z @ w + c
        i, f, o = _sigmoid(g[:, :HIDDEN]), _sigmoid(g[:, HIDDEN:2 * HIDDEN]), _sigmoid(g[:, 3 * HIDDEN:])
        a = np.tanh(g[:, 2 * HIDDEN:3 * HIDDEN])
        before, s = s, f * s + i * a
        h = o * np.tanh(s)
        out[rows] = h
        if keep is not None:
            keep.append((live, rows, z, i, f, a, o, before, s))
    return out


def probabilities(model: Model, x: Inputs) -> np.ndarray:
    if not len(x.measures):
        return np.zeros(0)
    made = model.embed(x)
    both = [_read(model, way, made, *_grid(x.sizes, way == "b"), None) for way in ("f", "b")]
    return _sigmoid(np.concatenate([*both, made], axis=1) @ model.values["out"] + model.values["bias"])


def gradients(model: Model, x: Inputs, truth: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean cross-entropy, by back-propagation through both directions."""
    v, made = model.values, model.embed(x)
    keeps: dict[str, list] = {"f": [], "b": []}
    both = [_read(model, way, made, *_grid(x.sizes, way == "b"), keeps[way]) for way in ("f", "b")]
    top = np.concatenate([*both, made], axis=1)
    error = ((_sigmoid(top @ v["out"] + v["bias"]) - truth) / len(truth)).astype(np.float32)
    grad = {"out": error @ top, "bias": np.array([error.sum()], np.float32)}
    back = error[:, None] * v["out"]
    d_made = back[:, 2 * HIDDEN:].copy()
    for k, way in enumerate(("f", "b")):
        w = v[f"w{way}"]
        dw, dc = np.zeros_like(w), np.zeros_like(v[f"c{way}"])
        pages = len(x.sizes)
        dh, ds = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
        for live, rows, z, i, f, a, o, before, s in reversed(keeps[way]):
            th = np.tanh(s)
            h = back[rows, k * HIDDEN:(k + 1) * HIDDEN] + dh[live]
            d = ds[live] + h * o * (1 - th * th)
            g = np.concatenate([d * a * i * (1 - i), d * before * f * (1 - f), d * i * (1 - a * a), h * th * o * (1 - o)], axis=1)
            dw += z.T @ g
            dc += g.sum(axis=0)
            dz = g @ w.T
            d_made[rows] += dz[:, :-HIDDEN]
            dh[live], ds[live] = dz[:, -HIDDEN:], d * f
        grad[f"w{way}"], grad[f"c{way}"] = dw, dc
    share = np.maximum(np.bincount(x.word_owner, minlength=len(made)), 1)[:, None]
    for name, places, owner, d in (("path", x.path, x.path_owner, d_made[:, :WIDTH]),
                                   ("word", x.word, x.word_owner, d_made[:, WIDTH:2 * WIDTH] / share)):
        total = np.zeros_like(v[name])
        np.add.at(total, places, d[owner])
        grad[name] = total
    return grad


def fit(pages: list[str], epochs: int = EPOCHS, layouts: int = 4, seed: int = 7) -> Model:
    """Train on the given pages as they are and in `layouts` other layouts each, with Adam steps on 32 pages."""
    draw, known = np.random.default_rng(seed), Places()
    examples: list[tuple[list[Block], list[bool]]] = []
    for page in pages:
        blocks = parse(page)
        if not blocks:
            continue
        if any(meaning(b.path) for b in blocks):
            examples.append((blocks, [meaning(b.path) for b in blocks]))
        for _ in range(layouts):
            made = relayout(blocks, draw)
            examples.append(([b for b, _ in made], [y for _, y in made]))
    model = Model.new()
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.values.items()}
    step = 0
    for epoch in range(epochs):
        turn = draw.permutation(len(examples))
        for a in range(0, len(turn), 32):
            part = sorted((examples[i] for i in turn[a:a + 32]), key=lambda e: -len(e[0]))
            x = inputs([blocks for blocks, _ in part], known)
            grad = gradients(model, x, np.concatenate([np.array(y, np.float32) for _, y in part]))
            step += 1
            rate = 0.02 * (1 - epoch / epochs) + 0.002
            for k, g in grad.items():
                m, s = moments[k]
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                model.values[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return model


def main_texts(model: Model, pages: list[str | None], known: Places) -> list[str]:
    """The kept blocks of each page, joined by an empty line."""
    parsed = [parse(p) for p in pages]
    order = sorted(range(len(pages)), key=lambda i: -len(parsed[i]))
    out = [""] * len(pages)
    full = [i for i in order if parsed[i]]
    if full:
        p = probabilities(model, inputs([parsed[i] for i in full], known))
        at = 0
        for i in full:
            n = len(parsed[i])
            out[i] = "\n\n".join(b.text for b, q in zip(parsed[i], p[at:at + n]) if q >= 0.5)
            at += n
    return out


def train(pages: DataFrame, key: str = "page_id", page: str = "html", most: int = PAGES) -> Model:
    """Fit on at most `most` pages of up to LONGEST characters, those with the smallest hashes of their keys."""
    rows = pages.where(F.col(page).isNotNull() & (F.length(page) <= LONGEST))
    drawn = rows.select(page, F.xxhash64(F.col(key), F.lit(23)).alias("_h")).orderBy("_h", page).limit(most).collect()
    return fit([r[0] for r in drawn])


def extract(pages: DataFrame, model: Model, page: str = "html") -> DataFrame:
    """pages with text and n_chars (its code points) in place of the html."""
    rows = pages.select(*(c for c in pages.columns if c not in ("text", "n_chars")))
    kept = [c for c in rows.columns if c != page]
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Places()
        for batch in batches:
            for part in slices(batch, page, 2 << 20):
                texts = main_texts(shared.value, part.column(page).to_pylist(), known)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in kept), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=[*kept, "text", "n_chars"])

    return rows.mapInArrow(run, with_fields(rows.select(*kept).schema, "text string, n_chars long"))
