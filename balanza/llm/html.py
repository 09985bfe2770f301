"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its leaf blocks; each block has the path of its
open elements, its words and its share of link text.  A bidirectional LSTM, in
numpy, reads hashed path and word vectors of the whole sequence and labels every
block as content or not.  The network is fitted on the driver on a bounded sample
of pages, labelled by plain structural rules and varied by renamed containers and
inserted page furniture, so that it learns paths and context rather than words.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from balanza.llm.common import pieces_of, ship

# Element names by their role in a page.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "title", "textarea", "template", "iframe", "svg", "xmp"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins",
    "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
    "noscript", "object", "canvas", "math", "annotation", "annotation-xml", "maction", "menclose", "merror", "mfenced", "mfrac", "mi",
    "mmultiscripts", "mn", "mo", "mover", "mpadded", "mphantom", "mprescripts", "mroot", "mrow", "ms", "mspace", "msqrt", "mstyle", "msub",
    "msubsup", "msup", "mtable", "mtd", "mtext", "mtr", "munder", "munderover", "none", "semantics",
}
#: Inline elements that part words.
SPACING = {"br", "mtd", "noscript", "object", "canvas"}
ITEMS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
FURNITURE = {"nav", "footer", "header", "aside", "form", "menu", "button", "select", "dialog"}
MAIN = {"article", "main"}
#: What may stand in the head of a page; anything else, text too, ends an open head.
HEAD = {"base", "basefont", "bgsound", "head", "link", "meta", "noframes", "noscript", "script", "style", "template", "title"}

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Block:
    """Text of one leaf, the names on its path and the share of its characters inside links."""

    path: tuple[str, ...]
    text: str
    linked: float = 0.0


@dataclass
class _Leaf:
    parts: list[str] = field(default_factory=list)
    linked: int = 0


def names(tag: str, attributes: str) -> tuple[str, ...]:
    """The element's name and the words of its class, id and role, singular."""
    if "=" not in attributes:
        return (tag,)
    found = " ".join(a or b or c for a, b, c in ATTRIBUTE.findall(attributes))
    return (tag, *("." + w.lower().removesuffix("s") for w in NAME.findall(found)))


def blocks(page: str) -> list[Block]:
    """Leaf blocks of a page in order: white space is one space, references are decoded, empty blocks are left out.

    Markup may be broken: an end tag without a start is ignored, an item or paragraph
    ends where the next begins, a head ends where the body or its text begins, a tag cut
    off at the end of the page is no text.
    """
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    leaf, links, at, n = _Leaf(), 0, 0, len(page)

    def end() -> None:
        nonlocal leaf
        if leaf.parts:
            raw = "".join(leaf.parts)
            text = " ".join(raw.split())
            if text:
                out.append(Block(tuple(x for _, ns in stack for x in ns), text, min(1.0, leaf.linked / len(raw))))
            leaf = _Leaf()

    def end_head() -> None:
        for i, (t, _) in enumerate(stack):
            if t == "head":
                end()
                del stack[i:]
                break

    while at < n:
        m = TOKEN.search(page, at)
        stop = m.start() if m else n
        if stop > at:
            piece = page[at:stop]
            piece = html.unescape(piece) if "&" in piece else piece
            if not piece.isspace():
                end_head()
            leaf.parts.append(piece)
            leaf.linked += len(piece) * (links > 0)
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), m[1] == "/"
        if tag not in HEAD and not closing:
            end_head()
        if tag in RAW and not closing:
            if not m[3].endswith("/"):
                close = re.compile(rf"</{tag}\b[^>]*(?:>|$)", re.I).search(page, at)
                at = close.end() if close else n
            continue
        if tag in INLINE:
            if tag == "a":
                links = max(0, links - 1) if closing else 1
            elif tag in SPACING:
                leaf.parts.append(" ")
            continue
        end()
        links = 0
        if tag in VOID:
            continue
        if closing:
            if any(t == tag for t, _ in stack):
                while stack.pop()[0] != tag:
                    pass
            continue
        if tag in ITEMS:
            # An open item of the same list ends here.
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag or tag in ("dt", "dd") and stack[i][0] in ("dt", "dd"):
                    del stack[i:]
                    break
                if stack[i][0] in ITEMS[tag]:
                    break
        elif stack and stack[-1][0] == "p":
            stack.pop()
        stack.append((tag, names(tag, m[3])))
    end()
    return out


# Names that page furniture and article containers go by, for the varied training pages.
INSERTS = (
    (("nav",), ("ul", ".menu"), ("div", ".menu"), ("div", ".navbar"), ("div", ".nav"), ("div", ".breadcrumb"), ("div", ".pagination"), ("div", ".toc")),
    (("header",), ("div", ".header"), ("div", ".masthead"), ("div", ".top", ".bar"), ("div", ".site", ".header"), ("div", ".logo")),
    (("footer",), ("div", ".footer"), ("div", ".copyright"), ("div", ".site", ".footer"), ("div", ".legal")),
    (("aside",), ("div", ".sidebar"), ("div", ".widget"), ("div", ".related"), ("aside", ".sidebar"), ("div", ".recommended"), ("div", ".trending"), ("div", ".side")),
    (("div", ".notice"), ("div", ".cookie"), ("div", ".cookie", ".notice"), ("div", ".consent"), ("div", ".banner"), ("div", ".alert"), ("div", ".gdpr"), ("div", ".popup"), ("div", ".modal"), ("dialog",)),
    (("div", ".ad"), ("div", ".advert"), ("div", ".advertisement"), ("div", ".sponsored"), ("div", ".promo"), ("div", ".sponsor"), ("div", ".banner", ".ad")),
    (("form",), ("form", ".search"), ("form", ".newsletter"), ("div", ".newsletter"), ("div", ".subscribe"), ("form", ".login"), ("div", ".signup"), ("fieldset",)),
    (("section", ".comment"), ("div", ".comment"), ("ol", ".comment", ".list"), ("div", ".reply"), ("div", ".discussion"), ("div", ".response"), ("ul", ".comment"), ("section", ".reader", ".comment")),
    (("div", ".share"), ("div", ".social"), ("div", ".author", ".bio"), ("div", ".tag"), ("div", ".meta"), ("div", ".byline")),
)
CONTAINERS = (
    ("article",), ("main",), ("article", ".post"), ("div", ".content"), ("div", ".post"), ("div", ".entry", ".content"), ("div", ".article", ".body"),
    ("section", ".article"), ("div", ".story"), ("div", ".main"), ("main", ".content"), ("section",), ("div", ".text"), (),
)
INNER = (("p",), ("li",), ("ul", "li"), ("div",), ("h3",), (), ("span",), ("div", "p"), ("label",), ("td",))


def rule(b: Block) -> bool:
    """Structural label of a training block: inside the article, outside page furniture."""
    path = set(b.path)
    if path & FURNITURE:
        return False
    if path & MAIN:
        return True
    furniture = {n for kind in INSERTS for ns in kind for n in ns if n[0] == "."}
    return not path & furniture and b.linked < 0.5 and len(b.text) >= 80


#: Other ends of a content block's path.
LEAVES = (("ul", "li"), ("ol", "li"), ("blockquote", "p"), ("h2",), ("h3",), ("h4",), ("table", "tr", "td"), ("pre",), ("div",), ("section", "p"), ("dl", "dd"))

Labelled = list[tuple[Block, bool]]


def varied(page: Labelled, pool: list[str], rng: np.random.Generator) -> Labelled:
    """A page with its container renamed and page furniture put before, inside and after the content."""
    container = CONTAINERS[rng.integers(len(CONTAINERS))]
    keep = rng.random() < 0.3
    out: Labelled = []
    for b, y in page:
        path = b.path
        if y and not keep:
            at = next((i for i, n in enumerate(path) if n in MAIN), None)
            if at is not None:
                path = path[:at] + container + path[at + 1 :]
        if y and rng.random() < 0.15:
            path = path[:-1] + LEAVES[rng.integers(len(LEAVES))]
        out.append((Block(path, b.text, b.linked), y))
    content = [i for i, (_, y) in enumerate(out) if y]
    for _ in range(int(rng.integers(0, 6))):
        kind = INSERTS[rng.integers(len(INSERTS))]
        wrap = kind[rng.integers(len(kind))]
        inner = INNER[rng.integers(len(INNER))]
        at = int(rng.integers(0, len(out) + 1))
        outer = ("html", "body")
        if content and rng.random() < 0.4:
            # Inside the article's own container.
            at = int(rng.integers(content[0], content[-1] + 2))
            near = out[min(at, len(out) - 1)][0].path
            outer = near[:-1] if out[min(at, len(out) - 1)][1] else outer
        linked = float(rng.random() < 0.4)
        new = []
        for _ in range(int(rng.integers(1, 7))):
            words = pool[rng.integers(len(pool))].split()
            words = words[: int(rng.integers(1, 9 if rng.random() < 0.5 else len(words) + 1))]
            new.append((Block(outer + wrap + inner, " ".join(words), linked), False))
        out[at:at] = new
        content = [i for i, (_, y) in enumerate(out) if y]
    return out


PATH, WORDS, EXTRA = 256, 32, 6
_SLOTS: dict[str, tuple[int, float]] = {}


def slot(name: str, size: int) -> tuple[int, float]:
    """Place and sign of a hashed name."""
    key = f"{size}{name}"
    if key not in _SLOTS:
        if len(_SLOTS) > 300_000:
            _SLOTS.clear()
        h = zlib.crc32(key.encode())
        _SLOTS[key] = (h >> 1) % size, 1.0 if h & 1 else -1.0
    return _SLOTS[key]


_PATHS: dict[tuple[str, ...], np.ndarray] = {}


def path_vector(path: tuple[str, ...]) -> np.ndarray:
    """Hashed names of a path."""
    v = _PATHS.get(path)
    if v is None:
        if len(_PATHS) > 20_000:
            _PATHS.clear()
        v = _PATHS[path] = np.zeros(PATH, np.float32)
        for n in set(path):
            at, sign = slot(n, PATH)
            v[at] += sign
    return v


def vectors(page: list[Block]) -> np.ndarray:
    """One row for each block: hashed names of the path, hashed words, lengths and place."""
    x = np.zeros((len(page), PATH + WORDS + EXTRA), np.float32)
    for i, b in enumerate(page):
        x[i, :PATH] = path_vector(b.path)
        words = b.text.split()
        for w in words:
            at, sign = slot(w, WORDS)
            x[i, PATH + at] += sign
        x[i, PATH : PATH + WORDS] /= len(words)
        tail = x[i, PATH + WORDS :]
        tail[:] = np.log1p(len(words)) / 5, b.linked, b.text[-1] in ".!?", len(b.path) / 10, i / len(page), 1 / (1 + len(page) - i)
    return x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Labeller:
    """Bidirectional LSTM with one logistic output for each block."""

    def __init__(self, width: int = PATH + WORDS + EXTRA, hidden: int = 16, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.weights: dict[str, np.ndarray] = {"out": rng.normal(0, 0.1, 2 * hidden), "bias": np.zeros(1)}
        for d in "fb":
            self.weights[d + "x"] = rng.normal(0, 0.08, (width, 4 * hidden))
            self.weights[d + "h"] = rng.normal(0, 0.1, (hidden, 4 * hidden))
            self.weights[d + "b"] = np.repeat([0.0, 1.0, 0.0, 0.0], hidden)
        self.weights = {k: v.astype(np.float32) for k, v in self.weights.items()}

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, trace: list | None) -> np.ndarray:
        """Hidden states of one direction; x: time, page, width."""
        w, n = self.weights, self.hidden
        z = (x.reshape(-1, x.shape[2]) @ w[d + "x"] + w[d + "b"]).reshape(*x.shape[:2], 4 * n)
        h = c = np.zeros((x.shape[1], n), np.float32)
        out = np.empty((*x.shape[:2], n), np.float32)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            a = z[t] + h @ w[d + "h"]
            gates, g = sigmoid(a[:, : 3 * n]), np.tanh(a[:, 3 * n :])
            i, f, o = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :]
            m = mask[t][:, None]
            c2 = f * c + i * g
            tc = np.tanh(c2)
            if trace is not None:
                trace.append((t, h, c, i, f, o, g, tc, m))
            h, c = m * (o * tc) + (1 - m) * h, m * c2 + (1 - m) * c
            out[t] = h
        return out

    def scores(self, x: np.ndarray, mask: np.ndarray, traces: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
        states = np.concatenate([self._run(x, mask, d, None if traces is None else traces.setdefault(d, [])) for d in "fb"], axis=2)
        return sigmoid(states @ self.weights["out"] + self.weights["bias"]), states

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy, by backpropagation through time."""
        traces: dict[str, list] = {}
        p, states = self.scores(x, mask, traces)
        d_out = (p - y) * mask / mask.sum()
        grads = {"out": np.einsum("tb,tbh->h", d_out, states), "bias": np.array([d_out.sum()], np.float32)}
        n = self.hidden
        for k, d in enumerate("fb"):
            wh, wo = self.weights[d + "h"], self.weights["out"][k * n : (k + 1) * n]
            dh = dc = np.zeros((x.shape[1], n), np.float32)
            dz = np.zeros((*x.shape[:2], 4 * n), np.float32)
            gh = np.zeros_like(wh)
            for t, h0, c0, i, f, o, g, tc, m in reversed(traces[d]):
                dh = dh + d_out[t][:, None] * wo
                dho = dh * m
                dct = dc * m + dho * o * (1 - tc * tc)
                da = np.concatenate([dct * g * i * (1 - i), dct * c0 * f * (1 - f), dho * tc * o * (1 - o), dct * i * (1 - g * g)], axis=1)
                dz[t] = da
                gh += h0.T @ da
                dh, dc = da @ wh.T + dh * (1 - m), dct * f + dc * (1 - m)
            flat = dz.reshape(-1, 4 * n)
            grads |= {d + "x": x.reshape(-1, x.shape[2]).T @ flat, d + "h": gh, d + "b": flat.sum(0)}
        return grads

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int, rate: float = 0.015, size: int = 32, seed: int = 6) -> None:
        """Adam over pages grouped by length."""
        rng = np.random.default_rng(seed)
        mean = {k: np.zeros_like(v) for k, v in self.weights.items()}
        square = {k: np.zeros_like(v) for k, v in self.weights.items()}
        pages = sorted(pages, key=lambda p: len(p[1]))
        groups = [padded(pages[i : i + size]) for i in range(0, len(pages), size)]
        step = 0
        for epoch in range(epochs):
            pace = rate * (1 - epoch / epochs)
            for j in rng.permutation(len(groups)):
                x, mask, y = groups[j]
                step += 1
                for k, g in self.gradients(x, mask, y).items():
                    mean[k] = 0.9 * mean[k] + 0.1 * g
                    square[k] = 0.99 * square[k] + 0.01 * g * g
                    self.weights[k] = self.weights[k] - pace * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-7)

    def label(self, pages: list[list[Block]], cells: int = 20_000) -> list[np.ndarray]:
        """Whether each block is content; pages of like length go through the network together, about ``cells`` blocks at once."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        while order:
            longest = len(pages[order[-1]])
            take = max(1, cells // longest)
            chunk, order = order[-take:], order[:-take]
            x, mask, _ = padded([(vectors(pages[i]), np.zeros(len(pages[i]))) for i in chunk])
            p, _ = self.scores(x, mask)
            for k, i in enumerate(chunk):
                out[i] = p[: len(pages[i]), k] >= 0.5
        return out


def padded(pages: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    longest = max(len(y) for _, y in pages)
    x = np.zeros((longest, len(pages), pages[0][0].shape[1]), np.float32)
    mask, y = np.zeros(x.shape[:2], np.float32), np.zeros(x.shape[:2], np.float32)
    for k, (v, t) in enumerate(pages):
        x[: len(t), k], mask[: len(t), k], y[: len(t), k] = v, 1, t
    return x, mask, y


def composed(pool: list[str], rng: np.random.Generator) -> Labelled:
    """An article of headings, paragraphs, items and cells with the words of ``pool``, for tables whose pages have no structural label."""
    out: Labelled = []
    for i in range(int(rng.integers(2, 25))):
        leaf = ("h1",) if i == 0 else ("p",) if rng.random() < 0.5 else LEAVES[rng.integers(len(LEAVES))]
        words = pool[rng.integers(len(pool))].split()
        if leaf != ("p",) or rng.random() < 0.3:
            words = words[: int(rng.integers(1, 12))]
        out.append((Block(("html", "body", "article", *leaf), " ".join(words)), True))
    return out


def trained(sample: list[str], copies: int = 5, epochs: int = 12, seed: int = 7) -> Labeller:
    """A labeller fitted on sample pages, each also in ``copies`` varied forms, or more where there are few pages.

    Only pages with an article or main element have labels to fit on; where none has,
    articles composed of the sample's texts take their place.
    """
    rng = np.random.default_rng(seed)
    read = [p for p in map(blocks, sample) if p]
    pool = [b.text for p in read for b in p] or ["Text of a page."]
    pages = [[(b, rule(b)) for b in p] for p in read if any(set(b.path) & MAIN and rule(b) for b in p)]
    pages = pages or [composed(pool, rng) for _ in range(100)]
    copies = max(copies, -(-800 // len(pages)))
    data = pages + [varied(p, pool, rng) for p in pages for _ in range(copies)]
    net = Labeller()
    net.fit([(vectors([b for b, _ in p]), np.array([y for _, y in p], np.float32)) for p in data], epochs)
    return net


def main_text(pages: DataFrame, sample_pages: int = 160) -> DataFrame:
    """page_id, url, text, n_chars: the content blocks of each page in order, joined by line breaks.

    ``pages`` has page_id, url and html.  The network is fitted on ``sample_pages``
    pages, those of smallest hash, pages with an article or main element first; every
    page is then read whole.  Null and empty html
    give an empty text and 0 characters, as do pages without a content block; null
    ids and urls and repeated rows stay as they are; other columns are ignored; an
    empty table gives none.
    """
    ship(pages.sparkSession)
    labelled = F.col("html").rlike(r"(?i)<(?:article|main)\b")
    hashed = pages.filter(F.length("html") > 0).select("html", F.xxhash64("page_id", "url").alias("h"), F.xxhash64("html").alias("g"))
    # Two numbers for each page decide; only the chosen pages are read for their html.
    chosen = hashed.select(labelled.alias("labelled"), "h", "g").distinct().orderBy(F.desc("labelled"), "h", "g").limit(sample_pages)
    order = {(r["h"], r["g"]): i for i, r in enumerate(chosen.collect())}
    wanted = F.col("h").isin([h for h, _ in order]) & F.col("g").isin([g for _, g in order])
    found = hashed.filter(wanted).dropDuplicates(["h", "g"]).collect() if order else []
    found = sorted((order[r["h"], r["g"]], r["html"]) for r in found if (r["h"], r["g"]) in order)
    net = trained([html for _, html in found])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces_of(batches, "html", 4_000_000):
            parsed = [blocks(h) if h else [] for h in b.column("html").to_pylist()]
            texts = ["\n".join(x.text for x, y in zip(p, ys) if y) for p, ys in zip(parsed, net.label(parsed))]
            columns = [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.record_batch(columns, ["page_id", "url", "text", "n_chars"])

    kind = dict(pages.dtypes)["page_id"]
    return pages.select("page_id", "url", "html").mapInArrow(extract, f"page_id {kind}, url string, text string, n_chars long")
