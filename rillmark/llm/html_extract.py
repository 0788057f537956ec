"""Main text of web pages: a bidirectional LSTM labels the blocks of a page in its context."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few_by_hash
from .nets import Adam, lstm, lstm_back, sigmoid
from .text_batches import slices

# HTML's elements by how they end a run of text.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
SILENT = frozenset("script style head title template noscript svg math iframe object textarea select canvas audio video".split())
RAW = frozenset("script style textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What can stand in a head; all else ends one that is open.
HEAD = frozenset("html head base basefont bgsound link meta title noscript noframes style script template".split())
#: What an opening tag closes, if it is the innermost open block.
CLOSES = {"li": {"li", "p"}, "dd": {"dd", "dt", "p"}, "dt": {"dd", "dt", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}} | {t: {"p"} for t in BLOCK - {"li", "dd", "dt", "tr", "td", "th", "option", "body", "html"}}

_NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_MARK = re.compile("[>\"']")
_NAMED = re.compile(r"(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[a-z]+")
#: A block's path has the parts of so many outermost and innermost open elements, and of each so many names.
OUTER, INNER, NAMES = 16, 32, 12
PATH_BUCKETS, WORD_BUCKETS, PATH_DIM, WORD_DIM, NUMBERS, HIDDEN = 512, 1024, 12, 6, 6, 12


@dataclass
class Block:
    """A run of text between block tags: its text, its ancestors' tags with the parts of their names (OUTER, INNER, NAMES), its share of links."""

    text: str
    path: tuple[str, ...]
    linked: float


def _tag_end(page: str, at: int, endless: set[int]) -> int:
    """The place of the ">" that ends a tag, outside quotes; -1 if there is none.

    endless holds the opening quotes from which earlier looks found no end. No look starts from one twice, so all looks
    together take time in proportion to the page.
    """
    seen = []
    while m := _MARK.search(page, at):
        if m[0] == ">":
            return m.start()
        close = -1 if m.start() in endless else page.find(m[0], m.end())
        seen.append(m.start())
        if close < 0:
            break
        at = close + 1
    endless.update(seen)
    return -1


def _tokens(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, "/" or "", tag, attributes) of each tag, comment and declaration, the last two without a tag.

    One pass: every character is looked at a bounded number of times, however tags are broken. A tag whose quotes never
    end stops at the next ">"; what no ">" follows is text. Texts of RAW elements belong to their start tag's token.
    """
    at, endless = 0, set()
    while (start := page.find("<", at)) >= 0:
        at = start + 1
        m = _NAME.match(page, at)
        if m:
            stop = _tag_end(page, m.end(), endless)
            if stop < 0 and (stop := page.find(">", m.end())) < 0:
                return
            attributes, end = page[m.end() : stop], stop + 1
            tag = m[2].lower()
            if tag in RAW and not m[1]:
                stop = re.compile(rf"</{tag}\s*>", re.I).search(page, end)
                end = stop.end() if stop else len(page)
            yield start, end, m[1], tag, attributes
            at = end
        elif page.startswith("!--", at):
            stop = page.find("-->", at + 3)
            at = stop + 3 if stop >= 0 else len(page)
            yield start, at, "", "", ""
        elif page[at : at + 1] in ("!", "?"):
            stop = page.find(">", at)
            if stop < 0:
                return
            at = stop + 1
            yield start, at, "", "", ""


class _Open:
    """The open elements of a page, with the places of each tag and of block tags, so that no end tag searches."""

    def __init__(self) -> None:
        self.parts: list[tuple[str, ...]] = []
        self.tags: list[str] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.silent = self.links = 0

    def push(self, tag: str, parts: tuple[str, ...]) -> None:
        at = len(self.tags)
        self.tags.append(tag)
        self.parts.append(parts)
        self.places.setdefault(tag, []).append(at)
        if tag in BLOCK:
            self.blocks.append(at)
        self.silent += tag in SILENT
        self.links += tag == "a"

    def close(self, k: int) -> None:
        """Closes the elements from place k on."""
        while len(self.tags) > k:
            tag = self.tags.pop()
            self.parts.pop()
            self.places[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()
            self.silent -= tag in SILENT
            self.links -= tag == "a"

    def path(self) -> tuple[str, ...]:
        some = self.parts if len(self.parts) <= OUTER + INNER else self.parts[:OUTER] + self.parts[-INNER:]
        return tuple(p for parts in some for p in parts)


def leaf_blocks(page: str) -> list[Block]:
    """The blocks of a page in order, as a browser would build them: unclosed and stray end tags are put up with.

    A head ends, closed or not, where something comes that cannot stand in one. The time grows with the page's length.
    """
    out: list[Block] = []
    opened = _Open()
    run: list[str] = []
    size = linked = at = 0

    def flush() -> None:
        nonlocal size, linked
        text = " ".join(html.unescape("".join(run)).split())
        if text:
            out.append(Block(text, opened.path(), linked / max(size, 1)))
        run.clear()
        size = linked = 0

    def in_head() -> bool:
        return bool(opened.tags) and opened.tags[-1] == "head"

    def read(piece: str) -> None:
        nonlocal size, linked
        if in_head() and html.unescape(piece).strip(" \t\n\f\r"):
            opened.close(len(opened.tags) - 1)
        if piece and not opened.silent:
            run.append(piece)
            size += len(piece)
            linked += len(piece) * (opened.links > 0)

    for start, end, slash, tag, attributes in _tokens(page):
        read(page[at:start])
        at = end
        if not tag:
            continue
        if in_head() and (tag in ("body", "html", "br") if slash else tag not in HEAD):
            opened.close(len(opened.tags) - 1)
        if slash:
            if tag in BLOCK:
                flush()
            places = opened.places.get(tag)
            if places and (tag in BLOCK or tag in SILENT or not opened.blocks or opened.blocks[-1] <= places[-1]):
                opened.close(places[-1])
        elif tag in VOID:
            if tag == "hr":
                flush()
            run.append(" ")
        elif tag not in RAW:
            if tag in BLOCK:
                flush()
                if opened.blocks and opened.tags[opened.blocks[-1]] in CLOSES.get(tag, ()):
                    opened.close(opened.blocks[-1])
            names = " ".join(a or b or c for a, b, c in _NAMED.findall(attributes)).lower() if attributes else ""
            if not (attributes.rstrip().endswith("/") and tag not in BLOCK):
                opened.push(tag, (tag, *(f".{x}" for x in _PART.findall(names)[:NAMES])))
    read(page[at:])
    flush()
    return out


def block_inputs(blocks: list[Block]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """(path buckets, word buckets, numbers) of each block of a page."""
    seed = lambda s, n: xxhash.xxh3_64_intdigest(s) % n
    paths = [np.fromiter({seed(p, PATH_BUCKETS) for p in b.path} or {0}, np.int64) for b in blocks]
    words = [np.fromiter((seed(w, WORD_BUCKETS) for w in b.text.lower().split()), np.int64) for b in blocks]
    numbers = np.array([[np.log1p(len(b.text)) / 5, b.linked, min(1, 8 * sum(map(b.text.count, ".,;!?")) / len(b.text)), i / max(1, len(blocks) - 1), min(len(b.path) / 10, 2), 1.0] for i, b in enumerate(blocks)], np.float32).reshape(-1, NUMBERS)
    return paths, words, numbers


class Labeller:
    """Block inputs (summed path vectors, mean word vectors, numbers) through two LSTMs to a logit for each block."""

    def __init__(self, seed: int = 7):
        r, h, d = np.random.default_rng(seed), HIDDEN, PATH_DIM + WORD_DIM + NUMBERS
        f = lambda *s: r.normal(0, 0.2, s).astype(np.float32)
        self.trained = False
        self.p = {"path": f(PATH_BUCKETS, PATH_DIM), "word": f(WORD_BUCKETS, WORD_DIM), "w": f(d, 8 * h), "uf": f(h, 4 * h), "ub": f(h, 4 * h), "o": f(2 * h + d), "b": np.zeros(1, np.float32)}

    def vectors(self, page: tuple) -> np.ndarray:
        paths, words, numbers = page
        p = np.add.reduceat(self.p["path"][np.concatenate(paths)], np.cumsum([0, *map(len, paths)])[:-1])
        w = np.add.reduceat(self.p["word"][np.concatenate(words)], np.cumsum([0, *map(len, words)])[:-1])
        return np.concatenate((p, w / np.array([len(x) for x in words], np.float32)[:, None], numbers), axis=1)

    def run(self, x: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        """Logits (T, B) of padded inputs x (T, B, d)."""
        g, h = x @ self.p["w"], HIDDEN
        f, tf = lstm(g[:, :, : 4 * h], mask, self.p["uf"], keep)
        b, tb = lstm(g[::-1, :, 4 * h :], mask[::-1], self.p["ub"], keep)
        states = np.concatenate((f, b[::-1], x), axis=2)
        return states @ self.p["o"] + self.p["b"][0], (states, tf, tb)

    @staticmethod
    def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        t = max(map(len, rows))
        x, mask = np.zeros((t, len(rows), rows[0].shape[1]), np.float32), np.zeros((t, len(rows)), bool)
        for i, r in enumerate(rows):
            x[: len(r), i], mask[: len(r), i] = r, True
        return x, mask

    def label(self, pages: list[list[Block]], max_steps: int = 20_000) -> list[np.ndarray]:
        """True for each block of the main text; pages of like length share a batch. A labeller that saw no page refuses."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        if order and not self.trained:
            raise ValueError("the labeller was trained on no page")
        at = 0
        while at < len(order):
            n = 1
            while at + n < len(order) and (n + 1) * len(pages[order[at + n]]) <= max_steps:
                n += 1
            some = order[at : at + n]
            logit, _ = self.run(*self.padded([self.vectors(block_inputs(pages[i])) for i in some]))
            for k, i in enumerate(some):
                out[i] = logit[: len(pages[i]), k] > 0
            at += n
        return out

    def fit(self, pages: list[tuple[tuple, np.ndarray]], epochs: int = 10, seed: int = 7) -> None:
        """pages: (block_inputs, 0/1 labels)."""
        r, adam, h = np.random.default_rng(seed), Adam(self.p, 0.01), HIDDEN
        self.trained = self.trained or bool(pages)
        for _ in range(epochs if pages else 0):
            order = r.permutation(len(pages))
            for some in np.array_split(order, max(1, len(order) // 16)):
                x, mask = self.padded([self.vectors(pages[i][0]) for i in some])
                y = np.zeros(mask.shape, np.float32)
                for k, i in enumerate(some):
                    y[: len(pages[i][1]), k] = pages[i][1]
                logit, (states, tf, tb) = self.run(x, mask, True)
                d = np.where(mask, sigmoid(logit) - y, 0).astype(np.float32) / mask.sum()
                ds = d[:, :, None] * self.p["o"]
                dgf, duf = lstm_back(ds[:, :, :h], tf, self.p["uf"])
                dgb, dub = lstm_back(ds[::-1, :, h : 2 * h], tb, self.p["ub"])
                dg = np.concatenate((dgf, dgb[::-1]), axis=2)
                dx = dg @ self.p["w"].T + ds[:, :, 2 * h :]
                dpath, dword = np.zeros_like(self.p["path"]), np.zeros_like(self.p["word"])
                for k, i in enumerate(some):
                    paths, words, _ = pages[i][0]
                    own = dx[: len(paths), k]
                    np.add.at(dpath, np.concatenate(paths), np.repeat(own[:, :PATH_DIM], [len(p) for p in paths], axis=0))
                    share = own[:, PATH_DIM : PATH_DIM + WORD_DIM] / np.array([len(w) for w in words], np.float32)[:, None]
                    np.add.at(dword, np.concatenate(words), np.repeat(share, [len(w) for w in words], axis=0))
                adam.step({"path": dpath, "word": dword, "w": np.tensordot(x, dg, ((0, 1), (0, 1))), "uf": duf, "ub": dub, "o": np.tensordot(states, d, ((0, 1), (0, 1))), "b": d.sum(keepdims=True).reshape(1)})


# How pages commonly name what is and what is not their main text.
MAIN = ["article", "main", "div.content", "div.article-body", "div.post", "div.entry-content", "div.story", "section.text", "div#main", "div.page-content", "article.post", "main#content", "div.post-body", "div.article"]
MENU = ["nav", "div.menu", "ul.nav", "div.navbar", "div.navigation", "div.breadcrumb", "div.breadcrumbs", "nav.main-nav", "div.topnav", "div.toc", "div.pagination", "div.tags", "div.share", "div.social"]
PROSE = ["div.ad", "div.ads", "div.advert", "div.advertisement", "div.promo", "div.sponsored", "div.banner", "aside", "aside.sidebar", "div.sidebar", "div.widget", "div.related", "div.notice", "div.cookie-notice", "div.cookie", "div.consent", "div.newsletter", "div.subscribe", "div.popup", "div.modal", "div.alert", "section.comments", "div.comments", "div.comment", "ol.comment-list", "div#comments", "div.reply", "div#disqus_thread", "form", "form.search", "div.form", "dialog", "div.disclaimer", "div.recommended", "div.author-bio"]
TOP, BOTTOM = ["header", "div.header", "div#header", "header.site-header", "div.masthead", "div.topbar"], ["footer", "div.footer", "div#footer", "footer.site-footer", "div.copyright", "div.bottom"]


def _tag(spec: str, inner: str) -> str:
    tag, mark, name = re.match(r"(\w+)([.#]?)(.*)", spec).groups()
    attr = f' {"class" if mark == "." else "id"}="{name}"' if mark else ""
    return f"<{tag}{attr}>{inner}</{tag}>"


_ATTRIBUTE = re.compile(r' (?:class|id)="[^"]*"')
_SEMANTIC = re.compile(r"<(/?)(?:article|main|nav|aside|header|footer|section|dialog)\b")


def anonymous(page: str, r: np.random.Generator) -> str:
    """Drops a page's names, or gives it ones that say nothing; in half of such pages every sectioning tag becomes a div."""
    if r.random() < 0.5:
        page = _ATTRIBUTE.sub("", page)
    else:
        page = _ATTRIBUTE.sub(lambda m: f' class="{"".join(chr(97 + c) for c in r.integers(0, 26, 5))}"', page)
    return _SEMANTIC.sub(r"<\1div", page) if r.random() < 0.5 else page


def arranged(prose: list[str], short: list[str], r: np.random.Generator) -> tuple[str, set[str]]:
    """A page that sets given texts in a layout drawn at random, and its main text's blocks. Each text is used once."""
    prose, short = list(prose), list(short)
    pick = lambda xs: xs[int(r.integers(len(xs)))]
    take = lambda xs: xs.pop() if xs else ""
    esc = html.escape

    def menu() -> str:
        items = [f'<a href="#">{esc(take(short))}</a>' for _ in range(int(r.integers(1, 7)))]
        return _tag(pick(MENU), "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if r.random() < 0.7 else " | ".join(items))

    def aside() -> str:
        spec, n = pick(PROSE), int(r.integers(1, 3))
        if r.random() < 0.35:  # linked teasers
            n = int(r.integers(2, 7))
            items = [f'<a href="#">{esc(take(short) if r.random() < 0.7 else take(prose))}</a>' for _ in range(n)]
            title = f"<h3>{esc(take(short))}</h3>" if r.random() < 0.6 else ""
            return _tag(spec, title + ("<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if r.random() < 0.6 else "".join(f"<div>{x}</div>" for x in items)))
        inner = "".join(f"<p>{esc(take(prose))}</p>" if r.random() < 0.6 else f"<div>{esc(take(prose))}</div>" if r.random() < 0.5 else esc(take(prose)) for _ in range(n))
        if r.random() < 0.3:
            inner = f"<h3>{esc(take(short))}</h3>" + inner
        if "form" in spec:
            inner += f"<label>{esc(take(short))}</label><input><button>{esc(take(short))}</button>"
        return _tag(spec, inner)

    main, parts = set(), []
    if r.random() < 0.8:
        h = take(short) + " " + take(short)
        parts.append(f"<h{1 + int(r.random() < 0.2)}>{esc(h)}</h1>")
        main.add(" ".join(h.split()))
    for i in range(int(r.integers(1, 9))):
        t = take(short if r.random() < 0.2 else prose)
        if not t:
            break
        main.add(" ".join(t.split()))
        kind = r.random()
        parts.append(f"<p>{esc(t)}</p>" if kind < 0.75 else f"<ul><li>{esc(t)}</li></ul>" if kind < 0.85 else f"<blockquote>{esc(t)}</blockquote>" if kind < 0.9 else f"<div>{esc(t)}</div>")
        if i and r.random() < 0.12:
            parts.append(aside())
        if r.random() < 0.1:
            h = take(short)
            main.add(" ".join(h.split()))
            parts.append(f"<h2>{esc(h)}</h2>")
    body = "".join(parts) if r.random() < 0.05 else _tag(pick(MAIN), "".join(parts))
    if r.random() < 0.3:
        body = _tag(pick(["div.wrapper", "div.container", "div#page", "section", "div.row"]), body)
    before = [menu() for _ in range(int(r.integers(0, 3)))] + [aside() for _ in range(int(r.integers(0, 2)))]
    after = [aside() for _ in range(int(r.integers(0, 3)))] + [menu() for _ in range(int(r.integers(0, 2)))]
    top = _tag(pick(TOP), f"<div>{esc(take(short))}</div>" + (menu() if r.random() < 0.5 else "")) if r.random() < 0.6 else ""
    bottom = _tag(pick(BOTTOM), f"<p>&copy; {esc(take(prose) or take(short))}</p>") if r.random() < 0.8 else ""
    return f"<html><head><title>x</title></head><body>{top}{''.join(before)}{body}{''.join(after)}{bottom}</body></html>", main


def train(pages: list[str], layouts: int, nameless: float, seed: int) -> Labeller:
    """A labeller of pages that mark their article, and of layouts arranged from their texts."""
    model, r, data, prose, short = Labeller(seed), np.random.default_rng(seed), [], [], []
    odd = {"nav", "aside", "footer", "header", "form", ".ad", ".comments", ".sidebar"}
    for page in pages:
        blocks = leaf_blocks(page)
        for b in blocks:
            (prose if len(b.text) >= 60 else short).append(b.text)
        if blocks and any("article" in b.path for b in blocks):
            y = np.array(["article" in b.path and not odd & set(b.path) for b in blocks], np.float32)
            data.append((block_inputs(blocks), y))
    short = list(dict.fromkeys(short))
    prose = list(dict.fromkeys(prose)) or short
    for _ in range(layouts if prose else 0):
        p = [prose[i] for i in r.permutation(len(prose))[:24]]
        s = [short[i] for i in r.permutation(len(short))[:60]]
        page, main = arranged(p, s, r)
        blocks = leaf_blocks(anonymous(page, r) if r.random() < nameless else page)
        y = np.array([b.text in main for b in blocks], np.float32)
        if blocks:
            data.append((block_inputs(blocks), y))
    model.fit(data)
    return model


def fit_labeller(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", max_pages: int = 300, layouts: int = 1100, nameless: float = 0.3, seed: int = 7) -> Labeller:
    """Trains on at most max_pages pages, each whole, and on layouts pages arranged from their texts.

    The tables hold no labels. Pages that mark an article and nothing odd within it label themselves by their tags; the
    arranged pages set the same texts under many other names, and a share of nameless ones under none that say
    anything, so that length, links, place and the blocks around must tell them apart.
    """
    texts = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).filter("html <> '' AND id IS NOT NULL")
    ids = few_by_hash(texts.select("id"), "id", max_pages).orderBy(F.xxhash64("id"), "id").limit(max_pages)
    rows = texts.join(F.broadcast(ids.distinct()), "id").orderBy("id", "html").limit(max_pages).collect()  # bounded by max_pages
    return train([row["html"] for row in rows], layouts, nameless, seed)


def extract(pages: DataFrame, model: Labeller, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_blocks, n_main), one row per input row.

    text: the blocks labelled main, in page order, joined by one blank; character references are decoded, white space
    in a block becomes one blank. Null and empty pages, and pages without a main block, have an empty text. Whole pages
    of any length are read; repeated rows each get the same text, an empty table gives none; other columns are ignored, whatever their names.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)  # its size is fixed by the bucket and state counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, 2):
            blocks = [leaf_blocks(t) for t in texts]
            labels = shared.value.label(blocks)
            main = [" ".join(b.text for b, y in zip(bs, ys) if y) for bs, ys in zip(blocks, labels)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(main, pa.string()), pa.array([len(b) for b in blocks], pa.int64()), pa.array([int(y.sum()) for y in labels], pa.int64())], names=["id", "url", "text", "n_blocks", "n_main"])

    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, f"id {kind}, url string, text string, n_blocks bigint, n_main bigint")
