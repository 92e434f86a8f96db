"""Main text of HTML pages by a recurrent block labeller.

``blocks`` turns a page into its sequence of leaf texts, each with the path of
open elements above it.  A bidirectional LSTM in numpy reads, for each block, a
vector of hashed path parts, hashed words and a few measures, and labels all
blocks of a page with the whole page as context.  It is trained here, on pages
that ``synthetic_page`` writes with known labels: articles of many layouts
among menus, headers, footers, sidebars, notices, adverts, forms and reader
comments, in invented words, so that structure and not vocabulary decides.

Cases: a null or empty page has no blocks and an empty text; scripts, styles,
comments and the head never make blocks; unclosed elements end where HTML ends
them.  Repeated rows are treated alike, and an empty table gives an empty one.
All other columns are kept, but for one that is named like the result.  Every
word and character of a block counts in its vector, and pages of any length are
read whole, one batch of blocks or one page at a time.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PART = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|title|iframe|svg|select)(?=[\s>/])[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[!?/][^>]*>|<(?P<loose>[a-zA-Z][a-zA-Z0-9:-]*)[^>]*>|[^<]+|<",
    re.S | re.I,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPACE = re.compile(r"\s+")

BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul button label".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An element that opens inside one of these ends it first.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


@dataclass
class Block:
    text: str
    #: Element names with their classes, ids and roles, outermost first.
    path: tuple[tuple[str, ...], ...]
    link_chars: int = 0
    label: int = 0
    words: list[str] = field(default_factory=list)


def blocks(page: str | None) -> list[Block]:
    """The leaf texts of a page in order."""
    out: list[Block] = []
    stack: list[tuple[str, ...]] = []
    text: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal linked
        joined = _SPACE.sub(" ", "".join(text)).strip()
        if joined and not any(p[0] == "head" for p in stack):
            out.append(Block(joined, tuple(stack), linked))
        text.clear()
        linked = 0

    def pop_to(at: int) -> None:
        flush()
        del stack[at:]

    for m in _PART.finditer(page or ""):
        tag = (m["tag"] or m["loose"] or "").lower()
        if not tag:
            if m[0][0] != "<" or len(m[0]) == 1:
                piece = html.unescape(m[0])
                text.append(piece)
                if links:
                    linked += len(piece.strip())
            continue
        if tag == "a":
            links = 0 if m["end"] else 1
        elif tag == "br":
            text.append(" ")
        elif tag not in BLOCK:
            continue
        elif m["end"]:
            at = next((i for i in reversed(range(len(stack))) if stack[i][0] == tag), None)
            if at is not None:
                pop_to(at)
            else:
                flush()
        else:
            links = 0
            if stack and stack[-1][0] == "p":
                pop_to(len(stack) - 1)
            if tag in ENDS:
                at = len(stack)
                while at and stack[at - 1][0] not in ("ul", "ol", "dl", "table", "select", "menu"):
                    at -= 1
                inner = next((i for i in range(at, len(stack)) if stack[i][0] in ENDS[tag]), None)
                if inner is not None:
                    pop_to(inner)
            if tag == "body":
                stack = [p for p in stack if p[0] != "head"]
            flush()
            if tag not in VOID:
                names = [x for groups in _NAMES.findall(m["attrs"] or "") for x in re.split(r"[\s_-]+", "".join(groups).lower()) if x]
                stack.append((tag, *names))
    flush()
    return out


PATH_DIMS, WORD_DIMS, MEASURES = 96, 24, 10
DIMS = PATH_DIMS + WORD_DIMS + MEASURES


@lru_cache(maxsize=20_000)
def _slot(part: str, dims: int) -> int:
    return zlib.crc32(part.encode()) % dims


class _WordSlots(dict):
    """Lower-case word -> its slot; forgotten when there are too many."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = at = zlib.crc32(b"word:" + word.encode(errors="replace")) % WORD_DIMS
        return at


_SLOTS = _WordSlots()


def vectors(page: list[Block]) -> np.ndarray:
    """One row a block: hashed path parts, hashed words, measures."""
    x = np.zeros((len(page), DIMS), np.float32)
    for i, b in enumerate(page):
        for depth, names in enumerate(reversed(b.path)):
            for j, name in enumerate(names):
                x[i, _slot(("tag:" if j == 0 else "name:") + name, PATH_DIMS)] += 1.0 if depth < 2 else 0.6
        words = b.text.lower().split()
        x[i, PATH_DIMS : PATH_DIMS + WORD_DIMS] = np.bincount(list(map(_SLOTS.__getitem__, words)), minlength=WORD_DIMS) / len(words)
        n = len(b.text)
        x[i, PATH_DIMS + WORD_DIMS :] = (
            min(np.log1p(n) / 8, 2), min(np.log1p(len(words)) / 6, 2), min(b.link_chars / n, 1), sum(map(b.text.count, ".,;:!?")) / n * 5,
            sum(map(b.text.count, "0123456789")) / n, b.text[-1] in ".!?…\"”", i / len(page), len(page) / (len(page) + 40), len(b.path) / 10, b.text[0].isupper(),
        )
    return x


class Labeller:
    """Bidirectional LSTM with a logistic output for each block."""

    def __init__(self, hidden: int = 16, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.p: dict[str, np.ndarray] = {"out": rng.normal(0, 0.3, (2 * hidden + DIMS, 1)), "bias": np.zeros(1)}
        for side in ("f", "b"):
            self.p[f"x{side}"] = rng.normal(0, 0.15, (DIMS, 4 * hidden))
            self.p[f"h{side}"] = rng.normal(0, 0.2, (hidden, 4 * hidden))
            self.p[f"c{side}"] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)])
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _side(self, x: np.ndarray, mask: np.ndarray, side: str, keep: list | None = None) -> np.ndarray:
        """Hidden states (pages, blocks, hidden); the backward side reads from the end."""
        n, steps, _ = x.shape
        h = c = np.zeros((n, self.hidden), np.float32)
        out = np.zeros((n, steps, self.hidden), np.float32)
        into = x @ self.p[f"x{side}"] + self.p[f"c{side}"]
        for t in range(steps) if side == "f" else reversed(range(steps)):
            z = into[:, t] + h @ self.p[f"h{side}"]
            i, f, o = (1 / (1 + np.exp(-z[:, k * self.hidden : (k + 1) * self.hidden])) for k in range(3))
            g = np.tanh(z[:, 3 * self.hidden :])
            live = mask[:, t, None]
            c2 = f * c + i * g
            tc = np.tanh(c2)
            if keep is not None:
                keep.append((t, i, f, o, g, c, tc, h, live))
            h, c = live * (o * tc) + (1 - live) * h, live * c2 + (1 - live) * c
            out[:, t] = h
        return out

    def scores(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        x, mask = _pad(pages)
        state = np.concatenate([self._side(x, mask, "f"), self._side(x, mask, "b"), x], axis=2)
        y = 1 / (1 + np.exp(-(state @ self.p["out"] + self.p["bias"])[..., 0]))
        return [y[i, : len(p)] for i, p in enumerate(pages)]

    def gradients(self, pages: list[np.ndarray], labels: list[np.ndarray]) -> dict[str, np.ndarray]:
        x, mask = _pad(pages)
        want = np.zeros(mask.shape, np.float32)
        for i, y in enumerate(labels):
            want[i, : len(y)] = y
        kept: dict[str, list] = {"f": [], "b": []}
        state = np.concatenate([*(self._side(x, mask, s, kept[s]) for s in "fb"), x], axis=2)
        y = 1 / (1 + np.exp(-(state @ self.p["out"] + self.p["bias"])[..., 0]))
        d = ((y - want) * mask / mask.sum())[..., None]
        grads = {"out": np.einsum("nts,ntk->sk", state, d), "bias": d.sum(axis=(0, 1))}
        back, width = d @ self.p["out"].T, self.hidden
        for at, side in enumerate("fb"):
            gx, gh, gc = (np.zeros_like(self.p[k + side]) for k in "xhc")
            dh = dc = np.zeros((len(pages), width), np.float32)
            for t, i, f, o, g, c, tc, h, live in reversed(kept[side]):
                dh_all = dh + back[:, t, at * width : (at + 1) * width]
                a = dh_all * live
                dc2 = a * o * (1 - tc**2) + dc * live
                dz = np.concatenate([dc2 * g * i * (1 - i), dc2 * c * f * (1 - f), a * tc * o * (1 - o), dc2 * i * (1 - g**2)], axis=1)
                gx += x[:, t].T @ dz
                gh += h.T @ dz
                gc += dz.sum(axis=0)
                dh, dc = dz @ self.p["h" + side].T + dh_all * (1 - live), dc2 * f + dc * (1 - live)
            grads |= {"x" + side: gx, "h" + side: gh, "c" + side: gc}
        return grads


def _pad(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(map(len, pages))
    x, mask = np.zeros((len(pages), longest, DIMS), np.float32), np.zeros((len(pages), longest), np.float32)
    for i, p in enumerate(pages):
        x[i, : len(p)], mask[i, : len(p)] = p, 1
    return x, mask


_SYLLABLES = "ka lo mi ter on re sa vi nu pel dor ish an the of in ou ent ra qui ber ge ción más ell tä über ver".split()


#: Stands before the article's texts in synthetic pages only.
MARK = "\ue000"


def _words(rng: random.Random, low: int, high: int, end: str = ".") -> str:
    out = ["".join(rng.choices(_SYLLABLES, k=rng.randint(1, 4))) for _ in range(rng.randint(low, high))]
    if rng.random() < 0.1:
        out = [x for w in out for x in (w, "|")]
    for i in range(len(out)):
        if rng.random() < 0.08 and len(out) > 6:
            out[i] += rng.choice((",", ".", ";"))
    return " ".join(out).capitalize() + (end if rng.random() < 0.85 else "")


def synthetic_page(rng: random.Random) -> str:
    """A page whose blocks of the article start with MARK."""
    mark = MARK
    parts: list[str] = []
    name = lambda *xs: rng.choice(xs)

    def noise(kind: str) -> str:
        links = "".join(f'<li><a href="/x">{_words(rng, 1, 3, "")}</a></li>' for _ in range(rng.randint(2, 9)))
        listed = rng.choice((f"<ul>{links}</ul>", links.replace("<li>", "<span>").replace("</li>", "</span> "), f"<div>{links}</div>".replace("li>", "div>")))
        prose = "".join(f"<p>{_words(rng, 2, 40)}</p>" for _ in range(rng.randint(1, 3)))
        line = _words(rng, 2, 14)
        return {
            "nav": lambda: name(f"<nav>{listed}</nav>", f'<div class="{name("menu", "nav", "navbar", "breadcrumb", "breadcrumbs", "navigation", "topnav")}">{listed}</div>', f'<ul id="{name("menu", "nav")}">{links}</ul>'),
            "header": lambda: name(f"<header><h1>{line}</h1>{listed}</header>", f"<header>{line}</header>", f'<div id="{name("header", "masthead", "banner", "top")}"><p>{line}</p></div>', f"<header><p>{line}</p></header>"),
            "footer": lambda: name(f"<footer>&copy; {line} &middot; {_words(rng, 3, 12)}</footer>", f'<div class="{name("footer", "site-footer", "copyright", "legal")}"><p>{prose}</p>{listed}</div>', f"<footer>{prose}</footer>"),
            "aside": lambda: name(f"<aside>{name(prose, listed, f'<h2>{line}</h2>{listed}')}</aside>", f'<div class="{name("sidebar", "side", "widget", "related", "popular", "trending", "recommended")}"><h3>{line}</h3>{name(listed, prose)}</div>', f'<section class="{name("related", "widget", "sidebar")}">{listed}</section>'),
            "ad": lambda: f'<{(t := name("div", "aside", "section", "p"))} class="{name("ad", "ads", "advert", "advertisement", "banner", "promo", "sponsored", "sponsor", "ad-slot", "promotion", "adsbox")}">{name(line, _words(rng, 5, 40), prose if t != "p" else line)}</{t}>',
            "notice": lambda: f'<div {name("class", "id")}="{name("notice", "cookie", "cookie-notice", "cookies", "alert", "consent", "gdpr", "popup", "modal", "paywall", "subscribe", "newsletter", "message", "warning")}">{name(prose, line)}{name("", "<button>Ok</button>")}</div>',
            "form": lambda: f'<form action="/x"{name("", " class=newsletter", " id=search")}>{name("", f"<label>{line}</label>")}<input name="q">{name("", f"<p>{line}</p>")}<button>{_words(rng, 1, 2, "")}</button></form>',
            "comments": lambda: name('<section id="comments">', '<div class="comments">', '<div id="comments" class="comment-list">', '<section class="comments">', '<ol class="comment-list">', '<div class="responses discussion">') + f"<h3>{line}</h3>" + "".join(name(f'<div class="comment"><b>{_words(rng, 1, 2, "")}</b>: <p>{_words(rng, 3, 50)}</p></div>', f'<p class="comment">{_words(rng, 3, 50)}</p>', f'<li class="comment">{_words(rng, 3, 40)}</li>', f"<p>{_words(rng, 3, 40)}</p>", f"<article class=\"comment\"><p>{_words(rng, 3, 40)}</p></article>") for _ in range(rng.randint(1, 5))) + "</section></div></ol>",
            "share": lambda: f'<div class="{name("share", "social", "tags", "byline", "meta", "author-box", "toolbar")}">{name(listed, line)}</div>',
        }[kind]()

    def main() -> str:
        out = []
        if rng.random() < 0.85:
            out.append(f"<h1>{mark}{_words(rng, 1, 10, '')}</h1>")
        if rng.random() < 0.2:
            out.append(noise("share"))
        for _ in range(rng.randint(1, 14)):
            r = rng.random()
            text = mark + _words(rng, *rng.choice(((1, 3), (3, 12), (8, 60), (40, 120))))
            if r < 0.72:
                out.append(name(f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br><p>{mark}{_words(rng, 4, 40)}</p>", f"<p>{text} <a href='/y'>{_words(rng, 1, 3, '')}</a></p>", f"<div>{text}</div>"))
            elif r < 0.8:
                out.append(f"<{(t := name('h2', 'h3', 'h4'))}>{mark}{_words(rng, 1, 8, '')}</{t}>")
            elif r < 0.86:
                out.append("<ul>" + "".join(f"<li>{mark}{_words(rng, 2, 20)}</li>" for _ in range(rng.randint(1, 5))) + "</ul>")
            elif r < 0.9:
                out.append(name(f"<blockquote><p>{text}</p></blockquote>", f"<pre>{text}</pre>", f"<blockquote>{text}</blockquote>", f"<figure><img src=x><figcaption>{text}</figcaption></figure>"))
            elif r < 0.93:
                out.append("<table>" + "".join(f"<tr><td>{mark}{_words(rng, 1, 4, '')}</td><td>{mark}{_words(rng, 1, 4, '')}</td></tr>" for _ in range(rng.randint(1, 4))) + "</table>")
            else:
                out.append(noise(name("ad", "form", "share", "notice", "aside")))
        body = "\n".join(out)
        if rng.random() < 0.15:
            body += noise("comments")
        plain = name("article", "article", "main", "section", "div")
        label = name(' class="content"', ' id="content"', ' class="post"', ' class="entry-content"', ' class="article-body"', ' class="story"', ' id="main"', ' class="post-content text"', ' itemprop="articleBody" class="body"')
        return name(f"<article>{body}</article>", f"<article>{body}</article>", f"<article{label}>{body}</article>", f"<main><article>{body}</article></main>", f"<main>{body}</main>", f"<{plain}{label}>{body}</{plain}>", f"<div{label}>{body}</div>", f"<main><div class=container>{body}</div></main>")

    tops = rng.sample(("nav", "header", "ad", "notice", "form", "nav"), rng.randint(0, 4))
    tails = rng.sample(("footer", "comments", "aside", "ad", "footer", "notice", "share", "form"), rng.randint(0, 5))
    parts = [noise(k) for k in tops] + [main()] + [noise(k) for k in tails]
    inner = "".join(parts)
    if rng.random() < 0.3:
        inner = f'<div class="{name("wrapper", "page", "container", "site", "layout")}">{inner}</div>'
    return f"<!DOCTYPE html><html><head><title>{_words(rng, 2, 8)}</title><style>p{{}}</style></head><body>{inner}" + name("</body></html>", "")


def training_pages(n: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    rng, out = random.Random(seed), []
    while len(out) < n:
        page = blocks(synthetic_page(rng))
        if page:
            y = np.array([b.text.startswith(MARK) for b in page], np.float32)
            for b in page:
                b.text = b.text.replace(MARK, "").strip() or "."
            out.append((vectors(page), y))
    return out


@lru_cache(maxsize=2)
def trained(pages: int = 700, epochs: int = 5, seed: int = 5) -> Labeller:
    """A labeller trained on `pages` synthetic pages by Adam; equal arguments give equal weights."""
    model, data, rng = Labeller(seed=seed), training_pages(pages, seed), random.Random(seed)
    m, v = ({k: np.zeros_like(x) for k, x in model.p.items()} for _ in range(2))
    step, steps = 0, epochs * ((pages + 15) // 16)
    for _ in range(epochs):
        data.sort(key=lambda d: len(d[0]) + rng.random() * 6)
        batches = [data[i : i + 16] for i in range(0, len(data), 16)]
        rng.shuffle(batches)
        for batch in batches:
            step += 1
            rate = 0.012 * (1 - step / (steps + 1)) + 1e-4
            for k, g in model.gradients([x for x, _ in batch], [y for _, y in batch]).items():
                g = np.clip(g, -1, 1)
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
                model.p[k] = (model.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return model


def main_texts(pages: list[str | None], model: Labeller, cells: int = 20_000) -> list[str]:
    """The main text of each page; pages of like length share a batch of at most `cells` blocks (or one page)."""
    parsed = [blocks(p) for p in pages]
    out = [""] * len(pages)
    order = sorted((i for i, b in enumerate(parsed) if b), key=lambda i: len(parsed[i]))
    while order:
        take = max(1, min(len(order), cells // len(parsed[order[-1]]), 128))
        batch, order = order[-take:], order[:-take]
        for i, score in zip(batch, model.scores([vectors(parsed[i]) for i in batch]), strict=True):
            out[i] = "\n".join(b.text for b, s in zip(parsed[i], score, strict=True) if s >= 0.5)
    return out


def extract(df: DataFrame, model: Labeller | None = None, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text) of every row."""
    labeller = model or trained()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(main_texts(part.column(part.num_columns - 1).to_pylist(), labeller), pa.string())], [*part.schema.names[:-1], "text"])

    rest = [c for c in df.columns if c not in (html_col, "text")]
    schema = T.StructType([*(df.schema[c] for c in rest), T.StructField("text", T.StringType())])
    return df.select(*rest, F.col(html_col)).mapInArrow(run, schema)
