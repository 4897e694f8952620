"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks, runs of text between block tags. Each block is described by its
hashed tag path (tags, classes and ids of its open elements), its hashed words and a few shape
numbers. A bidirectional LSTM in numpy reads the blocks of the whole page in order and labels
each as main text or not. It is trained on generated pages in many layouts; the frozen weights
are broadcast and pages are labelled in batches of like length.
"""

from __future__ import annotations

import functools
import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import slices

# Fixed values of HTML.
RAW = "script style title textarea iframe noembed noframes".split()  # what is in them is not markup
SILENT = frozenset("noscript template select svg".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSES = {"p": ("p",), "li": ("li",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}
BREAKS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul figure".split())

ATTRIBUTES = r"(?>[^=>]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))*+"  # quotes count after an equals sign only
DROPPED = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(" + "|".join(RAW) + rf")(?=[\s/>]){ATTRIBUTES}>.*?</\1(?=[\s/>])[^>]*>|<(?:script|style)(?=[\s/>]){ATTRIBUTES}>.*\Z", re.S | re.I
)
TAG = re.compile(rf"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)({ATTRIBUTES})>|<[/!?][^>]*>|<[a-zA-Z/!?][^<]*\Z")
NAMES = re.compile(r"(?<![-\w])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SPACE = re.compile(r"\s+")
PARTS = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
BUCKETS, WIDTH, HIDDEN, SHAPE = 1024, 12, 16, 6


def blocks(page: str | None) -> list[tuple[tuple[str, ...], str, int]]:
    """(tag path, text, how much of it is in links) of each leaf block, in page order.

    Raw elements are dropped with what is in them; script and style run to the end of the page if
    never closed, of the others only the tag goes then. Silent elements are dropped too, up to
    their end or their parent's. A head ends at the first tag that belongs in a body.
    """
    page = DROPPED.sub(" ", page or "")
    out: list[tuple[tuple[str, ...], str, int]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    opened: dict[str, int] = {}
    linked = at = silent = 0
    here: tuple[str, ...] = ()

    def leaf() -> None:
        nonlocal linked
        if parts:
            text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append((here, text, linked))
            parts.clear()
        linked = 0

    def close(name: str, only: frozenset[str] | None = None) -> None:
        nonlocal silent
        if not opened.get(name):
            return
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == name:
                for gone, _ in stack[k:]:
                    opened[gone] -= 1
                    silent -= gone in SILENT
                del stack[k:]
                return
            if only and stack[k][0] not in only:
                return

    def take(text: str) -> None:
        nonlocal here, linked
        if silent:
            return
        if not parts:
            here = tuple(x for _, names in stack for x in names)
        parts.append(text)
        linked += len(text) if opened.get("a") else 0

    for m in TAG.finditer(page):
        if m.start() > at:
            take(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if name == "br":
            parts.append(" ") if parts else None
            continue
        if name not in INLINE:
            leaf()
        if m[1]:
            close(name)
            continue
        if name in BREAKS_P or name == "body":
            close("head")
        if name in BREAKS_P:
            close("p", INLINE)
        for other in CLOSES.get(name, ()):
            close(other, INLINE)
        if name in VOID or m[3].endswith("/"):
            continue
        tokens = [name]
        if m[3]:
            for found in NAMES.finditer(m[3]):
                words = [w for w in PARTS.split((found[1] or found[2] or found[3] or "").lower()) if w]
                tokens += [f".{w}" for w in words]
        stack.append((name, tuple(tokens)))
        opened[name] = opened.get(name, 0) + 1
        silent += name in SILENT
    if at < len(page):
        take(page[at:])
    leaf()
    return out


@functools.lru_cache(200_000)
def _bucket(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "replace")) % BUCKETS


def describe(found: list[tuple[tuple[str, ...], str, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(path ids, path owners, word ids, word owners, shape numbers) of a page's blocks."""
    paths, powner, words, wowner = [], [], [], []
    shape = np.zeros((len(found), SHAPE), np.float32)
    for i, (path, text, linked) in enumerate(found):
        tokens = path + ((f"leaf:{path[-1]}",) if path else ())
        paths += [_bucket(t) for t in tokens]
        powner += [i] * len(tokens)
        w = text.lower().split()
        words += [_bucket("w:" + x) for x in w]
        wowner += [i] * len(w)
        n = len(text)
        shape[i] = (np.log1p(len(w)) / 5, min(1.0, linked / n), text[-1] in ".!?…", len(w) < 4, i == 0, "©" in text)
    return np.array(paths, np.int64), np.array(powner, np.int64), np.array(words, np.int64), np.array(wowner, np.int64), shape


def _mean(table: np.ndarray, ids: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, WIDTH), np.float32)
    np.add.at(out, owner, table[ids])
    return out / np.maximum(1, np.bincount(owner, minlength=n))[:, None].astype(np.float32)


#: Blocks of a batch of pages, padding included, and bytes of html whose blocks are held at once.
PADDED, HELD = 1 << 15, 1 << 22


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Weights of the bidirectional LSTM and its numpy forward and backward passes."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        n = 2 * WIDTH + SHAPE
        self.w = {"path": r.normal(0, 0.3, (BUCKETS, WIDTH)), "word": r.normal(0, 0.05, (BUCKETS, WIDTH)), "out": r.normal(0, 0.2, 2 * HIDDEN + n), "bias": np.zeros(1)}
        for d in "fb":
            self.w[d] = r.normal(0, 0.2, (n + HIDDEN + 1, 4 * HIDDEN))
            self.w[d][-1, HIDDEN : 2 * HIDDEN] = 1.0  # forget gates start open
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def inputs(self, pages: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        """(time, page, feature) inputs and (time, page) mask."""
        t = max(len(p[4]) for p in pages)
        x, mask = np.zeros((t, len(pages), 2 * WIDTH + SHAPE), np.float32), np.zeros((t, len(pages)), np.float32)
        for j, (a, ao, b, bo, shape) in enumerate(pages):
            n = len(shape)
            x[:n, j] = np.concatenate([_mean(self.w["path"], a, ao, n), _mean(self.w["word"], b, bo, n), shape], 1)
            mask[:n, j] = 1
        return x, mask

    def _scan(self, d: str, x: np.ndarray, mask: np.ndarray, keep: bool = True) -> tuple[np.ndarray, list]:
        h = c = np.zeros((x.shape[1], HIDDEN), np.float32)
        out, saved = np.zeros((*x.shape[:2], HIDDEN), np.float32), [None] * len(x)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            m = mask[t][:, None]
            z = np.concatenate([x[t], h, np.ones((x.shape[1], 1), np.float32)], 1)
            g = z @ self.w[d]
            i, f, o, u = sigmoid(g[:, :HIDDEN]), sigmoid(g[:, HIDDEN : 2 * HIDDEN]), sigmoid(g[:, 2 * HIDDEN : 3 * HIDDEN]), np.tanh(g[:, 3 * HIDDEN :])
            new = f * c + i * u
            if keep:
                saved[t] = (z, i, f, o, u, c, np.tanh(new), m)
            h, c = m * o * np.tanh(new) + (1 - m) * h, m * new + (1 - m) * c
            out[t] = h
        return out, saved

    def forward(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, list, list]:
        (f, sf), (b, sb) = self._scan("f", x, mask), self._scan("b", x, mask)
        top = np.concatenate([f, b, x], 2)
        return sigmoid(top @ self.w["out"] + self.w["bias"][0]), top, sf, sb

    def step(self, pages: list[tuple], labels: list[np.ndarray]) -> dict[str, np.ndarray]:
        """Gradients of the mean log loss, through time."""
        x, mask = self.inputs(pages)
        y = np.zeros(mask.shape, np.float32)
        for j, v in enumerate(labels):
            y[: len(v), j] = v
        p, top, sf, sb = self.forward(x, mask)
        d = (p - y) * mask / mask.sum()
        grad = {"out": np.einsum("tb,tbk->k", d, top), "bias": np.array([d.sum()], np.float32)}
        dtop = d[:, :, None] * self.w["out"]
        dx = dtop[:, :, 2 * HIDDEN :].copy()
        n = x.shape[2]
        for name, saved, lo, times in (("f", sf, 0, range(len(x) - 1, -1, -1)), ("b", sb, HIDDEN, range(len(x)))):
            gw = np.zeros_like(self.w[name])
            dh = dc = np.zeros((x.shape[1], HIDDEN), np.float32)
            for t in times:
                z, i, f, o, u, c, th, m = saved[t]
                dh = dh + dtop[t, :, lo : lo + HIDDEN]
                dnew = m * (dh * o * (1 - th * th)) + m * dc
                g = np.concatenate([dnew * u * i * (1 - i), dnew * c * f * (1 - f), m * dh * th * o * (1 - o), dnew * i * (1 - u * u)], 1)
                gw += z.T @ g
                dz = g @ self.w[name].T
                dx[t] += dz[:, :n]
                dh, dc = dz[:, n : n + HIDDEN] + (1 - m) * dh, dnew * f + (1 - m) * dc
            grad[name] = gw
        grad["path"], grad["word"] = np.zeros_like(self.w["path"]), np.zeros_like(self.w["word"])
        for j, (a, ao, b, bo, shape) in enumerate(pages):
            for key, ids, owner, lo in (("path", a, ao, 0), ("word", b, bo, WIDTH)):
                size = np.maximum(1, np.bincount(owner, minlength=len(shape)))[:, None]
                np.add.at(grad[key], ids, (dx[: len(shape), j, lo : lo + WIDTH] / size)[owner])
        return grad

    def label(self, pages: list[tuple]) -> list[np.ndarray]:
        """Probability of main text for each block of each page. Pages of like length go together, as many as make
        PADDED blocks with padding; a page of more blocks goes alone. Nothing is kept for a backward pass."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i][4])), key=lambda i: len(pages[i][4]))
        while order:
            longest = len(pages[order[-1]][4])
            some = order[-max(1, min(128, PADDED // longest)) :]
            del order[-len(some) :]
            x, mask = self.inputs([pages[i] for i in some])
            z = x @ self.w["out"][2 * HIDDEN :] + self.w["bias"][0]
            for d, lo in (("f", 0), ("b", HIDDEN)):
                z += self._scan(d, x, mask, keep=False)[0] @ self.w["out"][lo : lo + HIDDEN]
            for j, i in enumerate(some):
                out[i] = sigmoid(z[: len(pages[i][4]), j])
        return out


# Layouts of the generated training pages: block wrappers by part of the page.
MAIN = ["article", "main", "div class=post-content", "div id=content", "div class=article-body", "section class=entry-content", "main><article", "div class=story-text", "div class=content"]
OTHER = {
    "menu": ["nav", "div class=menu", "ul class=navbar", "header><nav", "div id=navigation", "div class=breadcrumbs"],
    "head": ["header", "div class=site-header", "div id=header", "div class=masthead"],
    "ad": ["div class=ad", "div class=advert", "aside class=ads", "div class=sponsored", "div id=ad-banner", "div class=promo", "section class=advertisement"],
    "side": ["aside", "div class=sidebar", "div id=sidebar", "section class=related", "div class=widget", "aside class=sidebar"],
    "notice": ["div class=cookie-notice", "div class=banner", "div class=notice", "div role=alert", "div class=newsletter-popup", "div id=cookie-consent", "div class=alert"],
    "form": ["form", "form class=subscribe", "div class=search><form", "form id=login"],
    "talk": ["div class=comments", "section id=comments", "div id=disqus-thread", "div class=reader-comments", "ol class=comment-list", "section class=comments"],
    "foot": ["footer", "div class=footer", "div id=footer", "footer class=site-footer"],
}
CUES = {
    "menu": "home about contact news products menu", "head": "welcome site official magazine", "ad": "buy now sale offer sponsored advertisement", "side": "related popular trending recent tags archive",
    "notice": "cookies accept privacy consent we use", "form": "email subscribe search name submit", "talk": "reply comment said ago thanks posted", "foot": "© copyright rights reserved terms",
}


def made_page(r: np.random.Generator) -> tuple[str, list[str]]:
    """One generated page and its main blocks."""
    syll = ["".join(x) for x in zip(r.choice(list("bcdfghklmnprstvwz"), 40), r.choice(list("aeiouéüó"), 40), strict=True)]
    word = lambda: "".join(r.choice(syll, r.integers(1, 4)))
    said = lambda n: " ".join(word() for _ in range(n))
    wrap = lambda how, inner: "".join(f"<{x.split()[0]} {x.split()[1].replace('=', '=\"')}\">" if " " in x else f"<{x}>" for x in how.split("><")) + inner + "".join(f"</{x.split()[0]}>" for x in reversed(how.split("><")))
    main: list[str] = []

    def body() -> str:
        made = []
        title = said(r.integers(2, 9)).capitalize()
        if r.random() < 0.85:
            main.append(title)
            made.append(f"<h1>{title}</h1>")
        for k in range(r.integers(1, 14)):
            text = ". ".join(said(r.integers(3, 30)).capitalize() for _ in range(r.integers(1, 5))) + ("." if r.random() < 0.9 else "")
            if r.random() < 0.2:  # short lines and lines with words of other parts are main text too
                text = said(r.integers(1, 5)).capitalize() + "."
            if r.random() < 0.12:
                text = " ".join([*r.choice(CUES[str(r.choice(list(CUES)))].split(), r.integers(1, 4)), said(r.integers(0, 6))]).strip() + "."
            kind = r.choice(["p", "p", "p", "p", "bold", "h2", "li", "quote", "div", "link", "pre"])
            if kind in ("h2",):
                text = said(r.integers(2, 7)).capitalize()
            if kind == "li":
                items = [said(r.integers(2, 12)) for _ in range(r.integers(1, 5))]
                main.extend(items)
                made.append("<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>")
                continue
            main.append(text)
            made.append({"p": f"<p>{text}</p>", "bold": f"<p><b>{text}<br>", "h2": f"<h2>{text}</h2>", "quote": f"<blockquote><p>{text}</p></blockquote>", "div": f"<div>{text}</div>", "link": f'<p><a href="/x">{text[: len(text) // 2]}</a>{text[len(text) // 2 :]}</p>', "pre": f"<pre>{text}</pre>"}[kind])
        return "".join(made)

    def other(kind: str) -> str:
        cue = CUES[kind].split()
        bit = lambda: " ".join([*r.choice(cue, r.integers(0, 3)), said(r.integers(1, 5))])
        if kind in ("menu", "side") and r.random() < 0.8:
            inner = "<ul>" + "".join(f'<li><a href="/{k}">{bit()}</a></li>' for k in range(r.integers(2, 9))) + "</ul>"
        elif kind == "talk":
            inner = "".join(f"<{t}>{bit()} {said(r.integers(4, 25))}.</{t}>" for t in r.choice(["p", "div", "li"], r.integers(1, 6)))
        elif kind == "form":
            inner = f"<label>{bit()}</label><input name=q><p>{bit()}</p><button>{bit()}</button>"
        else:
            inner = "".join(f"<p>{bit()} {said(r.integers(1, 12))}.</p>" if r.random() < 0.5 else f"{bit()} {said(r.integers(1, 12))}." for _ in range(r.integers(1, 3)))
        return wrap(str(r.choice(OTHER[kind])), inner)

    before = [other(k) for k in ("notice", "head", "menu", "ad", "side", "form") if r.random() < 0.45]
    r.shuffle(before)
    text = body()
    inside = ""
    if r.random() < 0.3:
        inside = other(str(r.choice(["ad", "side", "talk", "form", "notice"])))
    middle = wrap(str(r.choice(MAIN)), text + inside)
    after = [other(k) for k in ("talk", "ad", "side", "form", "notice", "foot") if r.random() < 0.45]
    page = "".join(before) + middle + "".join(after)
    if r.random() < 0.2:
        page = wrap(str(r.choice(["div class=wrapper", "div id=page", "div class=container"])), page)
    return f"<!DOCTYPE html><html><head><title>{said(4)}</title></head><body>{page}</body></html>", main


@functools.cache
def trained(pages: int = 900, epochs: int = 10, seed: int = 7) -> Labeller:
    """The labeller fitted to that many generated pages; the same for the same parameters."""
    r = np.random.default_rng(seed)
    made = []
    for _ in range(pages):
        page, main = made_page(r)
        found = blocks(page)
        want = {SPACE.sub(" ", m).strip() for m in main}
        made.append((describe(found), np.array([b[1] in want for b in found], np.float32)))
    net = Labeller(seed)
    m = {k: np.zeros_like(v) for k, v in net.w.items()}
    v = {k: np.zeros_like(x) for k, x in net.w.items()}
    t = 0
    for epoch in range(epochs):
        order = sorted(r.permutation(len(made)), key=lambda i: len(made[i][1]) // 6)
        groups = [order[i : i + 32] for i in range(0, len(order), 32)]
        r.shuffle(groups)
        for group in groups:
            t += 1
            grad = net.step([made[i][0] for i in group], [made[i][1] for i in group])
            for k, g in grad.items():
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                net.w[k] -= (0.02 if epoch < epochs - 3 else 0.005) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return net


def extract(pages: DataFrame) -> DataFrame:
    """Per row: page_id, url, text, n_chars, n_blocks.

    Blocks labelled main text, character references decoded and white space runs made one space,
    joined by a newline in page order. Null or empty html, or a page without a main block, gives
    an empty text. Memory follows the longest single page, not its batch. Repeated rows are each labelled, also without page_id; other columns are ignored,
    and an empty table gives no rows.
    """
    net = pages.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 2, HELD):
                found = [blocks(h.as_py()) for h in b.column(2)]
                scores = net.value.label([describe(f) for f in found])
                text = ["\n".join(x[1] for x, s in zip(f, score, strict=True) if s >= 0.5) for f, score in zip(found, scores, strict=True)]
                arrays = [b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64()), pa.array([len(f) for f in found], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["page_id", "url", "text", "n_chars", "n_blocks"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks long")
