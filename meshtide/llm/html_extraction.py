"""Main text of web pages, by a recurrent labeller of their blocks.

A page is read into leaves: runs of text between block-level tags, in page order. Each leaf is a vector of its tag path (learned vectors of the
hashed names, classes and ids of all elements around it), of its hashed words, and of a few shares. A bidirectional LSTM in
numpy reads a page's leaves from both ends, so every leaf is judged with the whole page in view; what is judged main text is the result.

There are no labels of pages, so the labeller learns from marked-up ones: in a bounded sample (``MAX_PAGES`` pages and ``MAX_BYTES`` of
html, least md5(page_id) first) leaves inside an article or main element are main text, unless an element around them names itself as
navigation, advert, comment and so on. The same leaves are also set into other page layouts, with and without telling names, so
that layouts the sample lacks are learned as well. Scoring is map only, over whole pages.

Defined cases: a null or empty page has an empty text, as has one without main text. Tags may be unclosed, a page may end anywhere.
Comments, scripts, styles and other raw elements are no leaves. A line break is white space. Repeated rows get equal texts. Columns other
than page_id, url and html are ignored. An empty table gives an empty result; a sample without marked-up pages is replaced by its longest leaves.
"""

from __future__ import annotations

import re
import zlib
from html import unescape

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshtide.llm.ngrams import word_hashes
from meshtide.llm.shared import arrow_map

MAX_PAGES, MAX_BYTES = 500, 16 << 20
NAMES, WORDS = 4096, 8192  # buckets of names and of words
D_NAME, D_WORD, HIDDEN, SHARES = 16, 12, 24, 7
SLICE_BYTES = 2 << 20
CELLS = 1 << 16  # leaves, with padding, of a batch of pages
WINDOW = 64  # leaves of a training sequence

TAG = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>?|</(?![a-zA-Z])[^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>?", re.S)
MARK = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
# Element names as HTML defines them
RAW = {"script", "style", "title", "textarea", "template", "iframe", "noembed", "noframes", "xmp", "svg", "math"}
VOID = {"area", "base", "col", "embed", "hr", "link", "meta", "param", "source", "track"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "input", "ins", "kbd",
          "label", "map", "mark", "meter", "nobr", "output", "picture", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub",
          "sup", "time", "tt", "u", "var", "wbr"}
HEADS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# an open element of the left ends where one of the right begins, unless one of the last set stands between
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
        "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
# names that tell what is not main text, as far as the sample's own markup goes
OTHER_TAGS = {"nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "noscript", "fieldset"}
OTHER_WORDS = {"ad", "ads", "advert", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "cookie", "cookies", "footer", "login",
               "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "popup", "promo", "related", "reply", "respond", "share", "sidebar", "social",
               "sponsor", "sponsored", "subscribe", "toolbar", "widget"}


def bucket(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "replace")) % NAMES


class Pages:
    """The leaves of a run of pages, and the elements around them as a forest: parents stand before children."""

    def __init__(self):
        self.texts: list[str] = []
        self.node: list[int] = []  # element of each leaf
        self.links: list[float] = []
        self.sizes: list[int] = []  # leaves per page
        self.parent, self.marks, self.names = [-1], [()], [frozenset()]
        self._known: dict[str, tuple] = {}

    def _element(self, name: str, attributes: str, parent: int) -> int:
        key = name + attributes
        held = self._known.get(key)
        if held is None:
            words = [w.lower() for m in MARK.finditer(attributes) for w in PIECE.findall(m[1] or m[2] or m[3] or "")]
            held = (tuple({bucket(name), *(bucket("." + w) for w in words)}), frozenset([name, *("." + w for w in words)]))
            if len(self._known) > 20_000:
                self._known.clear()
            self._known[key] = held
        self.parent.append(parent)
        self.marks.append(held[0])
        self.names.append(held[1])
        return len(self.parent) - 1

    def add(self, page: str) -> None:
        stack: list[tuple[str, int]] = [("", 0)]
        parts: list[str] = []
        link_at, linked, at, before = 0, 0, 0, len(self.texts)

        def close_leaf():
            nonlocal linked
            text = " ".join("".join(parts).split())
            if text:
                self.texts.append(text)
                self.node.append(stack[-1][1])
                self.links.append(min(1.0, linked / len(text)))
            parts.clear()
            linked = 0

        while at < len(page):
            m = TAG.search(page, at)
            end = m.start() if m else len(page)
            if end > at:
                text = unescape(page[at:end]) if "&" in page[at:end] else page[at:end]
                parts.append(text)
                linked += len(text.strip()) if link_at else 0
            if not m:
                break
            at = m.end()
            if m[2] is None:
                continue
            name = m[2].lower()
            if name in INLINE:
                if name == "br":
                    parts.append(" ")
                elif name == "a":
                    link_at = 0 if m[1] else len(stack)
                continue
            if name in RAW:
                if not m[1]:
                    past = re.compile(f"</{re.escape(name)}", re.I).search(page, at)
                    at = past.start() if past else len(page)
                continue
            close_leaf()
            if m[1]:
                if any(n == name for n, _ in stack):
                    while stack.pop()[0] != name:
                        pass
            else:
                if stack[-1][0] == "p" or (stack[-1][0] in HEADS and name in HEADS):
                    stack.pop()
                if name in ENDS:
                    ended, until = ENDS[name]
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i][0] in ended:
                            del stack[i:]
                            break
                        if stack[i][0] in until:
                            break
                if name not in VOID:
                    stack.append((name, self._element(name, m[3], stack[-1][1])))
            if link_at > len(stack):
                link_at = 0
        close_leaf()
        self.sizes.append(len(self.texts) - before)

    def around(self, leaf: int) -> set[str]:
        """All names of the elements around a leaf."""
        out: set[str] = set()
        at = self.node[leaf]
        while at > 0:
            out |= self.names[at]
            at = self.parent[at]
        return out

    def arrays(self) -> dict[str, np.ndarray]:
        """What a labeller needs of them, per element, per leaf and per word."""
        data = [t.encode("utf-8", "replace") for t in self.texts]
        joined = np.frombuffer(b"\n".join(data) + b"\n", np.uint8)
        h, leaf = word_hashes(joined, np.cumsum([len(d) + 1 for d in data]) - 1) if data else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        chars = np.array([len(t) for t in self.texts], np.float64)
        words = np.bincount(leaf, minlength=len(data))
        sizes = np.array(self.sizes, np.int64)
        place = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        ends_with_stop = [t[-1] in ".!?:;" for t in self.texts]
        commas = np.array([t.count(",") + t.count(".") for t in self.texts], np.float64)
        shares = np.stack([np.log1p(chars) / 6, np.log1p(words) / 4, np.array(self.links, np.float64), np.array(ends_with_stop, np.float64),
                           commas / np.maximum(words, 1), place / np.repeat(np.maximum(sizes - 1, 1), sizes), 1 / (1.0 + place)], 1) if data else np.zeros((0, SHARES))
        depth = np.zeros(len(self.parent), np.int64)
        for i in range(1, len(depth)):
            depth[i] = depth[self.parent[i]] + 1
        counts = np.array([len(m) for m in self.marks])
        return {"parent": np.array(self.parent), "depth": depth, "mark": np.array([x for m in self.marks for x in m], np.int64), "mark_of": np.repeat(np.arange(len(counts)), counts),
                "node": np.array(self.node, np.int64), "word": (h % np.uint64(WORDS)).astype(np.int64), "word_leaf": leaf.astype(np.int64),
                "n_words": np.maximum(words, 1), "shares": shares.astype(np.float32), "sizes": sizes}


def levels(depth: np.ndarray) -> list[np.ndarray]:
    """Elements by depth, from the first below the top."""
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)[1:]


def start(seed: int = 5) -> dict[str, np.ndarray]:
    random = np.random.default_rng(seed)
    d_in = 2 * D_NAME + D_WORD + SHARES

    def normal(*shape, scale):
        return (random.normal(size=shape) * scale).astype(np.float32)

    model = {"name": normal(NAMES, D_NAME, scale=0.3), "word": normal(WORDS, D_WORD, scale=0.1), "out": normal(2 * HIDDEN + d_in, scale=0.1), "bias": np.zeros(1, np.float32)}
    for side in "fb":
        model |= {f"w{side}": normal(d_in, 4 * HIDDEN, scale=d_in**-0.5), f"u{side}": normal(HIDDEN, 4 * HIDDEN, scale=HIDDEN**-0.5), f"c{side}": np.zeros(4 * HIDDEN, np.float32)}
        model[f"c{side}"][HIDDEN:2 * HIDDEN] = 1  # remember, at first
    return model


def inputs(model: dict, a: dict) -> np.ndarray:
    """One row per leaf: path, own element, words, shares."""
    own = np.zeros((len(a["parent"]), D_NAME), np.float32)
    np.add.at(own, a["mark_of"], model["name"][a["mark"]])
    path = own.copy()
    for level in levels(a["depth"]):
        path[level] += path[a["parent"][level]]
    words = np.zeros((len(a["node"]), D_WORD), np.float32)
    for at in range(0, len(a["word"]), 1 << 18):
        part = slice(at, at + (1 << 18))
        leaf = a["word_leaf"][part]
        first = np.flatnonzero(np.concatenate([[True], leaf[1:] != leaf[:-1]]))
        words[leaf[first]] += np.add.reduceat(model["word"][a["word"][part]], first)
    return np.concatenate([np.tanh(path[a["node"]]), np.tanh(own[a["node"]]), words / a["n_words"][:, None].astype(np.float32), a["shares"]], axis=1)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * z)


def run_lstm(x: np.ndarray, on: np.ndarray, w: np.ndarray, u: np.ndarray, c0: np.ndarray, keep: bool = False):
    """(T, B, HIDDEN) states of one direction; where ``on`` is 0 the state is carried on. ``keep``: also what going back needs."""
    steps, n = on.shape
    gates = x.reshape(-1, x.shape[-1]) @ w + c0
    gates = gates.reshape(steps, n, -1)
    h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    states, held = np.empty((steps, n, HIDDEN), np.float32), []
    for t in range(steps):
        z = gates[t] + h @ u
        s = sigmoid(z[:, :3 * HIDDEN])
        i, f, o = s[:, :HIDDEN], s[:, HIDDEN:2 * HIDDEN], s[:, 2 * HIDDEN:]
        g = np.tanh(z[:, 3 * HIDDEN:])
        m = on[t][:, None]
        fresh = f * c + i * g
        squashed = np.tanh(fresh)
        if keep:
            held.append((i, f, o, g, squashed, c, h, m))
        c = np.where(m, fresh, c)
        h = np.where(m, o * squashed, h)
        states[t] = h
    return states, held


def back_lstm(x: np.ndarray, held: list, d_states: np.ndarray, w: np.ndarray, u: np.ndarray):
    """Gradients of (w, u, c0, x) from those of the states."""
    steps, n = d_states.shape[:2]
    dz = np.empty((steps, n, 4 * HIDDEN), np.float32)
    du, dh, dc = np.zeros_like(u), np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1):
        i, f, o, g, squashed, c, h, m = held[t]
        dh = dh + d_states[t]
        to_c = np.where(m, dc + dh * o * (1 - squashed**2), 0)
        dz[t] = np.concatenate([to_c * g * i * (1 - i), to_c * c * f * (1 - f), np.where(m, dh * squashed * o * (1 - o), 0), to_c * i * (1 - g**2)], axis=1)
        du += h.T @ dz[t]
        dh = np.where(m, 0, dh) + dz[t] @ u.T
        dc = np.where(m, to_c * f, dc)
    flat = dz.reshape(steps * n, -1)
    return x.reshape(steps * n, -1).T @ flat, du, flat.sum(axis=0), (flat @ w.T).reshape(x.shape)


def padded(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(T, B) leaf numbers of pages, and where there is one."""
    step = np.arange(int(sizes.max()))[:, None]
    on = step < sizes[None, :]
    return np.where(on, starts[None, :] + step, 0), on


def odds(model: dict, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Log odds of every leaf; pages of like length are read together."""
    out, starts = np.zeros(len(x)), np.cumsum(sizes) - sizes
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 0]
    at = 0
    while at < len(order):
        to = at + 1
        while to < len(order) and (to - at + 1) * sizes[order[to]] <= CELLS:
            to += 1
        rows = order[at:to]
        place, on = padded(starts[rows], sizes[rows])
        seq = x[place]
        ahead, _ = run_lstm(seq, on, model["wf"], model["uf"], model["cf"])
        back, _ = run_lstm(seq[::-1], on[::-1], model["wb"], model["ub"], model["cb"])
        z = np.concatenate([ahead, back[::-1], seq], axis=2) @ model["out"] + model["bias"][0]
        out[place[on]] = z[on]
        at = to
    return out


class Adam:
    def __init__(self, model: dict, rate: float):
        self.model, self.rate, self.t = model, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in model.items()}
        self.v = {k: np.zeros_like(v) for k, v in model.items()}

    def step(self, grads: dict, share: float) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.01 * (g * g - self.v[k])
            self.model[k] -= self.rate * share * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.99**self.t)) + 1e-7)


def gradients(model: dict, a: dict, label: np.ndarray, rows: np.ndarray, starts: np.ndarray, sizes: np.ndarray, random: np.random.Generator) -> dict:
    """Of the mean log loss over the leaves of the training sequences ``rows``; half of the leaves hide their words, so that the page's build counts."""
    x = inputs(model, a)
    seen = random.random(len(x)) < 0.5
    x[~seen, 2 * D_NAME:2 * D_NAME + D_WORD] = 0
    place, on = padded(starts[rows], sizes[rows])
    seq = x[place] * on[..., None]
    ahead, kept_f = run_lstm(seq, on, model["wf"], model["uf"], model["cf"], keep=True)
    back, kept_b = run_lstm(seq[::-1], on[::-1], model["wb"], model["ub"], model["cb"], keep=True)
    both = np.concatenate([ahead, back[::-1], seq], axis=2)
    dz = (np.where(on, sigmoid(both @ model["out"] + model["bias"][0]) - label[place], 0) / on.sum()).astype(np.float32)
    grads = {"out": np.tensordot(dz, both, axes=2), "bias": dz.sum().reshape(1)}
    d_both = dz[..., None] * model["out"]
    grads["wf"], grads["uf"], grads["cf"], d_f = back_lstm(seq, kept_f, d_both[..., :HIDDEN], model["wf"], model["uf"])
    grads["wb"], grads["ub"], grads["cb"], d_b = back_lstm(seq[::-1], kept_b, d_both[::-1, :, HIDDEN:2 * HIDDEN], model["wb"], model["ub"])
    d_x = np.zeros_like(x)
    d_x[place[on]] = (d_both[..., 2 * HIDDEN:] + d_f + d_b[::-1])[on]
    d_path, d_own = (d_x[:, k * D_NAME:(k + 1) * D_NAME] * (1 - x[:, k * D_NAME:(k + 1) * D_NAME] ** 2) for k in (0, 1))
    per_path, per_own = (np.zeros((len(a["parent"]), D_NAME), np.float32) for _ in range(2))
    np.add.at(per_path, a["node"], d_path)
    np.add.at(per_own, a["node"], d_own)
    for level in reversed(levels(a["depth"])):
        np.add.at(per_path, a["parent"][level], per_path[level])
    grads["name"], grads["word"] = np.zeros_like(model["name"]), np.zeros_like(model["word"])
    np.add.at(grads["name"], a["mark"], (per_path + per_own)[a["mark_of"]])
    d_word = d_x[:, 2 * D_NAME:2 * D_NAME + D_WORD] * seen[:, None] / a["n_words"][:, None]
    order = np.argsort(a["word"], kind="stable")
    first = np.flatnonzero(np.diff(a["word"][order], prepend=-1))
    if len(first):
        grads["word"][a["word"][order[first]]] = np.add.reduceat(d_word[a["word_leaf"][order]], first)
    return grads


def silver(page: str) -> tuple[list[str], list[int]]:
    """The leaves of a page and, from its own markup, which are main text; no labels where nothing is marked."""
    pages = Pages()
    pages.add(page)
    around = [pages.around(i) for i in range(len(pages.texts))]
    marked = [bool(x & {"article", "main"}) and not x & OTHER_TAGS and not any(w[1:] in OTHER_WORDS for w in x if w[0] == ".") for x in around]
    return pages.texts, [int(m) for m in marked] if any(marked) else []


# What layouts are drawn from: (before, after) of main text, then of the rest, in markup that pages in general use
MAIN = ["<article>", "<main>", "<main><article>", "<div class=content>", "<div id=main-content>", "<div class='post-body entry'>", "<section class=story>", "<div role=main>",
        "<div><div>", "<div class=container><div class=article-body>", "<table><tr><td>", "<div class=page><section>", "<main><div class=text>"]
BLOCK = ["p"] * 8 + ["h2", "h3", "li", "blockquote", "div", "pre", "dd", "td"]
REST = ["<nav class=menu><ul>", "<nav>", "<header>", "<header class=site-header><div>", "<div id=header>", "<ul class=menu>", "<div class=breadcrumbs>", "<footer>", "<div class=footer>",
        "<aside>", "<div class=sidebar>", "<div id=sidebar><section class=widget>", "<aside class=related><ul>", "<div class=ad>", "<div class='ad-banner sponsored'>", "<ins class=adsbygoogle><div>",
        "<div class=cookie-notice>", "<div class=notice role=alert>", "<div class=banner>", "<form>", "<form class=newsletter><fieldset>", "<div class=share-buttons>", "<section class=comments>",
        "<div id=comments><ol><li class=comment>", "<div class=comment-list><div class=comment-body>", "<div class=promo>", "<dialog>", "<div class=login><form>", "<div class=popup-modal>", "<noscript>"]
PLAIN_REST = ["<div>", "<ul>", "<div><ul>", "<section>"]
SAID = ("Home|About us|Contact|Log in|Sign up|Subscribe to our newsletter|We use cookies to improve this site. Accept|Privacy policy|Terms of use|All rights reserved|Share this|Read more|"
        "Related articles|Advertisement|Sponsored|Leave a comment|Reply|3 comments|Search|Next page|Previous|Follow us|Back to top|Print|Email address|Your name").split("|")


def laid_out(main: list[str], rest: list[str], random: np.random.Generator) -> tuple[str, list[int]]:
    """A page of these leaves in a random layout, and the labels of its leaves in order."""
    label: list[int] = []
    pick = lambda of: of[random.integers(len(of))]
    escape = lambda t: t.replace("&", "&amp;").replace("<", "&lt;")

    def block(text: str, tag: str, good: int) -> str:
        label.append(good)
        return f"<{tag}>{escape(text)}</{tag}>"

    def closing(opened: str) -> str:
        return "".join(f"</{n}>" for n in reversed(re.findall(r"<([a-z]+)", opened)))

    def other(inside: bool) -> str:
        opened = pick(REST[8:] if inside or random.random() < 0.9 else PLAIN_REST) if inside else pick(REST + PLAIN_REST)
        wordy = "comment" in opened or random.random() < 0.3
        linked = not wordy and (opened in PLAIN_REST or random.random() < 0.5)
        body = block(pick(SAID) if random.random() < 0.5 or not main else " ".join(pick(main).split()[:random.integers(1, 8)]), pick(["h1", "h2", "h3", "h4"]), 0) if random.random() < 0.4 else ""
        for _ in range(random.integers(1, 7)):
            words = (pick(main) if main else pick(SAID)).split()
            text = pick(rest) if rest and random.random() < 0.4 else pick(SAID) if random.random() < 0.4 else " ".join(words[:random.integers(1, 60 if wordy else 6)])
            tag = "li" if "<ul" in opened or "<ol" in opened else "p" if wordy else pick(["p", "div", "li", "h3", "button"] if "form" in opened else ["p", "div", "li", "h3"])
            made = block(text, tag, 0)
            body += made.replace(">", "><a href=/x>", 1).replace(f"</{tag}>", f"</a></{tag}>") if linked else made
        return opened + body + closing(opened)

    page = "".join(other(False) for _ in range(random.integers(0, 4)))
    opened = pick(MAIN)
    page += opened
    parts = list(main[:40])
    if random.random() < 0.3:
        parts = [parts[i] for i in sorted(random.permutation(len(parts))[:random.integers(1, len(parts) + 1)])]
    if random.random() < 0.2:  # short lines, repeated, are main text where they stand in it
        words, i = pick(parts).split(), random.integers(len(parts) + 1)
        parts[i:i] = [" ".join(words[:random.integers(1, 5)])] * int(random.integers(2, 12))
    inner = random.random() < 0.5
    for i, text in enumerate(parts):
        made = block(text, pick(["h1", "h1", "h2", "p"]) if i == 0 else pick(BLOCK), 1)
        page += f"<header>{made}</header>" if i == 0 and random.random() < 0.3 else made
        if inner and random.random() < 0.2:
            page += other(True)
    page += other(True) if inner and random.random() < 0.5 else ""
    return page + closing(opened) + "".join(other(False) for _ in range(random.integers(0, 4))), label


def train(sample: list[str], layouts: int = 3, updates: int = 500, width: int = 20, rate: float = 0.01, seed: int = 5) -> dict[str, np.ndarray]:
    """Learn from the pages as they are and from ``layouts`` random ones of each, in ``updates`` steps of ``width`` sequences."""
    model, random = start(seed), np.random.default_rng(seed)
    ready: list[tuple[str, list[int]]] = []
    for page in sample:
        leaves, label = silver(page)
        if label:
            ready.append((page, label))
        else:
            cut = np.median([len(t) for t in leaves]) if leaves else 0
            label = [int(len(t) >= cut) for t in leaves]
        main, rest = ([t for t, x in zip(leaves, label, strict=True) if x == y] for y in (1, 0))
        if main:
            ready += [laid_out(main, rest, random) for _ in range(layouts)]
    if not ready:
        return model
    adam = Adam(model, rate)
    order, batches = random.permutation(len(ready)), []
    for at in range(0, len(order), width):
        pages, label = Pages(), []
        for r in order[at:at + width]:
            pages.add(ready[r][0])
            label += ready[r][1]
        batches.append((pages.arrays(), np.array(label, np.float32)))
    for step in range(updates):
        a, label = batches[step % len(batches)]
        sizes = a["sizes"]
        # of a longer page, another window each time
        first = np.cumsum(sizes) - sizes + np.array([random.integers(0, max(1, s - WINDOW + 1)) for s in sizes])
        some = np.flatnonzero(sizes > 0)
        if len(some):
            adam.step(gradients(model, a, label, some, first, np.minimum(sizes, WINDOW), random), 1 - step / updates)
    return model


def fit(table: DataFrame) -> dict[str, np.ndarray]:
    """Learn from the sample of ``table``, which the driver holds: at most MAX_PAGES pages and MAX_BYTES, whole pages."""
    size = F.octet_length(F.coalesce("html", F.lit("")))
    first = table.where("html is not null").select(F.md5(F.col("page_id").cast("string")).alias("h"), size.alias("size"), F.xxhash64("html").alias("t"), "html")
    keys = first.where(F.col("size") <= MAX_BYTES).select("h", "t", "size").orderBy("h", "t").limit(MAX_PAGES).collect()
    fits = np.cumsum([r["size"] for r in keys]) <= MAX_BYTES
    if not fits.any():
        return train([])
    last = keys[int(fits.sum()) - 1]
    rows = first.where((F.col("h") < last.h) | ((F.col("h") == last.h) & (F.col("t") <= last.t))).select("h", "t", "html").distinct().limit(MAX_PAGES).collect()
    return train([r.html for r in sorted(rows, key=lambda r: (r.h, r.t))])


def extract(pages: list[str], model: dict, least: float = 0.0) -> list[str]:
    """The main text of each page."""
    held = Pages()
    for p in pages:
        held.add(p)
    a = held.arrays()
    good = odds(model, inputs(model, a), a["sizes"]) >= least
    out, at = [], 0
    for n in held.sizes:
        out.append("\n\n".join(t for t, g in zip(held.texts[at:at + n], good[at:at + n].tolist(), strict=True) if g))
        at += n
    return out


def main_texts(table: DataFrame, model: dict | None = None) -> DataFrame:
    """(page_id, url, text, n_chars)."""
    shipped = table.sparkSession.sparkContext.broadcast(fit(table) if model is None else model)

    def run(batches):
        for b in batches:
            texts: list[str] = []
            sizes = pc.binary_length(b["html"]).to_numpy()
            at = 0
            while at < len(sizes):
                to = at + 1 + int(np.searchsorted(np.cumsum(sizes[at + 1:]), SLICE_BYTES))
                texts += extract(b["html"].slice(at, to - at).to_pylist(), shipped.value)
                at = to
            yield {"page_id": b["page_id"], "url": b["url"], "text": texts, "n_chars": [len(t) for t in texts]}

    rows = table.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    return arrow_map(rows, run, f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long")
