"""Main text of web pages: a recurrent block labeller.

A page is read as its leaf sequence. Each block is a vector: the mean of learned vectors of hashed path parts (tags, names
of classes and ids), of learned vectors of hashed words, and some numbers (length, share of link text, place). A
bidirectional LSTM in numpy reads the sequence both ways, so each block is judged in the context of the whole page, and a
logistic layer tells main text from the rest.

There are no labels for pages, so the net is trained here on pages that ``synthetic_page`` makes: many layouts with menus,
headers, footers, sidebars, notices, adverts, forms and reader comments around articles, whose blocks are known. Training
is seeded, takes some seconds and is done once for each driver.

Labelling keeps no tape: a direction holds one state for each page of a batch and one number for each block, batches are
bounded by blocks and by bytes of html, and a page of more blocks than a batch is read whole, in pieces that hand on the
state.

Defined cases: a null or empty page, or one without main blocks, has an empty text; equal rows get equal results; other
columns are not looked at; very long pages are labelled whole.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm import kernel as K
from tessel.llm.html_blocks import Block, blocks

PATHS, WORDS, PATH_VECTOR, WORD_VECTOR, NUMBERS, HIDDEN = 1024, 512, 24, 4, 5, 24
PAGES, EPOCHS, BATCH, RATE = 480, 6, 16, 0.01
#: Blocks of all pages of a labelling batch, padding included.
BLOCKS = 1 << 14
INPUT = PATH_VECTOR + WORD_VECTOR + NUMBERS


def path_parts(path: tuple[str, ...]) -> list[int]:
    """Hashed parts of a path: each part, and each tag with the one that holds it."""
    tags = [x for x in path if x[0] != "."]
    seen = [*path, *(f"{a}>{b}" for a, b in zip(tags, tags[1:], strict=False))]
    return [zlib.crc32(x.encode()) % PATHS for x in seen] or [0]


class Page:
    """A page's blocks as arrays: parts of the different paths, each block's path, words, numbers."""

    def __init__(self, found: list[Block]) -> None:
        number: dict[tuple[str, ...], int] = {}
        self.which = np.array([number.setdefault(b.path, len(number)) for b in found], np.int64)
        parts = [path_parts(p) for p in number]
        self.part = np.array([x for p in parts for x in p], np.int64)
        self.part_of = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        data, off = K.byte_view(pa.array([b.text for b in found], pa.string()))
        starts, ends, woff = K.word_bounds(K.LOWER[data], off, K.SPACED)
        self.word = (K.word_hashes(K.LOWER[data], starts, ends) % np.uint64(WORDS)).astype(np.int64)
        self.word_of = woff
        n = len(found)
        size = np.array([len(b.text) for b in found], np.float64)
        link = np.array([b.linked for b in found], np.float64)
        self.numbers = np.stack([np.log1p(size) / 5, np.minimum(link / np.maximum(size, 1), 1), np.arange(n) / max(n, 1), 1 / (1 + np.arange(n)), 1 / (1 + np.arange(n)[::-1])], 1)

    def vectors(self, net: dict[str, np.ndarray]) -> np.ndarray:
        path = np.add.reduceat(net["path"][self.part], self.part_of[:-1]) / np.diff(self.part_of)[:, None]
        count = np.diff(self.word_of)
        block = np.repeat(np.arange(len(count)), count)
        words = [np.bincount(block, net["word"][self.word, d], len(count)) / np.maximum(count, 1) for d in range(WORD_VECTOR)]
        return np.concatenate([path[self.which], np.stack(words, 1), self.numbers], 1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _lstm(x: np.ndarray, mask: np.ndarray, w: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
    """States for inputs (steps, rows, INPUT); a masked step keeps the state."""
    rows = x.shape[1]
    h, c = np.zeros((rows, HIDDEN)), np.zeros((rows, HIDDEN))
    out, tape = np.zeros((x.shape[0], rows, HIDDEN)), []
    for t in range(x.shape[0]):
        joined = np.concatenate([x[t], h], 1)
        z = joined @ w + b
        i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(z[:, 3 * HIDDEN :])
        m = mask[t][:, None]
        fresh = f * c + i * g
        tanh = np.tanh(fresh)
        tape.append((joined, i, f, o, g, c, tanh, m))
        c = np.where(m, fresh, c)
        h = np.where(m, o * tanh, h)
        out[t] = h
    return out, tape


def _lstm_back(slope: np.ndarray, tape: list[tuple], w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slopes of inputs, weights and bias."""
    steps, rows, _ = slope.shape
    to_x, to_w, to_b = np.zeros((steps, rows, INPUT)), np.zeros_like(w), np.zeros(4 * HIDDEN)
    dh, dc = np.zeros((rows, HIDDEN)), np.zeros((rows, HIDDEN))
    for t in range(steps - 1, -1, -1):
        joined, i, f, o, g, c, tanh, m = tape[t]
        dh = dh + slope[t]
        own = np.where(m, dh, 0)
        dcell = np.where(m, dc, 0) + own * o * (1 - tanh * tanh)
        dz = np.concatenate([dcell * g * i * (1 - i), dcell * c * f * (1 - f), own * tanh * o * (1 - o), dcell * i * (1 - g * g)], 1)
        to_w += joined.T @ dz
        to_b += dz.sum(0)
        back = dz @ w.T
        to_x[t] = back[:, :INPUT]
        dh = back[:, INPUT:] + np.where(m, 0, dh)
        dc = dcell * f + np.where(m, 0, dc)
    return to_x, to_w, to_b


def _padded(pages: list[Page], net: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    each = [p.vectors(net) for p in pages]
    steps = max(len(v) for v in each)
    x, mask = np.zeros((steps, len(pages), INPUT)), np.zeros((steps, len(pages)), bool)
    for r, v in enumerate(each):
        x[: len(v), r], mask[: len(v), r] = v, True
    return x, mask, each


def _both_ways(x: np.ndarray, mask: np.ndarray, net: dict[str, np.ndarray]) -> tuple[np.ndarray, tuple, tuple]:
    ahead, tape = _lstm(x, mask, net["w1"], net["b1"])
    behind, tape2 = _lstm(x[::-1], mask[::-1], net["w2"], net["b2"])
    return np.concatenate([ahead, behind[::-1]], 2), tape, tape2


def _read(x: np.ndarray, w: np.ndarray, b: np.ndarray, out: np.ndarray) -> np.ndarray:
    """What the states of one direction add to each block's log-odds: (steps, rows) for inputs (steps, rows, INPUT)."""
    steps, rows, _ = x.shape
    h, c = np.zeros((rows, HIDDEN), np.float32), np.zeros((rows, HIDDEN), np.float32)
    odds, of_state, piece = np.empty((steps, rows), np.float32), np.ascontiguousarray(w[INPUT:]), max(1, BLOCKS // rows)
    for lo in range(0, steps, piece):
        z = x[lo : lo + piece] @ w[:INPUT] + b
        for t in range(len(z)):
            now = z[t] + h @ of_state
            gates = _sigmoid(now[:, : 3 * HIDDEN])
            c = gates[:, HIDDEN : 2 * HIDDEN] * c + gates[:, :HIDDEN] * np.tanh(now[:, 3 * HIDDEN :])
            h = gates[:, 2 * HIDDEN :] * np.tanh(c)
            odds[lo + t] = h @ out
    return odds


def label(pages: list[Page], net: dict[str, np.ndarray]) -> list[np.ndarray]:
    """For each block, the probability of main text. Pages of like lengths are read together.

    Padding stands behind a page's blocks in both directions, so no state that counts has seen it.
    """
    out: list[np.ndarray] = [np.zeros(0)] * len(pages)
    slim = {k: v.astype(np.float32) for k, v in net.items()}
    order = sorted((i for i, p in enumerate(pages) if len(p.numbers)), key=lambda i: len(pages[i].numbers), reverse=True)
    while order:
        steps = len(pages[order[0]].numbers)
        own, order = order[: max(1, BLOCKS // steps)], order[max(1, BLOCKS // steps) :]
        size = [len(pages[i].numbers) for i in own]
        odds = 0.0
        for way, (w, b, half) in {1: ("w1", "b1", slice(0, HIDDEN)), -1: ("w2", "b2", slice(HIDDEN, None))}.items():
            x = np.zeros((steps, len(own), INPUT), np.float32)
            for r, i in enumerate(own):
                x[: size[r], r] = pages[i].vectors(net)[::way]
            got = _read(x, slim[w], slim[b], slim["out"][half])
            if way < 0:
                for r, n in enumerate(size):
                    got[:n, r] = got[:n, r][::-1]
            odds = odds + got
        p = _sigmoid(odds + slim["base"])
        for r, i in enumerate(own):
            out[i] = p[: size[r], r]
    return out


# Names that web pages give to parts around the main text, and to the main text. The net learns them from made pages.
ASIDE = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs topnav menubar pagination toc tabs",
    "header": "header masthead banner topbar branding logo hero siteheader",
    "footer": "footer bottom copyright legal colophon sitefooter credits imprint",
    "aside": "sidebar aside widget related recommended popular trending rail secondary tags share social author bio",
    "notice": "notice cookie consent alert gdpr warning popup modal message announcement banner",
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion adsense adslot dfp",
    "form": "form login signup subscribe newsletter search contact register",
    "comments": "comments comment reply replies discussion disqus responses thread commentlist",
}
MAIN = "content article post entry main story text body page single blog news document prose copy"


def synthetic_page(rng: random.Random) -> tuple[str, list[bool]]:
    """A made page and, for each of its blocks in order, whether it is main text."""
    words = ["".join(rng.choice(["an", "er", "the", "in", "ou", "de", "la", "sch", "qu", "es", "ción", "th"]) for _ in range(rng.randint(1, 4))) for _ in range(60)]
    marks: list[bool] = []

    def text(n: int) -> str:
        return " ".join(rng.choice(words) for _ in range(n)).capitalize() + rng.choice([".", ".", "", "!"])

    def named(tag: str, names: str, always: bool = False) -> str:
        if not always and rng.random() < 0.3:
            return f"<{tag}>"
        name = rng.choice(names.split())
        name = rng.choice([name, f"{name} {rng.choice(words)}", f"{rng.choice(words)}-{name}", f"{name}-{rng.choice(['box', 'wrap', 'area', 'inner'])}"])
        return f'<{tag} {rng.choice(["class", "class", "id", "role"])}="{name}">'

    def put(body: str, main: bool) -> str:
        marks.append(main)
        return body

    def links(n: int) -> str:
        style = rng.random()
        if style < 0.6:
            return "<ul>" + "".join(put(f'<li><a href="/{i}">{text(rng.randint(1, 3))}</a></li>', False) for i in range(n)) + "</ul>"
        return put(" ".join(f'<a href="/{i}">{text(1)}</a>' for i in range(n)), False)

    def around(kind: str) -> str:
        tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind, rng.choice(["div", "section"]))
        native = tag not in ("div", "section")
        if native and rng.random() < 0.35:
            tag, native = rng.choice(["div", "section"]), False
        body = ""
        if kind == "comments":
            for _ in range(rng.randint(1, 6)):
                body += rng.choice(["<li>", "<div>", "<article>" if rng.random() < 0.3 else "<div>", ""]) + put(f"<p>{text(rng.randint(3, 50))}</p>", False)
            body = f"<h3>{put(text(2), False)}</h3>" + body if rng.random() < 0.5 else body
            if rng.random() < 0.5:
                body += put(f"<form><label>{text(2)}</label></form>", False)
        elif kind == "form":
            body = put(f"<label>{text(2)}</label>", False) + f"<p>{put(text(4), False)}<p>"
        elif kind == "nav" or rng.random() < 0.3:
            body = links(rng.randint(2, 8))
        else:
            for _ in range(rng.randint(1, 4)):
                shape = rng.random()
                body += put(f"<p>{text(rng.randint(2, 30))}</p>" if shape < 0.5 else f"<div>{text(rng.randint(2, 25))}</div>" if shape < 0.7 else f"<h4>{text(3)}</h4>", False)
        return f"{named(tag, ASIDE[kind], not native)}{body}</{tag}>"

    def plain(kind: str) -> str:
        tag = {"footer": "footer", "header": "header"}.get(kind, "div")
        return f"{named(tag, ASIDE[kind], tag == 'div')}{put(text(rng.randint(3, 25)), False)}</{tag}>"

    def article() -> str:
        out = ""
        if rng.random() < 0.8:
            head = text(rng.randint(2, 10))
            out += put(rng.choice([f"<h1>{head}</h1>", f"<h1>{head}</h1>", f"<header><h1>{head}</h1></header>"]), True)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 8, 12, 20])):
            shape = rng.random()
            n = rng.choice([1, 2, 5, 10, 20, 40, 80])
            if shape < 0.55:
                out += put(f"<p>{text(n)}</p>", True)
            elif shape < 0.7:
                out += put(f"<p><b>{text(n)}<br>", True)
            elif shape < 0.78:
                out += put(f"<h2>{text(3)}</h2>", True)
            elif shape < 0.84:
                out += "<ul>" + "".join(put(f"<li>{text(rng.randint(2, 12))}</li>", True) for _ in range(3)) + "</ul>"
            elif shape < 0.88:
                out += put(f"<blockquote>{text(n)}</blockquote>", True)
            elif shape < 0.92:
                out += put(f"<pre>{text(n)}</pre>", True)
            elif shape < 0.95:
                out += put(f'<p>{text(4)} <a href="#">{text(3)}</a> {text(n)}</p>', True)
            elif shape < 0.98:
                out += around(rng.choice(["advert", "aside", "notice"]))
            else:
                out += "<table><tr>" + "".join(put(f"<td>{text(2)}</td>", True) for _ in range(2)) + "</tr></table>"
        shape = rng.random()
        if shape < 0.5:
            return f"<article>{out}</article>"
        if shape < 0.6:
            return f"{named('article', MAIN)}{out}</article>"
        if shape < 0.75:
            return f"<main>{out}</main>"
        return f"{named(rng.choice(['div', 'section']), MAIN, True)}{out}</div>"

    def some(kinds: list[str], most: int) -> str:
        return "".join((plain if rng.random() < 0.5 and k not in ("nav", "form", "comments") else around)(k) for k in rng.sample(kinds, rng.randint(0, most)))

    body = some(["nav", "header", "notice", "advert", "form"], 4)
    wrap = rng.random() < 0.3
    body += (named("div", "wrapper container page layout site", True) if wrap else "") + article()
    body += some(["aside", "advert", "comments", "form", "nav", "notice"], 4) + ("</div>" if wrap else "")
    body += (plain if rng.random() < 0.5 else around)("footer") if rng.random() < 0.8 else ""
    return f"<html><head><title>{text(4)}</title></head><body>{body}</body></html>", marks


@lru_cache(2)
def trained(seed: int = 17, pages: int = PAGES) -> dict[str, np.ndarray]:
    """The net, fitted to made pages by Adam; the same seed gives the same net."""
    made = random.Random(seed)
    ready = []
    while len(ready) < pages:
        text, marks = synthetic_page(made)
        found = blocks(text)
        if found and len(found) == len(marks):
            ready.append((Page(found), np.array(marks, np.float64)))
    ready.sort(key=lambda x: len(x[1]))
    rng = np.random.default_rng(seed)
    width = INPUT + HIDDEN
    net = {
        "path": rng.normal(0, 0.5, (PATHS, PATH_VECTOR)), "word": rng.normal(0, 0.1, (WORDS, WORD_VECTOR)),
        "w1": rng.normal(0, width**-0.5, (width, 4 * HIDDEN)), "b1": np.zeros(4 * HIDDEN), "w2": rng.normal(0, width**-0.5, (width, 4 * HIDDEN)), "b2": np.zeros(4 * HIDDEN),
        "out": rng.normal(0, 0.2, 2 * HIDDEN), "base": np.zeros(1),
    }
    for b in ("b1", "b2"):
        net[b][HIDDEN : 2 * HIDDEN] = 1.0  # remember at first
    mean, square = ({k: np.zeros_like(v) for k, v in net.items()} for _ in range(2))
    step, starts = 0, list(range(0, len(ready), BATCH))
    for epoch in range(EPOCHS):
        for at in rng.permutation(len(starts)):
            batch = ready[starts[at] : starts[at] + BATCH]
            x, mask, _ = _padded([p for p, _ in batch], net)
            states, tape, tape2 = _both_ways(x, mask, net)
            y = np.zeros(mask.shape)
            for r, (_, marks) in enumerate(batch):
                y[: len(marks), r] = marks
            slope = np.where(mask, _sigmoid(states @ net["out"] + net["base"]) - y, 0) / mask.sum()
            to_states = slope[:, :, None] * net["out"]
            x1, w1, b1 = _lstm_back(to_states[:, :, :HIDDEN], tape, net["w1"])
            x2, w2, b2 = _lstm_back(to_states[::-1, :, HIDDEN:], tape2, net["w2"])
            to_x = x1 + x2[::-1]
            grads = {"out": np.einsum("tr,trh->h", slope, states), "base": np.array([slope.sum()]), "w1": w1, "b1": b1, "w2": w2, "b2": b2, "path": np.zeros_like(net["path"]), "word": np.zeros_like(net["word"])}
            for r, (p, marks) in enumerate(batch):
                own = to_x[: len(marks), r]
                per = np.diff(p.part_of)
                by_path = np.zeros((len(per), PATH_VECTOR))
                np.add.at(by_path, p.which, own[:, :PATH_VECTOR])
                np.add.at(grads["path"], p.part, np.repeat(by_path / per[:, None], per, 0))
                per = np.diff(p.word_of)
                np.add.at(grads["word"], p.word, np.repeat(own[:, PATH_VECTOR : PATH_VECTOR + WORD_VECTOR] / np.maximum(per, 1)[:, None], per, 0))
            step += 1
            for k, g in grads.items():
                mean[k] += 0.1 * (g - mean[k])
                square[k] += 0.01 * (g * g - square[k])
                net[k] = net[k] - RATE * (1 - 0.9 * epoch / EPOCHS) * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
    return net


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",), net: dict[str, np.ndarray] | None = None) -> DataFrame:
    """One row for each page: id, the columns in ``keep``, text (main blocks joined by line feeds), n_chars, n_blocks."""
    net = trained() if net is None else net
    shared = pages.sparkSession.sparkContext.broadcast(net)  # some 300 kB
    source = pages.select(F.col(id_col).alias("rid"), F.col(html_col).cast("string").alias("txt"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])
    kinds = {f.name: f.dataType.simpleString() for f in source.schema.fields}
    rest = [f"k{i}" for i in range(len(keep))]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            for lo, hi in K.pieces(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                found = [blocks(x.as_py() or "") for x in part.column(1)]
                good = label([Page(b) for b in found], net)
                texts = ["\n".join(b.text for b, p in zip(own, ps.tolist(), strict=True) if p >= 0.5) for own, ps in zip(found, good, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *[part.column(2 + i) for i in range(len(rest))], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(b) for b in found], pa.int32())],
                    ["rid", *rest, "text", "n_chars", "n_blocks"],
                )

    out = source.mapInArrow(work, ", ".join([f"rid {kinds['rid']}", *[f"{k} {kinds[k]}" for k in rest], "text string", "n_chars long", "n_blocks int"]))
    return out.select(F.col("rid").alias(id_col), *[F.col(k).alias(c) for k, c in zip(rest, keep, strict=True)], "text", "n_chars", "n_blocks")
