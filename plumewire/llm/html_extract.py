"""HTML extraction with a recurrent block labeller.

A page is cut into leaf blocks: the text between two boundaries of block elements.  Each block becomes a vector
(hashed tag-path and class names, hashed words, a few figures), and a bidirectional LSTM in numpy reads the
sequence of all blocks of the page and labels each as article text or not, so that a block is judged in the
context of the whole document.

The labeller is trained here, on pages that a seeded generator makes from templates with known labels
(``TRAIN_PAGES`` pages); it learns nothing from the input.  Scripts, styles and other elements without visible
text never become blocks.

Defined results: a null or empty page has an empty text; repeated rows (ties) give repeated results; an empty table
gives an empty result; other columns are ignored.  A page of any length is read in one pass and labelled ``STEPS``
blocks at a time, with the state carried on.  A "<" without any ">" behind it is text.  A tag ends at the first ">"
outside quotes; where quotes don't close, at the first ">", and after ``TRIES`` such tags on a page always there.  Of a
block's path the nearest ``DEPTH`` elements count.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, bound_batches, lean

PATH_DIM, WORD_DIM, EXTRA_DIM, HIDDEN = 96, 32, 8, 24
TRAIN_PAGES, EPOCHS = 700, 8
#: Blocks labelled at once; elements of a path that are looked at; tags with open quotes until quotes are left out of account.
STEPS, DEPTH, TRIES = 4096, 64, 3

# Fixed lists of HTML element names.
SILENT = {"script", "style", "noscript", "template", "svg", "math", "head", "title", "textarea", "select", "button", "iframe", "object", "canvas", "audio", "video", "datalist"}
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "title", "svg")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html",
    "legend", "li", "main", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: An element that ends an open one of the same family, unless the second set's elements stand between.
ENDS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}), "tr": ({"tr"}, {"table"})}

_QUOTED = r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+"
_RAW = r"<!--.*?(?:-->|\Z)|<((?:" + "|".join(RAW) + r")(?=[\s/>])(?<!svg)|svg(?=[\s/>])(?!{inner}(?<=/)>)){open}.*?(?:</\1\s*+>|\Z)|<[!?][^>]*+>"
_TAG = r"<(/?)([a-zA-Z][\w:-]*+)({inner})>"
_PLAIN_TAG = _TAG.format(inner="[^>]*+")
_TOKEN = re.compile(_RAW.format(inner=_QUOTED, open=f"(?:{_QUOTED}>|[^>]*+>)") + "|" + _TAG.format(inner=_QUOTED) + "|" + _PLAIN_TAG, re.S | re.I)
#: The same with tags that end at the first ">"; a page is never searched twice for quotes that close nowhere.
_TOKEN_PLAIN = re.compile(_RAW.format(inner="[^>]*+", open="[^>]*+>") + "|" + _PLAIN_TAG + "|(?!)()()()", re.S | re.I)
_RAW_END = re.compile(r"(?:-->|</(?:" + "|".join(RAW) + r")\s*+>)\Z", re.I)


def _tokens(page: str, end: int) -> Iterator[re.Match]:
    """Tags, comments and raw elements up to ``end``."""
    tries = 0
    for m in _TOKEN.finditer(page, 0, end):
        yield m
        if m[6] and (tries := tries + 1) == TRIES:
            yield from _TOKEN_PLAIN.finditer(page, m.end(), end)
            return


_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']++)))?")
_NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_NAME = re.compile(r"[a-z]+")


@lru_cache(1 << 14)
def _slot(token: str, size: int) -> int:
    return zlib.crc32(token.encode()) % size


def _hidden(attributes: str) -> bool:
    """By an attribute's own name: hidden, aria-hidden="true", or a style without display."""
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and _NO_DISPLAY.search(value):
            return True
    return False


@lru_cache(1 << 14)
def _element(tag: str, attributes: str) -> tuple[str, tuple[int, ...], bool]:
    """Name, hashed places of its tag and its class, id and role words, and whether it is shown."""
    tokens = [tag]
    for _, a, b, c in _NAMED.findall(attributes):
        tokens += [f".{w}" for w in _NAME.findall((a or b or c).lower())]
    return tag, tuple(_slot(t, PATH_DIM) for t in dict.fromkeys(tokens)), not _hidden(attributes)


Block = tuple[str, tuple, int, str]  # text, path elements (the nearest ``DEPTH``), characters inside links, innermost block element


def blocks_of(page: str | None) -> list[Block]:
    """The visible leaf blocks in page order, white space inside turned into one space."""
    out: list[Block] = []
    if not page:
        return out
    stack: list[tuple] = []
    parts: list[str] = []
    linked = in_link = silent = 0
    path: tuple = ()
    opened: Counter[str] = Counter()

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                inner = next((e[0] for e in reversed(path) if e[0] in BLOCKS), "")
                out.append((text, path, linked, inner))
            parts, linked = [], 0

    def pop_to(depth: int) -> None:
        nonlocal in_link, silent
        while len(stack) > depth:
            e = stack.pop()
            opened[e[0]] -= 1
            in_link -= e[0] == "a"
            silent -= e[0] in SILENT or not e[2]

    def text(s: str) -> None:
        nonlocal linked, path
        if s and not silent:
            if not parts:
                path = tuple(stack[-DEPTH:])
            parts.append(s)
            if in_link:
                linked += len(s)

    last, end, m = 0, page.rfind(">") + 1, None
    for m in _tokens(page, end):
        if m.start() > last:
            text(page[last : m.start()])
        last = m.end()
        close, tag, attributes = (m[2], m[3], m[4]) if m[3] else (m[5], m[6], m[7])
        if not tag:
            continue
        tag = tag.lower()
        if tag == "br":
            text(" ")
            continue
        if tag in BLOCKS:
            flush()
        if close:
            if opened[tag]:
                pop_to(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
            continue
        if tag in BLOCKS:  # an open paragraph ends where a block begins
            for i in range(len(stack) - 1, -1, -1) if opened["p"] else ():
                if stack[i][0] == "p":
                    pop_to(i)
                    break
                if stack[i][0] in BLOCKS:
                    break
            if tag in ENDS:
                same, between = ENDS[tag]
                for i in range(len(stack) - 1, -1, -1) if any(opened[t] for t in same) else ():
                    if stack[i][0] in between:
                        break
                    if stack[i][0] in same:
                        pop_to(i)
                        break
        if tag == "body":  # a head that was not closed
            pop_to(next((i for i, e in enumerate(stack) if e[0] == "head"), len(stack)))
        if tag in VOID or attributes.endswith("/") and tag not in BLOCKS:
            continue
        e = _element(tag, attributes)
        stack.append(e)
        opened[tag] += 1
        in_link += tag == "a"
        silent += tag in SILENT or not e[2]
    cut_off = m is not None and m.end() == end and (m[1] or m[0].startswith("<!--")) and not _RAW_END.search(m[0])
    if last < len(page) and not cut_off:
        text(page[last:].partition("<!--")[0])
    flush()
    return out


_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


def vectors(blocks: list[Block], start: int = 0, stop: int | None = None) -> np.ndarray:
    """The vectors of the page's blocks, or of those from ``start`` to ``stop``."""
    some = blocks[start:stop]
    out = np.zeros((len(some), PATH_DIM + WORD_DIM + EXTRA_DIM), np.float32)
    paths: dict[tuple, np.ndarray] = {}
    for i, (text, path, linked, inner) in enumerate(some):
        v = paths.get(path)
        if v is None:
            v = np.zeros(PATH_DIM, np.float32)
            for depth, e in enumerate(reversed(path)):
                v[list(e[1])] += 1.0 if depth < 3 else 0.6
            paths[path] = v = np.minimum(v, 2.0)
        out[i, :PATH_DIM] = v
        words = text.lower().split()
        hashed = np.bincount([_slot(w.strip(".,:;!?()©·|"), WORD_DIM) for w in words], minlength=WORD_DIM)
        out[i, PATH_DIM:-EXTRA_DIM] = np.minimum(hashed, 8) / np.sqrt(len(words))
        n = len(text)
        marks = sum(map(text.count, ".,;!?"))
        out[i, -EXTRA_DIM:] = np.log1p(n) / 6, min(1.0, linked / n), min(1.0, 10 * marks / n), (start + i) / len(blocks), inner in _HEADINGS, inner == "p", inner in ("li", "td", "dd"), np.log1p(len(blocks)) / 6
    return out


# The labeller


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Bidirectional LSTM with one logistic output a step.  Steps beyond a sequence's length carry the state on."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        d, h = PATH_DIM + WORD_DIM + EXTRA_DIM, HIDDEN
        init = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"o": init(2 * h, 1), "ob": np.zeros(1, np.float32)}
        for side in "lr":
            bias = np.zeros(4 * h, np.float32)
            bias[h : 2 * h] = 1.0
            self.p |= {f"{side}x": init(d, 4 * h), f"{side}h": init(h, 4 * h), f"{side}b": bias}

    def _run(self, x: np.ndarray, mask: np.ndarray, side: str, state: tuple | None = None, tape: list | None = None) -> tuple[np.ndarray, tuple]:
        """Hidden states of all steps, and the last state.  A tape, which training needs, keeps every step's gates."""
        n, steps, _ = x.shape
        h, c = state or (np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32))
        inputs = x @ self.p[f"{side}x"] + self.p[f"{side}b"]
        out = np.zeros((n, steps, HIDDEN), np.float32)
        for t in range(steps) if side == "l" else range(steps - 1, -1, -1):
            z = inputs[:, t] + h @ self.p[f"{side}h"]
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[:, t, None]
            new_c = m * (f * c + i * g) + (1 - m) * c
            tc = np.tanh(new_c)
            new_h = m * (o * tc) + (1 - m) * h
            if tape is not None:
                tape.append((t, i, f, o, g, c, tc, h, m))
            h, c = new_h, new_c
            out[:, t] = h
        return out, (h, c)

    def _scores(self, both: np.ndarray) -> np.ndarray:
        return _sigmoid((both @ self.p["o"])[..., 0] + self.p["ob"])

    def predict(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        return self._scores(np.concatenate([self._run(x, mask, side)[0] for side in "lr"], axis=2))

    def predict_long(self, blocks: list[Block], steps: int = STEPS) -> np.ndarray:
        """Scores of one page of any length: a part at a time in each direction, the state carried on; only the
        hidden states of all blocks are held."""
        both = np.zeros((len(blocks), 2 * HIDDEN), np.float32)
        for k, side in enumerate("lr"):
            state = None
            starts = range(0, len(blocks), steps)
            for at in starts if side == "l" else reversed(starts):
                x, mask = padded([vectors(blocks, at, at + steps)])
                out, state = self._run(x, mask, side, state)
                both[at : at + steps, k * HIDDEN : (k + 1) * HIDDEN] = out[0]
        return self._scores(both)

    def gradient(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        tapes: dict[str, list] = {"l": [], "r": []}
        both = np.concatenate([self._run(x, mask, side, None, tapes[side])[0] for side in "lr"], axis=2)
        error = (self._scores(both) - y) * mask / max(1.0, mask.sum())
        grad = {"o": np.einsum("nth,nt->h", both, error)[:, None], "ob": error.sum(keepdims=True).reshape(1)}
        back = error[:, :, None] * self.p["o"][:, 0]
        for k, side in enumerate("lr"):
            wh = self.p[f"{side}h"]
            dh_next = np.zeros((len(x), HIDDEN), np.float32)
            dc_next = np.zeros_like(dh_next)
            dz_all = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            gh = np.zeros_like(wh)
            for t, i, f, o, g, c, tc, h, m in reversed(tapes[side]):
                dh = back[:, t, k * HIDDEN : (k + 1) * HIDDEN] + dh_next
                dc = dc_next + m * dh * o * (1 - tc * tc)
                dz = np.concatenate((dc * g * i * (1 - i), dc * c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)), axis=1) * m
                dz_all[:, t] = dz
                gh += h.T @ dz
                dh_next = dz @ wh.T + (1 - m) * dh
                dc_next = m * dc * f + (1 - m) * dc
            flat = dz_all.reshape(-1, 4 * HIDDEN)
            grad |= {f"{side}h": gh, f"{side}x": x.reshape(-1, x.shape[2]).T @ flat, f"{side}b": flat.sum(axis=0)}
        return grad


def padded(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, sequences))
    x = np.zeros((len(sequences), steps, sequences[0].shape[1]), np.float32)
    mask = np.zeros((len(sequences), steps), np.float32)
    for i, s in enumerate(sequences):
        x[i, : len(s)] = s
        mask[i, : len(s)] = 1
    return x, mask


def train(pages: int = TRAIN_PAGES, epochs: int = EPOCHS, seed: int = 5) -> Labeller:
    """Adam over generated pages, in batches of similar length."""
    made = [generate(random.Random(f"{seed}:{i}")) for i in range(pages)]
    data = []
    for page, good in made:
        blocks = blocks_of(page)
        if blocks:
            data.append((vectors(blocks), np.array([b[0] in good for b in blocks], np.float32)))
    data.sort(key=lambda d: len(d[0]))
    groups = [data[i : i + 20] for i in range(0, len(data), 20)]
    model, rng = Labeller(seed), random.Random(seed)
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    step = 0
    for epoch in range(epochs):
        rng.shuffle(groups)
        rate = 0.02 * (1 - epoch / epochs)
        for group in groups:
            x, mask = padded([d[0] for d in group])
            y = np.zeros_like(mask)
            for i, d in enumerate(group):
                y[i, : len(d[1])] = d[1]
            step += 1
            for k, g in model.gradient(x, mask, y).items():
                g = np.clip(g, -1, 1)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.98 * second[k] + 0.02 * g * g
                model.p[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.98**step)) + 1e-6)).astype(np.float32)
    return model


_trained: dict[tuple, Labeller] = {}


def labeller(pages: int = TRAIN_PAGES, epochs: int = EPOCHS, seed: int = 5) -> Labeller:
    """Trained once in a process."""
    key = (pages, epochs, seed)
    if key not in _trained:
        _trained[key] = train(*key)
    return _trained[key]


# Pages for training

_SYLLABLES = "an ba co de el fi go hu in ka lo me no or pa qui re sa ti un va we xo ye zu é ä ción ß".split()
_BOILER = "home about contact login subscribe newsletter share tweet cookies privacy terms copyright rights reserved menu search next previous related comments reply advertisement sponsored follow us read more sign up accept inicio contacto accueil impressum datenschutz".split()


def generate(r: random.Random) -> tuple[str, set[str]]:
    """A page and the texts of its article blocks."""
    seen: set[str] = set()

    def word() -> str:
        return "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4)))

    def prose(low: int, high: int) -> str:
        while True:
            out, left = [], r.randint(low, high)
            while left > 0:
                n = min(left, r.randint(3, 14))
                s = [word() for _ in range(n)]
                if n > 6 and r.random() < 0.5:
                    s[n // 2] += ","
                out.append(" ".join(s).capitalize() + ("." if n > 2 else ""))
                left -= n
            text = " ".join(out)
            if text not in seen:
                seen.add(text)
                return text

    def short() -> str:
        return " ".join(r.choice(_BOILER) if r.random() < 0.5 else word() for _ in range(r.randint(1, 4)))

    def name(*words: str) -> str:
        w = r.choice(words)
        w = r.choice((w, w, w + r.choice(("-box", "-wrap", "_inner", "-1", " clearfix")), r.choice(("site-", "page-", "js-", "main-")) + w))
        return r.choice((f'class="{w}"', f'class="{w}"', f'id="{w}"', f'class="{w} {r.choice(("row", "col", "block", "container"))}"'))

    def links(n: int) -> str:
        item = lambda: f'<a href="/{word()}">{r.choice((short, word))()}</a>'
        if r.random() < 0.7:
            return "<ul>" + "".join(f"<li>{item()}</li>" for _ in range(n)) + "</ul>"
        return r.choice((" | ", " ", "<span>/</span>")).join(item() for _ in range(n))

    def some() -> str:
        return r.choice((lambda: links(r.randint(2, 8)), lambda: f"<p>{prose(3, 40)}</p>", lambda: prose(2, 30), lambda: f"<h3>{short()}</h3>{links(r.randint(2, 6))}", lambda: f"<h4>{short()}</h4><p>{prose(5, 30)}</p>"))()

    def nav() -> str:
        inner = links(r.randint(3, 9))
        return r.choice((f"<nav>{inner}</nav>", f"<nav {name('menu', 'navbar')}>{inner}</nav>", f"<div {name('nav', 'menu', 'navigation', 'navbar', 'breadcrumb', 'breadcrumbs', 'topnav')}>{inner}</div>", f'<div role="navigation">{inner}</div>'))

    def header() -> str:
        inner = r.choice(("", f"<h2>{short()}</h2>", f"<p>{prose(2, 8)}</p>", f'<a href="/">{short()}</a>', f"<h1>{short()}</h1>")) + (nav() if r.random() < 0.7 else "")
        return r.choice((f"<header>{inner}</header>", f"<div {name('header', 'masthead', 'topbar', 'banner', 'top')}>{inner}</div>", inner))

    def footer() -> str:
        inner = r.choice((f"&copy; {word()}.example {prose(2, 12)}", f"<p>&copy; 2024 {short()}. {prose(3, 14)}</p>", links(r.randint(2, 6)) + f"<p>{short()}</p>", f"<p>{prose(5, 25)}</p>", f"&copy; {word()} &middot; {prose(4, 10)}"))
        return r.choice((f"<footer>{inner}</footer>", f"<footer {name('footer')}>{inner}</footer>", f"<div {name('footer', 'colophon', 'bottom', 'copyright', 'legal')}>{inner}</div>"))

    def sidebar() -> str:
        inner = "".join(some() for _ in range(r.randint(1, 4)))
        return r.choice((f"<aside>{inner}</aside>", f"<aside {name('sidebar', 'widget')}>{inner}</aside>", f"<div {name('sidebar', 'widget', 'secondary', 'rail', 'related', 'popular', 'trending')}>{inner}</div>"))

    def advert() -> str:
        inner = r.choice((prose(3, 30), f"<p>{prose(3, 25)}</p>", f'<a href="/x">{prose(2, 10)}</a>', f"<h4>{short()}</h4><p>{prose(4, 20)}</p>"))
        return f"<{(t := r.choice(('div', 'div', 'aside', 'section')))} {name('ad', 'ads', 'advert', 'advertisement', 'sponsored', 'promo', 'banner', 'adbox', 'sponsor')}>{inner}</{t}>"

    def notice() -> str:
        inner = r.choice((prose(5, 40), f"<p>{prose(5, 40)}</p><button>{short()}</button>", f"<p>{prose(5, 30)} <a href='/p'>{short()}</a></p>"))
        return f"<div {name('cookie', 'cookies', 'consent', 'notice', 'gdpr', 'alert', 'popup', 'modal', 'paywall', 'banner', 'message')}>{inner}</div>"

    def form() -> str:
        inner = f"<label>{short()}</label><input name='{word()}'>" + r.choice(("", f"<p>{prose(3, 20)}</p>")) + f"<button>{short()}</button>"
        inner = r.choice(("", f"<h3>{short()}</h3>")) + inner
        return r.choice((f"<form>{inner}</form>", f"<form {name('search', 'subscribe', 'newsletter', 'login', 'signup')}>{inner}</form>", f"<div {name('newsletter', 'subscribe', 'signup')}><form>{inner}</form></div>"))

    def social() -> str:
        return f"<div {name('share', 'social', 'sharing', 'tags', 'related', 'pagination', 'pager')}>{links(r.randint(2, 5))}</div>"

    def comments() -> str:
        one = lambda: r.choice((f"<b>{word()}</b> <p>{prose(4, 60)}</p>", f"<p>{prose(4, 60)}</p>", f"<span>{word()}</span>{prose(4, 40)}", f"<p>{prose(4, 40)}</p><p>{prose(4, 40)}</p>"))
        n, kind = r.randint(1, 6), r.randint(0, 3)
        head = r.choice(("", f"<h3>{n} comments</h3>", f"<h2>{short()}</h2>"))
        if kind == 0:
            inner = "<ol>" + "".join(f"<li>{one()}</li>" for _ in range(n)) + "</ol>"
        elif kind == 1:
            inner = "".join(f"<div {name('comment', 'reply', 'response')}>{one()}</div>" for _ in range(n))
        elif kind == 2:
            inner = "<ul>" + "".join(f'<li class="comment">{one()}</li>' for _ in range(n)) + "</ul>"
        else:
            inner = "".join(f"<article class='comment'>{one()}</article>" if r.random() < 0.3 else f"<div class='comment'>{one()}</div>" for _ in range(n))
        return f"<{(t := r.choice(('div', 'section', 'div')))} {name('comments', 'comment-list', 'discussion', 'responses', 'reviews', 'disqus', 'commentlist')}>{head}{inner}</{t}>"

    good: set[str] = set()

    def keep(text: str) -> str:
        good.add(" ".join(entities.unescape(re.sub(r"<[^>]*>", "", text)).split()))
        return text

    def inline(text: str) -> str:
        words = text.split(" ")
        if len(words) > 4 and r.random() < 0.4:
            i = r.randrange(len(words) - 1)
            t = r.choice(("b", "i", "em", "strong", "a href='/y'", "span"))
            words[i] = f"<{t}>{words[i]}</{t.split(' ')[0]}>"
        return " ".join(words)

    def article() -> str:
        title = prose(1, 12)
        out = [f"<{(t := r.choice(('h1', 'h1', 'h1', 'h2')))}>{keep(title)}</{t}>"] if r.random() < 0.9 else []
        if r.random() < 0.3:
            out.append(f"<p><b>{keep(r.choice((title, prose(1, 8))))}<br>")
        for _ in range(r.choice((1, 1, 2, 3, 5, 8, 14))):
            x = r.random()
            end = r.choice(("</p>", "</p>", "</p>", ""))
            if x < 0.7:
                out.append(f"<p>{keep(inline(prose(*r.choice(((1, 4), (5, 40), (20, 90), (30, 160))))))}{end}")
            elif x < 0.76:
                out.append(f"<h2>{keep(prose(1, 7))}</h2><p>{keep(prose(10, 60))}</p>")
            elif x < 0.82:
                out.append(f"<{(t := r.choice(('ul', 'ol')))}>" + "".join(f"<li>{keep(inline(prose(2, 25)))}{r.choice(('</li>', ''))}" for _ in range(r.randint(2, 6))) + f"</{t}>")
            elif x < 0.86:
                out.append(f"<blockquote>{r.choice((keep(prose(5, 40)), f'<p>{keep(prose(5, 40))}</p>'))}</blockquote>")
            elif x < 0.89:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{keep(prose(1, 4))}</td>" for _ in range(2)) + "</tr>" for _ in range(r.randint(1, 4))) + "</table>")
            elif x < 0.92:
                out.append(f"<pre>{keep(prose(3, 25))}</pre>")
            elif x < 0.95:
                out.append(f"<div>{keep(prose(10, 60))}</div>")
            elif x < 0.97:
                out.append(f"<p><b>{keep(prose(1, 30))}<br><p>{keep(prose(10, 60))}</p>")
            else:
                out.append(f"<figure><img src='x.jpg'><figcaption>{keep(prose(3, 15))}</figcaption></figure>")
            if r.random() < 0.1:
                out.append(r.choice((advert, social, advert, form, sidebar, notice))())
        body = "".join(out)
        kind = r.random()
        if kind < 0.45:
            return f"<article>{body}</article>" if r.random() < 0.7 else f"<article {name('post', 'entry', 'story')}>{body}</article>"
        if kind < 0.6:
            return f"<main>{body}</main>"
        if kind < 0.9:
            return f"<{(t := r.choice(('div', 'section', 'div')))} {name('content', 'post', 'entry', 'story', 'article', 'text', 'body', 'article-body', 'entry-content', 'main')}>{body}</{t}>"
        return r.choice((body, f"<div>{body}</div>", f"<table><tr><td>{body}</td></tr></table>"))

    before = [f() for f in (header, nav, advert, notice, form, sidebar, social) if r.random() < (0.65 if f in (header, nav) else 0.3)]
    after = [f() for f in (social, comments, sidebar, advert, form, notice, nav) if r.random() < 0.35]
    r.shuffle(before)
    r.shuffle(after)
    middle = article()
    if r.random() < 0.3:
        middle = f"<div {name('wrapper', 'container', 'page', 'layout', 'columns')}>" + r.choice((middle, middle + sidebar(), sidebar() + middle, middle + comments())) + "</div>"
    page = "".join(before) + middle + "".join(after) + (footer() if r.random() < 0.85 else "")
    if r.random() < 0.05:
        page = f"<form action='/all'>{page}</form>"
    if r.random() < 0.03:
        page = middle
    return f"<!DOCTYPE html><html><head><title>{short()}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>{page}</body></html>", good


# The operator


def extract(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """page_id, url, text (article blocks joined by line breaks), blocks (all blocks with their scores)."""
    bound_batches(pages.sparkSession)
    held = pages.sparkSession.sparkContext.broadcast((model or labeller()).p)  # fixed size
    block = pa.struct([("text", pa.string()), ("score", pa.float32())])
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("blocks", pa.list_(block))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = Labeller()
        labels.p = held.value
        for b in batches:
            found = [blocks_of(page) for page in b.column(2).cast(pa.string()).to_pylist()]
            scores: list = [np.zeros(0)] * len(found)
            order = sorted((i for i, x in enumerate(found) if x), key=lambda i: len(found[i]))
            at = 0
            while at < len(order):  # groups of similar length, of at most about STEPS steps in all
                longest = len(found[order[at]])
                if longest > STEPS:
                    scores[order[at]] = labels.predict_long(found[order[at]])
                    at += 1
                    continue
                stop = at + 1
                while stop < len(order) and (stop - at + 1) * len(found[order[stop]]) <= STEPS and len(found[order[stop]]) <= 2 * longest:
                    stop += 1
                group = order[at:stop]
                x, mask = padded([vectors(found[i]) for i in group])
                for i, s in zip(group, labels.predict(x, mask)):
                    scores[i] = s[: len(found[i])]
                at = stop
            texts = ["\n".join(x[0] for x, v in zip(f, s) if v > 0.5) for f, s in zip(found, scores)]
            kept = [[{"text": x[0], "score": float(v)} for x, v in zip(f, s)] for f, s in zip(found, scores)]
            yield batch(schema, b.column(0), b.column(1), texts, kept)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(lean(run), "page_id long, url string, text string, blocks array<struct<text: string, score: float>>")


def texts(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """page_id, url, text, n_chars."""
    return extract(pages, model).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
