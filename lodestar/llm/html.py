"""Main-text extraction: a linear-chain conditional random field over the leaf blocks of a page's tree."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of HTML: elements without an end tag, those whose text isn't shown, inline ones, and those that an opening tag ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template svg canvas head title iframe object audio video math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head", "title"}}
#: How far up an opening tag looks for what it ends.
SCOPES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}, "body": {"html"}}
#: Words of class and id values that count as features of their own.
HINTS = frozenset(
    "ad ads advert advertisement adbox sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer copyright sidebar widget aside related recommended share social "
    "cookie cookies consent notice alert popup modal comment comments reply respond discussion form search login newsletter subscribe signup tags meta pagination "
    "article content post entry main body story text".split()
)
LABELLED_PAGES, ROUNDS, RATE, DECAY = 200, 150, 0.15, 1e-3


class _Blocks(HTMLParser):
    """Leaf blocks in page order: (text, characters of links, tag, tags above, hints above)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, tuple[str, ...], bool]] = []  # tag, hints, whether it hides what is inside
        self.out: list[tuple] = []
        self.text: list[str] = []
        self.links = self.hidden = self.anchors = 0

    def flush(self):
        text = " ".join("".join(self.text).split())
        if text:
            tags = [t for t, _, _ in self.stack if t not in INLINE]
            self.out.append((text, self.links, tags[-1] if tags else "", frozenset(tags), frozenset(h for _, hints, _ in self.stack for h in hints)))
        self.text, self.links = [], 0

    def pop(self, first: int, end: int | None = None):
        for tag, _, hides in self.stack[first:end]:
            self.hidden -= hides
            self.anchors -= tag == "a"
        del self.stack[first:end]

    def handle_starttag(self, tag, attrs):
        if tag not in INLINE:
            self.flush()
            for i in range(len(self.stack) - 1, -1, -1):
                up = self.stack[i][0]
                if up == "p" or up in ENDS.get(tag, ()):
                    self.pop(i)
                elif up in SCOPES.get(tag, ()) or up not in INLINE and tag not in ENDS:
                    break
        if tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        words = re.findall("[a-z]+", " ".join(v for k, v in attrs if k in ("class", "id", "role") and v).lower())
        off = any(k == "hidden" or k == "aria-hidden" and v == "true" for k, v in attrs)
        self.stack.append((tag, tuple(w for w in words if w in HINTS), off or tag in HIDDEN))
        self.hidden += self.stack[-1][2]
        self.anchors += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in ("script", "style", "svg", "canvas", "iframe"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag not in INLINE:
            self.flush()
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                self.pop(i, i + 1 if tag in INLINE else None)  # blocks opened inside an inline element outlive it
                return

    def handle_data(self, data):
        if not self.hidden:
            self.text.append(data)
            self.links += len(data) * (self.anchors > 0)


def blocks(html: str | None) -> list[tuple]:
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.out


def features(found: list[tuple]) -> list[list[str]]:
    """Names of the features of each block: tags and hints above it, its tag, and bins of its text."""
    out = []
    for i, (text, links, tag, above, hints) in enumerate(found):
        words = text.count(" ") + 1
        density = links / len(text)
        out.append(
            ["bias", f"tag {tag}", f"words {min(7, words.bit_length())}", f"links {0 if not links else 1 + int(3 * density)}", f"end {text[-1] in '.!?:;…'}", f"mark {any(c in text for c in '©®')}"]
            + [f"above {t}" for t in above] + [f"hint {h}" for h in hints] + [f"first {i < 2}", f"last {i >= len(found) - 2}"]
        )
    return out


def _lattice(scores: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward log sums of (pages, blocks, 2) scores."""
    n = scores.shape[1]
    fwd, bwd = scores.copy(), np.zeros_like(scores)
    for t in range(1, n):
        fwd[:, t] += np.logaddexp.reduce(fwd[:, t - 1][:, :, None] + trans, axis=1)
    for t in range(n - 2, -1, -1):
        bwd[:, t] = np.logaddexp.reduce(trans + (scores[:, t + 1] + bwd[:, t + 1])[:, None, :], axis=2)
    return fwd, bwd, np.logaddexp.reduce(fwd[:, -1], axis=1)


def fit(pages: list[tuple[list[list[str]], list[int]]]) -> dict:
    """Weights of a two-label chain from (features, labels) of pages, by gradient ascent on the likelihood with decay.

    Pages of one length form one batch.
    """
    names = {f: i for i, f in enumerate(sorted({f for page, _ in pages for block in page for f in block}))}
    groups: dict[int, list] = {}
    for page, labels in pages:
        if page:
            groups.setdefault(len(page), []).append((page, labels))
    batches = []
    for n, group in groups.items():
        x = np.zeros((len(group), n, len(names)), np.float32)
        for i, (page, _) in enumerate(group):
            for t, block in enumerate(page):
                x[i, t, [names[f] for f in block]] = 1
        batches.append((x, np.eye(2)[np.array([y for _, y in group])]))
    w, trans = np.zeros((len(names), 2)), np.zeros((2, 2))
    squares = [np.full_like(w, 1e-8), np.full_like(trans, 1e-8)]
    for _ in range(ROUNDS):
        gw, gt = -DECAY * w * len(pages), -DECAY * trans * len(pages)
        for x, y in batches:
            scores = x @ w
            fwd, bwd, z = _lattice(scores, trans)
            gw += np.einsum("ptf,pty->fy", x, y - np.exp(fwd + bwd - z[:, None, None]))
            if x.shape[1] > 1:
                pair = fwd[:, :-1, :, None] + trans + (scores + bwd)[:, 1:, None, :] - z[:, None, None, None]
                gt += np.einsum("pta,ptb->ab", y[:, :-1], y[:, 1:]) - np.exp(pair).sum((0, 1))
        for p, g, s in ((w, gw, squares[0]), (trans, gt, squares[1])):
            s += g * g
            p += RATE * g / np.sqrt(s)
    return {"names": names, "w": w, "trans": trans}


def decode(model: dict, found: list[list[str]]) -> list[int]:
    """The likeliest labels of a page's blocks, by Viterbi."""
    if not found:
        return []
    w, names = model["w"], model["names"]
    scores = np.array([w[[names[f] for f in block if f in names]].sum(0) for block in found])
    best, back = scores[0], []
    for row in scores[1:]:
        paths = best[:, None] + model["trans"]
        back.append(paths.argmax(0))
        best = paths.max(0) + row
    labels = [int(best.argmax())]
    for step in reversed(back):
        labels.append(int(step[labels[-1]]))
    return labels[::-1]


def labelled_page(rng: random.Random) -> tuple[str, set[str]]:
    """A made page and the texts of its article's blocks. Layouts vary: semantic tags, class names only, or bare blocks."""
    word = lambda: "".join(rng.choice(("ba", "ro", "ti", "en", "sal", "or", "ka", "mi", "du", "lest")) for _ in range(rng.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    sentence = lambda a, b: words(a, b).capitalize() + "."
    prose = lambda a, b: " ".join(sentence(1, 16) for _ in range(rng.randint(a, b)))
    main: set[str] = set()

    def own(text: str) -> str:
        if rng.random() < 0.2:  # junk in an article is still the article's
            text = rng.choice((text.upper(), text.replace(" ", " | ") + " |", text.replace(" ", "### ") + "$$$", " ".join(text.split()[:1] * 9)))
        main.add(text)
        return text

    def wrap(tag: str, names: str, inner: str) -> str:
        kind = rng.choice(names.split())
        return f"<{tag}>{inner}</{tag}>" if tag != "div" and rng.random() < 0.6 else f'<{rng.choice((tag, "div"))} {rng.choice(("class", "id"))}="{kind}{rng.choice(("", "-box", " x1"))}">{inner}</{tag}>'

    def closed(tag: str, names: str, inner: str) -> str:
        out = wrap(tag, names, inner)
        return re.sub(r"</\w+>$", f"</{re.match(r'<(\w+)', out)[1]}>", out)

    links = lambda a, b: "".join(f'<li><a href="/{word()}">{words(1, 3)}</a></li>' for _ in range(rng.randint(a, b)))
    parts = {
        "nav": lambda: closed("nav", "menu nav navbar navigation breadcrumb", rng.choice((f"<ul>{links(2, 9)}</ul>", " | ".join(f'<a href="#">{word()}</a>' for _ in range(4))))),
        "header": lambda: closed("header", "header masthead topbar banner", rng.choice((f"<p>{sentence(2, 9)}</p>", f"<h2><a href='/'>{words(1, 4)}</a></h2><p>{words(3, 8)}</p>", words(2, 5)))),
        "ad": lambda: closed("div", "ad ads advert sponsored promo banner", rng.choice((prose(1, 4), f"<p>{prose(1, 3)}</p>", f'<a href="#">{words(3, 9)}</a>'))),
        "notice": lambda: closed("div", "cookie consent notice alert popup", f"<p>{prose(1, 3)}</p>" + f"<button>{word()}</button>" * rng.randint(0, 1)),
        "side": lambda: closed("aside", "sidebar widget related recommended", f"<h3>{words(1, 4)}</h3>" + rng.choice((f"<ul>{links(2, 6)}</ul>", f"<p>{prose(1, 4)}</p>"))),
        "form": lambda: f"<form class='{rng.choice(('search', 'login', 'newsletter', 'x'))}'><p>{prose(1, 2)}</p><label>{words(1, 4)}</label><input name=q><button>{word()}</button></form>",
        "share": lambda: closed("div", "share social tags meta", f"<ul>{links(2, 4)}</ul>"),
        "comments": lambda: closed("section", "comments comment discussion respond", f"<h3>{words(1, 3)}</h3>" + "".join(closed("div", "comment reply", f"<b>{word()}</b><p>{prose(1, 5)}</p>") for _ in range(rng.randint(1, 5)))),
        "footer": lambda: closed("footer", "footer copyright", rng.choice((f"&copy; {words(1, 3)} &middot; {sentence(2, 9)}", f"<p>© {prose(1, 3)}</p><ul>{links(1, 5)}</ul>", f"<p>{words(3, 9)}</p>"))),
    }
    body = [f"<h1>{own(words(2, 10).capitalize() + rng.choice(('', '.')))}</h1>"] if rng.random() < 0.9 else []
    for _ in range(rng.randint(1, 14)):
        kind = rng.random()
        if kind < 0.7:
            text = own(prose(1, 6) if rng.random() < 0.8 else sentence(1, 3))
            body.append(rng.choice((f"<p>{text}</p>", f"<p>{text}</p>", f"<p><b>{text}<br>", f"<p>{text}", f'<p><a href="#">{text[:6]}</a>{text[6:]}</p>')))
        elif kind < 0.78:
            body.append(f"<h2>{own(words(2, 7).capitalize())}</h2>")
        elif kind < 0.85:
            body.append("<ul>" + "".join(f"<li>{own(sentence(2, 12))}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
        elif kind < 0.9:
            body.append(f"<blockquote>{own(prose(1, 3))}</blockquote>")
        elif kind < 0.93:
            body.append(f"<table><tr><td>{own(words(2, 4))}</td><td>{own(words(2, 5))}</td></tr></table>")
        else:
            body.append(parts[rng.choice(("ad", "side", "form", "share"))]())
    whole = rng.choice(("<article>{}</article>", "<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", '<div class="content">{}</div>', '<div id="main"><div class="post">{}</div></div>', '<div class="article-body">{}</div>', "<div>{}</div>", "{}"))
    before = [parts[k]() for k in rng.sample(("nav", "header", "ad", "notice", "nav", "ad"), rng.randint(1, 4))]
    after = [parts[k]() for k in rng.sample(("side", "form", "share", "comments", "ad", "notice"), rng.randint(0, 3))] + [parts["footer"]()] * (rng.random() < 0.9)
    return f"<!DOCTYPE html><html><head><title>{words(2, 5)}</title></head><body>{''.join(before)}{whole.replace('{}', ''.join(body))}{''.join(after)}</body></html>", main


def train(pages: int = LABELLED_PAGES, seed: int = 11) -> dict:
    """A model from made labelled pages: the tables hold none. The number of pages bounds it."""
    rng, sample = random.Random(seed), []
    for _ in range(pages):
        html, main = labelled_page(rng)
        found = blocks(html)
        sample.append((features(found), [int(b[0] in main) for b in found]))
    return fit(sample)


def main_text(model: dict, html: str | None) -> str:
    found = blocks(html)
    return "\n".join(b[0] for b, y in zip(found, decode(model, features(found)), strict=True) if y)


def extract(pages: DataFrame, model: dict | None = None) -> DataFrame:
    """One row per page: page_id, url, text, n_chars. Whole pages; one pass without a shuffle.

    A null or empty html, or one without an article, has an empty text. Broken markup is read as browsers do for the usual
    cases (open paragraphs, list items and cells end where the next begins). Repeated rows each get their row; an empty
    table gives none; other columns are not read.
    """
    shipped = pages.sparkSession.sparkContext.broadcast(model or train())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [main_text(shipped.value, x) for x in pdf["html"]]
            yield pd.DataFrame({"page_id": pdf["page_id"].array, "url": pdf["url"].array, "text": texts, "n_chars": list(map(len, texts))})

    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return base.mapInPandas(run, "page_id long, url string, text string, n_chars long")
