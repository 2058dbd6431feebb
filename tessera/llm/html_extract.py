"""Main text of HTML pages by the maximum-scoring subsequence.

A page is a row of tags and words. A word scores the log-odds that where it stands is main text, a tag the
log-probability that one of its name and place is part of it, which is never positive: both are weights that
labelled pages give. Where a word stands is told by features: in a main container, beside one or on a page
without one; in which kind of block; in a link; and what the elements around it are called, which alone decides
nothing. One linear scan finds the contiguous region of the highest sum. Words in elements with a telling name
that score negative (adverts or reader comments within an article) are left out of it; in a main container they
neither join nor part what is around them.
"""

from __future__ import annotations

import functools
import html as _html
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import cluster

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"""
    r"""|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"""|<(?P<end2>/?)(?P<name2>[A-Za-z][^\s/>]*)(?P<rest2>[^>]*+)>?""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
_TOLD_BY = frozenset("class id role hidden aria-hidden style itemprop".split())
#: Elements whose content is never text of the page.
_RAW = frozenset("script style noscript template textarea svg math iframe object select title head canvas audio video".split())
_RAW_TEXT = frozenset("script style textarea title iframe noscript".split())  # their content holds no tags
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose name tells something; what it tells, the labelled pages say.
_TELLING = frozenset("nav header footer aside form menu dialog button".split())
_KINDS = {
    "header": "header masthead hero",
    "footer": "footer copyright colophon disclaimer imprint",
    "nav": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toolbar topbar skip toc",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner",
    "notice": "cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup paywall login search",
    "side": "sidebar aside widget widgets rail",
    "social": "social share sharing",
    "related": "related recommended recommendations trending popular",
    "comment": "comment comments commentlist disqus respond reply replies discussion",
}
_KIND = {word: kind for kind, words in _KINDS.items() for word in words.split()}
_MAIN_WORDS = frozenset("article articlebody content main post entry story blogpost maincontent".split())
#: Words that leave the meaning of a name to the others.
_PLAIN = _MAIN_WORDS | frozenset(
    "posts links link articles list box container wrapper wrap section block area bar top bottom left right site page primary secondary inner outer item items text body module panel group row col icon icons button buttons btn global fixed sticky news reader readers user slot unit zone form widget holder message".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
_CLOSES_P = _BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
_STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}, "p": {"article", "section", "div", "main", "body", "td", "blockquote", "li", "aside", "nav", "header", "footer", "form"}}


class Item:
    """A tag (name, no text), or the words between two tags."""

    __slots__ = ("at", "name", "text", "words", "block", "main", "told", "link")

    def __init__(self, at: int, name: str, text: str, words: int, block: int, main: int, told: tuple[str, ...], link: bool):
        self.at, self.name, self.text, self.words, self.block, self.main, self.told, self.link = at, name, text, words, block, main, told, link


_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@functools.lru_cache(maxsize=4096)
def name_kinds(value: str) -> tuple[tuple[str, ...], bool]:
    """What the names in a class or id tell, and whether one of them is that of a main container.

    A name of a known kind with other words in it ("related-work") is another feature than one without.
    """
    told, main = [], False
    for name in value.split():
        words = [w.lower() for w in _NAME_WORD.findall(name)]
        kinds = [_KIND[w] for w in words if w in _KIND]
        if kinds:
            pure = all(w in _KIND or w in _PLAIN for w in words)
            told.append(f"{'name' if pure else 'mixed'}:{kinds[-1]}")
        elif any(w in _MAIN_WORDS for w in words):
            main = True
    return tuple(dict.fromkeys(told)), main


def _attributes(rest: str) -> tuple[list[str], int]:
    """What an element's attributes tell, and whether they name a main container: 2 by its role, 1 by its class or id."""
    told: list[str] = []
    main = 0
    for m in _ATTRIBUTE.finditer(rest):
        name = m[1].lower()
        if name not in _TOLD_BY:
            continue
        value = next((x for x in m.groups()[1:] if x is not None), "")
        if name in ("class", "id"):
            kinds, is_main = name_kinds(value)
            told += kinds
            main = max(main, int(is_main))
        elif name == "role":
            if value.lower() in _ROLES:
                told.append("role")
            main = max(main, 2 * (value.lower() in ("main", "article")))
        elif name == "itemprop":
            main = max(main, 2 * (value.lower() == "articlebody"))
        elif name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                told.append("hidden")
        elif name == "hidden" or value.lower() == "true":
            told.append("hidden")
    return told, main


def tokenize(page: str) -> list[Item]:
    """The page's tags and runs of words, each run with where it stands. What is never text is not among them."""
    items: list[Item] = []
    stack: list[tuple[str, tuple[str, ...], int, bool]] = []  # name, what it and those around it tell, main container, never text
    at, block, links, raw = 0, 0, 0, ""
    size = len(page)

    def text(upto: int) -> None:
        piece = page[at:upto]
        if not piece or (stack and stack[-1][3]):
            return
        if "&" in piece:
            piece = _html.unescape(piece)
        inner = next((s[0] for s in reversed(stack) if s[0] in _BLOCK), "body")
        told, main = (stack[-1][1], stack[-1][2]) if stack else ((), 0)
        items.append(Item(at, inner, piece, len(piece.split()), block, main, told, links > 0))

    def tag(name: str, text: str = "") -> None:
        if not (stack and stack[-1][3]):
            told, main = (stack[-1][1], stack[-1][2]) if stack else ((), 0)
            items.append(Item(start, name, text, 0, block, main, told, False))

    def leave(k: int) -> None:
        nonlocal links
        links -= sum(s[0] == "a" for s in stack[k:])
        del stack[k:]

    while at < size:
        if raw:
            m = re.compile(rf"</{raw}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at, raw = (m.end() if m else size), ""
            continue
        start = page.find("<", at)
        m = None
        while start >= 0 and not (m := _TOKEN.match(page, start)):
            start = page.find("<", start + 1)
        if not m:
            text(size)
            break
        text(start)
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        closing, rest = bool(m["end"] or m["end2"]), m["rest"] or m["rest2"] or ""
        if name in _BLOCK:
            block += 1
        if closing:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if k is not None and (name in _BLOCK or not any(s[0] in _BLOCK for s in stack[k + 1 :])):
                leave(k)
            tag(name)
            continue
        if name in _VOID:
            tag(name, " " if name == "br" else "")
            continue
        if name in _RAW_TEXT:
            raw = name
            continue
        for closes in ([name] if name in _SAME else []) + (["p"] if name in _CLOSES_P else []):
            same, stops = _SAME[closes], _STOPS[closes]
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in same:
                    leave(k)
                    break
                if stack[k][0] in stops:
                    break
        told, main, never = (stack[-1][1], stack[-1][2], stack[-1][3]) if stack else ((), 0, False)
        own, own_main = _attributes(rest) if "=" in rest or "hidden" in rest else ([], 0)
        if name in ("html", "body", "article", "main"):
            own = [x for x in own if x == "hidden"]
        if name in _TELLING:
            own.append(name)
        if own:
            told = tuple(dict.fromkeys((*told, *(f"{'in' if main else 'out'}:{x}" for x in own))))
        else:
            main = max(main, own_main)
        if name in ("article", "main"):
            main = 2
        stack.append((name, told, main, never or name in _RAW))
        links += name == "a"
        tag(name)
    return items


# Labelled pages


def labelled_pages(n: int = 160, seed: int = 5) -> list[list[tuple[str, bool]]]:
    """Pages as pieces of HTML, each marked as main text or not: several layouts, of words of no language."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randrange(2, 9)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randrange(a, b)))
    items = lambda: "".join(f'<li><a href="/{word()}">{words(1, 3)}</a></li>' for _ in range(rng.randrange(3, 9)))
    named = lambda kind: rng.choice(("", "site-", "page-", "main-", "top-")) + rng.choice(_KINDS[kind].split()) + rng.choice(("", "", "-box", "-container", "-block"))
    attribute = lambda value: f'{rng.choice(("class", "class", "id"))}="{value}"'

    def boilerplate() -> str:
        kind = rng.choice(sorted(_KINDS))
        inner = rng.choice((f"<p>{words(4, 40)}</p>", f"<ul>{items()}</ul>", words(3, 20), f"<h3>{words(1, 3)}</h3><p>{words(5, 30)}</p><p>{words(5, 30)}</p>"))
        return f"<{(t := rng.choice(('div', 'div', 'section')))} {attribute(named(kind))}>{inner}</{t}>"

    pages = []
    for i in range(n):
        head = f"<html><head><title>{words(3, 8)}</title><style>p{{}}</style><script>x()</script></head><body>"
        before = rng.sample(
            [f"<nav><ul>{items()}</ul></nav>", f"<header><h1>{words(1, 4)}</h1></header>", f"<header><p>{words(2, 9)}</p><ul>{items()}</ul></header>", boilerplate(), boilerplate(), boilerplate(), f'<form><input name="q"><button>{words(1, 3)}</button></form>', f"<div>{words(2, 5)}</div>", f'<div><a href="/">{words(1, 3)}</a> | <a href="/">{words(1, 3)}</a></div>', f"<menu><li>{words(1, 3)}</li></menu>", f'<div role="navigation"><ul>{items()}</ul></div>', f'<div hidden>{words(5, 30)}</div>'],
            rng.randrange(2, 6),
        )
        title = f"<h1>{words(3, 9)}</h1>"
        kind = rng.choice(sorted(_KINDS))
        title = rng.choice((title, title, title, f"<header>{title}</header>", f'<div class="{rng.choice(("post-header", "entry-header", "header", "article-header", "page-header"))}">{title}<p>{words(2, 12)}</p></div>'))
        main = [title]
        for _ in range(rng.randrange(2, 9)):
            strange = f"{word()}x"
            main.append(
                rng.choice(
                    [f"<p>{words(20, 90)}</p>"] * 6
                    + [f"<h2>{words(2, 6)}</h2>", f"<p>{words(8, 30)} <a href='/'>{words(1, 3)}</a> {words(8, 30)}</p>", f"<ul><li>{words(4, 12)}</li><li>{words(4, 12)}</li></ul>", f"<blockquote><p>{words(10, 30)}</p></blockquote>", f"<pre>{words(5, 20)}</pre>", f"<table><tr><td>{words(1, 4)}</td><td>{words(1, 4)}</td></tr></table>", f"<dl><dt>{words(1, 3)}</dt><dd>{words(3, 9)}</dd></dl>", f"<figure><figcaption>{words(3, 12)}</figcaption></figure>", f"<div><p>{words(9, 40)}</p></div>", f"<div>{words(9, 70)}</div>", f"<div>{words(2, 7)}</div>", f"{words(9, 40)}<br><br>{words(9, 40)}", f"<section>{words(9, 40)}</section>", f"<section><h3>{words(1, 5)}</h3><p>{words(9, 40)}</p></section>"]
                    + [f"<{t} {attribute(rng.choice(_KINDS[kind].split()) + '-' + strange)}><h2>{words(1, 4)}</h2><p>{words(9, 50)}</p></{t}>" for t in ("section", "div")]
                )
            )
        inside = [(x, True) for x in main]
        for _ in range(rng.randrange(0, 3)):
            aside = rng.choice([f"<aside><p>{words(8, 30)}</p></aside>", f"<nav><ul>{items()}</ul></nav>", f"<form><p>{words(3, 12)}</p><button>{words(1, 2)}</button></form>", f"<footer><p>{words(3, 15)}</p></footer>", f'<div style="display:none">{words(4, 20)}</div>', f'<div role="complementary">{words(4, 20)}</div>', *(x for x in (boilerplate() for _ in range(4)) if not re.search(r'="\S*(?:header|masthead|hero)', x))])
            inside.insert(rng.randrange(1, len(inside) + 1), (aside, False))
        after = rng.sample([f"<footer><p>&copy; {words(4, 14)}</p></footer>", boilerplate(), boilerplate(), f'<div id="comments"><p>{words(10, 40)}</p><p>{words(10, 40)}</p></div>', f"<div>{words(2, 6)}</div>", f"<ul>{items()}</ul>", f"<p>{words(2, 7)}</p>", f'<dialog><p>{words(4, 12)}</p></dialog>'], rng.randrange(1, 5))
        opening, closing = (("<article>", "</article>"), ("<main>", "</main>"), (f'<div class="{rng.choice(("content", "main-content", "post", "entry-content", "story"))}">', "</div>"), ("<div>", "</div>"), ('<div role="main">', "</div>"), ("", ""))[i % 6]
        pages.append([(head, False), *((x, False) for x in before), (opening, True), *inside, (closing, True), *((x, False) for x in after), ("</body></html>", False)])
    return pages


def _places(items: list[Item]) -> list[str]:
    """Where each item stands: in a main container ("main"), beside one ("beside"), or on a page without one ("open").

    A container that only a class or id names counts where it holds a quarter of the page's words outside links.
    """
    plain = sum(x.words for x in items if not x.link)
    named = 4 * sum(x.words for x in items if x.main == 1 and not x.link) >= max(plain, 1)
    least = 1 if named else 2
    has = any(x.main >= least and x.words for x in items)
    return ["main" if x.main >= least else "beside" if has else "open" for x in items]


def _length(words: int) -> str:
    return "short" if words < 6 else "middle" if words < 15 else "long"


def _word_features(place: str, x: Item) -> tuple[str, ...]:
    return (place, f"{place}:{x.name}", f"{place}:{_length(x.words)}", *((f"{place}:link",) if x.link else ()), *x.told)


#: Scores of a word: at most so far from 0.
MOST_SCORE = 3.0


class Weights:
    """Log-odds of words by their features, log-probabilities of tags by place and name."""

    def __init__(self, bias: float, features: dict[str, float], tags: dict[str, float]):
        self.bias, self.features, self.tags = bias, features, tags
        self._known: dict[tuple, float] = {}

    def word(self, place: str, x: Item) -> float:
        key = (place, x.name, _length(x.words), x.link, x.told)
        if key not in self._known:
            total = self.bias + sum(self.features.get(f, 0.0) for f in _word_features(place, x))
            self._known[key] = max(-MOST_SCORE, min(MOST_SCORE, total))
        return self._known[key]

    def tag(self, place: str, name: str) -> float:
        return self.tags.get(f"{place}:{name}", self.tags.get(place, 0.0))


def fit_weights(pages: list[list[tuple[str, bool]]], ridge: float = 1.0, steps: int = 10) -> Weights:
    """A logistic model of words, each run of them weighed by the root of its length, and the shares of tags in main text."""
    rows: list[tuple[tuple[str, ...], float, bool]] = []
    inside, every = Counter(), Counter()
    for pieces in pages:
        page = "".join(p for p, _ in pieces)
        edges = np.cumsum([len(p) for p, _ in pieces])
        labels = [label for _, label in pieces]
        items = tokenize(page)
        for x, place in zip(items, _places(items)):
            label = labels[int(np.searchsorted(edges, x.at, "right"))]
            if x.words:
                rows.append((_word_features(place, x), math.sqrt(x.words), label))
            elif not x.text:
                for key in (place, f"{place}:{x.name}"):
                    every[key] += 1
                    inside[key] += label
    names = sorted({f for r in rows for f in r[0]})
    column = {f: k + 1 for k, f in enumerate(names)}
    z = np.zeros((len(rows), len(names) + 1))
    z[:, 0] = 1
    for k, (features, _, _) in enumerate(rows):
        z[k, [column[f] for f in features]] = 1
    w, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows], float)
    beta, pull = np.zeros(z.shape[1]), np.full(z.shape[1], ridge)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        h = (z * (w * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ z + np.diag(pull)
        beta = beta + np.linalg.solve(h, z.T @ (w * (y - p)) - pull * beta)
    return Weights(float(beta[0]), {f: float(beta[k]) for f, k in column.items()}, {k: math.log((inside[k] + 0.5) / (n + 1)) for k, n in every.items()})


@functools.cache
def weights() -> Weights:
    return fit_weights(labelled_pages())


def _scored(items: list[Item], w: Weights) -> tuple[list[float], list[bool]]:
    """A score for each item, and which runs of words are left out: those in elements with a telling name that score negative.

    In a main container what is left out, and the tags there, score 0.
    """
    scores, left_out = [], []
    for x, place in zip(items, _places(items)):
        score = w.word(place, x) if x.words or x.told else 0.0
        out = bool(x.told) and score < 0
        left_out.append(out)
        if out and place == "main" or x.text and not x.words:
            scores.append(0.0)
        else:
            scores.append(score * x.words if x.words else w.tag(place, x.name))
    return scores, left_out


def best_region(scores: list[float]) -> tuple[int, int, float]:
    """The contiguous run [i, j) of the highest sum, the earliest of equals; (0, 0, 0) if none is positive."""
    best, total, start, found = 0.0, 0.0, 0, (0, 0)
    for k, score in enumerate(scores):
        total += score
        if total <= 0:
            total, start = 0.0, k + 1
        elif total > best:
            best, found = total, (start, k + 1)
    return *found, best


def extract(page: str | None, w: Weights | None = None) -> str:
    """The main text of a page: its blocks, white space within each made one space, joined by an empty line."""
    if not page:
        return ""
    items = tokenize(page)
    scores, left_out = _scored(items, w or weights())
    i, j, _ = best_region(scores)
    blocks: list[list[str]] = []
    last = None
    for x, out in zip(items[i:j], left_out[i:j]):
        if x.text and not out:
            if x.block != last:
                blocks.append([])
                last = x.block
            blocks[-1].append(x.text)
    texts = (" ".join("".join(b).split()) for b in blocks)
    return "\n\n".join(t for t in texts if t)


def extract_pages(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row of pages: id, url, text and n_chars. A null page has an empty text; nulls elsewhere stay; repeated rows repeat; other columns are not read."""
    cluster.ship(spark)
    id_type = pages.schema[id_col].dataType.simpleString()
    fitted = weights()

    def run(batches):
        for batch in batches:
            texts = [extract(x.as_py(), fitted) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, f"id {id_type}, url string, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})
