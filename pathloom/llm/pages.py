"""Main text of web pages: boosted trees over DOM nodes, decoded so that ancestors and descendants agree."""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boost
from .common import chunks

_MARKUP = r"""<(?:(/?)([a-zA-Z][^\s/<>]*+)(%s)>|!--(?:.*?--!?>|.*\Z)|[!?/][^>]*+(?:>|\Z))"""
_TAG = re.compile(_MARKUP % r"""(?:[^"'>]++|"[^"]*+"|'[^']*+')*+""", re.DOTALL)
_NEAR = re.compile(_MARKUP % r"""(?:[^"'<>]++|"[^"<]*+"|'[^'<]*+'|["'])*+""", re.DOTALL)  # a quoted value ends before the next tag
_NAMES = re.compile(r"""\b(?:class|id|role|aria-label|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
_WORDS = re.compile(r"[a-z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head title script style template noscript svg math iframe object canvas audio video".split())
RAW = frozenset("script style title textarea".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_IN_P = BLOCK - {"html", "body", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "option", "optgroup", "legend"}
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead", "tfoot"}, {"table"})}
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
BUCKETS = 4096  # of hashed attribute tokens
TAGS = ("p", "div", "li", "ul", "section", "article", "main", "nav", "header", "footer", "aside", "form", "table", "td", "blockquote", "pre", "body", "figure", "dl", "a", "span", "button", "label")
_SHUT = frozenset("nav footer aside form button select textarea".split())
_MIXED = math.log(0.5)
_OPENS = re.compile("</?[a-zA-Z]")
_RAW_ENDS = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in sorted(RAW)}


class Page:
    """Elements in page order with their parents, and pieces of text with their element and block.

    Text that stands beside blocks in one element gets an element `#own` in that one, after all others, so
    that it is decided by itself. `origin` has the element in which each piece was written.
    """

    def __init__(self, html: str):
        self.tags, self.parents, self.names = ["#root"], [0], [frozenset()]
        self.pieces: list[tuple[int, int, str]] = []
        self.block = 0
        self.open: Counter[str] = Counter()
        self._parse(html)
        self._marks()
        self._split()

    def _marks(self) -> None:
        """For pages that carry marks."""

    def _parse(self, html: str) -> None:
        stack, at, hidden = [0], 0, 0  # hidden: elements open since one that is not shown
        tags, count = self.tags, self.open
        size = len(html)
        tag = _TAG
        begin = 0  # of text not yet read
        last = html.rfind("<") if html.rfind("<") > html.rfind(">") else -1
        while at < size:
            at = html.find("<", at)
            if at < 0:
                break
            m = tag.match(html, at)
            if m is None and tag is _TAG and _OPENS.match(html, at):
                tag = _NEAR  # a quote that is never closed: from here on each value must end before the next tag
                m = tag.match(html, at)
            if m is None:
                if at == last and _OPENS.match(html, at):
                    size = at  # an unfinished tag at the end
                    break
                at += 1
                continue
            if at > begin:
                self._text(stack[-1], html[begin:at], hidden)
            begin = at = m.end()
            name = m[2]
            if name is None:
                continue
            name = name.lower()
            if m[1]:
                if count[name]:
                    hidden = self._close(stack, name, hidden)
                continue
            if name == "br":
                self._text(stack[-1], "\n", hidden)
                continue
            if name in VOID:
                if name in BLOCK:
                    self.block += 1
                continue
            if name in _IN_P and count["p"]:
                self._pop_to(stack, {"p"}, {"table", "td", "th", "button", "object"})
            if name in HEADINGS and tags[stack[-1]] in HEADINGS:
                self._cut(stack, len(stack) - 1)
            if name in _ENDS and any(count[x] for x in _ENDS[name][0]):
                self._pop_to(stack, *_ENDS[name])
            if name == "body" and hidden:  # a head that was never closed
                while len(stack) > 1 and tags[stack[-1]] in HIDDEN:
                    self._cut(stack, len(stack) - 1)
                hidden = 0
            attributes = m[3]
            found = frozenset(w for v in _NAMES.findall(attributes) for w in _WORDS.findall(v.lower())) if "=" in attributes else frozenset()
            if name in BLOCK:
                self.block += 1
            if attributes.endswith("/") and name in ("svg", "path", "use"):
                continue
            self.parents.append(stack[-1])
            tags.append(name)
            self.names.append(found)
            if name in RAW:
                end = _RAW_ENDS[name].search(html, at)
                inner = html[at : end.start() if end else size]
                if name == "textarea":
                    self._text(len(tags) - 1, inner, hidden)
                begin = at = end.end() if end else size
                continue
            stack.append(len(tags) - 1)
            count[name] += 1
            if name in HIDDEN:
                hidden += 1
        if begin < size:
            self._text(stack[-1], html[begin:size], hidden)

    def _split(self) -> None:
        """Give the own text of elements that hold other deciding elements with text an element."""
        n = len(self.tags)
        owner, linked = [0] * n, [False] * n
        for k in range(1, n):
            up = self.parents[k]
            owner[k] = k if self.tags[k] in BLOCK or self.names[k] else owner[up]
            linked[k] = linked[up] or self.tags[k] == "a"
        self.origin = [node for node, _, _ in self.pieces]
        self.linked = [linked[node] for node in self.origin]
        direct = {owner[node] for node, _, t in self.pieces if t.strip()}
        above: set[int] = set()
        for k in direct:
            while k and (k := owner[self.parents[k]]) not in above:
                above.add(k)
        own = {}
        for k in sorted(direct & above):
            own[k] = len(self.tags)
            self.tags.append("#own")
            self.parents.append(k)
            self.names.append(frozenset())
        self.pieces = [(own.get(owner[node], node), block, t) for node, block, t in self.pieces]

    def _text(self, node: int, text: str, hidden: int) -> None:
        if not hidden:
            self.pieces.append((node, self.block, unescape(text) if "&" in text else text))

    def _cut(self, stack: list[int], k: int) -> None:
        for x in stack[k:]:
            self.open[self.tags[x]] -= 1
        del stack[k:]

    def _pop_to(self, stack: list[int], which: set[str], scope: set[str]) -> None:
        """Close the nearest open element of these, unless one of the scope is nearer."""
        for k in range(len(stack) - 1, 0, -1):
            tag = self.tags[stack[k]]
            if tag in which:
                self._cut(stack, k)
                self.block += 1
                return
            if tag in scope or (which == {"p"} and tag in BLOCK):
                return

    def _close(self, stack: list[int], name: str, hidden: int) -> int:
        inline = name not in BLOCK and name not in HIDDEN
        for k in range(len(stack) - 1, 0, -1):
            tag = self.tags[stack[k]]
            if tag == name:
                gone = sum(self.tags[x] in HIDDEN for x in stack[k:])
                self._cut(stack, k)
                if not inline:
                    self.block += 1
                return hidden - gone
            if inline and tag in BLOCK:
                break
        return hidden


def bucket(token: str) -> int:
    return crc32(token.encode()) % BUCKETS


def features(page: Page, weights: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """A row for each deciding element (blocks, elements with names, own text beside blocks), and these elements.

    `weights` has what each hashed attribute token says for main text, as token_weights() learns it.
    """
    n = len(page.tags)
    tags, parents, names = page.tags, page.parents, page.names
    text, count, links, punct, first = [0] * n, [0] * n, [0] * n, [0] * n, [-1] * n
    depth, shut, inside = [0] * n, [0] * n, [0] * n
    low, high, least, most = [0.0] * n, [0.0] * n, [0.0] * n, [0.0] * n  # of own tokens, and of those of all above
    kids: list[int] = [0] * n
    place = [0] * n
    same: dict[tuple[int, str], int] = {}
    for k in range(1, n):
        up = parents[k]
        depth[k] = depth[up] + 1
        shut[k] = shut[up] + (tags[k] in _SHUT)
        inside[k] = inside[up] + (tags[k] in ("article", "main"))
        if names[k]:
            said = [float(weights[bucket(t)]) for t in names[k]]
            low[k], high[k] = min(said), max(said)
        least[k], most[k] = min(least[up], low[k]), max(most[up], high[k])
        place[k] = kids[up]
        kids[up] += 1
        key = (up, tags[k])
        same[key] = same.get(key, 0) + 1
    done = 0
    for (node, _, t), in_link in zip(page.pieces, page.linked, strict=True):
        w = len(t.split())
        if w:
            size = len(t)
            text[node] += size
            count[node] += w
            links[node] += size if in_link else 0
            punct[node] += t.count(".") + t.count(",") + t.count("!") + t.count("?")
            if first[node] < 0:
                first[node] = done
            done += size
    elements, paragraphs, items, heads, fields, own = [1] * n, [0] * n, [0] * n, [0] * n, [0] * n, list(text)
    for k in range(n - 1, 0, -1):
        up = parents[k]
        tag = tags[k]
        paragraphs[k] += tag == "p"
        items[k] += tag == "li"
        heads[k] += tag in HEADINGS
        fields[k] += tag in ("form", "label", "button", "select", "textarea", "fieldset")
        for x in (text, count, links, punct, elements, paragraphs, items, heads, fields):
            x[up] += x[k]
        if first[k] >= 0:
            first[up] = first[k] if first[up] < 0 else min(first[up], first[k])
    whole = max(1, text[0])
    deciding = [k for k in range(1, n) if text[k] and (tags[k] in BLOCK or names[k] or tags[k] == "#own")]
    rows = []
    for k in deciding:
        up = parents[k]
        tag = tags[k]
        w = max(1, count[k])
        rows.append([
            *[tag == t for t in TAGS], tag in HEADINGS, tag in ("h1", "h2"), tag == "#own",
            low[k], high[k], len(names[k]), least[up], most[up], shut[up], inside[up],
            depth[k], place[k], kids[up], same[up, tag] / max(1, kids[up]),
            math.log1p(text[k]), math.log1p(w), links[k] / max(1, text[k]), punct[k] / w, elements[k] / w, text[k] / w, own[k] / max(1, text[k]),
            text[k] / whole, first[k] / whole, paragraphs[k], items[k], heads[k], fields[k], text[k] / max(1, text[up]), links[up] / max(1, text[up]), math.log1p(text[up]),
        ])
    return np.array(rows, np.float64).reshape(len(rows), len(TAGS) + 30), deciding


@dataclass(frozen=True)
class Model:
    trees: boost.Trees
    weights: np.ndarray

    def kept(self, pages: list[Page]) -> list[list[bool]]:
        found = [features(p, self.weights) for p in pages]
        logits = self.trees.logits(np.concatenate([f for f, _ in found])) if found else np.zeros(0)
        out, at = [], 0
        for page, (rows, deciding) in zip(pages, found, strict=True):
            out.append(decode(page, deciding, logits[at : at + len(rows)]))
            at += len(rows)
        return out


def decode(page: Page, deciding: list[int], logit: np.ndarray) -> list[bool]:
    """Which elements keep their text: the likeliest labels under which nothing in a dropped element is kept
    and nothing in a kept one dropped; an element may be mixed, at a price, and then its children decide."""
    n = len(page.tags)
    keep, drop, mixed = [0.0] * n, [0.0] * n, [_MIXED] * n
    plus = dict(zip(deciding, (-np.logaddexp(0, -logit)).tolist(), strict=True))
    minus = dict(zip(deciding, (-np.logaddexp(0, logit)).tolist(), strict=True))
    children = [False] * n
    for k in range(n - 1, 0, -1):
        up = page.parents[k]
        if k in plus:
            keep[k] += plus[k]
            drop[k] += minus[k]
            best = max(keep[k], drop[k], mixed[k] if children[k] else -math.inf)
            children[up] = True
        else:
            best = max(keep[k], drop[k], mixed[k] - _MIXED)
            children[up] = children[up] or children[k]
        keep[up] += keep[k]
        drop[up] += drop[k]
        mixed[up] += best
    state = [2] * n  # 0 dropped, 1 kept, 2 mixed
    kept = [False] * n
    kept[0] = not deciding  # a page of bare text
    for k in range(1, n):
        above = state[page.parents[k]]
        if above != 2:
            state[k] = above
        elif k in plus:
            options = [drop[k], keep[k], mixed[k] if children[k] else -math.inf]
            state[k] = options.index(max(options))
        kept[k] = state[k] == 1 or (state[k] == 2 and (plus[k] > minus[k] if k in plus else kept[page.parents[k]]))
    return kept


def join(page: Page, kept: list[bool]) -> str:
    blocks: dict[int, list[str]] = {}
    for node, block, text in page.pieces:
        if kept[node]:
            blocks.setdefault(block, []).append(text)
    return "\n\n".join(t for b in blocks.values() if (t := " ".join("".join(b).split())))


def extract_all(pages: list[str], model: Model) -> list[str]:
    parsed = [Page(p) for p in pages]
    return [join(p, k) for p, k in zip(parsed, model.kept(parsed), strict=True)]


# --- training pages -----------------------------------------------------------------------------


#: Words that the made-up pages name elements with, by what the elements hold. Unnamed elements and names
#: without meaning are as frequent, so that shape decides as well.
NAMES = {
    "main": "article content main post entry body story text prose copy",
    "page": "page wrapper container site layout outer inner row col grid",
    "nav": "nav navigation navbar menu breadcrumb breadcrumbs pagination pager toolbar links skip",
    "header": "header masthead top banner branding logo",
    "footer": "footer foot bottom copyright legal colophon",
    "advert": "ad ads advert adverts advertisement promo promoted promotion sponsor sponsored banner",
    "aside": "sidebar side aside related recommended widget widgets teaser trending popular",
    "share": "share social follow sharing tags meta",
    "notice": "cookie cookies consent notice gdpr alert popup modal overlay",
    "form": "form login signup subscribe newsletter search register",
    "comments": "comment comments reply replies respond discussion disqus commentlist thread",
}


class _Writer:
    """Writes one made-up page; elements of its main text carry the mark data-main."""

    def __init__(self, rng: random.Random):
        self.r = rng
        letters = rng.choice(["etaoinshrdlu", "aeiounrstlcdm", "enisratdhulcgm", "абвгдеиклмнопрст", "eaiouéèçñüö"])
        self.vocabulary = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 11))) for _ in range(300)]

    def words(self, low: int, high: int) -> str:
        r = self.r
        out = [r.choice(self.vocabulary) for _ in range(r.randint(low, high))]
        if r.random() < 0.1:
            out = [w + r.choice(["###", "!!", " |", "$$$", "&amp;"]) for w in out]
        return " ".join(out)

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.words(2, 14).capitalize() + self.r.choice([".", ".", ",", "?", ""]) for _ in range(self.r.randint(low, high)))

    def inline(self, text: str) -> str:
        r = self.r
        parts = text.split(" ")
        for _ in range(r.choice([0, 0, 1, 2])):
            k = r.randrange(len(parts))
            parts[k] = r.choice(["<b>%s</b>", "<em>%s</em>", '<a href="/x">%s</a>', "<b>%s", "%s<br>"]) % parts[k]
        return " ".join(parts)

    def named(self, role: str, share: float = 0.55) -> str:
        """A class or id of the role, one without meaning, or none."""
        r = self.r
        dice = r.random()
        if dice < share:
            word = r.choice(NAMES[role].split())
            extra = "".join(r.choice("bcdfgklmnprstvwxz") for _ in range(4))
            word = r.choice(["%s", "%s", "%s-" + extra, extra + "-%s", "%s " + extra, "the-%s"]) % word
        elif dice < share + 0.2:
            word = "".join(r.choice("bcdfghjklmnpqrstvwxz") for _ in range(r.randint(1, 6))) + r.choice(["", "1", "-2"])
        else:
            return ""
        return r.choice([' class="%s"', ' class="%s"', ' id="%s"', " class=%s" if " " not in word else ' class="%s"']) % word

    def block(self, role: str, tags: str, body: str) -> str:
        tag = self.r.choice(tags.split())
        # a plain element that nothing sets apart is named more often than not
        return f"<{tag}{self.named(role, 0.75 if tag in ('div', 'section', 'ul') else 0.35)}>{body}</{tag}>"

    def misleading(self) -> str:
        """A name that a paragraph of main text may have although one of its words says otherwise."""
        r = self.r
        if r.random() > 0.08:
            return ""
        return f' class="{r.choice(NAMES[r.choice(sorted(NAMES))].split())}-on-{"".join(r.choice("abcdefgilmnorstu") for _ in range(5))}"'

    def main(self) -> str:
        r = self.r
        out = []
        title = r.choice(["h1", "h1", "h2"])
        if r.random() < 0.85:
            out.append(f"<{title} data-main>{self.words(1, 12)}</{title}>")
        plain = r.random() < 0.12  # paragraphs without elements
        for _ in range(r.choice([1, 1, 2, 2, 3, 5, 8, 14])):
            kind = r.random()
            if plain and kind < 0.8:
                out.append(f"<span data-main>{self.inline(self.sentences(1, 4))}</span>" + r.choice(["<br><br>", "<br>", "<p data-main>" + self.sentences(1, 4) + "</p>"]))
            elif kind < 0.73:
                out.append(f"<p data-main{self.misleading()}>{self.inline(self.sentences(1, r.choice([1, 3, 8])))}" + r.choice(["</p>", "</p>", ""]))
            elif kind < 0.8:
                out.append("<ul data-main>" + "".join(f"<li data-main>{self.sentences(1, 2)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.85:
                out.append(f"<h{r.randint(2, 4)} data-main>{self.words(1, 6)}" + "<p data-main>" + self.sentences(1, 4) + "</p>")
            elif kind < 0.89:
                out.append(f"<blockquote data-main><p data-main>{self.sentences(1, 3)}</p></blockquote>")
            elif kind < 0.92:
                out.append(f"<div data-main{self.misleading()}>{self.sentences(1, 5)}</div>")
            elif kind < 0.95:
                out.append("<table data-main>" + "".join("<tr data-main>" + "".join(f"<td data-main>{self.words(1, 4)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(2, 4))) + "</table>")
            else:
                out.append(r.choice([self.advert, self.share, self.aside])())
        if r.random() < 0.1:
            out.insert(0, f"<header data-main><p data-main>{self.words(2, 6)}</p></header>")
        body = "".join(out)
        tag = r.choice(["article", "article", "article", "main", "div", "div", "div", "section", ""])
        return f"<{tag} data-main{self.named('main', 0.6)}>{body}</{tag}>" if tag else body

    def links(self, low: int = 2, high: int = 9) -> str:
        return "".join(f'<li><a href="/{self.words(1, 1)}">{self.words(1, 3)}</a></li>' for _ in range(self.r.randint(low, high)))

    def nav(self) -> str:
        r = self.r
        if r.random() < 0.15:
            return self.block("nav", "nav div p", r.choice([" | ", " ", " &gt; "]).join(f'<a href="/{k}">{self.words(1, 2)}</a>' for k in range(r.randint(2, 7))))
        return self.block("nav", "nav nav nav div", f"<ul>{self.links()}</ul>") if r.random() < 0.8 else self.block("nav", "ul", self.links())

    def header(self) -> str:
        title = self.r.choice(["<p>%s</p>", "<h1>%s</h1>", "<h2>%s</h2>", "%s", '<a href="/">%s</a>']) % self.words(1, 6)
        return self.block("header", "header header div", title + (self.nav() if self.r.random() < 0.3 else ""))

    def footer(self) -> str:
        text = self.r.choice(["&copy; ", ""]) + self.words(1, 3) + self.r.choice([" &middot; ", ". "]) + self.sentences(0, 2)
        return self.block("footer", "footer footer div", self.r.choice(["%s", "%s", "<p>%s</p>"]) % text)

    def advert(self) -> str:
        tag = self.r.choice(["div", "div", "aside", "p"])
        body = self.r.choice(["%s", "%s", "<p>%s</p>" if tag != "p" else "%s", '<a href="/x">%s</a>']) % self.sentences(1, 3)
        return f"<{tag}{self.named('advert', 1.0 if tag != 'aside' else 0.6)}>{body}</{tag}>"

    def share(self) -> str:
        return f"<div{self.named('share', 1.0)}>{self.words(1, 5)}</div>"

    def aside(self) -> str:
        body = self.r.choice(["<h3>%s</h3><ul>" + self.links() + "</ul>", "<h4>%s</h4><p>" + self.sentences(1, 3) + "</p>", "<p>%s " + self.sentences(1, 4) + "</p>"]) % self.words(1, 4)
        tag = self.r.choice(["aside", "aside", "div"])
        return f"<{tag}{self.named('aside', 1.0 if tag == 'div' else 0.4)}>{body}</{tag}>"

    def notice(self) -> str:
        body = self.r.choice(["<p>%s</p><button>ok</button>", "%s", "<p>%s</p>"]) % self.sentences(1, 3)
        return f"<{(t := self.r.choice(['div', 'div', 'section']))}{self.named('notice', 1.0)}>{body}</{t}>"

    def form(self) -> str:
        return self.r.choice(['<form action="/s"><label>%s</label><input name="q"><button>go</button></form>', "<form" + self.named("form") + "><p>%s</p><select><option>one</option><option>two</option></select></form>", "<div" + self.named("form", 0.9) + "><form><label>%s</label><textarea>text</textarea></form></div>"]) % self.words(1, 8)

    def comments(self) -> str:
        r = self.r
        one = r.choice(["<div" + self.named("comments", 0.9) + "><p>%s</p></div>", "<li><p>%s</p></li>", "<article" + self.named("comments", 1.0) + "><p>%s</p></article>", "<p>%s</p>"])
        body = "".join(one % self.sentences(1, 4) for _ in range(r.randint(1, 5)))
        tag = r.choice(["section", "div", "ol"])
        return f"<{tag}{self.named('comments', 1.0)}>{r.choice(['<h2>%s</h2>', '<h3>%s</h3>', '']) .replace('%s', self.words(1, 3)) if tag != 'ol' else ''}{body}</{tag}>"

    def page(self) -> str:
        r = self.r
        if r.random() < 0.1:  # a fragment: main text and nothing else
            return self.main()
        before = [f() for f, p in ((self.header, 0.4), (self.nav, 0.75), (self.notice, 0.25), (self.form, 0.15), (self.advert, 0.5), (self.aside, 0.2)) if r.random() < p]
        after = [f() for f, p in ((self.share, 0.1), (self.advert, 0.25), (self.aside, 0.3), (self.form, 0.2), (self.comments, 0.35), (self.nav, 0.1), (self.notice, 0.1), (self.footer, 0.8)) if r.random() < p]
        main = self.main()
        layout = r.random()
        if layout < 0.15:  # a table for layout
            cells = [f"<td>{x}</td>" for x in ("".join(before[1:]), main, "".join(after[:-1])) if x]
            body = "".join(before[:1]) + f"<table{self.named('page', 0.4)}><tr>{''.join(cells)}</tr></table>" + "".join(after[-1:])
        elif layout < 0.3:  # columns
            body = "".join(before[:1]) + f"<div{self.named('page')}><div{self.named('page')}>{main}</div><div{self.named('aside', 0.6)}>{''.join(after[:-1])}</div></div>" + "".join(before[1:] + after[-1:])
        else:
            body = "".join(before) + main + "".join(after)
        if r.random() < 0.3:
            body = f"<div{self.named('page')}>{body}</div>"
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 5)}</title><style>p{{}}</style></head><body>{body}</body></html>"


class _Marked(Page):
    """A training page: remembers which elements carry the mark."""

    def __init__(self, html: str):
        super().__init__(re.sub(r" data-main(?: (class|id)=\"?([^\">]*)\"?)?(?=[ >])", r' itemprop="datamain \2"', html))

    def _marks(self) -> None:
        marked = ["datamain" in names for names in self.names]
        self.names = [names - {"datamain"} for names in self.names]
        self.main = [False] * len(marked)
        for k in range(1, len(marked)):  # the nearest block decides
            self.main[k] = marked[k] or (self.main[self.parents[k]] and self.tags[k] not in BLOCK and not self.names[k])

    def shares(self) -> list[float]:
        """Share of main text in each element; -1 without text."""
        main, other = [0] * len(self.tags), [0] * len(self.tags)
        for (node, _, t), written in zip(self.pieces, self.origin, strict=True):
            if t.strip():
                (main if self.main[written] else other)[node] += len(t)
        for k in range(len(self.tags) - 1, 0, -1):
            main[self.parents[k]] += main[k]
            other[self.parents[k]] += other[k]
        return [m / (m + o) if m + o else -1.0 for m, o in zip(main, other, strict=True)]


def token_weights(pages: list[_Marked]) -> np.ndarray:
    """For each bucket of attribute tokens the log odds that an element so named holds main text, drawn to zero
    where few elements have it."""
    yes, no = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for page in pages:
        for names, share in zip(page.names, page.shares(), strict=True):
            for token in names:
                if share >= 0:
                    (yes if share > 0.5 else no)[bucket(token)] += 1
    return np.log((yes + 2) / (no + 2))


@lru_cache(2)
def train(pages: int = 600, seed: int = 11) -> Model:
    """Fit on made-up pages of many layouts and alphabets; elements that hold both kinds of text are left out.

    Attribute tokens are learned from as many other pages as the trees are, so that the trees see how far
    to trust them.
    """
    rng = random.Random(seed)
    weights = token_weights([_Marked(_Writer(rng).page()) for _ in range(pages)])
    rows, target = [], []
    for _ in range(pages):
        page = _Marked(_Writer(rng).page())
        shares = page.shares()
        for row, k in zip(*features(page, weights), strict=True):
            if shares[k] > 0.95 or shares[k] < 0.05:
                rows.append(row)
                target.append(float(shares[k] > 0.5))
    return Model(boost.fit(np.array(rows), np.array(target), trees=60), weights)


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages with the main text of its whole html.

    Character references are decoded, white space within a block becomes one space, blocks are joined by an
    empty line in page order. Null and empty html, and pages without main text, give an empty text; a page
    of bare text is all main text. Broken markup is read as browsers do it in outline: open paragraphs and
    items end where the next begins, unknown ends are ignored, an unfinished tag at the end is dropped, and
    after a quote that is never closed a quoted value ends before the next tag. Time and memory are linear
    in the page's length. Rows that repeat a page_id each have a row; an empty table gives an empty result;
    other columns are ignored.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or train())  # a fixed number of trees and buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "html", 1 << 20):
                texts = extract_all([h or "" for h in part.column("html").to_pylist()], shared.value)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
