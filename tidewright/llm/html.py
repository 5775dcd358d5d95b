"""Main text of web pages by a tree-structured graphical model over the DOM.

A node is a block element; inline elements belong to the block around them. Each node leads to content or
does not. A pair potential ties it to its parent (by the node's tag), a node potential to what it shows:
tag, words of class and id, length, share of link text, punctuation. Sum-product passes messages from
the leaves upward and from the root downward; a block's text is kept if the marginal of content
reaches KEEP. The potentials are log ratios of counts over labelled pages, taken by a Spark job.

No labelled pages come with the corpus, so ``labelled_pages`` makes them: page layouts of many kinds,
whose elements carry their label in an attribute.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEEP = 0.5
#: The bound of the labelled sample that the model is fitted on.
LABELLED_PAGES, LABELLED_SEED = 600, 11
SMOOTHING = 0.5
#: Siblings of one tag are written alike: together they say as much about their parent as so many nodes.
SIBLINGS = 3
#: Names of classes and ids count from so many elements on.
SEEN = 5
LABEL = "data-content"
TAGGED = ("links", "under", "stop", "plain")

#: Fixed values of HTML: elements without an end tag, elements whose text is not shown, and block elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())  # up to the end tag, without markup inside
HIDDEN = frozenset("noscript template select svg math object".split())  # nest, and end with their parent at the latest
FOREIGN = frozenset("svg math".split())  # may close themselves
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Fixed values of HTML: a start tag ends open elements of the first set, up to one of the second.
ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tr": (frozenset(["tr"]), frozenset(["table", "tbody", "thead", "tfoot"])),
}
_STOPS = frozenset(["table", "article", "section", "body", "ul", "ol"])
_GROUPS = {"ol": "ul", "menu": "ul", "dir": "ul", "dl": "ul", "dt": "li", "dd": "li", "th": "td", "tbody": "table", "thead": "table", "tfoot": "table", "tr": "table"} | {f"h{i}": "h" for i in range(1, 7)}

# a quoted value ends where white space or the end of the tag follows; a quote without such an end is a character like others
_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"(?=[\s/>]|\Z)|'[^']*'(?=[\s/>]|\Z)|["'])*+)>?""", re.DOTALL)
# attributes one by one, each with its whole value, so nothing inside a value is taken for an attribute
_ATTRIBUTE = re.compile(r"""([^\s"'>/=][^\s"'>/=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?|["'][^\s]*""")
_UNSHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
# letters behind digits, or in front of digits and letters, are part of a generated name and say nothing
_WORD = re.compile(r"(?<!\d)(?:[A-Z]++(?![a-z])|[A-Z]?[a-z]++)(?!\d+[A-Za-z])")


@dataclass
class Page:
    """The block tree of a page, in page order: a parent stands before its children."""

    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    cues: list[tuple[str, ...]] = field(default_factory=list)
    label: list[int | None] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    runs: list[tuple[int, str]] = field(default_factory=list)  # (node, text without outer white space)


def attributes_of(tag: str) -> dict[str, str]:
    """The attributes of what stands behind a tag's name, by lower-case name; the first of a name counts, as in browsers."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(tag):
        if m[1]:
            out.setdefault(m[1].lower(), next((v for v in m.groups()[1:] if v is not None), ""))
    return out


def parse(html: str, labelled: bool = False) -> Page:
    """The block tree of html; unclosed and stray tags are mended as browsers do, a cut page ends its open elements.

    Block elements that a page hides (hidden, or a style that says so) are not shown. Labels are read only if labelled.
    """
    page = Page()
    stack: list[int] = []
    opened: dict[str, int] = {}
    pieces: list[str] = []
    in_link, at, hidden = False, 0, 0

    def push(tag: str, attributes: str) -> None:
        nonlocal hidden
        own = attributes_of(attributes)
        names.append(tag)
        opened[tag] = opened.get(tag, 0) + 1
        shut.append(tag in HIDDEN or "hidden" in own or _UNSHOWN.search(own.get("style", "")) is not None)
        hidden += shut[-1]
        if hidden:  # no node of the tree: what is inside is not shown
            stack.append(stack[-1])
            return
        cues = [w.lower() for name in ("class", "id", "role") for w in _WORD.findall(own.get(name, ""))]
        page.parent.append(stack[-1] if stack else -1)
        page.tag.append(_GROUPS.get(tag, tag))
        page.cues.append(tuple(dict.fromkeys(cues)))
        page.label.append(int(own[LABEL]) if labelled and own.get(LABEL) in ("0", "1") else None)
        page.linked.append(0)
        stack.append(len(page.tag) - 1)

    def flush() -> None:
        text = " ".join("".join(pieces).split())
        pieces.clear()
        if text:
            page.runs.append((stack[-1], text))

    def pop() -> None:
        nonlocal hidden
        stack.pop()
        hidden -= shut.pop()
        opened[names.pop()] -= 1

    def text(value: str) -> None:
        if hidden:
            return
        value = entities.unescape(value) if "&" in value else value
        pieces.append(value)
        if in_link:
            page.linked[stack[-1]] += len(value)

    names: list[str] = []
    shut: list[bool] = []
    push("html", "")
    for m in iter(lambda: _MARKUP.search(html, at), None):
        if m.start() > at:
            text(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                in_link = False
            elif (tag in BLOCK or tag in HIDDEN) and tag not in ("html", "body") and opened.get(tag):
                if tag in BLOCK:
                    flush()
                while names[-1] != tag:
                    pop()
                pop()
                in_link = False
        elif tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.IGNORECASE).search(html, at)
            at = end.end() if end else len(html)
        elif tag in HIDDEN:
            if not (tag in FOREIGN and m[3].endswith("/")):
                push(tag, "")
        elif tag == "a":
            in_link = True
        elif tag == "br":
            pieces.append(" ")
        elif tag in ("hr",):
            flush()
        elif tag in BLOCK and tag != "html":
            if not hidden:
                flush()
            if names[-1] == "p":
                pop()
            if tag in ENDS:
                ended, scope = ENDS[tag]
                k = len(names) - 1
                while k > 0 and names[k] not in ended and names[k] not in scope and names[k] not in _STOPS:
                    k -= 1
                if names[k] in ended:
                    while len(names) > k:
                        pop()
            push(tag, m[3])
    text(html[at:])
    flush()
    return page


def features(page: Page) -> list[list[str]]:
    """What each node shows, as names of the model's tables."""
    n = len(page.tag)
    own, linked, last = [0] * n, list(page.linked), [""] * n
    commas, items = [0] * n, [0] * n
    for node, run in page.runs:
        own[node] += len(run)
        commas[node] += run.count(",") + run.count(". ")
        last[node] = run[-1]
    under = list(own)
    for i in range(n - 1, 0, -1):
        under[page.parent[i]] += under[i]
        linked[page.parent[i]] += linked[i]
        items[page.parent[i]] += page.tag[i] == "p" and own[i] > 0
    size = lambda x: min(13, x.bit_length())
    share = lambda part, whole: 0 if not part else 1 + min(2, 3 * part // max(1, whole))
    out = []
    for i in range(n):
        tag = page.tag[i]
        row = [f"links {tag} {share(linked[i], under[i])}", f"under {tag} {size(under[i]) // 2}"]
        if items[i]:
            row.append(f"paragraphs {min(4, items[i])}")
        if own[i]:
            row.append(f"stop {tag} {last[i] in '.!?:;…。'} {min(3, commas[i])}")
        row += [f"cue {c}" for c in page.cues[i]] or [f"plain {tag}"]
        out.append(row)
    return out


def labels(page: Page) -> list[int]:
    """A node's label: whether it or a node below it holds main text; a node without text inherits its label."""
    n = len(page.tag)
    inherited = [0] * n
    for i in range(n):
        inherited[i] = page.label[i] if page.label[i] is not None else (inherited[page.parent[i]] if i else 0)
    good, all_ = [0] * n, [0] * n
    for node, run in page.runs:
        all_[node] += len(run)
        good[node] += len(run) * inherited[node]
    for i in range(n - 1, 0, -1):
        good[page.parent[i]] += good[i]
        all_[page.parent[i]] += all_[i]
    return [int(good[i] > 0) if all_[i] else inherited[i] for i in range(n)]


@dataclass
class TreeModel:
    """shown: a feature's log P(feature | content) - log P(feature | not); tied: (tag, parent's label) to log P(0), log P(1)."""

    shown: dict[str, float]
    tied: dict[tuple[str, int], tuple[float, float]]
    anywhere: dict[int, tuple[float, float]]

    def marginals(self, page: Page) -> list[float]:
        """P(content) of every node by sum-product: upward messages in reverse page order, downward ones in page order."""
        n = len(page.tag)
        alike: dict[tuple[int, str], int] = {}
        for key in zip(page.parent, page.tag):
            alike[key] = alike.get(key, 0) + 1
        weight = [min(1.0, SIBLINGS / alike[key]) for key in zip(page.parent, page.tag)]
        # names that the labelled pages do not have say no more than no name
        bare = [[f"plain {tag}"] if cues and not any(f"cue {c}" in self.shown for c in cues) else [] for tag, cues in zip(page.tag, page.cues)]
        shown = [w * sum(self.shown.get(f, 0.0) for f in row + more) for w, row, more in zip(weight, features(page), bare)]
        # beliefs as log odds of what lies below a node; pair potentials as the four probabilities
        below = shown
        up = [0.0] * n
        pair = [None] * n
        for i in range(n - 1, 0, -1):
            t0, t1 = (self.tied.get((page.tag[i], y), self.anywhere[y]) for y in (0, 1))
            pair[i] = (t0, t1)
            up[i] = _log_sum(t1[0], t1[1] + below[i]) - _log_sum(t0[0], t0[1] + below[i])
            below[page.parent[i]] += up[i]
        root = self.anywhere[1]
        odds = [below[0] + root[1] - root[0]] + [0.0] * (n - 1)
        for i in range(1, n):
            t0, t1 = pair[i]
            rest = odds[page.parent[i]] - up[i]  # the parent's odds without this child's message
            odds[i] = below[i] + _log_sum(t0[1], t1[1] + rest) - _log_sum(t0[0], t1[0] + rest)
        return [1 / (1 + math.exp(-x)) if x > -700 else 0.0 for x in odds]

    def extract(self, html: str | None) -> str:
        """The main text of a page: its blocks in page order, joined by two line feeds; null has none."""
        if not html:
            return ""
        page = parse(html)
        keep = self.marginals(page)
        return "\n\n".join(run for node, run in page.runs if keep[node] >= KEEP)


def _log_sum(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def fit(labelled: DataFrame, html_col: str = "html") -> TreeModel:
    """The model of labelled pages, whose elements carry data-content="1" or "0" (elements below inherit it).

    Spark counts features and parent-child labels; what reaches the driver is one row for each distinct feature.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[str, str, int, int]] = []
            for value in batch.column(0):
                page = parse(value.as_py() or "", labelled=True)
                y = labels(page)
                for i, row in enumerate(features(page)):
                    rows += [("shown", f, 0, y[i]) for f in row]
                    rows.append(("tied", page.tag[i], y[page.parent[i]] if i else 1, y[i]))
            yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["kind", "name", "parent", "label"]).astype({"parent": "int64", "label": "int64"}), preserve_index=False)

    counted = labelled.select(html_col).mapInArrow(count, "kind string, name string, parent long, label long")
    found = {(r.kind, r.name, r.parent, r.label): r["count"] for r in counted.groupBy("kind", "name", "parent", "label").count().collect()}
    of = lambda kind, parent, label: sum(v for (k, _, p, y), v in found.items() if (k, p, y) == (kind, parent, label))
    nodes: dict[tuple[str, int], float] = {}  # by tag ("" for all) and label
    for (kind, tag, _, y), v in found.items():
        if kind == "tied":
            nodes[tag, y] = nodes.get((tag, y), 0) + v
            nodes["", y] = nodes.get(("", y), 0) + v
    shown = {}
    for name in {n for k, n, _, _ in found if k == "shown"}:
        words = name.split()
        if words[0] == "cue" and sum(found.get(("shown", name, 0, y), 0) for y in (0, 1)) < SEEN:
            continue
        tag = words[1] if words[0] in TAGGED else ""  # given its tag, since the pair potential has what the tag itself says
        zero, one = ((found.get(("shown", name, 0, y), 0) + SMOOTHING) / (nodes.get((tag, y), 0) + 4 * SMOOTHING) for y in (0, 1))
        shown[name] = math.log(one) - math.log(zero)
    both = lambda a, b: (math.log((a + SMOOTHING) / (a + b + 2 * SMOOTHING)), math.log((b + SMOOTHING) / (a + b + 2 * SMOOTHING)))
    tied = {(tag, p): both(found.get(("tied", tag, p, 0), 0), found.get(("tied", tag, p, 1), 0)) for tag in {n for k, n, _, _ in found if k == "tied"} for p in (0, 1)}
    return TreeModel(shown, tied, {p: both(of("tied", p, 0), of("tied", p, 1)) for p in (0, 1)})


#: Fixed values: (tags, class or id words, kind of inside) of page parts that are no main text.
PARTS = (
    ("nav", "", "links"), ("nav", "main-nav", "links"), ("div", "navbar", "links"), ("div", "nav menu", "links"), ("ul", "menu", "links"), ("div", "topnav", "links"),
    ("header", "", "head"), ("header", "site-header", "head"), ("div", "header", "head"), ("div", "masthead", "head"), ("div", "top bar", "head"),
    ("footer", "", "foot"), ("footer", "site-footer", "foot"), ("div", "footer", "foot"), ("div", "bottom copyright", "foot"),
    ("aside", "", "side"), ("aside", "sidebar", "side"), ("div", "sidebar", "side"), ("div", "right column widget", "side"), ("section", "widget", "side"),
    ("div", "ad", "ad"), ("div", "ads", "ad"), ("div", "advert", "ad"), ("div", "advertisement", "ad"), ("div", "sponsored", "ad"), ("aside", "promo", "ad"), ("div", "banner ad", "ad"), ("section", "ad slot", "ad"), ("p", "ad", "ad"),
    ("div", "cookie-banner", "notice"), ("div", "cookie consent", "notice"), ("div", "notice", "notice"), ("div", "popup modal", "notice"), ("div", "gdpr notice", "notice"), ("p", "notice", "notice"), ("div", "alert", "notice"), ("dialog", "", "notice"),
    ("form", "", "form"), ("form", "newsletter", "form"), ("form", "search", "form"), ("div", "subscribe signup", "form"), ("div", "login", "form"), ("fieldset", "", "form"),
    ("div", "share social", "links"), ("ul", "share-buttons", "links"), ("div", "related", "teasers"), ("section", "related recommended", "teasers"), ("div", "more stories", "teasers"),
    ("section", "comments", "comments"), ("div", "comments", "comments"), ("div", "comment-list", "comments"), ("ol", "commentlist", "comments"), ("section", "respond replies", "comments"), ("section", "discussion", "comments"),
    ("div", "breadcrumb", "links"), ("nav", "pagination", "links"), ("div", "pager", "links"), ("div", "tags", "links"),
)
#: Fixed values: (tag, class or id words) around main text.
MAINS = (("article", ""), ("article", ""), ("article", "post"), ("article", "entry hentry"), ("main", ""), ("main", "content"), ("div", "content"), ("div", "article-body"), ("div", "post entry"), ("div", "main content"), ("div", "story text"), ("section", "post"), ("section", ""), ("div", ""), ("td", ""))


def labelled_page(seed: int) -> str:
    """A page made by a random layout; its parts carry their label."""
    r = random.Random(seed)
    mark = lambda y: f' {LABEL}="{y}"'
    word = lambda: "".join(r.choice("bcdfglmnprstv") + r.choice("aeiou") for _ in range(r.randint(1, 4)))
    phrase = lambda a, b: " ".join(word() for _ in range(r.randint(a, b))).capitalize()
    stops = r.choice(("....!?", "....!?", "....!?", ("", ",", ".", " |", "!!", " $", "&amp;", ")")))
    most = r.choice((2, 4, 18, 18, 18, 18))  # words of a sentence on this page
    sentence = lambda: phrase(1, most) + (", " + phrase(2, 8).lower() if most > 4 and r.random() < 0.5 else "") + r.choice(stops)
    prose = lambda a, b: " ".join(sentence() for _ in range(r.randint(a, b)))
    longest = r.choice((1, 2, 4, 12, 12))  # sentences of a paragraph on this page
    link = lambda a=1, b=3: f'<a href="/{word()}">{phrase(a, b)}</a>'
    named = lambda words: "" if not words else f' {r.choice(("class", "class", "id"))}="{words}"'

    def inside(kind: str, tag: str) -> str:
        if kind == "links":
            links = [link() for _ in range(r.randint(1, 9))]
            return "".join(f"<li>{x}</li>" for x in links) if tag == "ul" else r.choice((" | ".join(links), "<ul>" + "".join(f"<li>{x}</li>" for x in links) + "</ul>"))
        if kind == "head":
            return r.choice(("", f"<h1>{phrase(1, 3)}</h1>", f"<p>{phrase(2, 6)}</p>", phrase(1, 3))) + r.choice(("", inside("links", "div")))
        if kind == "foot":
            return r.choice((f"&copy; {word()} {r.randint(1999, 2030)}", f"<p>&copy; {phrase(2, 5)}. {sentence()}</p>", f"{word()} &middot; {prose(1, 3)}")) + r.choice(("", inside("links", "div")))
        if kind == "side":
            return "".join(r.choice((f"<h3>{phrase(1, 3)}</h3>", inside("links", "div"), f"<p>{prose(1, 2)}</p>", f"<div class='widget'>{prose(1, 2)}</div>")) for _ in range(r.randint(1, 4)))
        if kind == "ad":
            return r.choice((prose(1, 3), sentence(), phrase(1, 4), link(2, 6), f"<p>{prose(1, 2)}</p>", f"<p>{link(2, 5)}</p>")) if tag != "p" else prose(1, 2)
        if kind == "notice":
            return prose(1, 3) if tag == "p" else r.choice((prose(1, 3), f"<p>{prose(1, 3)}</p>")) + r.choice(("", f"<button>{phrase(1, 2)}</button>", link()))
        if kind == "form":
            return r.choice(("", f"<p>{sentence()}</p>", f"<label>{phrase(1, 3)}</label>")) + "<input name=q>" + r.choice(("", f"<button>{phrase(1, 2)}</button>"))
        if kind == "teasers":
            return f"<h3>{phrase(1, 3)}</h3>" + "".join(r.choice((f"<li>{link(3, 9)}</li>", f"<p>{link(3, 9)}</p>", f"<div><h4>{link(3, 7)}</h4><p>{sentence()}</p></div>")) for _ in range(r.randint(1, 5)))
        item = lambda: r.choice((f'<div class="comment"><p>{prose(1, 6)}</p></div>', f'<article class="comment"><header>{phrase(1, 2)}</header><p>{prose(1, 6)}</p></article>', f'<li class="comment">{prose(1, 4)}</li>', f"<p>{prose(1, 4)}</p>", f"<div>{word()}: {prose(1, 3)}</div>"))
        return r.choice(("", f"<h2>{phrase(1, 2)}</h2>")) + "".join(item() for _ in range(r.randint(1, 7)))

    def part() -> str:
        tag, words, kind = r.choice(PARTS)
        return f"<{tag}{named(words)}{mark(0)}>{inside(kind, tag)}</{tag}>"

    def block() -> str:
        x = r.random()
        if x < 0.62:
            body = r.choice(("", "", f"<b>{phrase(1, 3)}</b> ")) + r.choice((prose(1, longest), prose(1, longest), prose(1, longest), phrase(1, 3))) + r.choice(("", "", f" {link()} {sentence()}"))
            return f"<p{mark(1)}>{body}" + r.choice(("</p>", "</p>", "", "<br>"))
        if x < 0.7:
            return f"<h{(k := r.randint(2, 4))}{mark(1)}>{phrase(1, 8)}</h{k}>"
        if x < 0.76:
            return f"<ul{mark(1)}>" + "".join(f"<li>{r.choice((sentence(), phrase(1, 5), prose(1, 3)))}</li>" for _ in range(r.randint(1, 6))) + "</ul>"
        if x < 0.81:
            return f"<blockquote{mark(1)}><p>{prose(1, 3)}</p></blockquote>"
        if x < 0.84:
            return f"<pre{mark(1)}>{phrase(3, 20)}</pre>"
        if x < 0.88:
            return f"<table{mark(1)}>" + "".join("<tr>" + "".join(f"<td>{phrase(1, 4)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 4))) + "</table>"
        if x < 0.94:
            return f"<div{mark(1)}>{r.choice((prose(1, longest), f'<p>{prose(1, longest)}</p><p>{prose(1, longest)}</p>'))}</div>"
        return f"<figure{mark(1)}><img src=x><figcaption>{sentence()}</figcaption></figure>"

    tag, words = r.choice(MAINS)
    title = r.choice((f"<h1{mark(1)}>{phrase(1, 10)}</h1>", f"<h1{mark(1)}>{phrase(1, 10)}</h1>", f"<header{mark(1)}><h1>{phrase(1, 9)}</h1></header>" if tag == "article" else "", ""))
    blocks = [block() + (part() if r.random() < 0.06 else "") for _ in range(r.randint(1, r.choice((3, 16, 16, 50))))]
    for _ in range(r.choice((0, 0, 1, 2))):  # blocks in groups, and groups in groups
        tag_of, words_of, most_of = r.choice(("section", "section", "div")), r.choice(("", "", "", "chapter", "text block", "paragraph", word())), r.choice((1, 1, 3, 8))
        grouped, at = [], 0
        while at < len(blocks):
            n = r.randint(1, most_of)
            inner = "".join(blocks[at : at + n])
            grouped.append(f"<{tag_of}{named(words_of)}{mark(1)}>{inner}</{tag_of}>")
            at += n
        blocks = grouped
    body = title + "".join(blocks)
    main = f"<{tag}{named(words)}{mark(1)}>{body}</{tag}>"
    main = f"<table><tr>{main}</tr></table>" if tag == "td" else main
    main = r.choice((main, main, main, f"<div{named(r.choice(('wrapper', 'container', 'page', '')))}>{main}</div>", f"<main>{main}</main>"))
    before, after = ("".join(part() for _ in range(r.randint(0, 4))) for _ in range(2))
    return f"<html><head><title>{phrase(1, 5)}</title></head><body>{before}{main}{after}" + r.choice(("", "</body></html>"))


def labelled_pages(spark: SparkSession, n: int = LABELLED_PAGES, seed: int = LABELLED_SEED) -> DataFrame:
    """html: n labelled pages, made in the tasks."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"html": [labelled_page(seed * 1_000_003 + i) for i in batch["id"]]})

    return spark.range(0, n, 1, 4).mapInPandas(make, "html string")


def extract(pages: DataFrame, model: TreeModel, html_col: str = "html") -> DataFrame:
    """pages with text and n_chars (code points), columns of these names replaced; every row stays, an empty table has none.

    Null and empty pages have an empty text; a page is read whole, however long or deep; repeated rows are read alike.
    """

    @F.arrow_udf("string")
    def main_text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([model.extract(x.as_py()) for x in batch], pa.string())

    return pages.withColumn("text", main_text(F.col(html_col))).withColumn("n_chars", F.length("text").cast("long"))


def extract_pages(pages: DataFrame, model: TreeModel | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    model = model or fit(labelled_pages(pages.sparkSession))
    return extract(pages.select("page_id", "url", "html"), model).select("page_id", "url", "text", "n_chars")
