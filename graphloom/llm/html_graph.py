"""Main text of web pages by sum-product message passing over the DOM tree.

A page becomes a tree of block elements with its text runs as leaves; inline markup only tells how much of a
run is links. Every node is boilerplate, content or, for elements, mixed. A node's own evidence (tag, words
of its class, id and role, link share, length, punctuation) and a potential for each parent-child pair give
a tree-structured model. One upward and one downward sweep of messages yield exact marginals, and the runs
whose content marginal exceeds one half, in page order, are the text.

Evidence and potentials are trained by counting over labelled pages. ``labelled_pages`` writes those from a
grammar of page layouts, each element with its label, since the tables carry no labelled pages; ``train``
takes any pages marked the same way.

Defined results: null or empty html gives an empty text; whatever is left open or cut off at the end of a
page is closed there; pages that repeat an id are extracted one by one; other columns are ignored. Scripts,
styles, titles and what lies between both tags of the elements in ``DROPPED`` are no text; one that is not
closed, or only after its parent, is a block like others. A head ends at its end tag or at the first thing that
cannot stand in one. ``xmp`` is text as it stands. Plain ``div`` elements round a single element are no nodes, so
depth alone tells nothing. No text run is shortened or dropped but for its label; a ``header`` is boilerplate, with a title in it too.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

JUNK, CONTENT, MIXED = 0, 1, 2
LOOSE = 3  # in labelled pages: mixed, and the runs of the element itself are content

# How HTML elements behave.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span strike strong "
                   "sub sup time tt u var wbr br object math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom "
                   "menclose mfenced msub msup msubsup munder mover munderover mmultiscripts mprescripts none mtable mtr mtd semantics annotation "
                   "annotation-xml".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp".split())  # xmp shows what it holds, the others do not
DROPPED = frozenset("noscript template select button iframe svg canvas audio video datalist".split())
IN_HEAD = frozenset("html head base basefont bgsound link meta noscript template".split())
ALONE = frozenset("button select".split())  # one that opens ends one that is open
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "tbody": ("thead", "tbody", "tr", "td", "th"), "option": ("option",), "button": ("button",), "select": ("select", "option"),
}
SCOPES = frozenset("ul ol dl table html body".split())

# Words in class, id and role that designers give to the parts of a page.
JUNK_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu menubar header masthead "
    "topbar footer bottombar colophon sidebar aside rail widget widgets complementary contentinfo comment comments commentlist respond reply replies disqus "
    "discussion cookie cookies consent gdpr notice notices alert alerts warning popup modal overlay dialog share sharing social related recommended "
    "recommendations breadcrumb breadcrumbs pagination pager login signup signin register subscribe subscription newsletter form search copyright legal "
    "disclaimer toolbar byline tags tagcloud meta skip hidden toc trending popular".split())
CONTENT_WORDS = frozenset("article main content maincontent post entry story body text page-content articlebody prose single hentry".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style|data-y)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass
class Node:
    parent: int
    tag: str
    hint: int = 0  # -1 junk, 1 content, 2 both
    label: int | None = None
    text: str = ""
    links: int = 0  # characters of the run that are links
    total: int = 0
    total_links: int = 0
    alone: bool = False  # the only child: its links are its parent's
    share: int = 0  # of the page's text, in steps
    children: list[int] = field(default_factory=list)


def _attributes(raw: str) -> tuple[int, int | None]:
    label, hidden, junk, content = None, False, False, False
    for name, a, b, c in ATTRIBUTE.findall(raw):
        name, value = name.lower(), a or b or c
        if name == "data-y":
            label = int(value)
        elif name == "hidden" or name == "style" and "display:none" in value.replace(" ", ""):
            hidden = True
        elif name != "style":
            for part in value.split():
                words = [w.lower() for w in WORD.findall(part)]
                bad, good = not JUNK_WORDS.isdisjoint(words), not CONTENT_WORDS.isdisjoint(words)
                junk |= bad
                content |= good and not (bad and words[-1] in JUNK_WORDS)  # post-meta is meta, comment-body both
    return -1 if hidden or junk and not content else 2 if junk else int(content), label


def _tokens(page: str) -> list[tuple]:
    """(start, end, closing, tag, attributes) of all markup; raw elements are one token without a tag.

    Only ``xmp`` is three: its tags, and ``#xmp`` with what they hold as attributes.
    """
    out, at = [], 0
    while found := TOKEN.search(page, at):
        at = found.end()
        closing, tag, raw = found.group(1), (found.group(2) or "").lower(), found.group(3) or ""
        if tag in RAW:
            if not closing:  # nothing inside is markup
                end = re.compile(rf"</{re.escape(tag)}[^>]*(?:>|\Z)", re.I).search(page, at)
                inside, until = at, end.start() if end else len(page)
                at = end.end() if end else len(page)
                if tag == "xmp":
                    out += [(found.start(), inside, "", tag, raw), (inside, until, "", "#xmp", page[inside:until]), (until, at, "/", tag, "")]
                    continue
            tag = ""
        out.append((found.start(), at, closing, tag, raw))
    return out


def _dropped_ends(tokens: list[tuple]) -> dict[int, int]:
    """The end tags of the dropped elements that are closed before their parents, by the place of the start tag."""
    out, stack, opened = {}, [], {}

    def pop(tag: str) -> int:
        while True:
            i, last = stack.pop()
            opened[last] -= 1
            if last == tag:
                return i

    for i, (_, _, closing, tag, raw) in enumerate(tokens):
        if not tag or tag in INLINE or tag in VOID or tag == "#xmp":
            continue
        if (closing or tag in ALONE) and opened.get(tag):
            start = pop(tag)
            if closing and tag in DROPPED:
                out[start] = i
        if not closing and not (tag in DROPPED and raw.rstrip().endswith("/")):
            stack.append((i, tag))
            opened[tag] = opened.get(tag, 0) + 1
    return out


def _without_wrappers(nodes: list[Node]) -> list[Node]:
    """The tree without plain ``div`` elements that hold one element and nothing else, however many lie in each other."""
    held = [0] * len(nodes)
    only = [0] * len(nodes)
    for i, n in enumerate(nodes[1:], 1):
        held[n.parent] += 1
        only[n.parent] = i
    place, out = [0] * len(nodes), []
    for i, n in enumerate(nodes):
        if n.parent >= 0:
            n.parent = place[n.parent]
        if n.tag == "div" and not n.hint and held[i] == 1 and nodes[only[i]].tag != "#text":
            inner = nodes[only[i]]
            inner.label = n.label if inner.label is None else inner.label
            place[i] = n.parent
        else:
            place[i] = len(out)
            out.append(n)
    return out


def parse(page: str) -> list[Node]:
    """The page's tree in page order; node 0 is the root, text runs are leaves with tag ``#text``."""
    nodes = [Node(-1, "#root")]
    stack = [0]
    opened: dict[str, int] = {}  # how many elements of each tag are open
    pieces: list[str] = []
    links = anchors = 0
    head = False

    def flush() -> None:
        nonlocal links
        text = " ".join(entities.unescape("".join(pieces)).split())
        if text:
            nodes.append(Node(stack[-1], "#text", 0, None, text, min(links, len(text))))
        pieces.clear()
        links = 0

    def close(tag: str) -> None:
        if opened.get(tag):
            flush()
            while True:
                last = nodes[stack.pop()].tag
                opened[last] -= 1
                if last == tag:
                    return

    tokens = _tokens(page)
    ends = _dropped_ends(tokens)
    at = place = 0
    while at < len(page):
        start, end, closing, tag, raw = tokens[place] if place < len(tokens) else (len(page), len(page), "", "", "")
        if start > at:
            head = head and page[at:start].isspace()
            if not head:
                pieces.append(page[at:start])
                if anchors:
                    links += len(page[at:start].strip())
        at = end
        place += 1
        if not tag:
            continue
        if tag == "#xmp":
            pieces.append(entities.escape(raw))  # no markup and no references in it
            continue
        if tag == "head" or head:
            if tag == "head":
                head = not closing and not raw.rstrip().endswith("/")
                pieces.append(" ")
                continue
            if closing and tag not in ("body", "html", "br") or not closing and tag in IN_HEAD:
                if place - 1 in ends:
                    place = ends[place - 1] + 1
                    at = tokens[place - 1][1]
                continue
            head = False
        if tag in DROPPED:
            if not closing and place - 1 in ends:
                place = ends[place - 1] + 1
                at = tokens[place - 1][1]
                pieces.append(" ")
                continue
            if closing and not opened.get(tag) or not closing and raw.rstrip().endswith("/"):
                pieces.append(" ")
                continue
        if tag in INLINE:
            if tag == "br":
                pieces.append(" ")
            elif tag == "a":
                anchors = 0 if closing else 1
            continue
        anchors = 0
        if closing:
            flush()
            close(tag)
            continue
        flush()
        ended = [t for t in CLOSES.get(tag, ()) if opened.get(t)]
        for s in reversed(stack[1:]):  # end tags that may be left out
            if nodes[s].tag == "p" or nodes[s].tag in ended:
                close(nodes[s].tag)
                if nodes[s].tag == "p":
                    continue
            elif nodes[s].tag in SCOPES or not ended:
                break
        if tag in VOID:
            continue
        nodes.append(Node(stack[-1], tag, *_attributes(raw)))
        stack.append(len(nodes) - 1)
        opened[tag] = opened.get(tag, 0) + 1
    flush()
    nodes = _without_wrappers(nodes)
    for i in range(len(nodes) - 1, 0, -1):
        n = nodes[i]
        if n.text:
            n.total, n.total_links = len(n.text), n.links
        up = nodes[n.parent]
        up.total += n.total
        up.total_links += n.total_links
    for i, n in enumerate(nodes[1:], 1):
        nodes[n.parent].children.append(i)
        n.share = sum(20 * n.total >= k * nodes[0].total for k in (1, 5, 12))
    for n in nodes:
        if len(n.children) == 1:
            nodes[n.children[0]].alone = True
    return nodes


def features(n: Node) -> list[tuple]:
    """What a node shows of itself."""
    share = n.total_links / n.total if n.total else -1.0
    linked = -1 if share < 0 else 0 if share < 0.05 else 1 if share < 0.35 else 2 if share < 0.8 else 3
    if n.tag == "#text":
        size = min(5, int(math.log2(len(n.text) + 1) // 1.5))
        return [("size", size), *[("run links", linked)] * (not n.alone), ("sentence", n.text[-1] in ".!?:…\"”»" or ". " in n.text)]
    return [("tag", n.tag), ("hint", n.hint), ("links", n.tag == "p", linked), ("share", n.tag == "form", n.share)]


class Model:
    """Evidence per node feature and a potential per parent-child pair of labels, counted over labelled trees."""

    def __init__(self, trees: Iterable[list[Node]]):
        seen: dict[tuple, list[float]] = {}
        totals: dict[str, list[float]] = {}
        pair = {False: [[0.2] * 3 for _ in range(3)], True: [[0.2] * 3 for _ in range(3)]}
        for nodes in trees:
            for n in nodes:
                leaf = n.tag == "#text"
                for f in features(n):
                    seen.setdefault(f, [0.3] * 3)[n.label] += 1
                    totals.setdefault(f[0], [1.0] * 3)[n.label] += 1
                if n.parent >= 0:
                    pair[leaf][nodes[n.parent].label][n.label] += 1
        self.likelihood = {f: [c / t for c, t in zip(counts, totals[f[0]])] for f, counts in seen.items()}
        for leaf, table in pair.items():
            for row in table:
                if leaf:
                    row[MIXED] = 0.0
                total = sum(row)
                row[:] = [x / total for x in row]
        self.pair = pair

    def evidence(self, n: Node) -> list[float]:
        out = [1.0, 1.0, 0.0 if n.tag == "#text" else 1.0]
        for f in features(n):
            like = self.likelihood.get(f)
            if like:
                out = [a * b for a, b in zip(out, like)]
        return _scaled(out)

    def marginals(self, nodes: list[Node]) -> list[list[float]]:
        """Exact marginals of all nodes: children's messages go up, then parents' messages come down."""
        own = [self.evidence(n) for n in nodes]
        own[0] = [0.0, 0.0, 1.0]  # the page as a whole is mixed
        below = [list(x) for x in own]  # own evidence and all that lies below
        up: list[list[float]] = [[]] * len(nodes)
        for i in range(len(nodes) - 1, 0, -1):
            n, b = nodes[i], below[i]
            table = self.pair[n.tag == "#text"]
            up[i] = _scaled([row[0] * b[0] + row[1] * b[1] + row[2] * b[2] for row in table])
            p = below[n.parent]
            below[n.parent] = _scaled([p[0] * up[i][0], p[1] * up[i][1], p[2] * up[i][2]])
        full = below[:1] + [[]] * (len(nodes) - 1)
        for i, n in enumerate(nodes[1:], 1):
            f, u, b = full[n.parent], up[i], below[i]
            rest = [f[k] / u[k] if u[k] > 0 else 0.0 for k in range(3)]  # the parent without this child
            table = self.pair[n.tag == "#text"]
            down = [rest[0] * table[0][k] + rest[1] * table[1][k] + rest[2] * table[2][k] for k in range(3)]
            full[i] = _scaled([down[k] * b[k] for k in range(3)])
        return full

    def text(self, page: str | None) -> str:
        if not page:
            return ""
        nodes = parse(page)
        marginals = self.marginals(nodes)
        return "\n".join(n.text for n, m in zip(nodes, marginals) if n.text and m[CONTENT] > 0.5)


def _scaled(x: list[float]) -> list[float]:
    total = x[0] + x[1] + x[2]
    return [a / total for a in x] if total > 0 else [1.0, 1.0, 1.0]


def labelled_tree(page: str) -> list[Node]:
    """Tree of a page whose elements carry ``data-y``; nodes without it take their parent's label.

    Text runs that lie in a mixed element itself are boilerplate, content in one that is marked ``LOOSE``.
    """
    nodes = parse(page)
    nodes[0].label = MIXED
    for n in nodes[1:]:
        if n.label is None:
            n.label = nodes[n.parent].label
        if n.tag == "#text" and n.label in (MIXED, LOOSE):
            n.label = JUNK if n.label == MIXED else CONTENT
    for n in nodes:
        n.label = MIXED if n.label == LOOSE else n.label
    return nodes


def train(pages: Iterable[str]) -> Model:
    return Model(labelled_tree(p) for p in pages)


def labelled_pages(count: int = 600, seed: int = 9) -> Iterator[str]:
    """Pages from a grammar of layouts, every element labelled."""
    rng = random.Random(seed)
    syllables = "an the re on ti en la de or ma ve sen tu ki pro ist ul gra".split()

    def words(low: int, high: int) -> str:
        return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.randint(low, high)))

    def sentences(low: int = 1, high: int = 6) -> str:
        return " ".join(words(1, 18).capitalize() + rng.choice(".....!?") for _ in range(rng.randint(low, high)))

    def link() -> str:
        return f'<a href="/{rng.randint(1, 999)}">{words(1, 4)}</a>'

    def tag(name: str, y: int, inside: str, *classes: str) -> str:
        plain = ("", "", f' class="c{rng.randint(1, 99)}"', ' class="row"', ' id="x"')
        named = [f' {k}="{c}"' for c in classes for k in ("class", "id")]
        return f'<{name} data-y="{y}"{rng.choice(named) if named else rng.choice(plain)}>{inside}</{name}>'

    def either(*options):
        return rng.choice(options)()

    def links(y: int = JUNK) -> str:
        return either(lambda: tag("ul", y, "".join(tag("li", y, link()) for _ in range(rng.randint(2, 9)))),
                      lambda: tag("div", y, " | ".join(link() for _ in range(rng.randint(2, 6)))))

    def paragraph() -> str:
        body = sentences()
        if rng.random() < 0.2:
            body = f"{words(1, 5)} <a href='/x'>{words(1, 3)}</a> {body}"
        if rng.random() < 0.08:
            return tag("p", CONTENT, link())
        return tag("p", CONTENT, body if rng.random() < 0.8 else words(1, 12))

    def block() -> str:
        return rng.choices([
            paragraph, lambda: tag(rng.choice(["h2", "h3", "h4"]), CONTENT, words(1, 8)),
            lambda: tag(rng.choice(["ul", "ol"]), CONTENT, "".join(tag("li", CONTENT, rng.choice([words(1, 8), words(1, 8), sentences(1, 2)])) for _ in range(rng.randint(1, 6)))),
            lambda: tag("blockquote", CONTENT, paragraph()), lambda: tag("pre", CONTENT, words(3, 20)), lambda: tag("div", CONTENT, sentences()),
            lambda: tag("table", CONTENT, "".join(tag("tr", CONTENT, "".join(tag("td", CONTENT, words(1, 4)) for _ in range(3))) for _ in range(rng.randint(1, 4)))),
            lambda: tag("figure", CONTENT, tag("figcaption", CONTENT, words(2, 9))), lambda: tag("section", CONTENT, paragraph() + paragraph()),
            lambda: tag("dl", CONTENT, tag("dt", CONTENT, words(1, 3)) + tag("dd", CONTENT, sentences(1, 2))),
        ], [12, 2, 3, 1, 0.5, 1, 0.5, 0.3, 0.5, 0.3])[0]()

    def advert() -> str:
        inside = rng.choice([sentences(1, 3), link(), tag("p", JUNK, sentences(1, 2)), tag("p", JUNK, link()), words(1, 8)])
        return tag(rng.choice(["div", "div", "section", "aside", "p"]), JUNK, inside, rng.choice(["ad", "ads", "advert", "sponsored", "promo", "banner", "ad-slot"]))

    def aside() -> str:
        inside = "".join(rng.choice([links, lambda: tag("h3", JUNK, words(1, 4)), lambda: tag("p", JUNK, sentences(1, 3))])() for _ in range(rng.randint(1, 4)))
        return either(lambda: tag("aside", JUNK, inside), lambda: tag("div", JUNK, inside, "sidebar", "widget", "related", "rail"))

    def notice() -> str:
        inside = rng.choice([sentences(1, 3), tag("p", JUNK, sentences(1, 3)) + link()])
        return tag(rng.choice(["div", "section", "p"]), JUNK, inside, "cookie-banner", "notice", "alert", "consent", "popup", "newsletter")

    def form() -> str:
        return tag("form", JUNK, rng.choice([words(1, 5) + "<input>", tag("p", JUNK, sentences(1, 2)) + "<label>" + words(1, 3) + "</label><input>",
                                             tag("fieldset", JUNK, tag("legend", JUNK, words(1, 3)) + tag("div", JUNK, words(1, 4)))]))

    def comments() -> str:
        def one() -> str:
            inside = tag("p", JUNK, sentences(1, 6)) * rng.randint(1, 2)
            return rng.choice([tag("li", JUNK, inside), tag("div", JUNK, tag("h4", JUNK, words(1, 2)) + inside, "comment"), tag("article", JUNK, inside, "comment"), inside])
        return tag(rng.choice(["section", "div", "ol"]), JUNK, "".join(one() for _ in range(rng.randint(1, 6))), "comments", "comment-list", "respond", "discussion", "post comments")

    def top() -> str:
        inside = rng.choice(["", tag("h1", JUNK, words(1, 3))]) + rng.choice(["", tag("p", JUNK, words(1, 8)), tag("div", JUNK, sentences(1, 1))]) + rng.choice(["", links()])
        return either(lambda: tag("header", JUNK, inside), lambda: tag("div", JUNK, inside, "header", "masthead", "topbar"))

    def nav() -> str:
        return either(lambda: tag("nav", JUNK, rng.choice([links(), links() + words(1, 3)])), lambda: tag("div", JUNK, links(), "menu", "navbar", "breadcrumbs"), links)

    def foot() -> str:
        inside = rng.choice([f"© {words(1, 4)}", tag("p", JUNK, sentences(1, 2)), links() + words(1, 9), sentences(1, 2)])
        return either(lambda: tag("footer", JUNK, inside), lambda: tag("div", JUNK, inside, "footer", "copyright", "legal"))

    def article() -> str:
        parts = [rng.choice(["", tag("h1", CONTENT, words(1, 12))])] + [block() for _ in range(rng.randint(1, 14))]
        for extra, chance in ((advert, 0.2), (aside, 0.1), (form, 0.06), (notice, 0.06), (comments, 0.06), (lambda: tag("div", JUNK, links(), "share", "social", "tags"), 0.1),
                              (lambda: tag("header", JUNK, words(1, 9)), 0.03), (lambda: tag("footer", JUNK, words(1, 9)), 0.05), (lambda: tag("nav", JUNK, links()), 0.04)):
            if rng.random() < chance:
                parts.insert(rng.randint(0, len(parts)), extra())
        inside = "".join(parts)
        return either(lambda: tag("article", CONTENT, inside), lambda: tag("article", CONTENT, tag("div", CONTENT, inside, "entry-content", "post-body")),
                      lambda: tag("main", CONTENT, inside), lambda: tag("div", CONTENT, inside, "content", "post", "main", "story", "articleBody"),
                      lambda: tag(rng.choice(["article", "div"]), CONTENT, inside, "post type-post meta", "content has-sidebar", "entry tag-notice hentry", "story with-ads"),
                      lambda: tag("main", MIXED, tag("article", CONTENT, inside)), lambda: tag("div", CONTENT, inside), lambda: tag("section", CONTENT, inside), lambda: inside)

    def loose() -> str:
        return rng.choice([" ", "<br><br>", "<p>"]).join(sentences(2, 6) for _ in range(rng.randint(1, 4)))

    for _ in range(count):
        front = "".join(x() for x, chance in ((notice, 0.2), (top, 0.6), (nav, 0.8), (advert, 0.5), (form, 0.2)) if rng.random() < chance)
        back = "".join(x() for x, chance in ((comments, 0.3), (advert, 0.2), (aside, 0.3), (form, 0.15), (notice, 0.1), (foot, 0.8)) if rng.random() < chance)
        left = aside() if rng.random() < 0.2 else ""
        style = rng.random()
        if style < 0.06:  # text without a block, with or without anything round it
            inside = rng.choice([loose(), front + loose() + tag("div", JUNK, links(), "footer", "menu")]).replace("<p>", '<p data-y="1">')
            yield f'<html data-y="{MIXED}"><head><title>{words(1, 6)}</title></head><body data-y="{LOOSE}">{inside}</body></html>'
            continue
        middle = left + article()
        middle = either(lambda: middle, lambda: tag("div", MIXED, middle), lambda: tag("div", MIXED, tag("div", MIXED, middle)))
        odd = words(1, 4) if rng.random() < 0.1 else ""
        whole = front + odd + middle + back
        if style < 0.12:  # a form round the whole page
            whole = tag("form", MIXED, whole)
        yield f'<html data-y="{MIXED}"><head><title>{words(1, 6)}</title></head><body data-y="{MIXED}">{whole}</body></html>'


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of every page. Nothing is shuffled."""
    model = train(labelled_pages())
    fields = [(key, pages.schema[key].dataType.simpleString()), (url, pages.schema[url].dataType.simpleString())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                get = {n: batch.column(batch.schema.get_field_index(n)) for n in (key, url, html)}
                texts = [model.text(x) for x in get[html].to_pylist()]
                yield pa.RecordBatch.from_arrays([get[key], get[url], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                                 names=[key, url, "text", "n_chars"])

    return pages.select(key, url, html).mapInArrow(run, ", ".join(f"{n} {t}" for n, t in fields) + ", text string, n_chars long")
